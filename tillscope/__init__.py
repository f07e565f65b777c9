"""Retail sales analytics as composable Spark DataFrame operators."""

from tillscope.model import RetailModel

__all__ = ["RetailModel"]
