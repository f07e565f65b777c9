"""Helpers of several operators: reliable checkpoints and the components of a graph."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, as in tests, a local session uses a folder in its warehouse; on a cluster
    the setting must be there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(folder or f"{warehouse}/_checkpoints")
    return context.getCheckpointDir()


def others(frame: DataFrame, names: Iterable[str]) -> list[Column]:
    """The frame's columns but those that a result of these names replaces."""
    taken = {name.lower() for name in names}
    return [frame[f"`{c}`"] for c in frame.columns if c.lower() not in taken]


class Memo(dict):
    """Remembers what `make` gave for short keys; starts anew when it holds `most` of them."""

    def __init__(self, make: Callable[[Any], Any], most: int = 200_000, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def settled(frame: DataFrame) -> DataFrame:
    """The frame's rows, written once to the shared folder, so that a lost executor loses nothing."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the undirected `links` (a, b).

    Alternating large and small stars: every node links its larger neighbours, then its smaller
    ones, to the smallest node it knows, until each component is a star around its smallest node.
    A star's hub may have any number of neighbours: minima are taken map-side, and the join that
    hands them back can be split. Links with a null end and loops are ignored.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """(u, v): v is a neighbour of u; each such v goes to the smallest node around u."""
        least = pairs.groupBy("u").agg(F.min("v").alias("least"))
        joined = pairs.join(least, "u").select(
            "u", "v", F.least("u", "least").alias("least")
        )
        return joined

    edges = settled(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            star(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        )
        large = large.where("u <> v").distinct()
        small = star(large)
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
        edges = settled(small.where("u <> v").distinct())
        before, state = (
            state,
            edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(),
        )
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
