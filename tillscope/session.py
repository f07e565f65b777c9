"""Session settings the operators count on, and durable intermediate results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only; memory, cores and shuffle partitions stay with the
# cluster. Joins carry no broadcast hint: Spark broadcasts a side only when its
# file size or its measured shuffle size is under autoBroadcastJoinThreshold and
# falls back to a shuffled join otherwise. That join hashes instead of sorting
# where every partition of one side was measured below 64 MB. A hot join key is
# split by the skew rule, also where the split costs one more exchange further up.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",  # an overflow is an error, never a wrong sum
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on: checked arithmetic and adaptive joins.

    The settings hold for the whole session, later queries of the caller included.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    context.setCheckpointDir(shared or f"{warehouse}/_checkpoints")


def durable(frame: DataFrame) -> DataFrame:
    """Materialise ``frame`` on reliable storage and cut its lineage.

    Used where a later step needs the very same rows and row numbers twice, so
    that a lost executor re-reads them instead of computing other ones. The
    folder is spark.checkpoint.dir; where that is unset, one in the warehouse of a local
    session, while a cluster has to name one.
    """
    _ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)
