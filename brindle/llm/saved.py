"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition of a saved table of narrow rows: small tables don't keep the many partitions of the step that made them.
ROWS = 20_000
#: Rows of a table that is broadcast, at most; more are joined by a shuffle.
FEW = 100_000


def shared(spark: SparkSession) -> str:
    """The folder of this session below spark.checkpoint.dir. Where the session names none, only a master on one machine gets one, in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = context.getConf().get("spark.checkpoint.dir")
        if not path:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        context.setCheckpointDir(path)
    return context.getCheckpointDir()


def folder(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there."""
    shared(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``saved`` for narrow rows, in partitions that suit their number, and that number."""
    shared(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint()
    n = seen.get["n"]
    return out.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS))), n


def bounded(df: DataFrame, n: int) -> DataFrame:
    """df for a join: marked for a broadcast where its n rows are few."""
    return F.broadcast(df) if n <= FEW else df
