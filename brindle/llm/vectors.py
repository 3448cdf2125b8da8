"""Embedding columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, label) with vec_id as key: rows without one are left out, of rows that repeat one the smallest counts."""
    out = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label")).where("vec_id IS NOT NULL")
    if out.groupBy("vec_id").count().where("count > 1").isEmpty():
        return out
    return out.groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("v")).select("vec_id", "v.embedding", "v.label")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near one: exact, and squares neither over- nor underflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
