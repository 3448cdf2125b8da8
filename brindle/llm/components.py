"""Connected components of an edge table by local contraction and pointer jumps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.saved import bounded, counted


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of edges(a, b), the smallest node that it reaches.

    A round replaces the edges of each partition by edges from its nodes to the smallest node that they
    reach there, once where the edges lie and once by their larger end. So a node comes to a partition as
    larger end once for each task at most, however many edges it has. Then every edge moves to the smallest parent of
    its smaller end. Rounds, about log(n), end when none of this changes an edge. Loops and rows with nulls
    count as no edge.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b AND a IS NOT NULL AND b IS NOT NULL")
    while True:
        dealt, n = counted(edges.mapInArrow(_contract, FOREST).select("a", "b").repartition("a").mapInArrow(_contract, FOREST))
        if not n:
            return dealt.select(F.col("a").alias("node"), F.col("b").alias("component"))
        parents = dealt.groupBy("a").agg(F.min("b").alias("up")).withColumnRenamed("a", "b")
        jumped, _ = counted(dealt.join(bounded(parents, n), "b", "left").select("a", F.coalesce("up", "b").alias("b"), (F.col("moved") | F.col("up").isNotNull()).alias("moved")))
        if jumped.where("moved").isEmpty():
            break
        edges = jumped.select("a", "b").where("a > b")
    leaves = jumped.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(jumped.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


FOREST = "a long, b long, moved boolean"
_FOREST = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("moved", pa.bool_())])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each node of a partition an edge to the smallest node that it reaches there; moved where that was not its only edge."""
    parts = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        on = x != y
        if not on.any():
            break
        np.minimum.at(root, np.maximum(x, y)[on], np.minimum(x, y)[on])
        while (root[root] != root).any():
            root = root[root]
    kept = np.zeros(len(nodes), bool)
    kept[a[root[a] == b]] = True
    kept[a[root[a] != b]] = False
    leaf = np.flatnonzero(root < np.arange(len(nodes)))
    for lo in range(0, len(leaf), 100_000):
        some = leaf[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(~kept[some])], schema=_FOREST)
