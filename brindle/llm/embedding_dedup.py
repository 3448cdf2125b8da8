"""Near-duplicate vectors by a tiled comparison in the order of principal axes (operator 2).

Vectors with the same components count once, with their number. A rotation to principal axes, fitted on
all vectors, puts most of a product into the leading dimensions. Vectors of a label are range-sorted by
the first of them and cut into blocks; two unit vectors with cosine c lie sqrt(2 - 2c) apart at most, so
only blocks whose ranges on that axis come so close are paired, found by an equality join on cells. In a
pair of blocks, products are accumulated a few dimensions at a time, the rest is bounded by the product
of the suffix norms, and a pair of vectors is dropped as soon as it cannot reach the threshold. What is
left is decided by the cosine of the original vectors. A pair of blocks returns a row per linked vector,
its links and the smallest vector of its local component, so groups of copies are never expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.blocks import packed_strings, unpacked
from brindle.llm.components import components
from brindle.llm.saved import saved
from brindle.llm.vectors import matrix, scaled, usable, vectors

THRESHOLD = 0.98
BLOCK = 512
STEPS = (8, 16, 32)
#: Axes are fitted for the most frequent lengths of vectors, so many at most, and up to this length; others keep the order of their dimensions.
FITTED, WIDEST = 8, 1024
SLACK = 1e-9

BLOCKS = "block long, label long, dim int, low double, high double, ids binary, copies binary, data binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("copies", pa.binary()), ("data", pa.binary())])


def axes(units: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension of vectors the principal axes as columns, from sums over all rows; what reaches the driver is a matrix of moments for a bounded number of bounded dimensions."""
    common = units.where(F.col("dim") <= WIDEST).groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(FITTED)
    fitted = [r.dim for r in common.collect()]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                x = scaled(matrix(batch.column("embedding").filter(pa.array(dims == d))))
                x = x / np.linalg.norm(x, axis=1)[:, None]
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * d * d, pa.int32()), "at": pa.array(np.arange(d * d)), "x": pa.array(m.ravel())})

    moments = units.where(F.col("dim").isin(fitted)).select("dim", "embedding").mapInArrow(sums, "dim int, at long, x double").groupBy("dim", "at").agg(F.sum("x").alias("x"))
    by: dict[int, list] = {}
    for r in moments.orderBy("dim", "at").collect():
        by.setdefault(r.dim, []).append(r.x)
    return {d: np.linalg.eigh(np.array(m).reshape(d, d))[1][:, ::-1].copy() for d, m in by.items()}


def _project(rotations: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, lead = batch.column("dim").to_numpy(), np.zeros(batch.num_rows)
            for d in np.unique(dims).tolist():
                on = dims == d
                x = scaled(matrix(batch.column("embedding").filter(pa.array(on))))
                lead[on] = (x @ rotations[d][:, 0] if d in rotations else x[:, 0]) / np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)], names=[*batch.schema.names, "lead"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring rows; a block has one label and one dimension."""
    number = TaskContext.get().partitionId() << 40
    held: pa.Table | None = None
    for batch in _with_end(batches):
        table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        held = None
        if table is None:
            continue
        key = np.stack([table.column("label").to_numpy(), table.column("dim").to_numpy()])
        edges = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))).tolist() + [table.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            for lo in range(a, b, BLOCK):
                hi = min(b, lo + BLOCK)
                if batch is not None and b == table.num_rows and hi == b and hi - lo < BLOCK:
                    held = table.slice(lo)
                    break
                part = table.slice(lo, hi - lo)
                lead, n = part.column("lead").to_numpy(), np.array([hi - lo])
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([int(key[0, lo])]), pa.array([int(key[1, lo])], pa.int32()), pa.array([lead.min()]), pa.array([lead.max()]), packed_strings(part.column("vec_id").to_numpy(), n), packed_strings(part.column("copies").to_numpy(), n), packed_strings(matrix(part.column("embedding")).ravel(), n * int(key[1, lo]))], schema=_BLOCKS)
                number += 1


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def linked_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray | None, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b with cosine of at least the threshold; of one block, each pair once."""
    a, b, dim = scaled(a), scaled(b), a.shape[1]
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    u, v = a / norm_a[:, None], b / norm_b[:, None]
    if rotation is not None:
        u, v = u @ rotation, v @ rotation
    left = [np.sqrt(np.maximum(0, 1 - np.cumsum(x * x, axis=1))) for x in (u, v)]  # suffix norms after each dimension
    steps = [s for s in STEPS if s < dim] + [dim]
    k = steps[0]
    score = u[:, :k] @ v[:, :k].T
    i, j = np.nonzero(score + left[0][:, k - 1, None] * left[1][None, :, k - 1] >= threshold - SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    part = score[i, j]
    for nxt in steps[1:]:
        if not len(i):
            break
        part = part + np.einsum("ij,ij->i", u[i, k:nxt], v[j, k:nxt])
        k = nxt
        rest = left[0][i, k - 1] * left[1][j, k - 1] if k < dim else 0
        keep = part + rest >= threshold - SLACK
        i, j, part = i[keep], j[keep], part[keep]
    cosine = np.einsum("ij,ij->i", a[i], b[j]) / (norm_a[i] * norm_b[j])
    return i[cosine >= threshold], j[cosine >= threshold]


def local_roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id in the component of each of n nodes."""
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root
        root = new


def _compare(rotations: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rotation = rotations.get(row["dim"])
                side = [(np.frombuffer(row[f"ids_{s}"], np.int64), np.frombuffer(row[f"copies_{s}"], np.int64), np.frombuffer(row[f"data_{s}"], np.float64).reshape(-1, row["dim"])) for s in "ab"]
                same = row["a"] == row["b"]
                i, j = linked_pairs(side[0][2], side[1][2], rotation, threshold, same)
                if not len(i):
                    continue
                ids = np.concatenate([side[0][0], side[1][0]])
                copies = np.concatenate([side[0][1], side[1][1]])
                j = j if same else j + len(side[0][0])
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                on = links > 0
                yield pa.RecordBatch.from_pydict({"vec_id": ids[on], "links": links[on], "root": local_roots(len(ids), i, j, ids)[on]})

    return run


def embedding_dedup(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links vectors of one label whose cosine, in double precision, reaches the threshold.

    Returns a row for each vector: vec_id, n_links (other vectors linked directly), component_id (smallest
    vec_id reachable) and kept (vec_id = component_id). Vectors that are null, empty, zero or hold null or
    non-finite components, and those without a label, link with nothing; vectors of different length do not
    link. Components of any finite size count: cosines are taken after an exact scaling. Rows without vec_id are left out; rows that repeat one count once. Other columns are ignored.
    """
    spark = table.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = vectors(table)
    units = every.where(F.col("label").isNotNull() & usable(F.col("embedding"))).withColumn("dim", F.size("embedding"))
    rotations = axes(units)
    same = units.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    lead = same.select("vec_id", "label", "dim", "embedding", "copies").mapInArrow(_project(rotations), "vec_id long, label long, dim int, embedding array<double>, copies long, lead double")
    order = ["label", "dim", "lead", "vec_id"]
    lead = saved(lead)
    blocks = saved(lead.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_blocks, BLOCKS))
    width = max(1e-6, float(np.sqrt(max(0.0, 2 - 2 * threshold)))) + 1e-9
    spot = blocks.select("block", "label", "dim", "low", "high")
    cells = lambda reach: F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") + F.lit(reach)) / width))).alias("cell")
    left = spot.select(F.col("block").alias("a"), "label", "dim", F.col("low").alias("low_a"), F.col("high").alias("high_a"), cells(width))
    right = spot.select(F.col("block").alias("b"), "label", "dim", F.col("low").alias("low_b"), F.col("high").alias("high_b"), cells(width))
    close = (F.col("a") <= F.col("b")) & (F.col("low_b") <= F.col("high_a") + width) & (F.col("low_a") <= F.col("high_b") + width)
    pairs = left.join(right, ["label", "dim", "cell"]).where(close).select("a", "b").distinct()
    of = lambda s: blocks.select(F.col("block").alias(s), *(["dim"] if s == "a" else []), *(F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "data")))
    found = saved(pairs.join(of("a"), "a").join(of("b"), "b").repartition(n, "a", "b").mapInArrow(_compare(rotations, threshold), "vec_id long, links long, root long"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    per = found.groupBy("vec_id").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    groups = same.select("label", "dim", "embedding", F.col("vec_id").alias("first"), "copies").join(per.withColumnRenamed("vec_id", "first"), "first", "left")
    member = units.select("vec_id", "label", "dim", "embedding").join(groups, ["label", "dim", "embedding"])
    member = member.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    out = every.select("vec_id").join(member, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
