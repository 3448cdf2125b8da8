"""Exact top-k by inner product: the three-phase uniform threshold over column blocks (operator 13).

Vectors are turned to whole numbers and dealt in shares of rows; a column block of a share is a node: it has, for
each query, a list of local scores, the products over its own columns, counted from the smallest local score of
that query and column block, so that all are at least 0.

1. Each node gives its k highest local scores and its smallest one. Sums over the column blocks, those that are
   missing counted as 0, give a first lower bound for a query's k-th score.
2. A row that reaches the bound has bound / b at least in one of the b column blocks. This cutoff goes to
   all nodes; each gives its entries from there on. With the cutoff for those that are missing a row has a
   lower and an upper bound, and the k-th lower bound rules out most of the rest.
3. Nodes give the local scores of the others, whose sums are exact.

The nodes of a share are one task's work, so entries and candidates don't leave it: a share sends k rows for a query
in either pass. Rows are shuffled once a pass, and each query once for a share; no pair of blocks is shipped.

Products are taken in doubles where every sum is below 2**53, so they are exact. Vectors with larger components
lie in shares of their own and are compared in Python's whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.blocks import packed_strings, unpacked
from brindle.llm.saved import bounded, counted, saved
from brindle.llm.vectors import matrix

NEIGHBOURS = 5
EVERY = 50
SCALE = 256
#: Columns of a node, rows of a share that are compared at once, queries in one row of the exchange.
COLUMNS, ROWS, QUERIES = 16, 4096, 128
#: Rows of a share, about; numbers in one, and in a row of the exchange.
SHARE, SHARE_VALUES, ROW_VALUES = 16_384, 1 << 22, 1 << 20
#: Sums of products stay below this; below the other one, single precision is exact too.
EXACT, EXACT_SINGLE = 2**53, 2**24
LONGEST = 2**63 - 1

KEY = ("dim", "wide", "part")
#: Rows of a share (is_query false), then queries that ask it; lowest and tau are known in the second pass.
PACKED = "dim int, wide boolean, part int, is_query boolean, size int, ids binary, data binary, lowest binary, tau binary"
_PACKED = pa.schema([("dim", pa.int32()), ("wide", pa.bool_()), ("part", pa.int32()), ("is_query", pa.bool_()), ("size", pa.int32()), *((x, pa.binary()) for x in ("ids", "data", "lowest", "tau"))])
HEADS = "query_id long, lowest binary, ids binary, s binary"
_HEADS = pa.schema([("query_id", pa.int64()), *((x, pa.binary()) for x in ("lowest", "ids", "s"))])
BOUND = "query_id long, lowest binary, tau long"
_BOUND = pa.schema([("query_id", pa.int64()), ("lowest", pa.binary()), ("tau", pa.int64())])
FOUND = "query_id long, ids binary, s binary"
_FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.binary()), ("s", pa.binary())])
#: Packed queries have part 0 until they are dealt to the shares of their length.
RESULT = "query_id long, rank int, vec_id long, score long"


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fewest bytes."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def numbers(row: dict, name: str, kind=np.int64) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def vectors_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = numbers(row, "ids")
    return ids, numbers(row, "data", f"i{row['size']}").reshape(len(ids), row["dim"])


def _pack(queries: bool):
    """Packs consecutive rows of one share: queries with what is known of them, or rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in KEY]
            edges = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))).tolist() + [batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                step = max(1, min(QUERIES if queries else ROWS, ROW_VALUES // max(1, int(keys[0][a]))))
                for lo in range(a, b, step):
                    some = batch.slice(lo, min(b, lo + step) - lo)
                    x = narrow(matrix(some.column("v")))
                    lowest, tau = b"", b""
                    if queries and "tau" in batch.schema.names:
                        lowest, tau = b"".join(some.column("lowest").to_pylist()), some.column("tau").to_numpy().tobytes()
                    head = (pa.array([keys[i][lo].item()], kind) for i, kind in enumerate((pa.int32(), pa.bool_(), pa.int32())))
                    yield pa.RecordBatch.from_arrays([*head, pa.array([queries]), pa.array([x.itemsize], pa.int32()), *(pa.array([y], pa.binary()) for y in (some.column("vec_id").to_numpy().tobytes(), x.tobytes(), lowest, tau))], schema=_PACKED)

    return run


def _each(work, schema: pa.Schema):
    """work(queries, q, blocks, row) for each packed row of queries, which come after the rows of their share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if tuple(row[k] for k in KEY) != key:
                    key, blocks = tuple(row[k] for k in KEY), []
                if not row["is_query"]:
                    blocks.append(vectors_of(row))
                elif blocks:
                    ids, q = vectors_of(row)
                    found = work(ids, q, blocks, row)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays(found, schema=schema)

    return run


def columns(dim: int) -> range:
    return range(0, max(1, dim), COLUMNS)


def products(q: np.ndarray, x: np.ndarray, others: float = 0.0) -> Iterator[np.ndarray]:
    """For each column block the local score of each pair, in a type that is exact for them, their differences, and numbers up to ``others``."""
    most = lambda v: float(np.abs(v.astype(np.float64)).max(initial=0.0))
    largest = 2 * most(q) * most(x) * q.shape[1] + others
    kind = np.float32 if largest < EXACT_SINGLE else np.float64
    for at in columns(q.shape[1]):
        s = q[:, at : at + COLUMNS].astype(kind) @ x[:, at : at + COLUMNS].astype(kind).T
        yield s if largest < EXACT else s.astype(np.int64)


def highest(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest of each row."""
    return np.argpartition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k :] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)


def _heads(k: int):
    """Pass 1: of each node and query the smallest local score and the k highest, by column block."""

    def work(ids: np.ndarray, q: np.ndarray, blocks: list, row: dict) -> list[pa.Array]:
        m = len(columns(row["dim"]))
        lowest, names, scores = np.full((len(ids), m), LONGEST), [[] for _ in range(m)], [[] for _ in range(m)]
        for known, x in blocks:
            same = np.nonzero(ids[:, None] == known[None, :])
            for col, s in enumerate(products(q, x)):
                lowest[:, col] = np.minimum(lowest[:, col], s.min(axis=1).astype(np.int64))
                s = s.astype(np.promote_types(s.dtype, np.float32))
                s[same] = -np.inf
                some = highest(s, k)
                names[col].append(known[some]), scores[col].append(np.take_along_axis(s, some, axis=1))
        ids_out, s_out = [], []
        for col in range(m):
            name, s = np.concatenate(names[col], axis=1), np.concatenate(scores[col], axis=1)
            some = highest(s, k)
            ids_out.append(np.take_along_axis(name, some, axis=1)), s_out.append(np.take_along_axis(s, some, axis=1))
        width = np.full(len(ids), m * ids_out[0].shape[1])
        s = np.concatenate(s_out, axis=1).astype(np.float64)
        return [pa.array(ids), packed_strings(lowest.ravel(), np.full(len(ids), m)), packed_strings(np.concatenate(ids_out, axis=1).ravel(), width), packed_strings(s.ravel(), width)]

    return _each(work, _HEADS)


def _bound(k: int):
    """The smallest local score of each column block over all shares, and the first lower bound of a query's k-th score; 0 where k rows are not met."""

    def settled(rows: list[dict]) -> tuple[np.ndarray, int]:
        lowest = np.min([numbers(r, "lowest") for r in rows], axis=0)
        m = len(lowest)
        ids, s = (np.concatenate([numbers(r, x, kind).reshape(m, -1) for r in rows], axis=1) for x, kind in (("ids", np.int64), ("s", np.float64)))
        some = highest(s, k)
        ids, s = np.take_along_axis(ids, some, axis=1), np.take_along_axis(s, some, axis=1)
        real = s > -np.inf
        name, at = np.unique(ids[real], return_inverse=True)
        sums = np.zeros(len(name), np.int64)
        np.add.at(sums, at, (np.where(real, s, 0).astype(np.int64) - lowest[:, None])[real])
        return lowest, int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) >= k else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            lowest, tau = settled(rows)
            return pa.RecordBatch.from_arrays([pa.array([rows[0]["query_id"]]), pa.array([lowest.tobytes()], pa.binary()), pa.array([tau])], schema=_BOUND)

        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["query_id"] != row["query_id"]:
                    yield out(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield out(rows)

    return run


def _candidates(k: int):
    """Pass 2: entries of the nodes from the cutoff on, bounds of the rows that have any, and the exact scores of those that the bounds leave; the k best of a share."""

    def work(ids: np.ndarray, q: np.ndarray, blocks: list, row: dict) -> list[pa.Array]:
        m = len(columns(row["dim"]))
        lowest, tau = numbers(row, "lowest").reshape(len(ids), m), numbers(row, "tau").copy()
        cutoff = -(-tau // m)
        others = float(np.abs(lowest.astype(np.float64)).sum(axis=1).max() + 2.0 * tau.max() + m)
        names, scores = [], []
        for known, x in blocks:
            low = seen = None
            for col, s in enumerate(products(q, x, others)):
                s -= lowest[:, col, None].astype(s.dtype)
                entry = s >= cutoff[:, None].astype(s.dtype)
                s *= entry
                low, seen = (s, entry.astype(s.dtype)) if low is None else (low + s, seen + entry)
            gone = (seen == 0) | (ids[:, None] == known[None, :])
            low[gone] = -1
            if len(known) >= k:  # the k-th lower bound of these rows; none if they are too few
                tau = np.maximum(tau, np.partition(low, len(known) - k, axis=1)[:, len(known) - k].astype(np.int64))
            high = low + (m - seen) * np.maximum(cutoff - 1, 0)[:, None].astype(low.dtype)
            i, j = np.nonzero((high >= tau[:, None].astype(low.dtype)) & ~gone)
            names.append((i, known[j])), scores.append(np.einsum("ij,ij->i", q[i].astype(np.int64), x[j].astype(np.int64)))
        i, name, s = np.concatenate([x[0] for x in names]), np.concatenate([x[1] for x in names]), np.concatenate(scores)
        return _best_of(ids, i, name, s, k)

    return _each(work, _FOUND)


def _best_of(ids: np.ndarray, i: np.ndarray, name: np.ndarray, s: np.ndarray, k: int) -> list[pa.Array]:
    """The k best (name, s) of each query that has any; i: place of the query."""
    order = np.lexsort((name, ~s, i))
    i, name, s = i[order], name[order], s[order]
    on = np.arange(len(i)) - np.searchsorted(i, i) < k
    which, counts = np.unique(i[on], return_counts=True)
    return [pa.array(ids[which]), packed_strings(name[on], counts), packed_strings(s[on], counts)]


def _wide(k: int):
    """The k best pairs of whole vectors in Python's numbers; a score beyond 64 bits counts as the nearest of 64 bits."""

    def work(ids: np.ndarray, q: np.ndarray, blocks: list, row: dict) -> list[pa.Array]:
        found = []
        for known, x in blocks:
            x = x.astype(object)
            for n, one in enumerate(q.astype(object)):
                s = np.array([min(LONGEST, max(-LONGEST - 1, int(y))) for y in (x @ one if row["dim"] else [0] * len(known))], np.int64)
                other = np.flatnonzero(known != ids[n])
                some = other[np.lexsort((known[other], ~s[other]))[:k]]
                found.append((np.full(len(some), n), known[some], s[some]))
        return _best_of(ids, *(np.concatenate(x) for x in zip(*found, strict=True)), k)

    return _each(work, _FOUND)


def _merged(k: int):
    """The k best of what all shares found for a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            ids, n = unpacked(batch.column("ids"), np.int64)
            parts.append((np.repeat(batch.column("query_id").to_numpy(), n), ids, unpacked(batch.column("s"), np.int64)[0]))
        if parts:
            q, ids, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ids, ~s, q))
            q, ids, s = q[order], ids[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
            on = rank <= k
            yield pa.RecordBatch.from_pydict({"query_id": q[on], "rank": rank[on].astype(np.int32), "vec_id": ids[on], "score": s[on]})

    return run


def whole_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v array<long>, dim, wide): floor(256 * x) of each component; wide where sums of products may reach 2**53."""
    x = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where("vec_id IS NOT NULL")
    if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = rows.where(F.coalesce(finite, F.lit(False))).select("vec_id", F.transform("embedding", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))
    most = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.coalesce(most * most * F.size("v") >= EXACT, F.lit(False)).alias("wide"))


def topk_search(table: DataFrame, every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, the k other rows with the highest whole-number inner product.

    Returns (query_id, rank, vec_id, score), all candidates where they are fewer than k; ties go to the smaller
    vec_id. A component x counts as floor(256 * x), beyond 64 bits as the nearest number of 64 bits, and so does a
    score. Vectors that are null or hold null or non-finite components take no part, zero vectors do; vectors
    meet only those of their own length, empty ones with score 0. Rows without vec_id are left out; of rows that
    repeat one the smallest vector counts. Other columns are ignored.
    """
    n = 2 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(whole_vectors(table))
    shares, n_shares = counted(rows.groupBy("dim", "wide").agg(F.count(F.lit(1)).alias("n")).select("dim", "wide", F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(SHARE), F.expr(f"{SHARE_VALUES} div greatest(1, dim)")))).cast("int").alias("shares")))
    parts = max(n, 4 * (shares.agg(F.sum("shares")).first()[0] or 0))  # few shares meet in one partition
    placed = rows.join(bounded(shares, n_shares), ["dim", "wide"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "shares").cast("int")).select(*KEY, "vec_id", "v")
    blocks = saved(placed.repartition(n, *KEY).sortWithinPartitions(*KEY, "vec_id").mapInArrow(_pack(False), PACKED))
    queries, n_queries = counted(rows.where(F.col("vec_id") % every == 0).select("dim", "wide", F.lit(0).alias("part"), "vec_id", "v"))
    goals = bounded(shares.select("dim", F.col("wide").alias("to"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("at")), n_shares)

    def passed(some: DataFrame, which: str, to: DataFrame, run, schema: str) -> DataFrame:
        """Each share's rows, then the queries that ask it, through one task."""
        packed = some.sortWithinPartitions("dim", "wide").mapInArrow(_pack(True), PACKED)
        spread = packed.join(goals, "dim").where(which).withColumns({"wide": F.col("to"), "part": F.col("at")}).select(*to.columns)
        return to.unionByName(spread).repartition(parts, *KEY).sortWithinPartitions(*KEY, "is_query").mapInArrow(run, schema)

    plain = "NOT wide AND NOT to"
    heads = passed(queries, plain, blocks.where("NOT wide"), _heads(k), HEADS)
    bounds = heads.repartition(n, "query_id").sortWithinPartitions("query_id").mapInArrow(_bound(k), BOUND)
    known = queries.join(bounds.withColumnRenamed("query_id", "vec_id"), "vec_id").select(*KEY, "vec_id", "v", "lowest", "tau")
    found = passed(known.repartition(max(1, -(-n_queries // (8 * QUERIES)))), plain, blocks.where("NOT wide"), _candidates(k), FOUND)
    if not shares.where("wide").isEmpty():
        found = found.unionByName(passed(queries, "wide OR to", blocks, _wide(k), FOUND))
    return found.repartition(n, "query_id").mapInArrow(_merged(k), RESULT)
