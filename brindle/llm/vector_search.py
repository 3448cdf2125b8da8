"""Approximate nearest neighbours by an adaptive dimension scan of probed lists (operator 5).

Rows are dealt to lists around centroids fitted on a bounded sample; every row is in a list. Lists are gathered in
shares of bounded size, and a crowded list is dealt over several. A share's rows are one task's; each query comes once
to every share that has a list that it probes, so no pair of queries and rows is shipped. A query probes the lists with the best
centroids; how many is measured on the sample, for ``TARGET`` of the true neighbours. In a block, vectors
rotated by a random orthogonal matrix are read a few dimensions at a time. The partial squared distance,
scaled up, is an estimate of the whole one, and a candidate is abandoned when a test on it says that it
cannot reach the query's bound: the k-th best of a few seed rows, then of what the share has found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.blocks import packed_strings, ragged, unpacked
from brindle.llm.saved import bounded, counted, saved
from brindle.llm.vectors import matrix, scaled, usable, vectors

NEIGHBOURS = 20
EVERY = 20
SAMPLE = 16_384
#: Rows of the sample that give each query its first bound.
SEEDS = 512
LIST_ROWS = 512
MOST_LISTS = SAMPLE // 8
#: Vectors with a larger component are compared with every query of their length, by the product alone: their squares may overflow.
WILD = 2.0**250
#: Longer vectors are not rotated.
WIDEST = 2048
BLOCK = 1024
QUERIES = 256
#: Rows of a share, about; numbers in one, and in a row of the exchange.
SHARE, SHARE_VALUES, ROW_VALUES = 4096, 1 << 22, 1 << 20
STEP = 16
#: Strictness of the test; a candidate is abandoned when its estimate exceeds the bound by 1 + STRICT / sqrt(dimensions read).
STRICT = 2.1
TARGET = 0.97
TRIAL_QUERIES = 256

#: Blocks of a share's rows by list, then queries with their first bounds and the (query, list) that they probe there.
PACKED = "share int, is_query boolean, list int, dim int, size int, ids binary, data binary, bounds binary, who binary, lists binary"
_PACKED = pa.schema([("share", pa.int32()), ("is_query", pa.bool_()), ("list", pa.int32()), ("dim", pa.int32()), ("size", pa.int32()), *((x, pa.binary()) for x in ("ids", "data", "bounds", "who", "lists"))])
HITS = "query_id long, ids binary, scores binary"
_HITS = pa.schema([("query_id", pa.int64()), ("ids", pa.binary()), ("scores", pa.binary())])
RESULT = "query_id long, rank int, vec_id long, score double"


@cache
def rotation(dim: int) -> np.ndarray | None:
    """A fixed random orthogonal matrix; none beyond a bounded length."""
    if dim > WIDEST:
        return None
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm on a sample of bounded size."""
    c = x[np.random.default_rng(0).choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        at = nearest_list(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        n_at = np.bincount(at, minlength=n)
        c = np.where(n_at[:, None] > 0, sums / np.maximum(n_at, 1)[:, None], c)
    return c


def nearest_list(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Lists:
    """Centroids, the number of lists to probe, and the seed rows that give first bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, n_rows: int, k: int):
        self.ids, self.x, self.k = ids, x, k
        if not len(x):
            self.c, self.probes = np.zeros((1, x.shape[1])), 1
            return
        self.c = centroids(x, min(len(x), max(1, min(MOST_LISTS, n_rows // LIST_ROWS))))
        self.probes = self._probes()
        seeds = min(SEEDS, n_rows // 8)
        self.ids, self.x = ids[:seeds], x[:seeds]

    def _probes(self) -> int:
        """Lists to probe so that, among rows of the sample, TARGET of the true neighbours lie in them."""
        at = nearest_list(self.x, self.c)
        q = self.x[:: max(1, len(self.x) // TRIAL_QUERIES)]
        products = q @ self.x.T
        best = np.argsort(-products, axis=1, kind="stable")[:, : self.k + 1]
        rank = np.argsort(np.argsort(-(q @ self.c.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(rank, at[best], axis=1).ravel())
        return int(needed[min(len(needed) - 1, int(TARGET * len(needed)))]) + 1

    def asked(self, q: np.ndarray) -> np.ndarray:
        """The lists that each query probes, and that of the wild rows."""
        near = np.argsort(-(scaled(q) @ self.c.T), axis=1, kind="stable")[:, : self.probes]
        return np.concatenate([near, np.full((len(q), 1), MOST_LISTS)], axis=1)


def wild(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(axis=1, initial=0.0) > WILD


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with y; a sum that is no number counts as minus infinity."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.einsum("ij,j->i", x, y)
    return np.where(np.isnan(score), -np.inf, score)


def rows_of(limit: int, values: int, dim: int) -> int:
    """How many vectors of this length go together."""
    return max(1, min(limit, values // max(1, dim)))


def _row(share: int, is_query: bool, number: int, x: np.ndarray, ids: np.ndarray, *others: np.ndarray) -> pa.RecordBatch:
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    x = single if (single == x).all() else x
    packed = [np.ascontiguousarray(y).tobytes() for y in (ids, x, *others)] + [b""] * (3 - len(others))
    return pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([is_query]), pa.array([number], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([x.itemsize], pa.int32()), *(pa.array([y], pa.binary()) for y in packed)], schema=_PACKED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs sorted rows of a list in a share into blocks."""
    for batch in batches:
        share, at = batch.column("share").to_numpy(), batch.column("list").to_numpy()
        edges = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (share[1:] != share[:-1]))).tolist() + [len(at)] if len(at) else [0]
        for a, b in zip(edges, edges[1:], strict=False):
            x, ids = matrix(batch.column("embedding").slice(a, b - a)), batch.column("vec_id").to_numpy()[a:b]
            step = rows_of(BLOCK, ROW_VALUES, x.shape[1])
            for lo in range(0, b - a, step):
                yield _row(int(share[a]), False, int(at[a]), x[lo : lo + step], ids[lo : lo + step])


def dealt(counts: dict[int, int], limits: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each list its first share, and over how many shares it is dealt; limits: rows of a share by list."""
    out, share, held = {}, 0, 0.0
    for number, n in sorted(counts.items()):
        part = n / limits[number]
        if held and held + part > 1:
            share, held = share + 1, 0.0
        k = max(1, -(-n // limits[number]))
        out[number] = (share, k)
        share, held = (share + k, 0.0) if k > 1 else (share, held + part)
    return out


def _number(lists: dict[int, Lists]):
    """The number of the list of each row; lists of different dimensions have different numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims).tolist():
                on = dims == d
                x = matrix(batch.column("embedding").filter(pa.array(on)))
                odd = wild(x)
                out[on] = np.where(odd, MOST_LISTS, nearest_list(np.where(odd[:, None], 0, x), lists[d].c)) + d * (MOST_LISTS + 1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(out)], names=["vec_id", "embedding", "list"])

    return run


def _ask(lists: dict[int, Lists], goals: dict[int, tuple[int, int]]):
    """Queries by share, with their first bound and the lists that they probe there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, every = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy()
            for d in np.unique(dims).tolist():
                on = dims == d
                ids, q = every[on], matrix(batch.column("embedding").filter(pa.array(on)))
                known = lists[d]
                bounds = np.full(len(ids), -np.inf)
                first = np.where(wild(q)[:, None], 0, q) @ known.x.T
                first[ids[:, None] == known.ids[None, :]] = -np.inf
                if first.shape[1] >= known.k:
                    bounds = np.partition(first, first.shape[1] - known.k, axis=1)[:, first.shape[1] - known.k]
                bounds[wild(q)] = -np.inf
                # the share of each list, and its others where a crowded list has several
                shares = np.full((MOST_LISTS + 1, 2), 0, np.int64)
                for number in range(MOST_LISTS + 1):
                    shares[number] = goals.get(number + d * (MOST_LISTS + 1), (0, 0))
                wanted = known.asked(q)
                query, which = np.repeat(np.arange(len(ids)), wanted.shape[1]), wanted.ravel()
                times = shares[which, 1]
                query, which, share = np.repeat(query, times), np.repeat(which, times), ragged(shares[which, 0], times)
                order = np.lexsort((query, share))
                query, which, share = query[order], which[order], share[order]
                edges = np.flatnonzero(np.append(True, share[1:] != share[:-1])).tolist() + [len(share)] if len(share) else [0]
                for a, b in zip(edges, edges[1:], strict=False):
                    asks, at = np.unique(query[a:b], return_inverse=True)
                    step = rows_of(QUERIES, ROW_VALUES, d)
                    for lo in range(0, len(asks), step):
                        some, pair = asks[lo : lo + step], slice(*np.searchsorted(at, (lo, lo + step)))
                        yield _row(int(share[a]), True, 0, q[some], ids[some], bounds[some], (at[pair] - lo).astype(np.int16), (which[a:b][pair] + d * (MOST_LISTS + 1)).astype(np.int32))

    return run


class Turned:
    """Vectors with what a scan needs of them: norms, coordinates after the rotation, which are wild."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.wild = ids, x, wild(x)
        y = np.where(self.wild[:, None], 0, x)
        turn = rotation(x.shape[1])
        self.norms, self.y = (y * y).sum(axis=1), y if turn is None else y @ turn

    def some(self, on: np.ndarray) -> Turned:
        out = object.__new__(Turned)
        out.ids, out.x, out.wild, out.norms, out.y = (z[on] for z in (self.ids, self.x, self.wild, self.norms, self.y))
        return out


def scan(queries: Turned, bounds: np.ndarray, rows: Turned, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, ids, scores) of the best of one block that reach each query's bound."""
    qids, q, ids, x, u, v = queries.ids, queries.x, rows.ids, rows.x, queries.y, rows.y
    dim, free = x.shape[1], queries.wild[:, None] | rows.wild[None, :]
    norms = queries.norms[:, None] + rows.norms[None, :]
    limit = norms - 2 * (bounds[:, None] - 1e-9)  # squared distance at which the bound is reached
    steps = [*range(STEP, dim, STEP), dim]
    d = steps[0]
    partial = (u[:, :d] ** 2).sum(axis=1)[:, None] + (v[:, :d] ** 2).sum(axis=1)[None, :] - 2 * u[:, :d] @ v[:, :d].T
    test = partial * (dim / d) <= limit * (1 + STRICT / np.sqrt(d)) ** 2 if d < dim else partial <= limit + 1e-9
    other = qids[:, None] != ids[None, :]
    test &= other & ~free
    i, j = np.nonzero(test)
    part = partial[i, j]
    for to in steps[1:]:
        if not len(i):
            break
        part = part + ((u[i, d:to] - v[j, d:to]) ** 2).sum(axis=1)
        d = to
        stay = part * (dim / d) <= limit[i, j] * (1 + (STRICT / np.sqrt(d) if d < dim else 0)) ** 2 + 1e-9
        i, j, part = i[stay], j[stay], part[stay]
    if free.any():
        more = np.nonzero(free & other)
        i, j = np.append(i, more[0]), np.append(j, more[1])
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
    edges = np.searchsorted(i, np.arange(len(qids) + 1)).tolist()
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if b > a:
            score = products(x[j[a:b]], q[n])
            best = top(score, ids[j[a:b]], k)
            yield n, ids[j[a:b]][best], score[best]


def _hits(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    n = np.array([len(x[1]) for x in found], np.int64)
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), packed_strings(np.concatenate([x[1] for x in found]), n), packed_strings(np.concatenate([x[2] for x in found]), n)], schema=_HITS)


def _scan(k: int):
    """Queries past the blocks of their share: the k best found there."""

    def unpack(row: dict) -> Turned:
        return Turned(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], f"f{row['size']}").astype(np.float64).reshape(-1, row["dim"]))

    def found(row: dict, blocks: dict[int, list[Turned]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        queries, bounds, out = unpack(row), np.frombuffer(row["bounds"], np.float64).copy(), {}
        who, which = np.frombuffer(row["who"], np.int16), np.frombuffer(row["lists"], np.int32)
        for number in np.unique(which).tolist():
            on = who[which == number]
            some = queries.some(on) if number in blocks else None
            for rows in blocks.get(number, ()):
                for n, ids, score in scan(some, bounds[on], rows, k):
                    n = on[n]
                    if n in out:
                        ids, score = np.append(out[n][0], ids), np.append(out[n][1], score)
                        best = top(score, ids, k)
                        ids, score = ids[best], score[best]
                    out[n] = (ids, score)
                    if len(ids) == k and not queries.wild[n]:
                        bounds[n] = max(bounds[n], score[-1])
        return [(int(queries.ids[n]), *x) for n, x in out.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, blocks = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["share"] != share:
                    share, blocks = row["share"], {}
                if not row["is_query"]:
                    blocks.setdefault(row["list"], []).append(unpack(row))
                elif hits := found(row, blocks):
                    yield _hits(hits)

    return run


def _sample_hits(lists: dict[int, Lists], k: int):
    """The best seed rows for each query; a query with a bound has found as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, every, found = batch.column("dim").to_numpy(), batch.column("vec_id").to_numpy(), []
            for d in np.unique(dims).tolist():
                on, known = dims == d, lists[d]
                ids, q = every[on], matrix(batch.column("embedding").filter(pa.array(on)))
                for n, query in enumerate(ids.tolist()):
                    score = products(known.x, q[n])
                    score[known.ids == query] = -np.inf
                    best = top(score, known.ids, k)
                    best = best[score[best] > -np.inf]
                    found.append((query, known.ids[best], score[best]))
            if found:
                yield _hits(found)

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, ids, scores = [], [], []
        for batch in batches:
            x, n = unpacked(batch.column("ids"), np.int64)
            qs.append(np.repeat(batch.column("query_id").to_numpy(), n)), ids.append(x), scores.append(unpacked(batch.column("scores"), np.float64)[0])
        if not qs:
            return
        q, i, s = np.concatenate(qs), np.concatenate(ids), np.concatenate(scores)
        order = np.lexsort((i, q))
        q, i, s = q[order], i[order], s[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
        q, i, s = q[new], i[new], s[new]
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first + 1
        on = rank <= k
        yield pa.RecordBatch.from_pydict({"query_id": q[on], "rank": rank[on].astype(np.int32), "vec_id": i[on], "score": s[on]})

    return run


def vector_search(table: DataFrame, every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``, the k rows found with the largest inner product.

    Returns (query_id, rank, vec_id, score); score is the inner product of the original vectors in double
    precision, ties go to the smaller vec_id, and a query gets all candidates where they are fewer than k.
    Vectors that are null, empty, zero or hold null or non-finite components take no part, and vectors meet
    only those of their own length. Products may be infinite; one that is no number counts as minus infinity. Rows without vec_id are left out; rows that repeat one count once.
    Other columns are ignored.
    """
    spark = table.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors(table).where(usable(F.col("embedding"))).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    lists = {}
    for d, size in sizes.items():
        some = rows.where((F.col("dim") == d) & ~F.exists("embedding", lambda x: F.abs(x) > WILD)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "embedding").toArrow()
        lists[d] = Lists(some.column("vec_id").to_numpy(), matrix(some.column("embedding")) if some.num_rows else np.empty((0, d)), size, k)
    numbered = saved(rows.mapInArrow(_number(lists), "vec_id long, embedding array<double>, list int"))
    counts = {r.list: r.n for r in numbered.groupBy("list").agg(F.count("*").alias("n")).collect()}
    goals = dealt(counts, {x: rows_of(SHARE, SHARE_VALUES, x // (MOST_LISTS + 1)) for x in counts})
    deal = spark.createDataFrame([(number, *goal) for number, goal in goals.items()], "list int, first int, times int")
    placed = numbered.join(bounded(deal, len(goals)), "list").withColumn("share", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "times")).cast("int"))
    blocks = placed.select("share", "list", "vec_id", "embedding").repartition(n, "share").sortWithinPartitions("share", "list", "vec_id").mapInArrow(_blocks, PACKED)
    queries, _ = counted(rows.where(F.col("vec_id") % every == 0))
    asked = queries.mapInArrow(_ask(lists, goals), PACKED)
    parts = max(n, 4 * sum(max(goals.values(), default=(0, 0))))  # few shares meet in one partition
    hits = blocks.unionByName(asked).repartition(parts, "share").sortWithinPartitions("share", "is_query").mapInArrow(_scan(k), HITS)
    hits = hits.unionByName(queries.mapInArrow(_sample_hits(lists, k), HITS))
    return hits.repartition(n, "query_id").mapInArrow(_merge(k), RESULT)
