"""Finding equal keys across a corpus with one shuffle of packed probes.

A task hashes what it looks for (anchors, windows, prefix tokens) and sends each probe to the bucket of
its hash, many probes packed in one row. Within its own flush a task settles what it can: when a key
occurs several times there, one representative goes on and the others are answered at once. So a key
that a third of all rows share reaches its bucket once per flush, not once per row, and no bucket grows
with the frequency of a key. Answers return packed by bucket of documents and end as one row per document,
to be joined to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.blocks import U64, mix, packed_strings, unpacked

PROBES = "bucket int, settled boolean, h binary, doc binary, pos binary"
RETURNS = "doc_bucket int, doc binary, pos binary"
ANSWERS = "doc_id long, found binary"
FLUSH = 1_000_000
#: Answers found in a flush go on in rows of this size, each to the next bucket.
SPREAD = 20_000

_PROBES = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("h", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary())])
_RETURNS = pa.schema([("doc_bucket", pa.int32()), ("doc", pa.binary()), ("pos", pa.binary())])
_ANSWERS = pa.schema([("doc_id", pa.int64()), ("found", pa.binary())])


def buckets(spark: SparkSession) -> int:
    """Buckets of an exchange: in proportion to the shuffle partitions, which are set to suit the input."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(n)) >> U64(32)).astype(np.int32)


class Packer:
    """Gathers probes of one task. rule: "repeated" answers every place of a key that occurs twice,
    "shared" those of a key that occurs in two documents, "later" those outside the key's smallest document;
    "all" only sends every probe on."""

    def __init__(self, n_buckets: int, rule: str, key_bytes: int = 4):
        self.n, self.rule, self.dtype = n_buckets, rule, {4: np.uint32, 8: np.uint64}[key_bytes]
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        context = TaskContext.get()
        self.size, self.turn = 0, 31 * context.partitionId() if context else 0

    def add(self, h: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((h, doc, pos.astype(np.int32)))
        self.size += len(h)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        h_in, doc_in, pos_in = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.argsort(h_in, kind="stable")
        h, doc = h_in[order], doc_in[order]
        answered, forward = settle(h, doc, self.rule)
        if answered.any():
            yes = np.sort(order[answered])
            for some in np.array_split(yes, -(-len(yes) // SPREAD)):
                self.turn += 1
                yield from _answer_rows(doc_in[some], pos_in[some], self.turn * 7919 % self.n)
        # back to the order of the texts, where documents and positions compress well; a representative of a
        # settled key is marked in the sign of its position
        mark = np.empty(len(h), np.int8)
        mark[order] = forward
        keep = np.flatnonzero(mark)
        h, doc, pos = h_in[keep], doc_in[keep], np.where(mark[keep] == 2, -1 - pos_in[keep], pos_in[keep]).astype(np.int32)
        b = bucket_of(h, self.n)
        order = np.argsort(b.astype(np.uint16) if self.n < 1 << 16 else b, kind="stable")
        h, doc, pos = h[order], doc[order], pos[order]
        which, counts = np.unique(b, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(np.zeros(len(which), bool)), packed_strings(h.astype(self.dtype), counts), packed_strings(doc, counts), packed_strings(pos, counts)], schema=_PROBES)


def settle(h: np.ndarray, doc: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Over rows sorted by h: which are answered here, and which go on (1: open, 2: as representative of a settled key)."""
    n = len(h)
    new = np.ones(n, bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
    if rule == "all":
        return np.zeros(n, bool), np.ones(n, np.int8)
    if rule == "later":
        answered = doc > np.repeat(low, size)
        return answered, (~answered).astype(np.int8)
    done = size > 1 if rule == "repeated" else low != high
    answered = np.repeat(done, size)
    forward = (~answered).astype(np.int8)
    forward[at[done]] = 2
    return answered, forward


def _answer_rows(doc: np.ndarray, pos: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([True]), pa.array([b""], pa.binary()), packed_strings(doc, np.array([len(doc)])), packed_strings(pos, np.array([len(doc)]))], schema=_PROBES)


def answers(probes: DataFrame, n_buckets: int, rule: str, key_bytes: int = 4) -> DataFrame:
    """(doc_id, found): a row for each document with answers, its positions packed as int32, ascending."""
    dtype = {4: np.uint32, 8: np.uint64}[key_bytes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, docs, poss, ready = [], [], [], []
        for batch in batches:
            doc, counts = unpacked(batch.column("doc"), np.int64)
            pos, _ = unpacked(batch.column("pos"), np.int32)
            h, _ = unpacked(batch.column("h"), dtype)
            settled = np.repeat(batch.column("settled").to_numpy(zero_copy_only=False), counts)
            ready.append((doc[settled], pos[settled]))
            if key_bytes == 4:
                h = h.astype(U64) | (np.repeat(batch.column("bucket").to_numpy().astype(U64), counts)[~settled] << U64(32))
            hs.append(h), docs.append(doc[~settled]), poss.append(pos[~settled])
        if hs:
            h, doc, pos = np.concatenate(hs), np.concatenate(docs), np.concatenate(poss)
            order = np.argsort(h, kind="stable")
            h, doc, pos = h[order], doc[order], pos[order]
            if len(h):
                marked = pos < 0
                pos = np.where(marked, -1 - pos, pos)
                answered, _ = settle(h, doc, rule)
                if rule != "later" and marked.any():
                    new = np.ones(len(h), bool)
                    new[1:] = h[1:] != h[:-1]
                    group = np.cumsum(new) - 1
                    answered |= np.bincount(group, weights=marked)[group] > 0
                ready.append((doc[answered & ~marked], pos[answered & ~marked]))
        del hs, docs, poss
        if ready:
            doc, pos = (np.concatenate(x) for x in zip(*ready, strict=True))
            yield from by_doc(doc, pos, n_buckets)

    return by_document(probes.repartition(n_buckets, "bucket").mapInArrow(run, RETURNS), n_buckets)


def by_doc(doc: np.ndarray, pos: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Answers on their way back, a packed row for each bucket of documents."""
    if not len(doc):
        return
    b = (mix(doc.astype(U64)) >> U64(32)).astype(np.int64) * n_buckets >> 32
    order = np.argsort(b, kind="stable")
    which, counts = np.unique(b, return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), packed_strings(doc[order], counts), packed_strings(pos[order], counts)], schema=_RETURNS)


def by_document(returns: DataFrame, n_buckets: int, dtype=np.int32) -> DataFrame:
    """(doc_id, found): one row for each document that has answers, its distinct positions ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, poss = [], []
        for batch in batches:
            docs.append(unpacked(batch.column("doc"), np.int64)[0])
            poss.append(unpacked(batch.column("pos"), dtype)[0])
        if not docs:
            return
        doc, pos = np.concatenate(docs), np.concatenate(poss)
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
        doc, pos = doc[new], pos[new]
        which, counts = np.unique(doc, return_counts=True)
        ends = np.append(0, np.cumsum(counts))
        for a in range(0, len(which), 20_000):
            some = counts[a : a + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(which[a : a + 20_000], pa.int64()), packed_strings(pos[ends[a] : ends[a] + some.sum()], some)], schema=_ANSWERS)

    return returns.repartition(n_buckets, "doc_bucket").mapInArrow(run, ANSWERS)


def positions(found: pa.Array, dtype=np.int32) -> list[np.ndarray | None]:
    """Per row the packed positions; None where there are none."""
    return [None if x is None else np.frombuffer(x, dtype) for x in found.to_pylist()]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with doc_id as key: rows without one are left out, rows that repeat one count once (the smallest text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs
    return docs.groupBy("doc_id").agg(F.min("text").alias("text"))
