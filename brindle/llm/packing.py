"""Packing token sequences along a space-filling curve (operator 7).

Each document is tokenized once, in the task that reads it. Its tokens are cut into whole sequences and
one rest, and the token counts are projected to three dimensions, whose Hilbert index is the document's
place on the curve. Only these small rows are shuffled: a range sort by (curve, doc_id, start) deals
neighbouring documents to the same task, which fills sequences from runs of neighbours, best fit first.
Copies have one place on the curve; the further sort keys spread them over tasks.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from brindle.llm.saved import saved

VOCABULARY = "byte_bpe_50k"
SPECIAL = {"<|endoftext|>": 50256}
END = 1
LENGTH = 2048
#: Neighbours along the curve that are packed together.
NEIGHBOURS = 1024
BITS = 10
DIMENSIONS = 3
SPREAD = 4.0

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, curve long"
_PIECES = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "curve")])
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long"
_RESULT = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve")])


@cache
def encoder(vocabulary: str):
    """The vocabulary's ranks give the same ids as its tokenizers file, at several times the speed; tests compare the two."""
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@cache
def directions() -> np.ndarray:
    """A fixed random direction for each token id."""
    return np.random.default_rng(7).standard_normal((1 << 16, DIMENSIONS)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of points with integer coordinates below 2**bits, a row each."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations, from the largest cube to the smallest
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    q = top
    while q > 1:
        fix ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= fix
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> bit) & 1)
    return out


def curve_places(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of each document, from the summed directions of its tokens."""
    mean = sums / np.maximum(counts, 1)[:, None]
    cells = ((np.tanh(SPREAD * mean) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
    return hilbert(cells)


def _cut(vocabulary: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, towards = encoder(vocabulary), directions()
        for batch in batches:
            rows, sums, counts = [], np.zeros((batch.num_rows, DIMENSIONS)), np.zeros(batch.num_rows, np.int64)
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
                ids = np.append(encode.encode_to_numpy(text.as_py() or "", allowed_special="all"), np.uint32(END)).astype("<u4")
                sums[i], counts[i] = towards[ids].sum(axis=0), len(ids)
                raw = memoryview(ids.tobytes())
                for a in range(0, len(ids), length):
                    b = min(a + length, len(ids))
                    rows.append((doc, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), len(ids), i))
            places = curve_places(sums, counts)
            columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in range(6)]
            columns[5] = places[np.array(columns[5], np.int64)] if rows else []
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_PIECES)

    return run


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each piece, longest first into the bin that it fills best; the number of bins."""
    bins, offsets, used = [0] * len(lengths), [0] * len(lengths), 0
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, at, used = size, used, used + 1
        bins[i], offsets[i] = at, size - room
        by_room[room - n].append(at)
        rooms |= 1 << (room - n)
    return bins, offsets, used


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_id = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        waiting = 0

        def close(table: pa.Table) -> pa.RecordBatch:
            nonlocal next_id
            bins, offsets, used = best_fit(table.column("length").to_pylist(), length)
            out = [table.column(k).combine_chunks() for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            out += [pa.array(np.array(bins, np.int64) + next_id), pa.array(np.array(offsets, np.int64)), table.column("curve").combine_chunks()]
            next_id += used
            return pa.RecordBatch.from_arrays(out, schema=_RESULT)

        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= NEIGHBOURS:
                table = pa.Table.from_batches(held)
                whole = waiting // NEIGHBOURS * NEIGHBOURS
                for a in range(0, whole, NEIGHBOURS):
                    yield close(table.slice(a, NEIGHBOURS))
                held = table.slice(whole).to_batches()
                waiting -= whole
        if waiting:
            yield close(pa.Table.from_batches(held))

    return run


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """Packs all documents into sequences of at most ``length`` tokens, neighbours on the curve together.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve.
    A document's ids are those of its whole text (null: empty) and then the id 1; each lies in one piece.
    doc_id may be null or repeat; every row is packed. Other columns are ignored.
    """
    pieces = saved(docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(_cut(vocabulary, length), PIECES))
    n = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "doc_id", "start"]
    return pieces.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_pack(length), RESULT)
