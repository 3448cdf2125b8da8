"""Vectorised views of Arrow text columns: pieces of bounded size, word bounds, prefix polynomial hashes.

Everything here works on one Arrow batch inside a task. Texts are read as UTF-8 bytes straight from the
Arrow buffer; a null text counts as empty. Long texts are cut into overlapping pieces, so the arrays of
a step stay bounded by ``PIECE_BYTES`` whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2_000_000

U64 = np.uint64
#: Odd, so each has an inverse modulo 2**64.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1B54A32D192ED03

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, U64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        have = _POWERS[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """P with P[e] - P[s] the polynomial of values[s:e], scaled by base**s."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of each span, equal for equal contents wherever they lie."""
    return (prefix[end] - prefix[start]) * powers(base, len(prefix))[1][start]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 offsets in them."""
    column = pc.fill_null(column, "") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Piece:
    """Some whole texts, or one part of a long text: row of each text, bytes, offsets, and the place of byte 0 in its text."""

    __slots__ = ("rows", "data", "offsets", "base")

    def __init__(self, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray, base: int = 0):
        self.rows, self.data, self.offsets, self.base = rows, data, offsets, base


def pieces(data: np.ndarray, offsets: np.ndarray, overlap: int = 0, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cuts texts into pieces of at most about ``limit`` bytes; parts of a long text overlap by ``overlap`` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= limit:
            yield Piece(np.arange(i, j), data[lo:hi], offsets[i : j + 1] - lo)
        else:
            for a in range(lo, max(lo + 1, hi - overlap), limit):
                b = min(hi, a + limit + overlap)
                yield Piece(np.array([i]), data[a:b], np.array([0, b - a]), a - lo)
        i = j


def whole_texts(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, bytes and offsets of several whole texts, about ``limit`` bytes at a time; a longer text comes alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield np.arange(i, j), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes outside words of letters: ASCII that is no letter.
NO_LETTER = np.arange(256) < 128
NO_LETTER[[*range(65, 91), *range(97, 123)]] = False


def word_bounds(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each run of bytes not in ``outside``; words end with their text."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    solid = ~outside[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = np.empty(n + 1, bool)
    last[0], last[n] = False, solid[-1]
    last[1:n] = solid[:-1] & ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = solid[cut]
    last[cut] |= solid[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``word_bounds`` and a 64-bit hash of each word."""
    start, end, text = word_bounds(data, offsets)
    return start, end, text, mix(span_hash(prefix_hash(data, BYTE_BASE), start, end, BYTE_BASE))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; the last n - 1 words start none."""
    if len(words) < n:
        return np.empty(0, U64)
    at = np.arange(len(words) - n + 1)
    return mix(span_hash(prefix_hash(words, WORD_BASE), at, at + n, WORD_BASE))


def packed_strings(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows are consecutive runs of ``values``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column of packed numbers, and how many each row has."""
    data, offsets = text_bytes(pc.fill_null(column, b"") if column.null_count else column)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data.tobytes(), dtype), np.diff(offsets) // size


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(first, counts) + np.repeat(starts, counts)
