"""Periodic runs of words by heavy and light lag counting (operator 11).

A run of period q and length l has l - q words in a row that are equal to the word q places on. So a lag q
can only have a run if it has as many equal pairs. These pairs are counted for all lags of a text at once:
a frequent word by the autocorrelation of its places (a real FFT, sums of squares rounded to whole
numbers), a rare one by the differences of its places. Only lags with enough pairs are scanned for
islands of consecutive pairs. Whole texts are handled together, a few megabytes at a time; words are
numbered exactly within such a step, by a dictionary of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm.blocks import ragged, text_bytes, whole_texts, word_bounds
from brindle.llm.exchange import keyed

#: A run has at least so many words, and two periods.
LEAST = 12
#: A word is frequent in a text of n words with more places than this and than sqrt(n log2 n).
FREQUENT = 64
#: Numbers in the arrays of one step.
STEP = 1 << 22

RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed_text", pa.string())])


def needed(lag: np.ndarray) -> np.ndarray:
    """Equal pairs in a row that a run of this period has at least."""
    return np.maximum(LEAST - lag, lag)


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes only."""
    size = end - start
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    flat = np.ascontiguousarray(data[ragged(start, size)])
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return words.dictionary_encode().indices.to_numpy()


def autocorrelation(places: list[np.ndarray], n: int) -> np.ndarray:
    """For each lag up to n // 2, how many pairs of places of one word lie so far apart."""
    size = 1 << (n + n // 2).bit_length()
    power = np.zeros(size // 2 + 1)
    some = max(1, STEP // size)
    for lo in range(0, len(places), some):
        words = places[lo : lo + some]
        marks = np.zeros((len(words), size))
        for row, at in zip(marks, words, strict=True):
            row[at] = 1
        found = np.fft.rfft(marks, axis=1)
        power += (found.real**2 + found.imag**2).sum(axis=0)
    return np.rint(np.fft.irfft(power, size)[: n // 2 + 1]).astype(np.int64)


def lag_counts(codes: np.ndarray, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal pairs for each lag 0 .. n // 2 of each text (lag 0 stays 0), and where the lags of a text begin."""
    lags = size // 2 + 1
    base = np.append(0, np.cumsum(lags))
    counts = np.zeros(base[-1], np.int64)
    order = np.argsort(text * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
    t, c, place = text[order], codes[order], order - first[text[order]]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
    at = np.flatnonzero(new)
    often = np.diff(np.append(at, len(t)))
    n = size[t[at]]
    frequent = often > np.maximum(FREQUENT, np.sqrt(n * np.log2(np.maximum(n, 2))))
    for one in np.unique(t[at[frequent]]).tolist():
        of = np.flatnonzero(frequent & (t[at] == one))
        found = autocorrelation([place[a : a + k] for a, k in zip(at[of].tolist(), often[of].tolist(), strict=True)], int(size[one]))
        found[0] = 0
        counts[base[one] : base[one + 1]] += found
    # the k-th next place of a rare word, for k = 1, 2, ... while it is no more than half a text away
    rest = np.repeat(at + often, often) - 1
    some, gathered, held, k = np.flatnonzero(~np.repeat(frequent, often)), [], 0, 1
    while len(some):
        some = some[some + k <= rest[some]]
        lag = place[some + k] - place[some]
        near = lag < lags[t[some]]
        some, lag = some[near], lag[near]
        gathered.append(base[t[some]] + lag)
        held, k = held + len(some), k + 1
        if held > STEP or not len(some):
            counts += np.bincount(np.concatenate(gathered), minlength=len(counts))
            gathered, held = [], 0
    return counts, base


def islands(codes: np.ndarray, first: np.ndarray, text: np.ndarray, lag: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over texts and lags to scan: which of them, first word, and number of equal pairs in a row, where they are enough."""
    parts, lo = [], 0
    ends = np.cumsum(n - lag)
    while lo < len(lag):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, side="right")))
        q, size = lag[lo:hi], (n - lag)[lo:hi]
        at = ragged(first[text[lo:hi]], size)
        hit = np.flatnonzero(codes[at] == codes[at + np.repeat(q, size)])
        which = np.searchsorted(np.cumsum(size), hit, side="right")
        begins = np.ones(len(hit), bool)
        begins[1:] = (hit[1:] != hit[:-1] + 1) | (which[1:] != which[:-1])
        a = np.flatnonzero(begins)
        long = np.diff(np.append(a, len(hit)))
        on = long >= needed(q[which[a]])
        a, long = a[on], long[on]
        parts.append((which[a] + lo, at[hit[a]] - first[text[lo:hi]][which[a]], long))
        lo = hi
    if not parts:
        return (np.empty(0, np.int64),) * 3
    which, begin, long = (np.concatenate(x) for x in zip(*parts, strict=True))
    return which, begin, long


def runs_of(codes: np.ndarray, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period."""
    counts, base = lag_counts(codes, text, first, size)
    lags = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
    scan = np.flatnonzero((counts >= needed(lags)) & (lags > 0))
    of, lag = np.searchsorted(base, scan, side="right") - 1, lags[scan]
    which, start, pairs = islands(codes, first, of, lag, size[of])
    of, period = of[which], lag[which]
    length = pairs + period
    # a stretch of a smaller period is found under multiples of it too, with the same bounds
    order = np.lexsort((period, length, start, of))
    of, start, length, period = of[order], start[order], length[order], period[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    of, start, length, period = of[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, of))
    return of[order], start[order], length[order], period[order]


def kept_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray, kept: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    size = (end - start + 1)[kept]
    flat = np.append(data, np.uint8(32))[ragged(start[kept], size)]
    flat[np.cumsum(size) - 1] = 32  # the byte after each word
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(kept))[bounds]]
    flat, ends = flat.tobytes(), ends.tolist()
    return pa.array([flat[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)], pa.binary()).cast(pa.string())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in whole_texts(*text_bytes(batch.column("text"))):
            start, end, text = word_bounds(data, offsets)
            bounds = np.searchsorted(text, np.arange(len(rows) + 1))
            first, size = bounds[:-1], np.diff(bounds)
            of, begin, length, period = runs_of(word_codes(data, start, end), text, first, size)
            cover = np.zeros(len(start) + 1, np.int64)
            np.add.at(cover, first[of] + begin + period, 1)
            np.add.at(cover, first[of] + begin + length, -1)
            kept = np.cumsum(cover)[:-1] == 0
            each = np.searchsorted(of, np.arange(len(rows) + 1))
            best = np.lexsort((period, begin, -length, of))[each[:-1][each[1:] > each[:-1]]]
            longest = np.full((3, len(rows)), -1)
            longest[:, of[best]] = begin[best], length[best], period[best]
            none = longest[1] < 0
            lists = pa.ListArray.from_arrays(pa.array(each, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (begin, length, period)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(int(rows[0]), len(rows)), pa.array(size, pa.int64()), pa.array(np.diff(each), pa.int64()), *(pa.array(x, pa.int64(), mask=none) for x in longest), lists, kept_texts(data, start, end, kept, bounds)], schema=_RESULT
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """All runs of each text: stretches of words with a smallest period q, of 12 words and 2q words at least, that no neighbouring word extends.

    Returns (doc_id, n_words, n_runs, start, length, period, runs, collapsed_text), a row for each document.
    start, length and period are those of the longest run (ties: smallest start, then period; null without a
    run), runs has all of them by start and period, numbered from word 0, and collapsed_text the words that no
    run has after its first period, joined by one space. Words are runs outside space and \\t..\\r, taken
    unchanged. A null or empty text has no words, no run and an empty collapsed text. Rows without doc_id are
    left out; of rows that repeat one the smallest text counts. Other columns are ignored, whatever their
    names. Texts are handled where they lie, without a shuffle; memory is in proportion to the longest text.
    """
    return keyed(docs).mapInArrow(_runs, RESULT)
