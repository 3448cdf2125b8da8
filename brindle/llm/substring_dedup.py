"""Word-window deduplication by difference-cover anchors (operator 6).

A window is 13 consecutive words. {1, 2, 4} is a difference cover modulo 7: for any two word positions
there is a shift below 7 that brings both to cover positions. So if the same window starts at i and at
j, the 7 words that begin at one and the same shift inside both windows start at cover positions in
both documents, and hashing 7-word anchors at three of seven positions finds every repeated window.
An anchor that two documents share is extended to all windows that can hold it; these windows are
settled by their own hashes: the smallest document that has a window keeps it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm import exchange
from brindle.llm.blocks import gram_hashes, ragged, text_bytes, text_words, whole_texts, word_bounds

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _grams(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of each n words that lie in one text."""
    h = gram_hashes(words, n)
    inside = text[: len(h)] == text[n - 1 : n - 1 + len(h)]
    return np.flatnonzero(inside), h[inside]


def _anchors(n_buckets: int):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = exchange.Packer(n_buckets, "shared")
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for rows, data, offsets in whole_texts(*text_bytes(batch.column("text"))):
                _, _, text, words = text_words(data, offsets)
                at, h = _grams(words, text, ANCHOR)
                place = np.arange(len(text)) - np.searchsorted(text, np.arange(len(rows)))[text]
                on = cover[place[at] % PERIOD]
                at, h = at[on], h[on]
                yield from out.add(h, ids[rows][text[at]], place[at])
        yield from out.flush()

    return run


def _windows(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = exchange.Packer(n_buckets, "later", 8)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            found = exchange.positions(batch.column("found"))
            for rows, data, offsets in whole_texts(*text_bytes(batch.column("text"))):
                _, _, text, words = text_words(data, offsets)
                first = np.searchsorted(text, np.arange(len(rows)))
                near = np.zeros(len(words) + 1, np.int32)
                for k, row in enumerate(rows):
                    if found[row] is not None:  # windows from which the anchor is at most PERIOD - 1 words away
                        a = found[row] + first[k]
                        np.add.at(near, np.maximum(a - PERIOD + 1, first[k]), 1)
                        np.add.at(near, a + 1, -1)
                at, h = _grams(words, text, WINDOW)
                on = np.cumsum(near)[at] > 0
                at, h = at[on], h[on]
                yield from out.add(h, ids[rows][text[at]], at - first[text[at]])
        yield from out.flush()

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = exchange.positions(batch.column("found"))
        n_words, n_removed, digest, kept_text = [], [], [], []
        for rows, data, offsets in whole_texts(*text_bytes(batch.column("text"))):
            start, end, text = word_bounds(data, offsets)
            bounds = np.searchsorted(text, np.arange(len(rows) + 1))
            cover = np.zeros(len(start) + 1, np.int32)
            for k, row in enumerate(rows):
                if found[row] is not None:
                    np.add.at(cover, found[row] + bounds[k], 1)
                    np.add.at(cover, found[row] + bounds[k] + WINDOW, -1)
            kept = np.cumsum(cover)[:-1] == 0
            size = (end - start + 1)[kept]
            left = np.append(data, np.uint8(32))[ragged(start[kept], size)]
            left[np.cumsum(size) - 1] = 32  # the byte after each word
            ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(kept))[bounds]]
            left, ends = left.tobytes(), ends.tolist()
            n_words += np.diff(bounds).tolist()
            n_removed += (np.diff(bounds) - np.diff(np.append(0, np.cumsum(kept))[bounds])).tolist()
            for a, b in zip(ends, ends[1:], strict=False):
                one = left[a : max(a, b - 1)]
                digest.append(hashlib.sha256(one).hexdigest())
                kept_text.append(one)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary()).cast(pa.string())], schema=_RESULT)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Removes each word covered by a 13-word window that also starts in a document with a smaller doc_id.

    Returns (doc_id, n_words, n_removed, kept_sha256, kept_text), a row for each document; kept_text has
    the kept words joined by one space. Words are runs outside space and \\t..\\r, taken unchanged.
    A null or empty text has no words. Rows without doc_id are left out; rows that repeat a doc_id count
    as one document. Further columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    n = exchange.buckets(spark)
    texts = exchange.keyed(docs).repartition(n, "doc_id")
    anchors = exchange.answers(exchange.keyed(docs).mapInArrow(_anchors(n), exchange.PROBES), n, "shared")
    near = texts.join(anchors.hint("shuffle_hash"), "doc_id")
    windows = exchange.answers(near.mapInArrow(_windows(n), exchange.PROBES), n, "later", 8)
    both = texts.join(windows.hint("shuffle_hash"), "doc_id", "left")
    return both.mapInArrow(_removed, RESULT)
