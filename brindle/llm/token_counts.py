"""Token counts by a compiled finite-state tokenizer (operator 10).

The vocabulary is a lower-casing byte-pair tokenizer with word ends: texts are normalised, split into
words by a regular expression, and each word is encoded by itself. Both levels are compiled:

* The word splitter is a deterministic automaton over character classes (``DELTA``); a transition into a
  new word emits a boundary. Characters are laid out in fixed chunks, every chunk runs from all states at
  once, which gives its state map; the maps are composed by a parallel prefix scan, and with its entry
  state known each chunk emits its boundaries. Chunks cross text bounds, where an end mark resets the state.
* Each word is a path through a word automaton whose final transition carries the number of tokens that
  the word emits. Its states are prefix polynomial hashes; a path is compiled when a word is first met, by
  encoding that word once with the tokenizer library.

Texts that hold one of the tokenizer's added strings ("<|...|>"), or a character that Python's tables don't
know (the tokenizer's may be newer), go to the library whole, so counts don't depend on Python's version.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from brindle.llm.blocks import BYTE_BASE, U64, mix, prefix_hash, span_hash

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 256
BATCH_CHARS = 1_000_000
#: Words kept compiled in one worker; beyond it the automaton starts anew.
COMPILED_WORDS = 3_000_000

RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

# The splitter is 's|'t|'re|'ve|'m|'ll|'d | letters | one digit | others, white space between.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER, SHORT, HEAD, TAIL = range(7)
"""Classes of characters. SHORT is an apostrophe that one of s, t, m, d follows; HEAD one that re, ve or ll
follows; TAIL marks the end of a text."""
START, IN_WORD, IN_OTHER, SHORT_1, LONG_1, LONG_2 = range(6)


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a word begins, for each state and class."""
    step, begins = np.zeros((6, 7), np.uint8), np.zeros((6, 7), bool)
    for state in range(6):
        for kind, (to, new) in {SPACE: (START, False), TAIL: (START, False), LETTER: (IN_WORD, state != IN_WORD), NUMBER: (START, True), OTHER: (IN_OTHER, state != IN_OTHER), SHORT: (SHORT_1, True), HEAD: (LONG_1, True)}.items():
            step[state, kind], begins[state, kind] = to, new
    for kind in (SHORT, HEAD):  # inside a run of other characters an apostrophe is one of them
        step[IN_OTHER, kind], begins[IN_OTHER, kind] = IN_OTHER, False
    for state, to in ((SHORT_1, START), (LONG_1, LONG_2), (LONG_2, START)):  # the letters after the apostrophe
        step[state, LETTER], begins[state, LETTER] = to, False
    return step, begins


STEP, BEGINS = _transitions()


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[SPACES] = SPACE
    return out


@cache
def unsure() -> np.ndarray:
    """Code points that this Python's character tables do not know: newer ones of the tokenizer may."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def plain(text: str) -> bool:
    """Whether the compiled tokenizer covers a text: no added string in it, and no character outside the tables."""
    if text.isascii():
        return "<|" not in text
    return "<|" not in text and not unsure()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any()


@cache
def library(vocabulary: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


def normalised(text: str) -> str:
    """NFC and lower case, character by character."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def kinds(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of each code point, apostrophes by what follows them; ends are the places of end marks."""
    kind = classes()[points]
    kind[ends] = TAIL
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        padded = np.append(points, np.zeros(2, points.dtype))
        one, two = padded[quotes + 1], padded[quotes + 2]
        kind[quotes[np.isin(one, [115, 116, 109, 100])]] = SHORT
        kind[quotes[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]] = HEAD
    return kind


def word_starts(kind: np.ndarray) -> np.ndarray:
    """Runs the splitter over all characters: where words begin."""
    n = len(kind)
    width = max(1, -(-n // CHUNK))
    grid = np.full(width * CHUNK, TAIL, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(width, CHUNK).T)  # a row holds the same place of every chunk
    flat = STEP.ravel()
    maps = np.repeat(np.arange(len(STEP), dtype=np.uint8)[:, None], width, axis=1)
    for row in grid:
        maps = flat[maps * np.uint8(STEP.shape[1]) + row]
    reach = 1  # prefix scan: maps[:, i] becomes the composition of all chunks up to i
    while reach < width:
        maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach].copy(), axis=0)
        reach *= 2
    state = np.full(width, START, np.uint8)
    state[1:] = maps[START, :-1]
    out = np.empty(grid.shape, bool)
    begins = BEGINS.ravel()
    for k, row in enumerate(grid):
        move = state * np.uint8(STEP.shape[1]) + row
        out[k] = begins[move]
        state = flat[move]
    return out.T.reshape(-1)[:n]


class WordCounts:
    """Final transitions of the word automaton: a word's hash and its number of tokens."""

    def __init__(self, vocabulary: str):
        self.library = library(vocabulary)
        self.of_words = library(vocabulary).from_str(self.library.to_str())
        self.of_words.normalizer = None  # words are normalised already, as parts of their texts
        self.hashes, self.counts = np.empty(0, U64), np.empty(0, np.int32)

    def of(self, hashes: np.ndarray, word_at) -> np.ndarray:
        """Counts for words by hash; word_at(i) gives word i as text, to compile it."""
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        out = np.zeros(len(hashes), np.int32)
        out[known] = self.counts[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            found = np.fromiter((len(x) for x in self.of_words.encode_batch_fast([word_at(i) for i in new.tolist()], add_special_tokens=False)), np.int32, len(new))
            out[new] = found
            if len(self.hashes) + len(new) > COMPILED_WORDS:
                self.hashes, self.counts = np.empty(0, U64), np.empty(0, np.int32)
            merged = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(merged, kind="stable")
            self.hashes, self.counts = merged[order], np.concatenate([self.counts, found])[order]
        return out


def count_tokens(texts: list[str], words: WordCounts) -> np.ndarray:
    """Tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    if not texts:
        return out
    joined = "\x00".join([normalised(x) for x in texts] + [""])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter((len(normalised(x)) for x in texts), np.int64, len(texts)) if joined.count("\x00") != len(texts) else None
    ends = np.flatnonzero(points == 0) if lengths is None else np.cumsum(lengths + 1) - 1
    kind = kinds(points, ends)
    starts = word_starts(kind)
    begin = np.flatnonzero(starts)
    if not len(begin):
        return out
    stop = np.append(begin[1:], len(points))  # a word ends before the next, or at white space or an end mark
    gap = np.flatnonzero((kind == SPACE) | (kind == TAIL))
    if len(gap):
        following = np.searchsorted(gap, begin)
        stop = np.minimum(stop, np.append(gap, len(points))[following])
    hashes = mix(span_hash(prefix_hash(points, BYTE_BASE), begin, stop, BYTE_BASE))
    unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    counts = words.of(unique, lambda i: joined[begin[first[i]] : stop[first[i]]])[back]
    sums = np.append(0, np.cumsum(counts))[np.searchsorted(begin, np.append(-1, ends), side="right")]
    return np.diff(sums)


def _counts(vocabulary: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCounts(vocabulary)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            total = np.zeros(len(texts), np.int64)
            compiled = []
            for i, x in enumerate(texts):
                if plain(x):
                    compiled.append(i)
                else:
                    total[i] = len(words.library.encode(x, add_special_tokens=False))
            some, size = [], 0
            for i in [*compiled, None]:
                if i is None or size >= BATCH_CHARS:
                    total[some] = count_tokens([texts[k] for k in some], words)
                    some, size = [], 0
                if i is not None:
                    some.append(i)
                    size += len(texts[i])
            n_bytes = np.fromiter((len(x.encode()) for x in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(total), pa.array(total > limit)], schema=_RESULT)

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, in one pass without a shuffle.

    Counts are those of the tokenizer library for the whole text, without added special tokens. A null or
    empty text has none. doc_id may be null or repeat; each row gives a row. Other columns are ignored.
    """
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(_counts(vocabulary, limit), RESULT)
