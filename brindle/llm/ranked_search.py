"""Ranked lexical search by the three-phase uniform threshold over term-partitioned postings (operator 12).

Documents are read twice: once for the counts of the corpus and of the terms, once for the postings. These come in
slices of bounded size: each slice gives for every term that an item may ask for a packed row of its documents, known by
their place in the slice, and of their scores before the term's weight. What an item asks for is known to the tasks by
a bitmap of fixed size; the join by term is exact. The lists are dealt by term and slice, so a term of a third of all
documents lies on many tasks.

1. The heads of all lists are fetched. The best sums of heads are looked up, and the k-th score of an item is its
   first lower bound.
2. A document that reaches the bound has a score of bound / m at least in one of the item's m lists. Every
   list sends its entries from an eighth of that on, once for a group of items; with the largest score that a missing entry
   can have, a document has a lower and an upper bound. The k-th lower bound rules out most of the rest.
3. The others' scores are looked up in the lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.blocks import BYTE_BASE, LOWER, U64, mix, packed_strings, prefix_hash, ragged, span_hash, text_bytes, unpacked, whole_texts, word_bounds
from brindle.llm.exchange import keyed
from brindle.llm.saved import bounded, counted, saved

RESULTS = 20
#: Entries at the head of a list, and sums of heads that are looked up for each item, for each result asked for.
HEAD, LOOKUPS = 10, 5
#: Bits of the bitmap of asked terms.
BITS = 22
#: Postings and documents of a slice, about.
SLICE, SLICE_DOCS = 500_000, 1 << 15
#: Terms of a group of items, about.
GROUP = 1 << 14
#: A list sends entries from this share of bound / m on, so that missing entries can add little and few documents stay.
SHARE = 8
#: Items whose lookups of one term in one slice are packed together, and lookups that are broadcast at most.
TOGETHER, FEW = 4096, 1_000_000

#: Bytes outside terms.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

TERMS = "item_id long, term string, c long, h long"
_TERMS = pa.schema([("item_id", pa.int64()), ("term", pa.string()), ("c", pa.int64()), ("h", pa.int64())])
COUNTS = "term string, n long, n_terms long"
_COUNTS = pa.schema([("term", pa.string()), ("n", pa.int64()), ("n_terms", pa.int64())])
#: docs: places in the slice; parts: scores before the weight. The row of the empty term has the slice's doc_ids.
LISTS = "term string, slice long, docs binary, parts binary"
_LISTS = pa.schema([("term", pa.string()), ("slice", pa.int64()), ("docs", pa.binary()), ("parts", pa.binary())])
HEADS = "term string, slice long, place long, s long"
_HEADS = pa.schema([("term", pa.string()), ("slice", pa.int64()), ("place", pa.int64()), ("s", pa.int64())])
SCORES = "item_id long, slice long, place long, s long"
_SCORES = pa.schema([(x, pa.int64()) for x in ("item_id", "slice", "place", "s")])
NAMED = "item_id long, doc_id long, score long"
_NAMED = pa.schema([(x, pa.int64()) for x in ("item_id", "doc_id", "score")])
ASKED = ("item", "c", "cap", "total", "tau")
FETCHED = "grp long, slice long, w long, docs binary, parts binary, " + ", ".join(f"{x} array<long>" for x in ASKED)
CANDIDATES = "item_id long, slice long, place long, low long, high long"
_CANDIDATES = pa.schema([(x, pa.int64()) for x in ("item_id", "slice", "place", "low", "high")])


def term_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each term, equal for equal bytes only, and the terms by number."""
    size = end - start
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    flat = np.ascontiguousarray(data[ragged(start, size)])
    found = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def term_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(span_hash(prefix_hash(data, BYTE_BASE), start, end, BYTE_BASE))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for rows, data, offsets in whole_texts(*text_bytes(batch.column("text"))):
            data = LOWER[data]
            start, end, text = word_bounds(data, offsets, OUTSIDE)
            code, terms = term_words(data, start, end)
            key, first, c = np.unique(text * max(1, len(terms)) + code, return_index=True, return_counts=True)
            h = term_hashes(data, start[first], end[first])
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows][text[first]]), terms.take(pa.array(code[first])).cast(pa.string()), pa.array(c), pa.array(h.view(np.int64))], schema=_TERMS)


def _bitmap(items: DataFrame) -> np.ndarray:
    """The bits of all asked terms; of one size, whatever the number of terms."""
    bits = items.select(F.shiftrightunsigned("h", 64 - BITS).alias("bit"))
    words = bits.groupBy(F.expr("bit div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("x")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("x").to_numpy()
    return out.view(U64)


def _asked_terms(batch: pa.RecordBatch, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Rows of some texts, their numbers of terms, and the text, count and number of each term of a text that may be asked for, with the terms by number."""
    for rows, data, offsets in whole_texts(*text_bytes(batch.column("text"))):
        data = LOWER[data]
        start, end, text = word_bounds(data, offsets, OUTSIDE)
        size = np.bincount(text, minlength=len(rows))
        on = asked[(term_hashes(data, start, end) >> U64(64 - BITS)).astype(np.int64)] if len(start) else np.zeros(0, bool)
        code, terms = term_words(data, start[on], end[on])
        key, tf = np.unique(text[on] << 32 | code, return_counts=True)
        yield rows, size, key >> 32, tf, key & 0xFFFFFFFF, terms


def _counts(words: np.ndarray):
    """Documents that hold each term; under the empty term documents that hold any, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)
        n_docs, n_terms = 0, 0
        found: dict[bytes, int] = {}

        def counted_() -> pa.RecordBatch:
            terms = pa.array([b"", *found], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([terms, pa.array([n_docs, *found.values()], pa.int64()), pa.array([n_terms, *[0] * len(found)], pa.int64())], schema=_COUNTS)

        for batch in batches:
            for _, size, _, _, code, terms in _asked_terms(batch, asked):
                n_docs, n_terms = n_docs + int((size > 0).sum()), n_terms + int(size.sum())
                for term, n in zip(terms.to_pylist(), np.bincount(code, minlength=len(terms)).tolist(), strict=True):
                    found[term] = found.get(term, 0) + n
                if len(found) >= SLICE:
                    yield counted_()
                    n_docs, n_terms = 0, 0
                    found.clear()
        yield counted_()

    return run


def _postings(words: np.ndarray, n_docs: int, n_terms: int):
    """Rows of lists by slices of documents, and for each slice the row of its doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)
        turn = TaskContext.get().partitionId() << 24
        known: dict[bytes, int] = {}
        parts: list[tuple[np.ndarray, ...]] = []
        names: list[np.ndarray] = []
        held, n = 0, 0

        def flushed() -> pa.RecordBatch:
            code, place, part = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, code))
            code, place, part = code[order], place[order].astype(np.int32), part[order].astype(np.int32)
            which, counts = np.unique(code, return_counts=True)
            terms = pa.array(list(known), pa.binary()).cast(pa.string()).take(pa.array(which))
            ids = np.concatenate(names)
            rows = [terms, packed_strings(place, counts), packed_strings(part, counts)]
            own = [pa.array([""]), packed_strings(ids, np.array([len(ids)])), pa.array([b""], pa.binary())]
            term, docs, scores = (pa.concat_arrays(x) for x in zip(rows, own, strict=True))
            return pa.RecordBatch.from_arrays([term, pa.array(np.full(len(term), turn)), docs, scores], schema=_LISTS)

        for batch in batches:
            every = batch.column("doc_id").to_numpy()
            for rows, size, at, tf, code, terms in _asked_terms(batch, asked):
                code = np.array([known.setdefault(x, len(known)) for x in terms.to_pylist()], np.int64)[code] if len(code) else code
                m = 100 - 25 + (25 * size[at] * n_docs) // n_terms
                parts.append((code, n + at, (1_000_000_000 * tf) // (1000 * tf + 12 * m)))
                names.append(every[rows])
                held, n = held + len(code), n + len(rows)
                if held >= SLICE or n >= SLICE_DOCS:
                    yield flushed()
                    turn, held, n = turn + 1, 0, 0
                    known.clear(), parts.clear(), names.clear()
        if parts:
            yield flushed()

    return run


def _heads(k: int):
    """The k highest entries of each term in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for term, part, w, docs, parts in zip(*(batch.column(x).to_pylist() for x in ("term", "slice", "w", "docs", "parts")), strict=True):
                docs, scores = np.frombuffer(docs, np.int32).astype(np.int64), w * np.frombuffer(parts, np.int32).astype(np.int64)
                found = (np.full(len(docs), part), docs, scores)
                if term in best:
                    found = tuple(np.concatenate(x) for x in zip(best[term], found, strict=True))
                if len(found[1]) > k:
                    some = np.argpartition(-found[2], k)[:k]
                    found = tuple(x[some] for x in found)
                best[term] = found
        names = list(best)
        for lo in range(0, len(names), 1000):
            some = names[lo : lo + 1000]
            size = [len(best[x][1]) for x in some]
            yield pa.RecordBatch.from_arrays([pa.array(some).take(pa.array(np.repeat(np.arange(len(some)), size))), *(pa.array(np.concatenate([best[x][i] for x in some])) for i in range(3))], schema=_HEADS)

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of asked documents in one list: those that have the term."""
    for batch in batches:
        columns = [batch.column(x).to_pylist() for x in ("slice", "w", "docs", "parts", "item", "place", "c")]
        found = []
        for part, w, docs, parts, item, place, c in zip(*columns, strict=True):
            docs = np.frombuffer(docs, np.int32)
            item, place, c = (np.array(x, np.int64) for x in (item, place, c))
            at = np.minimum(np.searchsorted(docs, place.astype(np.int32)), len(docs) - 1)
            on = docs[at] == place
            found.append((item[on], np.full(on.sum(), part), place[on], c[on] * w * np.frombuffer(parts, np.int32)[at[on]].astype(np.int64)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=_SCORES)


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of each list from its threshold on, with the items that ask for it."""
    for batch in batches:
        docs, counts = unpacked(batch.column("docs"), np.int32)
        parts = unpacked(batch.column("parts"), np.int32)[0]
        w = batch.column("w").to_numpy()
        on = np.repeat(w, counts) * parts >= np.repeat(batch.column("need").to_numpy(), counts)
        left = np.diff(np.append(0, np.cumsum(on))[np.append(0, np.cumsum(counts))])
        out = pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("slice"), batch.column("w"), packed_strings(docs[on], left), packed_strings(parts[on], left), *(batch.column(x) for x in ASKED)], names=["grp", "slice", "w", "docs", "parts", *ASKED])
        yield out.filter(pa.array(left > 0))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_ids of places in slices."""
    for batch in batches:
        for ids, item, place, score in zip(*(batch.column(x).to_pylist() for x in ("ids", "item", "place", "score")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(np.frombuffer(ids, np.int64)[place]), pa.array(score, pa.int64())], schema=_NAMED)


def _candidates(k: int):
    """Bounds of a slice's documents for each item of a group; those stay whose upper bound reaches the item's bound or the k-th lower bound of the slice."""

    def bounds(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        at = [np.frombuffer(r["docs"], np.int32) for r in rows]
        scores = [r["w"] * np.frombuffer(r["parts"], np.int32).astype(np.int64) for r in rows]
        n = 1 + max(int(x[-1]) for x in at)
        asked: dict[int, list[tuple[int, int, int]]] = {}
        limits: dict[int, tuple[int, int]] = {}
        for i, r in enumerate(rows):
            for item, c, cap, total, tau in zip(*(r[x] for x in ASKED), strict=True):
                asked.setdefault(item, []).append((i, c, cap))
                limits[item] = total, tau
        for item, lists in asked.items():
            low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, c, cap in lists:
                low[at[i]] += c * scores[i]
                high[at[i]] -= cap
            total, tau = limits[item]
            seen = low > 0
            bound = max(tau, int(np.partition(low, len(low) - k)[len(low) - k])) if len(low) >= k else tau
            high += low + total
            on = np.flatnonzero(seen & (high >= bound))
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(on), item), np.full(len(on), part), on, low[on], high[on])], schema=_CANDIDATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["grp"], r["slice"]) != key:
                    if rows:
                        yield from bounds(key[1], rows)
                    key, rows = (r["grp"], r["slice"]), []
                rows.append(r)
        if rows:
            yield from bounds(key[1], rows)

    return run


def best(found: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The k rows of each item with the highest value, with their rank."""
    order = Window.partitionBy("item_id").orderBy(F.desc(by), *ties)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def kth(found: DataFrame, by: str, k: int) -> DataFrame:
    """(item_id, tau): the k-th highest value of each item that has k."""
    top = best(found, by, k, "slice", "place")
    return top.groupBy("item_id").agg(F.min(by).alias("tau"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).select("item_id", "tau")


def looked_up(lists: DataFrame, items: DataFrame, n_items: int, wanted: DataFrame) -> DataFrame:
    """(item_id, slice, place, score) of wanted(item_id, slice, place), from the lists."""
    salt = F.pmod(F.xxhash64("item_id"), F.lit(max(1, n_items // TOGETHER)))
    rows, n = counted(wanted.join(bounded(items, n_items), "item_id").select("item_id", "slice", "place", "term", "c"))
    packed = rows.groupBy("term", "slice", salt.alias("salt")).agg(F.collect_list("item_id").alias("item"), F.collect_list("place").alias("place"), F.collect_list("c").alias("c"))
    packed = F.broadcast(packed) if n <= FEW else packed
    return lists.join(packed, ["term", "slice"]).mapInArrow(_looked_up, SCORES).groupBy("item_id", "slice", "place").agg(F.sum("s").alias("score"))


def ranked_search(items: DataFrame, docs: DataFrame, k: int = RESULTS) -> DataFrame:
    """For each item (item_id, text) the k documents (doc_id, text) with the highest scores above 0.

    Returns (item_id, rank, doc_id, score); equal scores rank by ascending doc_id. Terms are runs of ASCII
    letters and digits and of all other characters beyond ASCII, A-Z lower-cased, in the whole text; the weight
    of a term and the score follow the corpus counts of all documents in 64-bit integers. A null or empty text
    has no terms: as an item it has no rows, as a document it is no result. Rows without an id are left out, of
    rows that repeat one the smallest text counts. Other columns are ignored, whatever their names. A text is
    handled whole, in memory in proportion to its length.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    items, n_items = counted(keyed(items.select(F.col("item_id").alias("doc_id"), "text")).mapInArrow(_item_terms, TERMS))
    words, texts = _bitmap(items), keyed(docs)
    counts = saved(texts.mapInArrow(_counts(words), COUNTS).groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_terms").alias("n_terms")))
    corpus = counts.where("term = ''").first()
    n_docs, n_terms = (corpus.n, max(1, corpus.n_terms)) if corpus else (0, 1)
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("n") + 1))).cast("long")
    weights, n_weights = counted(items.select("term").distinct().join(counts, "term").select("term", weight.alias("w")).where("w > 0"))

    # a slice is what one task reads between two flushes, so its places need rows in a fixed order
    every = saved(texts.sortWithinPartitions("doc_id").mapInArrow(_postings(words, n_docs, n_terms), LISTS).repartition(n, "term", "slice"))
    lists = every.join(bounded(weights, n_weights), "term")

    order = Window.partitionBy("term").orderBy(F.desc("s"), "slice", "place")
    heads = saved(lists.mapInArrow(_heads(HEAD * k), HEADS).withColumn("at", F.row_number().over(order)).where(F.col("at") <= HEAD * k))
    sums = heads.join(bounded(items, n_items), "term").groupBy("item_id", "slice", "place").agg(F.sum(F.col("c") * F.col("s")).alias("low"))
    tau = kth(looked_up(lists, items, n_items, best(sums, "low", LOOKUPS * k, "slice", "place")), "score", k)

    tops = heads.groupBy("term").agg(F.max("s").alias("top"))
    asked = items.join(tops, "term").join(tau, "item_id", "left").fillna(0, ["tau"])
    grouped = F.pmod(F.xxhash64("item_id"), F.lit(-(-n_items // GROUP) or 1)).alias("grp")
    asked = asked.select("*", grouped, F.count(F.lit(1)).over(Window.partitionBy("item_id")).alias("m"))
    need = F.greatest(F.lit(1), F.expr(f"(tau + {SHARE} * m * c - 1) div ({SHARE} * m * c)"))
    asked = asked.withColumn("need", F.min(need).over(Window.partitionBy("term", "grp")))
    asked = asked.withColumn("cap", F.col("c") * F.least("top", F.col("need") - 1))
    asked = asked.withColumn("total", F.sum("cap").over(Window.partitionBy("item_id"))).withColumnRenamed("item_id", "item")
    asked, n_asked = counted(asked.groupBy("term", "grp").agg(F.first("need").alias("need"), *(F.collect_list(x).alias(x) for x in ASKED)))

    fetched = lists.join(bounded(asked, n_asked), "term").mapInArrow(_fetched, FETCHED)
    found = saved(fetched.repartition(n, "grp", "slice").sortWithinPartitions("grp", "slice").mapInArrow(_candidates(k), CANDIDATES))
    rest = found.join(kth(found, "low", k), "item_id", "left").where("tau IS NULL OR high >= tau")
    scores = looked_up(lists, items, n_items, rest.select("item_id", "slice", "place")).where("score > 0")
    by_slice = scores.groupBy("slice").agg(F.collect_list("item_id").alias("item"), F.collect_list("place").alias("place"), F.collect_list("score").alias("score"))
    named = every.where("term = ''").select("slice", F.col("docs").alias("ids")).join(by_slice, "slice").mapInArrow(_named, NAMED)
    return best(named, "score", k, "doc_id").select("item_id", "rank", "doc_id", "score")
