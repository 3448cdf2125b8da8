"""Toxicity by nearest labelled examples under exact TF-IDF cosine (operator 1).

A bounded sample of labelled documents (``EXAMPLES`` of each class, those with the smallest hashes of
their ids) serves as examples. Terms are lower-cased words of letters and their beginnings; the terms that
tell the classes apart in the sample are kept, at most ``TERMS``, and weighed by their inverse document
frequency in all documents. The examples form an inverted index in blocks; each posting list knows the
largest weight of each block, so a block whose summed bounds stay below the k-th best similarity is never
scored, and the k nearest are exact. Their votes, weighed by similarity, become a calibrated score by a
monotone fit on the examples, each scored without itself. Index and terms are bounded by the parameters,
so they are shipped to the tasks; every document is scored in the task that reads it, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.blocks import BYTE_BASE, LOWER, NO_LETTER, U64, mix, prefix_hash, ragged, span_hash, text_bytes, whole_texts, word_bounds
from brindle.llm.saved import saved

EXAMPLES = 3000
TERMS = 4096
BEGINNINGS = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 64
#: Least number of examples with a term. A term is kept if the chi-square of its classes exceeds 2 log(number
#: of terms), which few terms reach by chance.
MIN_EXAMPLES = 3
#: Weight of the share of toxic examples among the votes.
PRIOR_WEIGHT = 0.05
FOLDS = 5

RESULT = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id: long, similarity: double, toxic: int>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", _EVIDENCE)])


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, hash) of every occurrence of a term, for one kind of term at a time."""
    data = LOWER[data]
    start, end, text = word_bounds(data, offsets, NO_LETTER)
    prefix = prefix_hash(data, BYTE_BASE)
    yield text, mix(span_hash(prefix, start, end, BYTE_BASE))
    for n in BEGINNINGS:
        on = end - start > n
        yield text[on], mix(span_hash(prefix, start[on], start[on] + n, BYTE_BASE) ^ U64(n))


class Terms:
    """Known terms by hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.seen = np.zeros(1 << 18, bool)
        self.seen[(self.hashes >> U64(46)).astype(np.int64)] = True

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, term, occurrences) by text and term."""
        keys = []
        for text, h in term_hashes(data, offsets):
            on = np.flatnonzero(self.seen[(h >> U64(46)).astype(np.int64)])
            at = np.searchsorted(self.hashes, h[on])
            hit = (at < len(self.hashes)) & (self.hashes[np.minimum(at, len(self.hashes) - 1)] == h[on]) if len(self.hashes) else np.zeros(len(on), bool)
            keys.append(text[on[hit]] * len(self.hashes) + at[hit])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        size = max(1, len(self.hashes))
        return key // size, key % size, count


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples of each class with each term, summed over the rows of a task."""
    found, toxic = [], []
    for batch in batches:
        label = batch.column("toxic").to_numpy()
        for rows, data, offsets in whole_texts(*text_bytes(batch.column("text"))):
            pairs = [np.stack([h, t.astype(U64)]) for t, h in term_hashes(data, offsets)]
            pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
            found.append(pairs[0]), toxic.append(label[rows][pairs[1].astype(np.int64)])
    if found:
        h, back = np.unique(np.concatenate(found), return_inverse=True)
        bad = np.bincount(back, weights=np.concatenate(toxic), minlength=len(h)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"term": h.view(np.int64), "bad": bad, "total": np.bincount(back, minlength=len(h))})


def _document_counts(terms: Terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms.hashes) + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, data, offsets in whole_texts(*text_bytes(batch.column("text"))):
                total += np.bincount(terms.of(data, offsets)[1], minlength=len(total))
        total[-1] = n  # the last entry counts the documents
        yield pa.RecordBatch.from_pydict({"term": np.arange(len(total)), "n": total})

    return run


def _example_vectors(terms: Terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column("doc_id").to_numpy(), batch.column("toxic").to_numpy()
            for rows, data, offsets in whole_texts(*text_bytes(batch.column("text"))):
                text, term, count = terms.of(data, offsets)
                ends = np.searchsorted(text, np.arange(len(rows) + 1))
                yield pa.RecordBatch.from_pydict({"doc_id": ids[rows], "toxic": label[rows], "terms": pa.array([term[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.list_(pa.int64())), "counts": pa.array([count[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.list_(pa.int64()))})

    return run


class Index:
    """Postings by term in blocks of ``BLOCK`` examples, with the largest weight of each block."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray):
        self.idf = idf
        unit = [self.unit(t, c) for t, c in vectors]
        strongest = np.array([t[np.argmax(w)] if len(t) else -1 for (t, _), w in zip(vectors, unit, strict=True)])
        order = np.lexsort((ids, toxic, strongest))  # alike examples share blocks, which makes their bounds tight
        self.ids, self.toxic = ids[order], toxic[order].astype(np.int64)
        example = np.concatenate([np.full(len(vectors[k][0]), i) for i, k in enumerate(order)] or [np.empty(0, np.int64)]).astype(np.int64)
        term = np.concatenate([vectors[k][0] for k in order] or [np.empty(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([unit[k] for k in order] or [np.empty(0)])
        by = np.lexsort((example, term))
        example, term, weight = example[by], term[by], weight[by]
        block = example // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        self.example, self.weight = example, weight
        self.start, self.stop = start, np.append(start[1:], len(term))
        self.block, self.most = block[start], np.maximum.reduceat(weight, start) if len(start) else np.empty(0)
        self.lists = np.searchsorted(term[start], np.arange(len(idf) + 1))
        self.blocks = -(-len(ids) // BLOCK)

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / (np.sqrt((w * w).sum()) or 1)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples, ties to the earlier one, and their similarity; only those above 0."""
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        size = self.lists[terms + 1] - self.lists[terms]
        entry = ragged(self.lists[terms], size)  # (term, block) pairs of the query's posting lists
        weight, block = np.repeat(weights, size), self.block[entry]
        bound = np.bincount(block, weights=weight * self.most[entry], minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        first = np.zeros(self.blocks, bool)
        first[order[: -(-k // BLOCK) + 1]] = True
        found, score = self._scored(first, entry, weight, block, without)
        floor = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else 0.0
        rest = ~first & (bound > 0) & (bound >= floor - 1e-12)
        if rest.any():
            more, other = self._scored(rest, entry, weight, block, without)
            found, score = np.append(found, more), np.append(score, other)
        best = np.lexsort((self.ids[found], -score))[:k]
        return found[best], score[best]

    def _scored(self, blocks: np.ndarray, entry: np.ndarray, weight: np.ndarray, block: np.ndarray, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Examples with similarity above 0 in some blocks."""
        on = blocks[block]
        some, n = entry[on], (self.stop - self.start)[entry[on]]
        at = ragged(self.start[some], n)
        total = np.bincount(self.example[at], weights=self.weight[at] * np.repeat(weight[on], n), minlength=len(self.ids))
        if without is not None:
            total[self.ids == without] = 0
        found = np.flatnonzero(total > 0)
        return found, total[found]


class Model:
    """Terms, index and calibration."""

    def __init__(self, terms: Terms, index: Index, share: float):
        self.terms, self.index, self.share = terms, index, share
        self.steps, self.values = np.array([0.0]), np.array([share])

    def vote(self, near: np.ndarray, similarity: np.ndarray) -> float:
        pull = similarity / np.maximum(1 - similarity, 0.05)
        return float(((pull * self.index.toxic[near]).sum() + PRIOR_WEIGHT * self.share) / (pull.sum() + PRIOR_WEIGHT))

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> None:
        """Pools adjacent votes until the share of toxic examples rises with the vote."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []
        for v, y, w in zip(votes[order].tolist(), toxic[order].tolist(), weight[order].tolist(), strict=True):
            if pools and pools[-1][0] == v:
                pools[-1][1] += w * y
                pools[-1][2] += w
            else:
                pools.append([v, w * y, w])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, a, b = pools.pop()
                pools[-1][1] += a
                pools[-1][2] += b
        if pools:
            self.steps = np.array([p[0] for p in pools])
            self.values = np.array([p[1] / p[2] for p in pools])

    def score(self, vote: float) -> float:
        """The calibrated share, raised a little by the vote inside its step."""
        at = max(0, int(np.searchsorted(self.steps, vote, side="right")) - 1)
        return float(0.999 * self.values[at] + 0.001 * vote)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Fits on the labelled documents outside the held-out fold; what reaches the driver is bounded by ``examples`` and ``TERMS``."""
    train = labels.selectExpr("cast(doc_id AS long) AS doc_id", "cast(toxic AS int) AS toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = train.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    n = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    picked = None
    for c in (0, 1):
        one = train.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        picked = one if picked is None else picked.unionByName(one)
    rows = picked.collect()
    spark = docs.sparkSession
    bounded = spark.createDataFrame([(r.doc_id, r.toxic) for r in rows], "doc_id long, toxic int")
    sample = docs.join(F.broadcast(bounded), "doc_id").select("doc_id", "toxic", "text")  # 2 * examples rows
    counts = sample.mapInArrow(_sample_terms, "term long, bad long, total long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("total").alias("total")).where(F.col("total") >= MIN_EXAMPLES)
    counts = saved(counts)
    n_bad = float(sum(r.toxic for r in rows))
    n_all = float(max(1, len(rows)))
    a, t = F.col("bad").cast("double"), F.col("total").cast("double")
    expected = t * n_bad * (n_all - n_bad) * (n_all - t)
    chi = F.when(expected > 0, n_all * F.pow(a * (n_all - n_bad) - (t - a) * n_bad, 2) / expected).otherwise(0.0)
    chosen = counts.select("term", chi.alias("chi")).where(F.col("chi") >= 2 * float(np.log(max(2, counts.count())))).orderBy(F.desc("chi"), "term").limit(TERMS).collect()
    terms = Terms(np.array([r.term for r in chosen], np.int64).view(U64))
    df = np.zeros(len(terms.hashes) + 1, np.int64)
    for r in docs.select("text").mapInArrow(_document_counts(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1
    table = sorted(sample.mapInArrow(_example_vectors(terms), "doc_id long, toxic int, terms array<long>, counts array<long>").collect(), key=lambda r: r.doc_id)
    vectors = [(np.array(r.terms, np.int64), np.array(r.counts, np.int64)) for r in table]
    ids, toxic = np.array([r.doc_id for r in table], np.int64), np.array([r.toxic for r in table], np.int64)
    index = Index(ids, toxic, vectors, idf)
    model = Model(terms, index, share)
    votes = np.array([model.vote(*index.nearest(v[0], index.unit(*v), NEIGHBOURS, without=int(i))) for i, v in zip(ids, vectors, strict=True)])
    weight = np.where(toxic == 1, share / max(1, toxic.sum()), (1 - share) / max(1, (1 - toxic).sum()))
    model.calibrate(votes, toxic, weight)
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, list]] = {}
        for batch in batches:
            scores, evidence = [], []
            for rows, data, offsets in whole_texts(*text_bytes(batch.column("text"))):
                text, term, count = model.terms.of(data, offsets)
                ends = np.searchsorted(text, np.arange(len(rows) + 1)).tolist()
                for a, b in zip(ends, ends[1:], strict=False):
                    key = term[a:b].tobytes() + b"|" + count[a:b].tobytes()
                    if key not in known:
                        if len(known) > 100_000:
                            known.clear()
                        near, similarity = model.index.nearest(term[a:b], model.index.unit(term[a:b], count[a:b]), NEIGHBOURS)
                        proof = [{"doc_id": int(model.index.ids[i]), "similarity": float(s), "toxic": int(model.index.toxic[i])} for i, s in zip(near.tolist(), similarity.tolist(), strict=True)]
                        known[key] = model.score(model.vote(near, similarity)), proof
                    one = known[key]
                    scores.append(one[0]), evidence.append(one[1])
            score = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence, _EVIDENCE)], schema=_RESULT)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Scores every row of docs; evidence holds the nearest labelled examples with their similarity.

    Returns (doc_id, held_out, score, predicted, evidence). Only labels of documents outside the held-out
    fold, crc32(doc_id as text) mod 5 = 0, are learned from. Text is the only input of a score: a null,
    empty or unrelated text gets the calibrated share of documents without known terms. Without toxic
    labels every score is that share, 0. doc_id may be null (held_out is false then) or repeat; rows of
    labels with nulls are ignored, and of repeated ones the largest label counts.
    """
    docs = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    model = fit(docs, labels, examples)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(_score(model), RESULT)
