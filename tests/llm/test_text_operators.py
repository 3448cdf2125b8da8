"""Text operators against brute force on small documents with copies, repeats, nulls, empty and long texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from brindle.llm import ngram_join, packing, piece_sampling, saved, suffix_dedup, token_counts
from brindle.llm.ngram_join import ngram_join as join
from brindle.llm.packing import pack_documents
from brindle.llm.piece_sampling import decode, sample_segmentations
from brindle.llm.substring_dedup import substring_dedup
from brindle.llm.token_counts import token_counts as count

# Columns of the input whose names clash with those inside the operators.
SCHEMA = "doc_id long, text string, pos int, found string, n long, skey string, label string, bits string, kept_text string"


def documents(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé漢 ".strip()) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    for i in range(0, n, 5):
        texts[i] = texts[i] + "\n" + passage + ("." if i % 2 else " x ") + texts[i][:50]
    for i in range(3, n, 9):
        texts[i] = texts[i - 3]
    for i in range(7, n, 11):
        words = texts[i - 7].split(" ")
        words[len(words) // 2] = "CHANGED"
        texts[i] = " ".join(words)
    texts += ["", None, "  \t\n", "one two", "ONE two", passage * 40, "a " * 400, "x" * 350, "<|endoftext|> it's <|startoftext|>", "é İ ΣΣ 'll 've's"]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "f", 2, "s", "l", "b", "k") for i, t in rows], SCHEMA)


def words_of(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    out, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def roots(n_ids, pairs):
    root = {i: i for i in n_ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n_ids}


@pytest.fixture(scope="module")
def rows():
    return documents()


def test_suffix_dedup(spark, rows):
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    assert got == want


def test_suffix_dedup_of_cut_texts(spark, rows, monkeypatch):
    """Texts longer than a piece are cut with overlap."""
    whole = {r.doc_id: r.kept_sha256 for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()}
    data = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
    cut = [p for p in suffix_dedup.pieces(data, np.array([0, len(data)]), overlap=99, limit=1000)]
    starts = np.concatenate([suffix_dedup.Runs(p).start + p.base for p in cut])
    counts = np.concatenate([suffix_dedup.Runs(p).count for p in cut])
    assert counts.sum() == len(data) - 99 and len(np.unique(starts)) == len(starts) and whole


def test_short_phrases_bring_no_segments_together():
    """A phrase below an anchor's length, with other surroundings in each text, shares no probe; 100 common bytes do."""
    rng = np.random.default_rng(1)
    probes = lambda common: [set(suffix_dedup.Runs(suffix_dedup.Piece(np.arange(1), d, np.array([0, len(d)]))).h.tolist()) for d in (np.concatenate([rng.integers(97, 123, 150), common, rng.integers(97, 123, 150)]).astype(np.uint8) for _ in range(2))]
    for _ in range(30):
        a, b = probes(rng.integers(97, 123, 60))
        assert not a & b
        a, b = probes(rng.integers(97, 123, 100))
        assert a & b


def test_suffix_order_is_the_order_of_bytes():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1500] = data[:500]
    starts, family = np.arange(2900), np.zeros(2900, np.int64)
    prefix = suffix_dedup.prefix_hash(data, suffix_dedup.BYTE_BASE)
    order = suffix_dedup.suffix_order(data, prefix, starts, family)
    keys = [bytes(data[s : s + 100]) for s in starts[order]]
    assert keys == sorted(keys)
    late = suffix_dedup.later_windows(data, starts, family, np.zeros(2900, np.int64), starts)
    assert late.sum() == 2900 - len(set(keys))


def test_substring_dedup(spark, rows):
    first, want = {}, {}
    for i, t in rows:
        w = words_of(t)
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, rows)).collect()}
    assert got == want


def shingles(text):
    w = words_of(text, lower=True)
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def check_join(spark, rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(list(sets), links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(frame(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_ngram_join(spark, rows):
    check_join(spark, rows)


def test_ngram_join_of_crowded_buckets(spark, monkeypatch):
    """Near copies around several bases, with buckets and rounds made small."""
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 10**6)}" for _ in range(80)] for _ in range(3)]
    base[1][:60] = base[0][:60]
    rows = []
    for i in range(60):
        w = list(base[i % 3])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"z{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "ALL_PAIRS", 3)
    monkeypatch.setattr(ngram_join, "AT_ONCE", 1)
    monkeypatch.setattr(ngram_join, "FEW", 1)
    monkeypatch.setattr(saved, "FEW", 1)
    check_join(spark, rows)


@pytest.mark.parametrize("size", range(31))
def test_group_pairs_of_few_probes(size):
    """A partition with any number of probes, none included."""
    rng = np.random.default_rng(size)
    h, g, n = rng.integers(1, 6, size).astype(np.uint64), rng.permutation(size).astype(np.int64), rng.integers(6, 12, size).astype(np.int32)
    batch = pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in (("h", h), ("doc", g), ("pos", n))})
    got = [x for b in ngram_join._group_pairs(iter([batch])) for x in b.to_pylist()]
    want = {(min(g[i], g[j]), max(g[i], g[j])) for i in range(size) for j in range(i) if h[i] == h[j] and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j])}
    crowded = {k for k in h.tolist() if (h == k).sum() > ngram_join.ALL_PAIRS}
    want = {(a, b) for a, b in want if h[g.tolist().index(a)] not in crowded}
    assert [(x["a"], x["b"]) for x in got if x["bucket"] is None] == sorted(want)
    assert sum(x["bucket"] is not None for x in got) == len(crowded)


@pytest.mark.parametrize("n_texts", [1, 2, 3])
def test_ngram_join_of_tiny_tables(spark, n_texts):
    words = [f"w{i}" for i in range(40)]
    check_join(spark, list(enumerate([" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(reversed(words))][:n_texts])))


def test_ngram_join_of_many_copies(spark):
    """Copies collapse to a few groups, whose probes are dealt over many partitions."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200)) for _ in range(20)]
    rows = [(i, texts[i % 20]) for i in range(4000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        got = {r.doc_id: r.component_id for r in join(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {i: i % 20 for i, _ in rows}


def no_stars(spark):
    one = "struct<skey:long,label:long,n:long,bits:binary>"
    return spark.createDataFrame([], f"k long, m array<{one}>, c array<{one}>")


def test_ngram_join_deals_large_buckets_in_blocks(spark, monkeypatch):
    """No row is longer than blocks of few members make it, links between crowded groups count, and the result is exact."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for p in rng.sample(range(0, 100, 10), i % 4):
            w[p] = f"z{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w[: 100 - i % 2])))
    sizes = spark.sparkContext.accumulator(0)
    stars = ngram_join._stars

    def watched(nearest):
        run = stars(nearest)

        def count(batches):
            for batch in batches:
                for m, c in zip(batch.column("m"), batch.column("c"), strict=True):
                    sizes.add(max(len(m), len(c)) > 60)
                yield from run(iter([batch]))

        return count

    monkeypatch.setattr(ngram_join, "_stars", watched)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "ALL_PAIRS", 3)
    check_join(spark, rows)
    monkeypatch.setattr(ngram_join, "_around_centers", lambda places, sets: no_stars(spark))  # all is left to pairs of blocks
    check_join(spark, rows)
    assert sizes.value == 0


def test_token_counts(spark, rows):
    library = token_counts.library(token_counts.VOCABULARY)
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in rows}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count(frame(spark, rows)).collect()}
    assert got == want


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    pieces = pack_documents(frame(spark, rows), length=256).collect()
    per_doc, per_sequence = {}, {}
    for r in pieces:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(part.tobytes()) == r.ids_crc32 and len(part) == r.length
        per_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        per_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(per_doc) == set(ids)
    for groups, end in ((per_doc, lambda k: len(ids[k])), (per_sequence, None)):
        for k, spans in groups.items():
            at = 0
            for start, n in sorted(spans):
                assert start == at
                at += n
            assert at == end(k) if end else at <= 256


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    order = np.argsort(packing.hilbert(points, bits=3))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_samples_round_trip_and_differ(spark, rows):
    rows = [(i, t) for i, t in rows if t is None or "<|" not in t]
    samples = sample_segmentations(frame(spark, rows), k=3)
    back = {(r.doc_id, r["sample"]): r.text for r in decode(samples).collect()}
    assert back == {(r.doc_id, r["sample"]): r.text for r in sample_segmentations(frame(spark, rows), k=3, decoded=True).collect()}
    got = samples.collect()
    texts = dict(rows)
    for r in got:
        assert back[r.doc_id, r["sample"]] == (texts[r.doc_id] or "")
        assert len(r.ids) == 4 * r.n_pieces and r.log_inclusion <= 1e-9
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append((r["sample"], r.ids, r.perturbed))
    for found in by_doc.values():
        found.sort()
        assert len({x[1] for x in found}) == len(found) and [x[2] for x in found] == sorted((x[2] for x in found), reverse=True)
    assert len(by_doc[next(i for i, t in rows if t == "")]) == 1


def test_sampling_follows_the_distribution():
    """First and second samples of a short text come as often as Gumbel top-k says."""
    n = 3000
    pieces = piece_sampling.vocabulary(piece_sampling.VOCABULARY)
    out = list(piece_sampling.sample_texts(np.arange(n) * 31 + 7, ["abcd"] * n, piece_sampling.Known(pieces), 2))
    p, seen = {}, [{}, {}]
    for k, x in enumerate(out):
        ends = np.append(0, np.cumsum(x["n"]))
        for i in range(n):
            key = x["ids"][ends[i] : ends[i + 1]].tobytes()
            p[key] = float(np.exp(x["log_prob"][i]))
            seen[k][key] = seen[k].get(key, 0) + 1
    for key, q in p.items():
        second = sum(p[o] * q / (1 - p[o]) for o in p if o != key)
        for k, want in ((0, q), (1, second)):
            assert abs(seen[k].get(key, 0) / n - want) < 4 * np.sqrt(want * (1 - want) / n) + 0.01


def test_samples_do_not_depend_on_other_rows(rows):
    """A text alone and among others, before and after its words are known: equal ids and equal doubles."""
    texts = [t or "" for _, t in rows]
    keys = np.arange(len(texts)) * 31 + 7
    store = piece_sampling.Known(piece_sampling.vocabulary(piece_sampling.VOCABULARY))
    together = list(piece_sampling.sample_texts(keys, texts, store, 2))
    for i in range(0, len(texts), 7):
        for own in (store, piece_sampling.Known(store.pieces)):
            alone = list(piece_sampling.sample_texts(keys[i : i + 1], texts[i : i + 1], own, 2))
            for x, y in zip(together, alone, strict=True):
                at = int(x["n"][:i].sum())
                if np.isfinite(x["perturbed"][i]):
                    assert x["ids"][at : at + x["n"][i]].tolist() == y["ids"].tolist()
                assert all(x[c][i] == y[c][0] for c in ("log_prob", "perturbed", "log_inclusion"))


def test_decode_of_odd_ids(spark):
    rows = [(1, 1, np.array([99_999, 1 << 31], "<u4").tobytes()), (2, 1, None), (3, 1, b"\x05"), (4, 1, b"")]
    got = {r.doc_id: r.text for r in decode(spark.createDataFrame(rows, "doc_id long, sample int, ids binary")).collect()}
    assert got[2] is None and got[3] == got[4] == "" and got[1].endswith("\ufffd")


EMPTY = {
    "suffix": lambda d: suffix_dedup.suffix_dedup(d),
    "substring": substring_dedup,
    "join": join,
    "count": count,
    "pack": pack_documents,
    "sample": sample_segmentations,
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_table(spark, name):
    assert EMPTY[name](frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["suffix", "substring", "join"])
def test_repeated_and_missing_keys(spark, name):
    """Rows that repeat a key count once, rows without one are left out."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "x y"), (2, None)]
    assert sorted(r.doc_id for r in EMPTY[name](frame(spark, rows)).collect()) == [1, 2]


@pytest.mark.parametrize("name", ["count", "pack", "sample"])
def test_row_operators_keep_every_row(spark, name):
    rows = [(1, "a"), (1, "a"), (None, "a"), (2, None)]
    got = [r.doc_id for r in EMPTY[name](frame(spark, rows)).collect()]
    assert got.count(1) >= 2 and got.count(None) >= 1 and got.count(2) >= 1


def test_token_counts_of_odd_characters(spark):
    """Newer characters than Python's tables, and lower-casing that leaves marks out of canonical order."""
    rng = random.Random(8)
    ranges = [(0x20, 0x7E), (0x20, 0x250), (0x370, 0x6FF), (0x900, 0xDFF), (0x13460, 0x143FA), (0x10D50, 0x10D85), (0x1F300, 0x1FAFF)]
    texts = ["".join(rng.choice([chr(rng.randint(*rng.choice(ranges[: 4 + i % 4]))), *"'́Σİ "]) for _ in range(rng.randint(1, 40))) for i in range(1500)]
    library = token_counts.library(token_counts.VOCABULARY)
    got = {r.doc_id: r.n_tokens for r in count(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
