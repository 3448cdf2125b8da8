"""Periodic runs, ranked search and exact top-k against brute force on small tables."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from brindle.llm import periodic_runs as periodic
from brindle.llm import queries, ranked_search as ranked, topk_search as topk
from brindle.llm.periodic_runs import periodic_runs
from brindle.llm.ranked_search import ranked_search
from brindle.llm.topk_search import topk_search

DOCS = "doc_id long, text string, runs string, term string, start int"


def frame(spark, texts, ids=None):
    """Texts with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def all_runs(w):
    found = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            part = w[s : i + q]
            if i > s and len(part) >= max(12, 2 * q) and not any(all(a == b for a, b in zip(part, part[p:], strict=False)) for p in range(1, q)):
                found.add((s, len(part), q))
            i = max(i, s + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_texts():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "ab ba " * 300, "é\x00 " * 40, "  x " * 20]
    for _ in range(60):
        w = [str(rng.randrange(rng.choice([1, 2, 3, 60]))) for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(4)):
            if len(w) > 20:
                a, p = rng.randrange(len(w)), rng.randrange(1, 30)
                for i in range(a + p, min(len(w), a + p * rng.randrange(2, 6))):
                    w[i] = w[i - p]
        texts.append(rng.choice([" ", "\n\t"]).join(w))
    return texts


@pytest.mark.parametrize(("frequent", "step"), [(64, 1 << 22), (2, 300)])
def test_periodic_runs(spark, monkeypatch, frequent, step):
    monkeypatch.setattr(periodic, "FREQUENT", frequent)
    monkeypatch.setattr(periodic, "STEP", step)
    texts = periodic_texts()
    out = {r.doc_id: r for r in periodic_runs(frame(spark, texts)).collect()}
    some = 0
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = all_runs(w)
        assert [(r.start, r.length, r.period) for r in out[i].runs] == want
        assert (out[i].n_words, out[i].n_runs) == (len(w), len(want))
        gone = {j for s, n, q in want for j in range(s + q, s + n)}
        assert out[i].collapsed_text == " ".join(x for j, x in enumerate(w) if j not in gone)
        longest = min(want, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (out[i].start, out[i].length, out[i].period) == longest
        some += len(want)
    assert some > 60


def test_periodic_runs_keys_and_long_text(spark):
    rng = random.Random(4)
    page = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))
    texts = [page + " " + page, "b " * 14, "a " * 14, "c", page]
    out = {r.doc_id: r for r in periodic_runs(frame(spark, texts, [1, 2, 2, None, 3])).collect()}
    assert sorted(out) == [1, 2, 3] and len(texts[0]) > 800_000
    assert [(r.start, r.length, r.period) for r in out[1].runs] == [(0, 120_000, 60_000)] and out[1].collapsed_text == page
    assert out[2].collapsed_text == "a" and out[3].n_runs == 0
    assert periodic_runs(frame(spark, [])).count() == 0


def test_planted_period(spark):
    import zlib

    texts = [" ".join(f"w{j}" for j in range(n % 50)) for n in range(400)]
    docs = frame(spark, texts)
    got = {r.doc_id: r.text for r in docs.select("doc_id", queries.planted(docs.text, docs.doc_id).alias("text")).collect()}
    changed = 0
    for i, text in enumerate(texts):
        h = zlib.crc32(str(i).encode())
        w, g = text.split(), h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (j - a) % p] if j >= a else w[j] for j in range(len(w))]
            changed += 1
        assert got[i] == " ".join(w)
    assert changed > 20


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranking(items, docs, k):
    """Every document scored for every item."""
    terms = lambda text: TERM.findall((text or "").translate(LOWER))
    bags = {d: Counter(terms(t)) for d, t in docs.items()}
    size = {d: sum(b.values()) for d, b in bags.items()}
    n, total = sum(x > 0 for x in size.values()), sum(size.values())
    df = Counter(t for b in bags.values() for t in b)
    out = []
    for item, text in items.items():
        scores = {}
        for t, c in Counter(terms(text)).items():
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
            for d, bag in bags.items():
                if bag[t]:
                    m = 100 - 25 + (25 * size[d] * n) // total
                    scores[d] = scores.get(d, 0) + c * w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m))
        best = sorted((-s, d) for d, s in scores.items() if s > 0)[:k]
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(best)]
    return sorted(out)


def search_tables():
    rng = random.Random(8)
    words = [f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(6000)] + ["The", "THE", "Ünal", "über", "naïve-x", "ÀB", "c_d"]
    docs = {i: " ".join(rng.choices(words, k=rng.randrange(1, 80))) for i in range(0, 900, 3)}
    docs |= {i: docs[0] for i in range(5000, 5040)}  # ties beyond the 20 results
    docs |= {7000: None, 7001: "", 7002: "--- !!", 7003: "t5 " * 3000, -4: docs[3], 7004: "\x00\x7f t7"}
    items = {i: " ".join(rng.choices(words, k=rng.randrange(1, 40))) for i in range(30)}
    items |= {40: docs[0], 41: None, 42: "", 43: "absent", 44: "the the The", 45: "t5 t5 über"}
    return items, docs


@pytest.mark.parametrize(("cut", "head"), [(500_000, 10), (60, 1)])
def test_ranked_search(spark, monkeypatch, cut, head):
    """Slices of many documents and of few, deep and short heads."""
    monkeypatch.setattr(ranked, "SLICE", cut)
    monkeypatch.setattr(ranked, "HEAD", head)
    monkeypatch.setattr(ranked, "LOOKUPS", head)
    monkeypatch.setattr(ranked, "GROUP", 40)
    items, docs = search_tables()
    rows = spark.createDataFrame([*((i, t, 1) for i, t in items.items()), (None, "t5", 1)], "item_id long, text string, doc_id int")
    got = ranked_search(rows, frame(spark, [*docs.values(), "t5 t6"], [*docs, None]))
    assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == ranking(items, docs, 20)


def test_ranked_search_repeated_keys_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "b a"), (1, "c"), (2, "a")], "item_id long, text string")
    docs = frame(spark, ["a x", "b b", "c d", "e f", "g h"], [1, 1, 2, 3, 4])
    want = ranking({1: "b a", 2: "a"}, {1: "a x", 2: "c d", 3: "e f", 4: "g h"}, 20)
    assert sorted(tuple(r) for r in ranked_search(items, docs).collect()) == want and want
    assert ranked_search(items, frame(spark, [])).count() == 0
    assert ranked_search(items.where("item_id = 9"), docs).count() == 0
    assert ranked_search(items, frame(spark, [None, " "])).count() == 0


def test_ranked_search_very_long_text(spark):
    docs = {1: "a " + "b " * 1_500_000, 2: "a", 3: "c", 4: "d", 5: "e"}
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = sorted(tuple(r) for r in ranked_search(items, frame(spark, list(docs.values()), list(docs))).collect())
    assert got == ranking({1: "a b c"}, docs, 20)


def products(rows, every, k):
    fine = {i: [math.floor(256 * x) for x in v] for i, v in rows.items() if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out, ends = [], (-(2**63), 2**63 - 1)
    clip = lambda x: min(ends[1], max(ends[0], x))
    fine = {i: [clip(x) for x in v] for i, v in fine.items()}
    for q in (i for i in fine if i % every == 0):
        scores = sorted((-clip(sum(a * b for a, b in zip(fine[q], v, strict=True))), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, 3, "z") for i, v in rows], "vec_id long, embedding array<double>, dim int, ids string")


@pytest.mark.parametrize(("rows", "queries_", "columns"), [(8192, 256, 16), (40, 3, 5)])
def test_topk_search(spark, monkeypatch, rows, queries_, columns):
    for name, x in (("ROWS", rows), ("QUERIES", queries_), ("COLUMNS", columns)):
        monkeypatch.setattr(topk, name, x)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 23))
    x[40:80] = x[0] + 0.1 * rng.standard_normal((40, 23))
    x[100:120] = x[50]  # equal scores
    table = {i: v.tolist() for i, v in enumerate(x)}
    table |= {500: None, 501: [None] * 23, 502: [math.nan] * 23, 503: [math.inf] * 23, 550: [0.0] * 23, 600: [1.0, 2.0], 650: [3.0, -1.0], 651: [0.001, 0.5], 700: [9.0] * 3, 750: [], 751: [], -50: x[7].tolist()}
    got = topk_search(vector_table(spark, [*table.items(), (None, [1.0] * 23)]))
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == products(table, 50, 5)


def test_topk_search_large_components(spark):
    rng = np.random.default_rng(6)
    table = {i: (rng.standard_normal(4) * 10.0 ** int(rng.integers(-2, 14))).tolist() for i in range(0, 300, 5)}
    table |= {1: [1e300] * 4, 2: [-1e300, 1e17, 3.0, 0.0], 350: [2e17, -1.0, 1e300, 0.5]}
    got = sorted(tuple(r) for r in topk_search(vector_table(spark, list(table.items()))).collect())
    assert got == products(table, 50, 5) and any(s == 2**63 - 1 for *_, s in got)


def test_topk_search_repeated_keys_and_empty_table(spark):
    rows = [(50, [1.0, 1.0]), (50, [2.0, 2.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (100, [5.0])]
    got = sorted(tuple(r) for r in topk_search(vector_table(spark, rows)).collect())
    assert got == [(50, 1, 3, 65536)]
    assert topk_search(vector_table(spark, [])).count() == 0
    assert topk_search(vector_table(spark, [(7, [1.0])])).count() == 0


def test_topk_search_over_shares(spark, monkeypatch):
    """Shares send k rows for a query, so less is shuffled than there are pairs."""
    monkeypatch.setattr(topk, "SHARE", 900, raising=False)
    x = np.random.default_rng(8).standard_normal((4000, 17))
    table = {i: v.tolist() for i, v in enumerate(x)}
    df = vector_table(spark, list(table.items()))
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    time.sleep(1)  # the figures come late
    before = sent()
    got = sorted(tuple(r) for r in topk_search(df).collect())
    time.sleep(1)
    assert got == products(table, 50, 5)
    assert sent() - before < 8 * 80 * 4000 / 2
