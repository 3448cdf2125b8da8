"""Vectors, licences, toxicity and the pipeline against brute force on small tables."""

import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import embedding_dedup, vector_search
from brindle.llm.components import components
from brindle.llm.embedding_dedup import embedding_dedup as dedup
from brindle.llm import licenses
from brindle.llm.licenses import license_scan
from brindle.llm.toxicity import toxicity
from brindle.llm.vector_search import vector_search as search

ODD = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] * 8, [1.0, None] * 4, [1.0, 2.0]]


def vectors(n=160, dim=8):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, dim))
    for i in range(0, n, 4):
        x[i] = x[0] + 0.05 * rng.standard_normal(dim)
    x[10] = x[20] = x[30]
    rows = [(i, [float(v) for v in x[i]], i % 3 if i % 7 else None, "e") for i in range(n)]
    return rows + [(n + i, v, 0, "e") for i, v in enumerate(ODD)]


SCHEMA = "vec_id long, embedding array<double>, label int, dim string"


def fine(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


def test_embedding_dedup(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    good = [(i, np.array(v), k) for i, v, k, _ in rows if fine(v) and k is not None]
    links = [(a, b) for a, x, k in good for b, y, m in good if a < b and k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
    root = {i: i for i, *_ in rows}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    want = {i: (sum(i in p for p in links), root[i], root[i] == i) for i in root}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and links


def extreme():
    """Components of any size, repeated keys, and one row of 50,000 numbers."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(4) * 10.0 ** int(rng.integers(-1, 2))).tolist()) for i in range(80)]
    rows += [(100, [1e-200] * 4), (101, [2e-200] * 4), (102, [1e170, 1e170, 1e170, 1.1e170]), (103, [-1e300, 1e300, 1e300, 0.0]), (104, [5e-324, 0.0, 0.0, 0.0]), (120, [1e170, -1e170, 0.0, 1.0])]
    return [(i, v, 0, "e") for i, v in [*rows, (5, rows[5][1]), (5, rows[5][1]), (106, [1.0] * 50_000), (140, [1.0] * 50_000)]]


def test_vectors_of_extreme_size(spark):
    """Cosines after scaling, products as doubles give them, infinite ones included."""
    rows = extreme()
    got = {r.vec_id: (r.n_links, r.component_id) for r in dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    good = {i: np.array(v) / max(map(abs, v)) for i, v, *_ in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = {i: [j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in unit}
    assert {i: n for i, (n, _) in got.items()} == {i: len(x) for i, x in links.items()}
    assert got[101][1] == got[102][1] == got[100][1] and got[140] == (1, 106)
    found = {}
    for r in search(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    with np.errstate(over="ignore", invalid="ignore"):
        for q in (i for i in good if i % 20 == 0):
            y = {i: float(np.einsum("ij,j->i", np.array([v]), np.array(dict((i, v) for i, v, *_ in rows)[q]))[0]) for i, v, *_ in rows if i != q and len(v) == len(good[q])}
            want = sorted((-(-np.inf if np.isnan(s) else s), i) for i, s in y.items())[:20]
            assert [(m[1], m[2]) for m in sorted(found[q])] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("block", [1024, 16])
def test_vector_search(spark, monkeypatch, block):
    monkeypatch.setattr(vector_search, "BLOCK", block)
    monkeypatch.setattr(vector_search, "LIST_ROWS", 40)
    rows = vectors(600, 32)
    good = {i: np.array(v) for i, v, *_ in rows if fine(v) and len(v) == 32}
    got = {}
    for r in search(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in (i for i in good if i % 20 == 0):
        want = sorted(((-float(good[q] @ y), i) for i, y in good.items() if i != q))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        assert all(abs(s - float(good[q] @ good[i])) < 1e-9 for _, i, s in mine)
        hit += len({i for _, i in want} & {m[1] for m in mine})
        total += 20
    assert hit / total >= 0.9


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0], 1, "e"), (1, [0.5, 0.5], 1, "e"), (20, [0.0, 2.0], 1, "e")]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in search(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]


@pytest.mark.parametrize("f", [dedup, search])
def test_no_vectors(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0
    only_odd = f(spark.createDataFrame([(i, v, 0, "e") for i, v in enumerate(ODD[:6])], SCHEMA)).collect()
    assert all(r.n_links == 0 and r.kept for r in only_odd) if f is dedup else only_odd == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 130)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == root[x] for x in root)


def test_licences(spark):
    rows = [
        (1, "h/a/LICENSE", "Released under the MIT License.", "z"),
        (2, "h/a/b/code.py", "x = 1\ny = 2", "z"),
        (3, "h/a/b/own.py", "<p>Licensed under the Apache License, Version 2.0.</p> text", "z"),
        (4, "h/c/code.py", "nothing here about a license", "z"),
        (5, "h/a/b/deep/COPYING", "line\nThis work is licensed under the GNU General Public License, version 3.", "z"),
        (6, "h/a/b/deep/er/x", None, "z"),
        (7, None, "Licensed under CC BY-NC 4.0.", "z"),
        (7, None, "Licensed under CC BY-NC 4.0.", "z"),
        (8, "top", "", "z"),
    ]
    got = sorted((r.file_id, r.own_license, r.licensed_by, r.license) for r in license_scan(spark.createDataFrame(rows, "file_id long, path string, text string, row string")).collect())
    assert got == [
        (1, "mit", None, "mit"), (2, None, "h/a", "mit"), (3, "apache-2.0", None, "apache-2.0"), (4, None, None, None), (5, "gpl-3.0", None, "gpl-3.0"),
        (6, None, "h/a/b/deep", "gpl-3.0"), (7, "cc-by-nc-4.0", None, "cc-by-nc-4.0"), (7, "cc-by-nc-4.0", None, "cc-by-nc-4.0"), (8, None, None, None),
    ]
    assert license_scan(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def wrapped(text, prefix="", width=60):
    out, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            out.append(prefix + line)
            line = ""
        line += word + " "
    return "\n".join([*out, prefix + line])


def test_licences_of_wrapped_and_diluted_texts(spark):
    """Notices over several lines, heads and whole files; against plain vectors of lines and blocks."""
    whole = licenses.TEMPLATES
    rng = random.Random(1)
    noise = lambda n: " ".join(f"w{rng.randint(0, 300)}" for _ in range(n))
    rows = [
        (1, "a/LICENSE", "Copyright (c) 2020 Someone\n\n" + wrapped(whole["mit"][2])), (2, "a/x.c", noise(50)),
        (3, "b/x.c", "/*\n" + wrapped(whole["bsd"][0], " * ") + "\n */\nint x;\n" + noise(80)),
        (4, "c/x.py", "# Copyright 2020\n#\n" + wrapped(whole["apache-2.0"][2], "# ") + "\n#\n# http://www.apache.org/licenses/LICENSE-2.0\n\n" + noise(90)),
        (5, "d/COPYING", "            GNU GENERAL PUBLIC LICENSE\n               Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation\n\n" + "\n\n".join(noise(40) for _ in range(20))),
        (6, "d/e/f.c", ""), (7, "g/x", "released under mit " + noise(2000)), (8, "g/y", noise(300) + "\nReleased under the MIT License.\n" + noise(3)),
        (9, "h/COPYING.txt", wrapped(whole["bsd-3-clause"][0], width=72)), (10, "h/i/j", None),
    ]
    got = {r.file_id: (r.own_license, r.license) for r in license_scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: "mit", 2: "mit", 3: "bsd", 4: "apache-2.0", 5: "gpl-3.0", 6: "gpl-3.0", 7: None, 8: "mit", 9: "bsd-3-clause", 10: "bsd-3-clause"}
    assert got == {i: (own, got[i][1]) for i, own in plain_licences(rows).items()}


def plain_licences(rows):
    words = lambda t: re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())
    texts = [set(words(t)) for _, _, t in rows if t is not None]
    idf = lambda w: math.log((len(texts) + 1) / (sum(w in t for t in texts) + 1)) + 1

    def vector(t):
        v = {w: n * idf(w) for w, n in Counter(words(t)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    shows = lambda t: {n for n in licenses.SIGNS if re.search(licenses.sign(n), " ".join(words(t)))}
    models = [(name, vector(t), set(licenses.NEEDS.get(name, [])), {"negated", *licenses.BARS.get(name, [])} - shows(t)) for name, texts in licenses.TEMPLATES.items() for t in texts]
    out = {}
    for i, path, text in rows:
        block, parts = [], list((text or "").split("\n"))
        for line in [*parts, ""]:
            if words(line):
                block.append(line)
            else:
                parts.append("\n".join(block))
                block = []
        if path.split("/")[-1].startswith(("LICENSE", "COPYING")):
            parts.append(text)
        units = [(vector(p), shows(p)) for p in parts if words(p)]
        best = [(round(sum(x * m.get(w, 0) for w, x in v.items()), 6), name) for v, signs in units for name, m, needs, bars in models if needs <= signs and not bars & signs]
        best = [(-s, name) for s, name in best if s >= licenses.THRESHOLD]
        held = {name for _, name in best}
        best = [(s, name) for s, name in best if not any(part == name and whole in held for part, whole in licenses.PART_OF)]
        out[i] = min(best)[1] if best else None
    return out


def test_each_template_shows_its_signs():
    for (name, k), (needs, _) in licenses.rules().items():
        text = " ".join(licenses.words_in(licenses.TEMPLATES[name][k]))
        assert all(re.search(licenses.sign(s), text) for i, s in enumerate(licenses.SIGNS) if needs >> i & 1), (name, k)


GNU_NOTICE = """This {} is free software; you can redistribute it and/or modify it under the
terms of the GNU {} General Public License as published by the Free Software
Foundation; either version {} of the License, or (at your option) any later
version.
"""
PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so"""


def test_licences_with_much_the_same_words(spark):
    """Expected names are written by hand."""
    cases = [
        (GNU_NOTICE.format("program", "", 2), "gpl-2.0"), (GNU_NOTICE.format("program", "", 3), "gpl-3.0"),
        (GNU_NOTICE.format("library", "Lesser", 2.1), "lgpl-2.1"), (GNU_NOTICE.format("library", "Lesser", 3), "lgpl-3.0"),
        (GNU_NOTICE.format("library", "Library", 2), "lgpl-2.0"), (GNU_NOTICE.format("program", "Affero", 3), "agpl-3.0"),
        ("This program is licensed under the GNU General Public License, version 2.", "gpl-2.0"),
        ("This library is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3.0"),
        ("This work is licensed under the GNU General Public License, version 4.", None),
        ("Licensed under the Apache License, Version 1.1", None), ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("Not released under the MIT License.", None), ("This is no longer released under the MIT License.", None),
        ("This work isn't licensed under the GNU General Public License, version 3.", None), ("Released under the MIT License", "mit"),
        (PERMISSION + ".", "mit-0"), (PERMISSION + ", subject to the following conditions:", "mit"), ("Released under the MIT-0 License", "mit-0"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0bsd"),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        ("3. All advertising materials mentioning features or use of this software must display the following acknowledgement:\n\n4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-4-clause"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"), ("Licensed under CC BY 4.0", "cc-by-4.0"), ("Licensed under CC BY 3.0", None),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1", None),
        ("", None), (None, None),
    ]
    rows = [(i, f"p{i}/x.c", text) for i, (text, _) in enumerate(cases)] + [(1000 + i, f"n/{i}", f"plain words of file {i}") for i in range(30)]
    rows.append((99, "both/x.c", "Licensed under the Apache License, Version 2.0\nReleased under the MIT License"))
    got = {r.file_id: r for r in license_scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert [(text, got[i].own_license) for i, (text, _) in enumerate(cases)] == cases
    assert (got[99].own_license, got[99].other_licenses) == ("apache-2.0", "mit")


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no whole licences")
def test_whole_long_licences(spark):
    """Whole texts of long licences, given as templates, are known without their heads."""
    files = {"apache-2.0": "Apache-2.0", "gpl-2.0": "GPL-2", "gpl-3.0": "GPL-3", "lgpl-2.1": "LGPL-2.1", "mpl-2.0": "MPL-2.0"}
    texts = {}
    for name, file in files.items():
        with open(f"{COMMON}/{file}") as f:
            texts[name] = f.read()
    rows = [(i, f"p{i}/LICENSE", "\n".join(t.split("\n")[8:-40])) for i, t in enumerate(texts.values())] + [(9, "q/LICENSE", "some other words")]
    got = {r.file_id: r.own_license for r in license_scan(spark.createDataFrame(rows, "file_id long, path string, text string"), texts={n: [t] for n, t in texts.items()}).collect()}
    assert got == {**dict(enumerate(texts)), 9: None}


def labelled(n=400):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            text[3:3] = rng.sample(["vilest", "scumbag", "rubbish"], 2)
        docs.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    docs += [(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (None, "scumbag rubbish", "en", "s", 0)]
    labels += [(None, 1, 1), (5000, 1, None), (3, 1, 0)]
    got = toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for i in range(400):
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= by[i].score <= 1 and by[i].predicted == int(by[i].score >= 0.5)
    assert sum(by[i].predicted == int(i % 5 == 0) for i in range(400) if by[i].held_out) / sum(by[i].held_out for i in range(400)) > 0.95
    assert by[None].predicted == 1 and by[1000].predicted == by[1001].predicted == 0 and by[0].evidence


def test_toxicity_without_labels(spark):
    docs, _ = labelled(5)
    got = toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r.predicted for r in got} == {0} and len(got) == 5


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(200)
    copies = [(1000 + i, docs[i][1], "en", "s", 1) for i in range(1, 9)]
    passage = " ".join(f"p{i}" for i in range(60))
    shared = [(2000 + i, docs[10 + i][1][:200] + " " + passage + f" q{i}", "en", "s", 1) for i in range(1, 4)]
    spark.createDataFrame(docs + copies + shared, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r for r in now.collect()})
    toxic = {i for i in range(200) if i % 5 == 0}
    assert len(toxic & set(kept[0])) <= 2 and {i for i in range(200)} - toxic <= set(kept[0])
    assert not set(kept[1]) & {1000 + i for i in range(1, 9)} and set(kept[0]) - set(kept[1]) == {1000 + i for i in range(1, 9) if 1000 + i in kept[0]}
    assert passage in kept[2][2001].text and passage not in kept[2][2002].text
    assert set(kept[3]) == set(kept[2])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_pipeline_keeps_one_row_for_each_id(spark):
    rows = [(1, "b", "en", "s", 1), (2, "z", "en", "s", 1), (2, "y", "de", "t", 2), (2, None, "de", "t", 2), (None, "x", "en", "s", 1), (3, None, "en", "s", 0), (3, None, "en", "s", 0)]
    got = corpus_pipeline.one_row_per_id(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id, r.text, r.lang) for r in got.collect() if r.text) == [(1, "b", "en"), (2, "y", "de")] and got.count() == 3


def test_vector_search_ships_no_pairs(spark, monkeypatch):
    """A crowded list lies in several shares; queries come once to a share, blocks never to a query."""
    monkeypatch.setattr(vector_search, "SHARE", 300, raising=False)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 32)) / 6
    x[:1000] = x[0] + 0.001 * rng.standard_normal((1000, 32))
    df = spark.createDataFrame([(i, v.tolist(), 0, "e") for i, v in enumerate(x)], SCHEMA)
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    time.sleep(1)  # the figures come late
    before, got = sent(), {}
    for r in search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    time.sleep(1)
    shipped = sent() - before
    best = {q: set(np.lexsort((np.arange(4000), -np.where(np.arange(4000) == q, -np.inf, x @ x[q])))[:20].tolist()) for q in range(0, 4000, 20)}
    assert sum(len(best[q] & got[q]) for q in best) >= 0.9 * 20 * len(best) and all(len(y) == 20 for y in got.values())
    assert shipped < 6 * x.nbytes, shipped


def test_dealt():
    goals = vector_search.dealt({1: 50, 2: 60, 3: 250, 4: 30, 5: 70, 6: 1}, dict.fromkeys(range(1, 7), 100))
    assert goals == {1: (0, 1), 2: (1, 1), 3: (2, 3), 4: (5, 1), 5: (5, 1), 6: (6, 1)}
