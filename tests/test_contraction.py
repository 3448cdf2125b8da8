"""Contraction of region graphs, budgets and label plans."""

import random

import numpy as np
from pyspark.sql import functions as F

from brindle.operators import contraction, merging
from test_shapes import image_rows

REGIONS = "image_id string, region_id long, area double, perimeter double, l double, a double, b double, protection double, costs array<double>"
EDGES = "image_id string, lo long, hi long, shared_len double, evidence double, user_edge boolean"


def tables(spark, regions, edges):
    """regions: id, area, perimeter, l, protection; edges: lo, hi, shared, evidence, user."""
    return spark.createDataFrame([("i", r, float(a), float(p), float(c), 0.0, 0.0, s, [abs(c - 20) * a * 1.0, abs(c - 70) * a * 1.0]) for r, a, p, c, s in regions], REGIONS), spark.createDataFrame([("i", lo, hi, float(n), e, u) for lo, hi, n, e, u in edges], EDGES)


def test_absorbed(spark):
    regions = [(1, 100, 40, 50, 0.0), (2, 3, 8, 51, 0.0), (3, 200, 60, 80, 0.0), (4, 3, 8, 79, 0.0), (5, 3, 8, 20, 0.0), (6, 1, 4, 90, 0.0), (7, 2, 6, 51, 0.0)]
    edges = [(1, 2, 4, 0.1, False), (2, 3, 4, 0.0, False), (3, 4, 8, 0.75, False), (3, 5, 4, 0.9, False), (3, 6, 4, 0.9, False), (1, 7, 3, 0.1, False), (1, 3, 9, 0.9, False)]
    to = {r.region_id: r.to for r in contraction.absorbed(*tables(spark, regions, edges), 10.0, 0.5, 2.0, 0.2).collect()}
    # 2 and 7 join the larger, similar 1; 4 and 5 have hard boundaries only and stay; 6 lies below the printable floor
    assert to == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 3, 7: 1}


def test_absorbed_adds_up_and_ends(spark):
    rng = random.Random(1)
    n = 40
    regions = [(i, rng.choice((1, 2, 30)), 20, rng.randrange(0, 100), 0.0) for i in range(n)]
    edges = [(i, j, rng.randrange(1, 6), rng.random() * 0.6, False) for i in range(n) for j in range(i + 1, n) if j == i + 1 or rng.random() < 0.05]
    to = {r.region_id: r.to for r in contraction.absorbed(*tables(spark, regions, edges), 25.0, 0.0).collect()}
    area = {}
    for r, a, *_ in regions:
        area[to[r]] = area.get(to[r], 0) + a
    assert set(to) == set(range(n)) and all(to[t] == t for t in to.values())
    assert min(area.values()) >= 25 and sum(area.values()) == sum(r[1] for r in regions) and len(area) > 1


def test_weak_pairs_and_target(spark):
    regions = [(0, 400, 80, 20, 0.0), (1, 400, 80, 21, 0.0), (2, 400, 80, 70, 0.0), (3, 400, 80, 71, 0.0)]
    edges = [(0, 1, 20, 0.1, False), (1, 2, 20, 0.9, False), (2, 3, 20, 0.1, False)]
    joined, over = contraction.merge_hierarchically(*tables(spark, regions, edges), 2, 3, 2)
    assert {r.region_id: r.merged_id for r in joined.collect()} == {0: 0, 1: 0, 2: 2, 3: 2} and over.isEmpty()


def test_selected_pairs_give_way_only_above_the_maximum(spark):
    regions = [(k, 400, 80, 10 + 60 * (k % 2) + k, 0.0) for k in range(14)]
    joined, over = contraction.merge_hierarchically(*tables(spark, regions, [(k, k + 1, 20, 0.9, True) for k in range(13)]), 10, 11, 2)
    assert len({r.merged_id for r in joined.collect()}) == 11 and over.isEmpty()


def test_floor_missing_evidence_and_what_stays_above(spark):
    regions = [(0, 5, 10, 10, 0.9), (1, 400, 80, 60, 0.0), (2, 400, 80, 60.5, 0.1), (3, 400, 80, 60.5, 0.0)]
    joined, over = contraction.merge_hierarchically(*tables(spark, regions, [(0, 1, 5, None, False), (1, 2, 20, None, False)]), 1, 1, 2, least_area=10.0)
    assert {r.region_id: r.merged_id for r in joined.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert [tuple(r) for r in over.collect()] == [("i", 2)]  # 3 touches nothing


def test_budget_over_many_keys(spark):
    rng = random.Random(2)
    rows = [(k, float(rng.randrange(1, 60)), i) for k in "abc" for i in range(30)] + [("d", 200.0, 1)]
    got = {r.k: (r.used, r.kept) for r in merging.budget_with_skip(spark.createDataFrame(rows, "k string, size double, item long"), "k", "size", [(-F.col("size")).alias("o")], 100.0).collect()}
    for key in "abcd":
        used, kept = 0.0, 0
        for _, s, _ in sorted((x for x in rows if x[0] == key), key=lambda x: (-x[1], x[2])):
            if used + s <= 100:
                used, kept = used + s, kept + 1
        assert got[key] == (used, kept)


def test_label_plan(spark):
    a = np.ones((30, 120), int)
    a[5:25, 10:40] = 2
    a[0, 119] = 3
    a[10:14, 60:64] = 4
    p = image_rows(spark, {"a": a})
    rows = merging.label_places(p, 9.0, 4, 2.0).collect()
    big = np.pad(a, 1)
    for r in (1, 2, 3, 4):
        cells = {(y, x): min(((s - (y + 1, x + 1)) ** 2).sum() for s in np.argwhere(big != r)) ** 0.5 for y, x in np.argwhere(a == r)}
        fit = {c: d for c, d in cells.items() if d >= 2.0} or {max(cells, key=lambda c: (cells[c], -c[0], -c[1])): max(cells.values())}
        kept = []
        for c in sorted(fit, key=lambda c: (-fit[c], *c)):
            if len(kept) < 4 and all((c[0] - k[0]) ** 2 + (c[1] - k[1]) ** 2 >= 81 for k in kept):
                kept.append(c)
        assert [(x.y, x.x) for x in sorted((x for x in rows if x.region_id == r), key=lambda x: x.ordinal)] == [tuple(map(int, k)) for k in kept]
    plan = merging.label_plan(p, 1.0)
    n = merging.numbering(plan).first()
    labels = {}
    for x in plan.collect():
        labels.setdefault(x.region_id, []).append(x.ordinal)
    assert len(labels[1]) == 4 and labels[2] == [1] and (n.placed, n.repeated, n.unnumbered, n.least_height_mm) == (7, 3, 0, 2)


def strips(n, seed):
    """A grid of large regions, few of which have small or similar ones on their borders, some in chains."""
    rng = random.Random(seed)
    regions = [(i, 100 + i % 7, 40, (i * 37) % 101, 0.0) for i in range(n)]
    edges = [(i, i + d, 5 + i % 3, 0.3 + 0.3 * rng.random(), False) for i in range(n) for d in (1, 12) if i + d < n]
    for k in range(n, n + n // 15):
        at = rng.randrange(n)
        regions.append((k, 1 + k % 4, 8, regions[at][3] + rng.random() * 3 - 1, 0.0))
        edges += [(at, k, 2, rng.random() * 0.6, False)] + ([(k - 1, k, 1, rng.random() * 0.3, False)] if k > n and k % 2 else [])
    return regions, edges


def test_narrowed_rounds_give_the_same(spark, monkeypatch):
    """Rounds over the few regions that can merge write little, and give what rounds over the whole graph give."""
    regions, edges = strips(240, 3)
    written, real = [], contraction.saved
    monkeypatch.setattr(contraction, "saved", lambda df: (written.append(real(df)), written[-1])[1])
    found = {}
    for how, narrow in (("narrow", 4), ("whole", 10**6)):
        monkeypatch.setattr(contraction, "NARROW", narrow, raising=False)
        written.clear()
        to = {r.region_id: r.to for r in contraction.absorbed(*tables(spark, regions, edges), 12.0, 0.0).collect()}
        rows = sum(x.count() for x in written)
        joined, over = contraction.merge_hierarchically(*tables(spark, regions, edges), 235, 238, 2)
        found[how] = (to, {r.region_id: r.merged_id for r in joined.collect()}, over.collect())
        if how == "narrow":
            assert rows < 3 * (len(regions) + len(edges))
    assert found["narrow"] == found["whole"]
    assert len(set(found["whole"][0].values())) < len(regions) and len(set(found["whole"][1].values())) <= 238


def test_quota_over_ranges_of_keys(spark):
    """Of leaves that are too many go those of the smallest keys in each image."""
    rows = [(i, k, k * 7 % 31 / 2, k % 5 == 0, k % 3 == 0) for i in ("a", "b", "c") for k in range(31)]
    leaves = spark.createDataFrame(rows, "image_id string, region_id long, key double, must boolean, user boolean")
    quota = spark.createDataFrame([("a", 4, 2), ("b", 31, 31), ("c", -1, -3)], "image_id string, left int, left_user int")
    got = {(r.image_id, r.region_id) for r in contraction._within(leaves.repartition(5), quota).collect()}
    want = set()
    for name, left, user in (("a", 4, 2), ("b", 31, 31), ("c", -1, -3)):
        for rank, r in enumerate(sorted((x for x in rows if x[0] == name), key=lambda x: (x[2], x[1])), 1):
            if r[3] or rank <= (user if r[4] else left):
                want.add(r[:2])
    assert got == want
