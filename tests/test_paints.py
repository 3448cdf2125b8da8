"""Paint conflicts and consolidation against an ordered walk."""

import random

import pandas as pd
import pytest

from brindle.functions.colour import difference_of
from brindle.operators import paints as P


def de(a, b):
    return float(difference_of(a, b))


def walk(regions, edges, paints):
    """One thing after the other, for one image."""
    area, lab, prot = ({r: x[i] for r, x in regions.items()} for i in range(3))
    edges, to = dict(edges), {r: r for r in regions}
    counts = {"merges": 0, "recoloured": 0, "selected": 0, "forced": 0}
    while True:
        error = {r: {i: de(lab[r], c) for i, *c in paints} for r in lab}
        got = {r: min(error[r], key=lambda i: (error[r][i], i)) for r in lab}
        around = {r: sorted({x for e in edges if r in e for x in e} - {r}) for r in lab}
        paint = {i: c for i, *c in paints}
        ev = lambda a, b: edges[min(a, b), max(a, b)][0] if edges[min(a, b), max(a, b)][0] is not None else max(prot[a], prot[b])
        for lo, hi in sorted(edges):
            if got[lo] != got[hi] or de(lab[lo], lab[hi]) < 2 and ev(lo, hi) < 0.2:
                continue
            found = []
            for r in (lo, hi):
                for i in paint:
                    if error[r][i] > 8 or error[r][i] > min(error[r].values()) + 2 or i in {got[n] for n in around[r]}:
                        continue
                    if all(de(paint[i], paint[got[n]]) <= max(5.0, 1.5 * de(lab[r], lab[n]) + 2) and not (de(lab[r], lab[n]) < 2 and ev(r, n) < 0.2 and de(paint[i], paint[got[n]]) >= 5) for n in around[r]):
                        found.append((error[r][i], r, i))
            if found:
                _, r, i = min(found)
                got[r] = i
                counts["recoloured"] += 1
        broken = []
        for lo, hi in edges:
            d, p = de(lab[lo], lab[hi]), de(paint[got[lo]], paint[got[hi]])
            if got[lo] == got[hi] or d < 2 and ev(lo, hi) < 0.2 and p >= 5:
                broken.append((ev(lo, hi), d, p, lo, hi))
        if not broken:
            return got, {r: t for r, t in to.items() if r != t}, counts
        taken, used = [], set()
        for _, _, _, lo, hi in sorted(broken):
            if not {lo, hi} & used and ((edges[lo, hi][0] or 0.0) < 0.7 or edges[lo, hi][1]):
                taken.append((lo, hi))
                used |= {lo, hi}
                counts["selected"] += edges[lo, hi][1]
        if not taken:
            def loss(x):
                e, d, _, lo, hi = x
                n = area[lo] + area[hi]
                mixed = [(a * area[lo] + b * area[hi]) / n for a, b in zip(lab[lo], lab[hi], strict=True)]
                apart = (error[lo][got[lo]] * area[lo] + error[hi][got[hi]] * area[hi]) / n
                return max(0.0, min(de(mixed, c) for c in paint.values()) - apart), e, d, lo, hi
            taken = [min(broken, key=loss)[3:]]
            counts["forced"] += 1
        counts["merges"] += len(taken)
        for lo, hi in taken:
            n = area[lo] + area[hi]
            lab[lo] = tuple((a * area[lo] + b * area[hi]) / n for a, b in zip(lab[lo], lab[hi], strict=True))
            area[lo], prot[lo] = n, max(prot[lo], prot[hi])
            for m in (area, lab, prot):
                del m[hi]
            to = {r: lo if t == hi else t for r, t in to.items()}
        name, new = dict((hi, lo) for lo, hi in taken), {}
        for (a, b), (e, user) in edges.items():
            a, b = sorted((name.get(a, a), name.get(b, b)))
            if a != b:
                f, other = new.get((a, b), (None, False))
                new[a, b] = (max((x for x in (e, f) if x is not None), default=None), user or other)
        edges = new


PAINTS = [(1, 50.0, 0.0, 0.0), (2, 56.0, 3.0, 2.0), (3, 40.0, 30.0, 20.0), (4, 52.0, -2.0, 4.0), (5, 70.0, 10.0, -30.0)]


def cases():
    rng = random.Random(11)
    out = {}
    for k in range(2):
        n = (8, 1)[k]
        base = [rng.choice(PAINTS)[1:] for _ in range(n)]
        regions = {i + 1: (rng.randrange(1, 40), tuple(v + rng.uniform(-4, 4) for v in base[i]), rng.choice((0.0, 0.3, 0.9))) for i in range(n)}
        edges = {(i, j): (rng.choice((None, 0.0, 0.1, 0.5, 0.75, 0.9)), rng.random() < 0.2) for i in regions for j in regions if i < j and (j == i + 1 or rng.random() < 0.18)}
        out[f"i{k}"] = (regions, edges)
    for seed in range(1000):  # two neighbours between paints 1 and 4, one of which can take the other
        r = random.Random(seed)
        mid = [tuple((a + b) / 2 + r.uniform(-2, 2) for a, b in zip(PAINTS[0][1:], PAINTS[3][1:], strict=True)) for _ in range(2)]
        found = ({1: (5, mid[0], 0.0), 2: (6, mid[1], 0.0), 3: (4, (90.0, 0.0, 0.0), 0.0)}, {(1, 2): (0.5, False), (2, 3): (0.9, False)})
        if walk(*found, PAINTS)[2]["recoloured"]:
            out["faithful"] = found
            break
    same = (10, (50.0, 0.0, 0.0), 0.0)
    out["natural"] = ({1: same, 2: (10, (50.8, 0.0, 0.0), 0.0)}, {(1, 2): (0.90, False)})
    out["selected"] = ({1: same, 2: (10, (50.8, 0.0, 0.0), 0.0)}, {(1, 2): (0.90, True)})
    return out


def test_resolved_paints(spark):
    images = cases()
    regions = spark.createDataFrame([(n, r, float(x[0]), *x[1], x[2]) for n, (some, _) in images.items() for r, x in some.items()], "image_id string, region_id long, area double, l double, a double, b double, protection double")
    edges = spark.createDataFrame([(n, *e, *x) for n, (_, some) in images.items() for e, x in some.items()], "image_id string, lo long, hi long, evidence double, user_edge boolean")
    assigned, joined, counts = P.resolve_paints(regions, edges, PAINTS)
    got, to = {}, {}
    for r in assigned.collect():
        got.setdefault(r.image_id, {})[r.region_id] = r.color_id
    for r in joined.collect():
        to.setdefault(r.image_id, {})[r.region_id] = r.to
    total = dict.fromkeys(counts, 0)
    for n, (some, links) in images.items():
        want, moved, c = walk(some, links, PAINTS)
        assert got[n] == want and to.get(n, {}) == moved, n
        total = {k: total[k] + v for k, v in c.items()}
    assert counts == total and min(counts.values()) > 0
    assert to["natural"] == to["selected"] == {2: 1}


def test_one_paint_and_no_edges(spark):
    regions = spark.createDataFrame([("a", 1, 3.0, 50.0, 0.0, 0.0, None), ("a", 2, 1.0, 60.0, 0.0, 0.0, 0.1)], "image_id string, region_id long, area double, l double, a double, b double, protection double")
    edges = spark.createDataFrame([], "image_id string, lo long, hi long, evidence double, user_edge boolean")
    assigned, joined, counts = P.resolve_paints(regions, edges, PAINTS[:1])
    assert sorted((r.region_id, r.color_id) for r in assigned.collect()) == [(1, 1), (2, 1)] and joined.isEmpty() and not any(counts.values())


@pytest.mark.parametrize("spread", [1.2, 6.0])
def test_consolidated(spark, spread):
    rng = random.Random(5)
    rows = []
    for image in "ab":
        for i in range(25):
            l, a, b = (50 + rng.uniform(0, 2) * spread, rng.uniform(0, spread), rng.uniform(0, spread))
            rows.append((image, i, l, a, b, round(l), round(a), round(b)))
    got = {(r.image_id, r.cluster_id): r.color_id for r in P.consolidated(spark.createDataFrame(rows, "image_id string, cluster_id int, l double, a double, b double, r int, g int, bl int")).collect()}
    for image in "ab":
        known, kept = {}, []
        for _, i, *c in sorted((x for x in rows if x[0] == image), key=lambda x: (*x[2:5], x[1])):
            lab, rgb = c[:3], tuple(c[3:])
            if rgb not in known:
                d = [de(lab, k) for k in kept]
                if d and min(d) < 2:
                    known[rgb] = d.index(min(d)) + 1
                else:
                    kept.append(lab)
                    known[rgb] = len(kept)
            assert got[image, i] == known[rgb]
        assert 1 < len(kept) < 25


def test_consolidated_meets_kept_paints_only(spark, monkeypatch):
    """Many paints close together: a number for each, and no join of paints with paints."""
    rng = random.Random(8)
    rows = [("a", i, 50 + rng.uniform(0, 1.5), rng.uniform(0, 1), rng.uniform(0, 1), i, 0, 0) for i in range(3000)] + [("b", 0, 4.0, 0.0, 0.0, 1, 1, None), ("b", 1, 96.0, 0.0, 0.0, 2, 2, 2)]
    met, plain = [], P.difference_of
    monkeypatch.setattr(P, "difference_of", lambda kept, here: met.append(len(kept)) or plain(kept, here))
    frames = [pd.DataFrame(sorted(rows, key=lambda x: (x[0], *x[2:5], x[1])), columns="image_id cluster_id l a b r g bl".split())]
    numbers = pd.concat(P._kept_in_order(2.0)(iter(frames)))
    assert len(numbers) == len(rows) and sum(met) < 4 * len(rows)
    got = P.consolidated(spark.createDataFrame(rows, "image_id string, cluster_id int, l double, a double, b double, r int, g int, bl int")).collect()
    assert len(got) == len(rows) and {(r.cluster_id, r.color_id) for r in got if r.image_id == "b"} == {(0, 1), (1, 2)}
