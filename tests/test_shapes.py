"""Segmentation, floods, moves and distances against sequential versions on small rasters."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import alignment, distance, graph, segmentation


def image_rows(spark, images, **grids):
    """images: name to array (rows, columns) of region ids; further grids by column name."""
    names = list(grids)
    rows = [(n, y, x, int(a[y, x]), *(grids[k][n][y, x].item() for k in names)) for n, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    kinds = {k: "double" if next(iter(grids[k].values())).dtype.kind == "f" else "boolean" if next(iter(grids[k].values())).dtype.kind == "b" else "long" for k in names}
    return spark.createDataFrame(rows, "image_id string, y long, x long, region_id long" + "".join(f", {k} {kinds[k]}" for k in names))


def back(df, images, column):
    out = {n: np.zeros(a.shape) for n, a in images.items()}
    for r in df.select("image_id", "y", "x", column).collect():
        out[r.image_id][r.y, r.x] = r[column]
    return out


def four_connected(labels):
    out, n = np.zeros(labels.shape, int), 0
    for y in range(labels.shape[0]):
        for x in range(labels.shape[1]):
            if not out[y, x]:
                n += 1
                out[y, x], stack = n, [(y, x)]
                while stack:
                    i, j = stack.pop()
                    for p, q in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                        if 0 <= p < labels.shape[0] and 0 <= q < labels.shape[1] and not out[p, q] and labels[p, q] == labels[i, j]:
                            out[p, q] = n
                            stack.append((p, q))
    return out


def one_pass(img, scale, least):
    """The criterion over all edges in order, one by one."""
    h, w, _ = img.shape
    edges = []
    for y in range(h):
        for x in range(w):
            for k, (dy, dx) in enumerate(((0, 1), (1, -1), (1, 0), (1, 1))):
                if y + dy < h and 0 <= x + dx < w:
                    edges.append((float(np.sqrt(((img[y, x] - img[y + dy, x + dx]).astype(float) ** 2).sum())), y, x, k, y * w + x, (y + dy) * w + x + dx))
    up, size, inner = list(range(h * w)), [1] * (h * w), [0.0] * (h * w)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for d, *_, a, b in sorted(edges):
        a, b = root(a), root(b)
        if a != b and d < min(inner[a] + scale / size[a], inner[b] + scale / size[b]):
            up[b], inner[a] = a, d
            size[a] += size[b]
    for *_, a, b in sorted(edges):
        a, b = root(a), root(b)
        if a != b and min(size[a], size[b]) < least:
            up[b] = a
            size[a] += size[b]
    return four_connected(np.array([root(i) for i in range(h * w)]).reshape(h, w))


def colours():
    rng = np.random.default_rng(1)
    out = {}
    for k, top in enumerate((256, 6, 40)):
        a = rng.integers(0, top, (20 + 3 * k, 31 - 4 * k, 3))
        a[5:15, 3:12] //= 4
        out[f"i{k}"] = a
    out["flat"] = np.full((9, 5, 3), 7)
    out["dot"] = np.zeros((1, 1, 3), int)
    return out


@pytest.mark.parametrize(("scale", "least", "side"), [(400.0, 4, 8), (60.0, 1, 256)])
def test_segments(spark, scale, least, side):
    images = colours()
    rows = [(n, y, x, *map(int, a[y, x])) for n, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    p = spark.createDataFrame(rows, "image_id string, y long, x long, r int, g int, b int")
    got = back(segmentation.segments(p, ["r", "g", "b"], scale, least, side), {n: a[..., 0] for n, a in images.items()}, "region_id")
    for n, a in images.items():
        assert (got[n] == one_pass(a, scale, least)).all(), n


def test_rounds_over_the_whole_graph(spark):
    """A round without tiles settles nothing that a sorted pass would settle otherwise."""
    a = np.random.default_rng(5).integers(0, 60, (5, 6, 3))
    p = spark.createDataFrame([("a", y, x, *map(int, a[y, x])) for y in range(5) for x in range(6)], "image_id string, y long, x long, r int, g int, b int")
    edges = graph.saved(segmentation.contacts(p, ["r", "g", "b"]))
    states = spark.createDataFrame([], "image_id string, node long, size long, internal double")
    steps = []
    for _ in range(3):
        edges, states, joined = segmentation.whole_round(edges, states, 100.0)
        steps.append(joined)
    edges, states, joined = segmentation.tile_round(edges, states, 64, 100.0)
    assert edges.isEmpty() and not steps[0].isEmpty()
    total = {r.node: r.to for r in segmentation.composed([*steps, joined]).collect()}
    label = np.array([[total.get((y << 32) + x, (y << 32) + x) for x in range(6)] for y in range(5)])
    assert (four_connected(label) == one_pass(a, 100.0, 1)).all()


def test_predicate_holds(spark):
    """Neither too fine: between two regions of the criterion lies an edge that is not below the bound of both; nor too
    coarse: inside a region every edge of its spanning tree was below the bounds of what it joined (the sorted pass)."""
    a = colours()["i2"]
    p = spark.createDataFrame([("a", y, x, *map(int, a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id string, y long, x long, r int, g int, b int")
    found = graph.saved(segmentation.criterion_components(p, ["r", "g", "b"], 80.0, side=8))
    edges = segmentation.contacts(found, ["r", "g", "b"], "root").select("w", "root_a", "root_b", "tie").collect()
    size = {r.root: r["count"] for r in found.groupBy("root").count().collect()}
    inner = dict.fromkeys(size, 0.0)
    up = {}

    def top(i):
        while up.get(i, i) != i:
            i = up[i]
        return i

    for e in sorted((e for e in edges if e.root_a == e.root_b), key=lambda e: (e.w, e.tie)):
        x, y = top(e.tie >> 2), top((e.tie >> 2) + {0: 1, 1: (1 << 32) - 1, 2: 1 << 32, 3: (1 << 32) + 1}[e.tie & 3])
        if x != y:
            up[x], inner[e.root_a] = y, max(inner[e.root_a], e.w)
    low = {}
    for e in edges:
        if e.root_a != e.root_b:
            key = tuple(sorted((e.root_a, e.root_b)))
            low[key] = min(low.get(key, np.inf), e.w)
    assert len(size) > 3 and all(w >= min(inner[i] + 80.0 / size[i] for i in pair) for pair, w in low.items())


def flood(v, marker):
    """One queue over the whole image."""
    label, heap, done = np.zeros(v.shape, int), [], np.zeros(v.shape, bool)
    for y, x in zip(*np.nonzero(marker), strict=True):
        heap.append((v[y, x], 0, int(marker[y, x]), int(y), int(x)))
    heapq.heapify(heap)
    while heap:
        c, h, name, y, x = heapq.heappop(heap)
        if done[y, x] or (marker[y, x] and marker[y, x] != name):
            continue
        done[y, x], label[y, x] = True, name
        for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= p[0] < v.shape[0] and 0 <= p[1] < v.shape[1] and not done[p] and not marker[p]:
                heapq.heappush(heap, (v[p], 0, name, *p) if v[p] > c else (c, h + 1, name, *p))
    return label


@pytest.mark.parametrize("side", [5, 64])
def test_flood(spark, side):
    rng = np.random.default_rng(7)
    images, v, marker = {}, {}, {}
    for k in range(4):
        shape = (17, 23 - 3 * k)
        images[f"i{k}"] = np.ones(shape, int)
        v[f"i{k}"] = rng.integers(0, (3, 50, 1, 8)[k], shape).astype(float)
        m = np.where(rng.random(shape) < (0.03, 0.05, 0.02, 0.0)[k], rng.integers(1, 9, shape), 0)
        marker[f"i{k}"] = m
    got = back(alignment.flooded(image_rows(spark, images, v=v, marker=marker), side), images, "label")
    for n in images:
        assert (got[n] == flood(v[n], marker[n])).all(), n
    assert not got["i3"].any()


def test_long_flood_takes_few_rounds(spark, monkeypatch):
    """A marker below all else reaches the end of a long strip, past walls and other markers, without a round for each tile on the way."""
    rng = np.random.default_rng(3)
    v = {"a": np.where(rng.random((120, 9)) < 0.1, rng.integers(3, 6, (120, 9)), 1).astype(float), "b": np.where(rng.random((120, 7)) < 0.2, 4.0, 1.0)}
    marker = {n: np.where((a > 3) & (rng.random(a.shape) < 0.2), rng.integers(5, 9, a.shape), 0) for n, a in v.items()}
    v["a"][0, 0], marker["a"][0, 0] = 2.0, 3
    v["b"][0, 0], marker["b"][0, 0], v["b"][119, 0], marker["b"][119, 0] = 4.0, 4, 4.0, 2
    images, calls, plain = {n: np.ones(a.shape, int) for n, a in v.items()}, [], alignment.each_tile
    monkeypatch.setattr(alignment, "each_tile", lambda *a, **k: calls.append(a) or plain(*a, **k))
    one = {n: images[n] for n in "a"}
    got = back(alignment.flooded(image_rows(spark, one, v=v, marker=marker), 5), one, "label")
    assert (got["a"] == flood(v["a"], marker["a"])).all() and len(calls) <= 6
    got = back(alignment.flooded(image_rows(spark, images, v=v, marker=marker), 30), images, "label")
    assert all((got[n] == flood(v[n], marker[n])).all() for n in images)


def holes_and_parts(labels):
    out = {}
    for r in np.unique(labels):
        inside = np.pad(labels == r, 1)
        parts, left = [], None
        for mask, steps in ((inside, alignment.FOUR), (~inside, alignment.AROUND)):
            left, n = set(zip(*(x.tolist() for x in np.nonzero(mask)), strict=True)), 0
            while left:
                n += 1
                stack = [left.pop()]
                while stack:
                    y, x = stack.pop()
                    for dy, dx in steps:
                        if (y + dy, x + dx) in left:
                            left.remove((y + dy, x + dx))
                            stack.append((y + dy, x + dx))
            parts.append(n)
        out[int(r)] = tuple(parts)
    return out


def moved_one_by_one(labels, target, benefit, pairs, passes=8):
    label, simple = np.pad(labels, 1), alignment._simple()
    cells = [(y, x) for y, x in zip(*(z.tolist() for z in np.nonzero(target != labels)), strict=True) if tuple(sorted((int(labels[y, x]), int(target[y, x])))) in pairs]
    order = sorted(cells, key=lambda p: (-benefit[p], *p))
    for turn in range(passes):
        moves = 0
        for y, x in order if turn % 2 == 0 else order[::-1]:
            here, to, y, x = label[y + 1, x + 1], target[y, x], y + 1, x + 1
            if here == to:
                continue
            sides = {int(label[y + dy, x + dx]) for dy, dx in alignment.FOUR} - {0, int(to)}
            near = [label[y + dy, x + dx] for dy, dx in alignment.AROUND]
            if all(tuple(sorted((int(to), s))) in pairs for s in sides) and all(simple[sum(int(n == r) << i for i, n in enumerate(near))] for r in (here, to)):
                label[y, x] = to
                moves += 1
        if not moves:
            break
    return label[1:-1, 1:-1]


@pytest.mark.parametrize("side", [4, 64])
def test_safe_moves(spark, side):
    rng = random.Random(2)
    images, target, benefit = {}, {}, {}
    for k in range(3):
        a = np.ones((16, 19), int)
        a[3:12, 4:9] = 2
        a[6:8, 9:15] = 2  # a peninsula
        a[10:15, 12:18] = 3
        if k == 2:
            a[5:7, 5:7] = 1  # a hole
        images[f"i{k}"] = a
        target[f"i{k}"] = np.array([[rng.choice((1, 2, 3)) if rng.random() < 0.5 else a[y, x] for x in range(19)] for y in range(16)])
        benefit[f"i{k}"] = np.array([[float(rng.randrange(4)) for _ in range(19)] for _ in range(16)])
    pairs = {"i0": {(1, 2), (1, 3)}, "i1": {(1, 2), (1, 3), (2, 3)}, "i2": {(1, 2)}}
    rows = spark.createDataFrame([(n, *p) for n, some in pairs.items() for p in some], "image_id string, lo long, hi long")
    got = back(alignment.safe_moves(image_rows(spark, images, target=target, benefit=benefit), rows, side=side), images, "region_id")
    for n, a in images.items():
        want = moved_one_by_one(a, target[n], benefit[n], pairs[n])
        assert (got[n] == want).all() and (want != a).any(), n
        assert holes_and_parts(got[n].astype(int)) == holes_and_parts(a)


def stripes(wavy):
    """Two colours with a wavy edge, and a region map whose boundary is jagged around it."""
    h, w = 16, 26
    lab, labels = np.zeros((h, w, 3)), np.ones((h, w), int)
    for y in range(h):
        edge = w // 2 + (round(3 * np.sin(y / 4)) if wavy else 0)
        lab[y, :edge], lab[y, edge:] = (55.0, 60.0, 40.0), (45.0, 10.0, -60.0)
        labels[y, edge + ((2 if (y // 4) % 2 else -2) if wavy else 0) :] = 2
    return lab, labels


@pytest.mark.parametrize("wavy", [True, False])
def test_aligned(spark, wavy):
    lab, labels = stripes(wavy)
    strength = np.zeros(labels.shape)
    jump = (lab[:, 1:] != lab[:, :-1]).any(axis=2)
    strength[:, 1:][jump] = strength[:, :-1][jump] = 1.0
    images = {"a": labels}
    p = image_rows(spark, images, strength={"a": strength}, l={"a": lab[..., 0]}, a={"a": lab[..., 1]}, b={"a": lab[..., 2]})
    found, log = alignment.aligned(p, "strength", 2 if wavy else 1)
    got = back(found, images, "region_id")["a"]
    assert holes_and_parts(got.astype(int)) == holes_and_parts(labels)
    on = lambda a: strength[np.nonzero((a != np.roll(a, 1, 1))[:, 1:])[0], np.nonzero((a != np.roll(a, 1, 1))[:, 1:])[1] + 1].mean()
    assert on(got) >= on(labels) and (on(got) > on(labels)) == wavy
    assert [x["radius"] for x in log] == ([2, 1] if wavy else [1])
    if not wavy:  # frozen regions stay as they are
        assert (got == labels).all()
    else:
        frozen = spark.createDataFrame([("a", 2)], "image_id string, region_id long")
        assert (back(alignment.aligned(p, "strength", 1, frozen)[0], images, "region_id")["a"] == labels).all()


def test_distances(spark):
    rng = np.random.default_rng(4)
    images = {"a": rng.integers(1, 3, (14, 11)), "b": np.ones((6, 9), int), "c": np.kron(rng.integers(1, 4, (4, 4)), np.ones((5, 6), int))}
    mask = {n: rng.random(a.shape) < 0.05 for n, a in images.items()}
    mask["b"][:] = False
    p = image_rows(spark, images, mask=mask)
    far = back(distance.squared_to(p, F.col("mask"), "far"), images, "far")
    room = back(distance.squared_room(p), images, "room")
    soft = back(distance.feathered(p, "mask", 3.0), images, "weight")
    for n, a in images.items():
        big = np.pad(a, 1)
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                seeds = np.argwhere(mask[n])
                d = min(((s - (y, x)) ** 2).sum() for s in seeds) if len(seeds) else np.inf
                assert far[n][y, x] == d and abs(soft[n][y, x] - max(0, 1 - np.sqrt(d) / 4)) < 1e-12
                assert room[n][y, x] == min(((s - (y + 1, x + 1)) ** 2).sum() for s in np.argwhere(big != a[y, x]))
    pockets = {(r.image_id, r.region_id): r.pocket_mm for r in distance.label_pockets(p, 0.5).collect()}
    assert all(abs(w - (2 * np.sqrt(room[n][images[n] == r].max()) - 1) * 0.5) < 1e-9 for (n, r), w in pockets.items()) and len(pockets) > 4


def test_components_over_bands(spark, monkeypatch):
    monkeypatch.setattr(graph, "BAND", 3)
    rng = np.random.default_rng(3)
    images = {"a": rng.integers(1, 3, (17, 13)), "b": np.ones((20, 4), int)}
    images["b"][:, 1] = 2
    got = back(graph.pixel_components(image_rows(spark, images)), images, "component")
    for n, a in images.items():
        want = four_connected(a)
        width = max(x.shape[1] for x in images.values())
        first = {k: min(y * width + x for y, x in np.argwhere(want == k)) for k in np.unique(want)}
        assert (got[n] == np.vectorize(first.get)(want)).all()


def test_numbered(spark):
    pairs = [(i, i + 3) for i in range(1, 60, 2)] + [(200, 201)]
    rows = graph.union_pairs(spark.createDataFrame(pairs, "a long, b long")).collect()
    roots = sorted({r.root for r in rows})
    assert all(r.label == roots.index(r.root) + 1 for r in rows) and len(roots) > 2


def test_later_rounds_of_moves_have_only_what_waits(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a = np.ones((48, 12), int)
    a[:, 5:] = 2
    target = np.where(rng.random(a.shape) < 0.6, rng.integers(1, 3, a.shape), a)
    benefit = rng.random(a.shape)
    rows, plain = [], alignment.each_tile
    monkeypatch.setattr(alignment, "each_tile", lambda p, *x, **k: rows.append(p.count()) or plain(p, *x, **k))
    pairs = spark.createDataFrame([("a", 1, 2)], "image_id string, lo long, hi long")
    images = {"a": a}
    got = back(alignment.safe_moves(image_rows(spark, images, target={"a": target}, benefit={"a": benefit}), pairs, passes=1, side=16), images, "region_id")
    assert (got["a"] == moved_one_by_one(a, target, benefit, {(1, 2)}, 1)).all() and (got["a"] != a).any()
    assert len(rows) > 1 and rows[0] == a.size and max(rows[1:]) < a.size // 2


def test_labels_by_ranges(spark):
    """Labels ascend within each image, and no window holds all ids of one."""
    from brindle.operators import raster

    images = {n: np.random.default_rng(k).integers(0, 60, (9, 11)) * 3 for k, n in enumerate("abc")}
    labels = raster.compact_labels(image_rows(spark, images))
    got = {(r.image_id, r.region_id): r.label for r in labels.collect()}
    assert got == {(n, int(v)): k for n, a in images.items() for k, v in enumerate((x for x in np.unique(a) if x), 1)}
    assert "dense_rank" not in labels._jdf.queryExecution().optimizedPlan().toString()


def test_moves_beside_frozen_regions_and_by_colour(spark):
    """A frozen region keeps its pixels while others move beside it; benefits are differences of colours; passes go on until nothing moves."""
    rng = np.random.default_rng(11)
    a = np.ones((20, 18), int)
    a[:, 7:] = 2
    a[12:, :] = 3
    target = np.where(rng.random(a.shape) < 0.7, rng.integers(1, 4, a.shape), a)
    lab = {c: rng.normal(50, 20, a.shape).round(2) for c in "lab"}
    centre = {1: (30.0, 5.0, 2.0), 2: (50.0, -8.0, 4.0), 3: (70.0, 0.0, -9.0)}
    pairs = {(1, 2), (1, 3), (2, 3)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    p = image_rows(spark, {"a": a}, target={"a": target}, **{c: {"a": x} for c, x in lab.items()})
    pair_rows, centres = frame([("a", *x) for x in pairs], "image_id string, lo long, hi long"), frame([("a", r, *c) for r, c in centre.items()], "image_id string, region_id long, l_m double, a_m double, b_m double")
    ends = [*(F.col(c) for c in "lab"), *(F.col(f"m{c}") for c in "lab")]
    each = [(y, x, r, *(float(lab[c][y, x]) for c in "lab"), *centre[r]) for y in range(20) for x in range(18) for r in {int(a[y, x]), int(target[y, x])}]
    far = {(r.y, r.x, r.r): r.e for r in frame(each, "y long, x long, r long, l double, a double, b double, ml double, ma double, mb double").select("y", "x", "r", alignment.difference(*ends).alias("e")).collect()}
    benefit = np.array([[far[y, x, int(a[y, x])] - far[y, x, int(target[y, x])] for x in range(18)] for y in range(20)])
    for frozen in (None, 3):
        held = target.copy()
        if frozen:
            held[(a == frozen) | (target == frozen)] = a[(a == frozen) | (target == frozen)]
        want = moved_one_by_one(a, held, benefit, pairs)
        rows = frame([("a", frozen)], "image_id string, region_id long") if frozen else None
        got = back(alignment.projected(p, pair_rows, centres, rows, side=8), {"a": a}, "region_id")["a"]
        assert (got == want).all() and (want != a).any()
        if frozen:
            assert ((want == 3) == (a == 3)).all() and (want[10:12] != a[10:12]).any()


def test_aligned_boundaries_leaves_no_move(spark, monkeypatch):
    """The query hands over benefits by colour and goes on until a pass moves nothing, not for a fixed two."""
    from brindle.plans import shape_queries

    seen = {}
    monkeypatch.setattr(alignment, "safe_moves", lambda p, pairs, *x, **k: seen.update(p=p, more=x, k=k) or p)
    shape_queries.aligned_boundaries(spark, "/root/testdata/sf0.001")
    assert not seen["more"] and seen["k"].get("passes", 8) >= 8
    assert seen["p"].where("target <> region_id AND benefit <> abs(v)").count() > 0


def test_wide_rims_settle_floods_and_all_passes(spark, monkeypatch):
    """Tiles that see far enough need one run for a flood or for all passes; what depends on more is found and settled otherwise."""
    rng = np.random.default_rng(5)
    a = np.ones((70, 13), int)
    a[:, 6:] = 2
    a[30:] += 2
    images = {"a": a, "b": a[::-1].copy()}
    v = {n: rng.integers(0, 4, x.shape).astype(float) for n, x in images.items()}
    dense, sparse = ({n: np.where(rng.random(x.shape) < share, rng.integers(1, 9, x.shape), 0) for n, x in images.items()} for share in (0.5, 0.02))
    target = {n: np.where(rng.random(x.shape) < 0.7, rng.integers(1, 5, x.shape), x) for n, x in images.items()}
    benefit = {n: rng.random(x.shape) for n, x in images.items()}
    benefit["b"] = np.add.outer(np.arange(70.0), np.arange(13) / 20)  # a chain down the whole image
    pairs = {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)}
    rows = spark.createDataFrame([(n, *p) for n in images for p in pairs], "image_id string, lo long, hi long")
    calls, plain = [], alignment.each_tile
    monkeypatch.setattr(alignment, "each_tile", lambda *x, **k: calls.append(k.get("rim", 1)) or plain(*x, **k))
    for marker, side, rim in ((dense, 24, 12), (sparse, 16, 2)):
        calls.clear()
        got = back(alignment.flooded(image_rows(spark, images, v=v, marker=marker), side, rim), images, "label")
        assert all((got[n] == flood(v[n], marker[n])).all() for n in images)
        assert calls == [12] if rim == 12 else len(calls) > 1
    for names, side, rim, runs in (("a", 32, 24, [24]), ("ab", 16, 4, [4, 16, 1])):
        calls.clear()
        some = {n: images[n] for n in names}
        got = back(alignment.safe_moves(image_rows(spark, some, target=target, benefit=benefit), rows, side=side, rim=rim), some, "region_id")
        for n in some:
            want = moved_one_by_one(images[n], target[n], benefit[n], pairs)
            assert (got[n] == want).all() and (want != images[n]).any(), n
        assert calls[: len(runs)] == runs and (names != "a" or len(calls) == 1)


@pytest.mark.parametrize("reach", [1.0, 2.5])
def test_distance_within_a_reach(spark, reach):
    rng = np.random.default_rng(8)
    images = {n: np.ones(shape, int) for n, shape in (("a", (15, 21)), ("b", (1, 9)))}
    seed = {n: rng.random(x.shape) < 0.06 for n, x in images.items()}
    got = back(distance.squared_within(image_rows(spark, images, seed=seed), F.col("seed"), "far", reach), images, "far")
    for n, x in images.items():
        far = np.min([np.add.outer((np.arange(x.shape[0]) - i) ** 2.0, (np.arange(x.shape[1]) - j) ** 2.0) for i, j in np.argwhere(seed[n])] + [np.full(x.shape, np.inf)], 0)
        assert (got[n] == np.where(far <= reach * reach, far, np.inf)).all()
