"""Superpixels and source reports against plain versions on small rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import colour
from brindle.operators import quality
from test_shapes import four_connected, image_rows


def coloured(spark, images):
    """images: name to array (rows, columns, 3) of 8-bit colours."""
    rows = [(n, y, x, *map(float, a[y, x])) for n, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    p = spark.createDataFrame(rows, "image_id string, y long, x long, r double, g double, bl double")
    return p.withColumn("lab", colour.lab(F.col("r"), F.col("g"), F.col("bl"))).select("image_id", "y", "x", "lab.l", "lab.a", "lab.b")


def sources():
    flat = np.full((64, 64, 3), [225, 210, 180])
    flat[16:48, 16:48] = [70, 80, 100]
    ramp = np.linspace(20, 235, 64)
    x, y = np.meshgrid(ramp, ramp)
    blue = 127.5 + 107.5 * np.sin((x + y) * np.pi / 96.0)
    return {"flat": flat, "ramp": np.stack([x, y, blue], 2).round().astype(int)}


def test_flat_source_passes_and_ramp_warns(spark):
    p = coloured(spark, sources())
    got = {r.image_id: r for r in quality.source_quality(p, 24, 2.0, 64, 4).collect()}
    assert got["flat"].status == "pass" and got["flat"].codes == "" and got["flat"].regions == 2
    assert got["flat"].mean_loss == pytest.approx(0, abs=1e-6)
    assert got["ramp"].status == "warn" and "palette_mismatch" in got["ramp"].codes.split(",")
    assert quality.source_quality(p.limit(0), 24, 2.0, 64, 1).count() == 0


def test_superpixels_are_connected_and_not_small(spark):
    images = sources()
    got = quality.superpixels(coloured(spark, images), 64, 3).collect()
    for name, a in images.items():
        labels = np.full(a.shape[:2], -1)
        for r in got:
            if r.image_id == name:
                labels[r.y, r.x] = r.region_id
        assert (labels >= 0).all()
        ids, sizes = np.unique(labels, return_counts=True)
        assert len(np.unique(four_connected(labels))) == len(ids)
        assert sizes.min() >= 64 * 64 / 64 / 2 and 32 <= len(ids) <= 80


def plain_complexity(a, mm):
    parts, small = four_connected(a), 0
    places = np.argwhere(np.ones(a.shape, bool))
    for part in np.unique(parts):
        inside = np.argwhere(parts == part)
        outside = places[(a != a[tuple(inside[0])]).ravel()]
        reach = max((min(((i - o) ** 2).sum() for o in outside) for i in inside), default=0) if len(outside) else np.inf
        width = max(0.0, 2 * np.sqrt(reach) - 1) * mm
        if len(inside) * mm**2 < 12 or width < 4:
            small += len(inside)
    return len(np.unique(parts)), 100 * small / a.size


@pytest.mark.parametrize("mm", [0.6, 1.5])
def test_complexity(spark, mm):
    rng = np.random.default_rng(4)
    images = {"random": np.kron(rng.integers(1, 4, (5, 6)), np.ones((4, 3), int)), "one": np.ones((7, 9), int), "stripe": np.repeat([[1, 1, 1, 2, 1, 1, 1, 1]], 9, 0)}
    got = {r.image_id: (r.parts, r.micro_percent) for r in quality.complexity(image_rows(spark, images), mm).collect()}
    for name, a in images.items():
        parts, share = plain_complexity(a, mm)
        assert got[name] == (parts, pytest.approx(share))


def test_palettes_of_few_colours_are_exact(spark):
    rows = [("p", 10.0 * (i % 3), 1.0, -2.0, i + 1) for i in range(30)] + [("q", 5.0, 5.0, 5.0, 4)]
    got = {r.image_id: [tuple(c) for c in r.centres] for r in quality.palettes(spark.createDataFrame(rows, "image_id string, l double, a double, b double, area long"), 5).collect()}
    assert got["q"] == [(5.0, 5.0, 5.0)]
    assert [c[0] for c in got["p"]] == pytest.approx([0, 10, 20])


def test_source_report_has_all_superpixels_and_rounds(spark, monkeypatch):
    from brindle.plans import shape_queries

    seen = {}
    monkeypatch.setattr(quality, "superpixels", lambda p, wanted, rounds: seen.update(wanted=wanted, rounds=rounds) or p.withColumn("region_id", F.col("y")))
    monkeypatch.setattr(quality, "complexity", lambda p, mm: p.groupBy("image_id").agg(F.count("*").alias("parts"), F.lit(0.0).alias("micro_percent")))
    shape_queries.source_report(spark, "/root/testdata/sf0.001")
    assert seen == {"wanted": 1225, "rounds": 10}


def test_pixels_meet_centres_in_blocks(spark, monkeypatch):
    """Nearest centres are found for a block of pixels at a time, with the plain rule's result, and rounds of superpixels keep only sums of blocks."""
    monkeypatch.setattr(quality, "BLOCK", 4)
    p = coloured(spark, sources())
    placed = quality.cells(p, 30).persist()
    centres = quality.first_centres(placed).withColumn("y", F.col("y") + 2.5)
    own = quality.assigned(placed, centres)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "transform(" not in plan
    known = {}
    for c in centres.collect():
        known[c.image_id, c.cy, c.cx] = c
    seen = 0
    for r in own.where("y % 7 = 0").collect():
        far = []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if c := known.get((r.image_id, r.cy + dy, r.cx + dx)):
                    colour = (r.l - c.l) ** 2 + (r.a - c.a) ** 2 + (r.b - c.b) ** 2
                    far.append((colour / c.spread + ((r.y - c.y) ** 2 + (r.x - c.x) ** 2) / r.step**2, c.cy, c.cx, colour))
        best = min(far)
        assert (r.home.cy, r.home.cx) == best[1:3] and r.colour == pytest.approx(best[3])
        seen += 1
    assert seen == 2 * 10 * 64 and own.count() == 2 * 64 * 64
    placed.unpersist()
