import numpy as np
from pyspark.sql import functions as F

from brindle.functions import colour
from brindle.operators import evidence, graph, merging, raster, search, state, validation
from brindle.streaming import jobs


# Published test pairs of the CIEDE2000 formula.
PAIRS = [
    ((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425),
    ((50.0, 3.1571, -77.2803), (50.0, 0.0, -82.7485), 2.8615),
    ((50.0, -1.3802, -84.2814), (50.0, 0.0, -82.7485), 1.0000),
    ((50.0, 0.0, 0.0), (50.0, -1.0, 2.0), 2.3669),
    ((50.0, 2.49, -0.001), (50.0, -2.49, 0.0009), 7.1792),
    ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492),
    ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082),
]


def test_ciede2000(spark):
    rows = spark.createDataFrame([(*a, *b, d) for a, b, d in PAIRS], "a double, b double, c double, d double, e double, f double, want double")
    got = rows.select(colour.difference(*(F.col(c) for c in "abcdef")).alias("de"), "want").collect()
    assert all(abs(r.de - r.want) < 1e-4 for r in got)


def test_white_and_black(spark):
    rows = spark.createDataFrame([(255, 255, 255), (0, 0, 0)], "r int, g int, b int").select(colour.lab(F.col("r"), F.col("g"), F.col("b")).alias("x")).collect()
    assert abs(rows[0].x.l - 100) < 1e-3 and abs(rows[0].x.a) < 0.02 and abs(rows[1].x.l) < 1e-6


def pixels(spark, rows):
    return spark.createDataFrame([("i", y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id string, y long, x long, region_id long")


def test_components_touch_by_sides_only(spark):
    p = graph.pixel_components(pixels(spark, [[1, 1, 0], [0, 0, 1], [2, 0, 1]]))
    sizes = sorted((r.region_id, r["count"]) for r in p.groupBy("region_id", "component").count().collect())
    assert sizes == [(0, 1), (0, 3), (1, 2), (1, 2), (2, 1)]


def test_holes(spark):
    p = pixels(spark, [[1, 1, 1, 1, 1], [1, 0, 1, 2, 1], [1, 1, 1, 1, 1]])
    assert [(r.region_id, r.holes) for r in graph.holes(p).collect()] == [(1, 2)]


def test_perimeter_of_a_square(spark):
    s = raster.region_stats(pixels(spark, [[1, 1], [1, 1]]).withColumn("v", F.lit(1.0)), "v").first()
    assert (s.area, s.perimeter, s.thickness) == (4, 8, 1.0)


def test_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 60)], "a long, b long")
    assert {r.root for r in graph.union_pairs(pairs).collect()} == {1}


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("k", 60.0, 1), ("k", 50.0, 2), ("k", 40.0, 3)], "k string, size double, item long")
    r = merging.budget_with_skip(rows, "k", "size", [(-F.col("size")).alias("o")], 100.0).first()
    assert (r.used, r.kept) == (100.0, 2)


def test_ciede2000_inside_tasks():
    a, b, want = (np.array([p[i] for p in PAIRS]) for i in range(3))
    assert np.abs(colour.difference_of(a, b) - want).max() < 1e-4


CANDIDATE = "key string, difficulty string, attempt int, regions int, loss double, recall double, retention double"


def chosen(spark, *rows):
    r = search.select_candidates(spark.createDataFrame([("k", *x) for x in rows], CANDIDATE)).first()
    return r.easy, r.medium, r.hard


def test_candidates(spark):
    easy, medium, hard = ("easy", 1, 300, 2.0, 1.0, 1.0), ("medium", 1, 330, 2.25, 1.0, 1.0), ("hard", 1, 363, 1.5, 1.0, 1.0)
    assert chosen(spark, easy, medium, hard) == (1, 1, 1)  # steps of just ten percent
    assert chosen(spark, easy, ("medium", 1, 600, 2.3, 1.0, 1.0), hard) == (1, None, 1)  # too much loss
    assert chosen(spark, easy, medium, ("hard", 1, 900, 1.5, 0.9, 1.0)) == (1, None, 1)  # less recall than the medium one
    assert chosen(spark, ("hard", 1, 1060, 1.0, 1.0, 1.0), ("hard", 2, 1045, 1.0, 1.0, 1.0)) == (None, None, 2)  # beyond the budget


def test_patch_and_deletion(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id long, status string, deleted_at timestamp")
    changes = spark.createDataFrame([(1, "")], "id long, status string")
    assert [r.status for r in state.patch(rows, changes, "id", ["status"]).orderBy("id").collect()] == [None, "b"]
    gone = state.soft_delete(rows, rows.where("id = 1"), F.current_timestamp())
    assert [r.id for r in state.live(gone).collect()] == [2]


def test_lasso_and_brush(spark):
    p = pixels(spark, [[0] * 8] * 8)
    assert raster.inside_polygon(p, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]).where("selected").count() == 16
    assert raster.inside_polygon(p, [(0.0, 0.0), (4.0, 0.0)]).where("selected").count() == 0
    assert raster.brushed(p.withColumn("m", F.lit(False)), [(0.5, 0.5, 7.5, 0.5, 1.0, True), (0.5, 0.5, 0.5, 0.5, 1.0, False)], "m").where("m").count() == 7


def test_stream_routes_and_folds(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, kind in enumerate(("ai_image", "other")):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"type": "{kind}", "project_id": "p{i}", "retry_count": 0, "max_retries": 2}}\n')
    stream = jobs.route(jobs.read_jobs(spark, str(tmp_path / "in")))
    jobs.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r.handler for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["image", "legacy"]


def test_further_rules_of_validation(spark):
    """A sound input breaks no rule; each change breaks just its own."""
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "region_id long")
    areas = lambda **changed: spark.createDataFrame([(i, *changed.get(f"r{i}", (10.0, 2.0)), 1) for i in (1, 2, 3)] + [(4, 1000.0, 20.0, 1)], "region_id long, area double, thickness double, components int")
    paints = {1: 1, 2: 2, 3: 1, 4: 2}
    colours = {1: (200, 10, 10), 2: (10, 10, 200)}
    assigned = spark.createDataFrame(list(paints.items()), "region_id long, color_id long")
    palette = spark.createDataFrame([(k, *v) for k, v in colours.items()], "color_id long, r int, g int, b int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "lo long, hi long")
    labels = spark.createDataFrame([(0, x, x) for x in range(5)], "y int, x int, region_id long")
    pixels = lambda last: spark.createDataFrame([(0, 0, 255, 255, 255)] + [(0, x, *colours[paints[x]]) for x in (1, 2, 3)] + last, "y int, x int, r int, g int, b int")
    labelled = lambda *x: spark.createDataFrame([x, (9.0, 9.0)], "font_pt double, height_mm double")
    good = {
        "protected": ids(1, 2), "prefilled": ids(1), "same_ids": True, "region_budget": 4, "least_regions": 4, "placements": labelled(3.0, 1.0), "artificial": 0, "loss": 6.0, "protected_recall": 0.9,
        "protected_mean": 8.0, "protected_p90": 15.0, "painted": (labels, pixels([(0, 4, *colours[2])])), "page_sizes": ((10, 20), (10, 20)),
    }

    def codes(regions=None, **changed):
        rows = validation.validate(areas() if regions is None else regions, edges, assigned, palette, ids(1), ids(), 1.0, 1.0, 2, 0.03, good | changed).collect()
        return sorted(r.code for r in rows)

    assert codes() == []
    assert codes(prefilled=ids(1, 3)) == ["ordinary_region_prefilled"]
    assert codes(areas(r2=(0.4, 2.0))) == ["protected_detail_too_small"]
    assert codes(areas(r2=(10.0, 0.4))) == ["protected_detail_too_thin"]
    assert codes(areas(r1=(0.4, 0.4))) == ["prefilled_detail_too_small", "prefilled_detail_too_thin", "protected_detail_too_small", "protected_detail_too_thin"]
    assert codes(areas().where("region_id < 5").unionByName(areas().where("region_id = 4").withColumn("region_id", F.lit(5).cast("long")))) == ["region_mapping_mismatch", "unmapped_region"]
    for name, value, code in [
        ("region_budget", 3, None), ("region_budget", 2, "protected_budget_exceeded"), ("least_regions", 5, "region_count_below_difficulty"), ("placements", labelled(3.0, 0.9), "label_height_too_small"),
        ("placements", labelled(2.0, 1.0), "label_font_too_small"), ("artificial", 1, "artificial_boundary"), ("loss", 6.1, "global_reconstruction_loss"), ("protected_recall", 0.89, "protected_boundary_loss"),
        ("protected_mean", 8.1, "protected_colour_mean_loss"), ("protected_p90", 15.1, "protected_colour_p90_loss"), ("painted", (labels, pixels([(0, 4, 0, 0, 0)])), "painted_reference_mismatch"),
        ("painted", (labels, pixels([])), "painted_reference_mismatch"), ("page_sizes", ((10, 20), (20, 10)), "page_size_mismatch"),
    ]:
        assert codes(**{name: value}) == ([code] if code else []), name
