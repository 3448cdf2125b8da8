"""Registered queries over rasters and region graphs, with their SQL for DuckDB.

The table embeddings is read as one raster: vec_id is the row, the position in the array the column, and
floor(8 v) the region of a pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import contraction, evidence, graph, merging, quantiles, raster
from brindle.sources.tables import table

SCALE = 8


def grid(spark: SparkSession, d: str) -> DataFrame:
    """(image_id, y, x, v, region_id) of every pixel."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return e.select(F.lit("e").alias("image_id"), "y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"), (F.floor(F.col("v") * SCALE) + 10).cast("long").alias("region_id"))


GRID = f"(SELECT 'e' AS image_id, y, x, v, floor(v * {SCALE})::BIGINT + 10 AS region_id FROM (SELECT vec_id AS y, unnest(range(len(embedding))) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings))"
CONTACTS = f"(SELECT y, x, region_id AS l, lead(region_id) OVER (PARTITION BY y ORDER BY x) AS r, v, lead(v) OVER (PARTITION BY y ORDER BY x) AS v_r, 'right' AS axis FROM {GRID} UNION ALL SELECT y, x, region_id, lead(region_id) OVER (PARTITION BY x ORDER BY y), v, lead(v) OVER (PARTITION BY x ORDER BY y), 'down' FROM {GRID})"
BORDERS = f"(SELECT *, least(l, r) AS lo, greatest(l, r) AS hi FROM {CONTACTS} WHERE r IS NOT NULL AND l <> r)"


def raster_region_stats(spark: SparkSession, d: str) -> DataFrame:
    s = raster.region_stats(grid(spark, d), "v")
    return s.select("region_id", "area", "left", "top", "right", "bottom", "perimeter", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("thickness", 6).alias("thickness"))


def raster_shared_boundary(spark: SparkSession, d: str) -> DataFrame:
    return raster.shared_boundary(grid(spark, d)).drop("image_id")


def raster_adjacency_degree(spark: SparkSession, d: str) -> DataFrame:
    return raster.degrees(grid(spark, d)).drop("image_id")


def raster_boundary_mask_length(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    mask = raster.boundary_mask(g).agg(F.count_if("edge").alias("edge_pixels"), F.round(F.avg(F.when(F.col("edge"), F.abs("v"))), 6).alias("alignment"))
    return mask.crossJoin(raster.contacts(g).where("l <> r").agg(F.count("*").alias("boundary_length")))  # one row each


def raster_dilated_retention(spark: SparkSession, d: str) -> DataFrame:
    m = raster.dilated(raster.boundary_mask(grid(spark, d)).withColumn("high", F.col("v") > 0.3), "high", 2, "near")
    return m.agg(F.count_if("near").alias("near"), F.round(F.coalesce(F.count_if(F.col("near") & F.col("edge")) / F.nullif(F.count_if("edge"), F.lit(0)), F.lit(1.0)), 6).alias("retention"))


def raster_gradient_percentile(spark: SparkSession, d: str) -> DataFrame:
    g = graph.saved(raster.gradient(grid(spark, d), "v").select("gradient"))
    p = quantiles.percentiles(g, [], "gradient", p995=0.995, p90=0.9)
    return p.crossJoin(g.agg(F.avg("gradient").alias("mean"))).select(*(F.round(c, 6).alias(c) for c in ("p995", "p90", "mean")))  # one row each


def raster_gaussian_blur(spark: SparkSession, d: str) -> DataFrame:
    b = raster.blurred(grid(spark, d), "v", 0.4, "smooth")
    return b.groupBy("region_id").agg(F.round(F.avg("smooth"), 6).alias("smooth"), F.round(F.stddev_pop("smooth"), 6).alias("spread"))


def edge_selection_coverage(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).withColumn("w", F.when(F.col("x") < 32, 1.0).otherwise(0.25))
    return raster.selection_coverage(g, "w").select("lo", "hi", F.round("coverage", 6).alias("coverage"))


def edge_strongest_anchor(spark: SparkSession, d: str) -> DataFrame:
    return raster.strongest_anchor(grid(spark, d), "v").select("lo", "hi", "y", "x", "axis", F.round("strength", 6).alias("strength"))


def _edges(g: DataFrame) -> DataFrame:
    cover = raster.selection_coverage(g.withColumn("w", F.when(F.col("x") < 32, 1.0).otherwise(0.25)), "w")
    mean = g.groupBy("image_id", "region_id").agg(F.avg("v").alias("m"))
    ends = lambda s: mean.select("image_id", F.col("region_id").alias(s), F.col("m").alias(f"m_{s}"))
    e = raster.shared_boundary(g).join(cover, ["image_id", "lo", "hi"]).join(ends("lo"), ["image_id", "lo"]).join(ends("hi"), ["image_id", "hi"])
    return e.withColumn("delta_e", F.abs(F.col("m_lo") - F.col("m_hi")) * 20).withColumn("evidence", F.least(F.lit(1.0), F.col("delta_e") / 10))


def edge_evidence_boost(spark: SparkSession, d: str) -> DataFrame:
    e = raster.boosted_evidence(_edges(grid(spark, d)), 5.8)
    return e.select("lo", "hi", F.round("evidence", 6).alias("evidence"), "hard")


def region_protection_score(spark: SparkSession, d: str) -> DataFrame:
    """A region without edges has 0."""
    g = grid(spark, d)
    e = _edges(g)
    ends = e.select(F.col("lo").alias("region_id"), "evidence", "shared_len").unionByName(e.select(F.col("hi").alias("region_id"), "evidence", "shared_len"))
    score = F.least(F.lit(1.0), 0.6 * F.max("evidence") + 0.4 * F.sum(F.col("evidence") * F.col("shared_len")) / F.sum("shared_len"))
    scores = ends.groupBy("region_id").agg(F.round(score, 6).alias("score"))
    return g.select("region_id").distinct().join(scores, "region_id", "left").fillna(0.0, ["score"])


def label_compaction(spark: SparkSession, d: str) -> DataFrame:
    return raster.compact_labels(grid(spark, d)).drop("image_id")


def label_overlap_remap(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).withColumn("fine", F.floor(F.col("v") * 20).cast("long"))
    return raster.overlap_remap(g, "region_id", "fine").drop("image_id")


def label_first_pixel_remap(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).withColumn("fine", F.floor(F.col("v") * 20).cast("long"))
    return raster.first_pixel_remap(g, "fine", "region_id").drop("image_id")


def lut_gather(spark: SparkSession, d: str) -> DataFrame:
    paints = raster.compact_labels(grid(spark, d)).where("label % 3 <> 0").withColumn("paint", F.col("label") * 10)
    return raster.looked_up(grid(spark, d), paints, "region_id", "paint", 255).groupBy("paint").agg(F.count("*").alias("n"))


PALETTE = [(1, -0.2, -0.2, -0.2), (2, 0.0, 0.0, 0.0), (3, 0.2, 0.2, 0.2), (4, 0.2, -0.2, 0.1)]


def nearest_palette_assign(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("abc")))
    return raster.nearest_paint(e, PALETTE, F.col("a"), F.col("b"), F.col("c")).select("vec_id", "color_id", F.round("distance", 6).alias("distance"))


def pixel_paint_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of each paint for each region: pixels are counted by value first, so only distinct values meet the palette."""
    counts = grid(spark, d).groupBy("region_id", F.round("v", 2).alias("value")).agg(F.count("*").alias("n"))
    paints = F.explode(F.array(*(F.struct(F.lit(i).alias("color_id"), F.lit(x).alias("paint")) for i, x, _, _ in PALETTE))).alias("p")
    return counts.select("region_id", "value", "n", paints).groupBy("region_id", F.col("p.color_id").alias("color_id")).agg(F.round(F.sum(F.col("n") * F.abs(F.col("value") - F.col("p.paint"))), 6).alias("cost"))


POLYGON = [(4.0, 3.0), (50.0, 10.0), (40.0, 60.0), (10.0, 45.0)]


def lasso_coverage(spark: SparkSession, d: str) -> DataFrame:
    g = raster.inside_polygon(grid(spark, d), POLYGON)
    g = raster.brushed(g, [(5.0, 5.0, 60.0, 60.0, 6.0, True), (30.0, 0.0, 30.0, 63.0, 4.0, False)], "selected")
    return g.groupBy("y").agg(F.count_if("selected").alias("selected"), F.round(100 * F.avg(F.col("selected").cast("double")), 6).alias("coverage"))


def undo_history(spark: SparkSession, d: str) -> DataFrame:
    """The ten newest versions of each key."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("r <= 10").drop("r")


def component_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.pixel_components(grid(spark, d)).groupBy("region_id", "component").agg(F.count("*").alias("area"))


def region_component_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.pixel_components(grid(spark, d)).groupBy("region_id").agg(F.countDistinct("component").alias("components"))


def region_holes(spark: SparkSession, d: str) -> DataFrame:
    return graph.holes(grid(spark, d)).drop("image_id")


def union_pairs_min_root(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    pairs = c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") * 7 % 1000 + 1).alias("b"))
    return graph.union_pairs(pairs)


def running_budget_skip(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", F.col("p_size").alias("size"), F.col("p_partkey").alias("item"))
    return merging.budget_with_skip(p, "p_brand", "size", [(-F.col("size")).alias("k1"), F.col("item").alias("k2")], 100.0)


def _region_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions and edges of the whole raster's components."""
    g = graph.saved(graph.pixel_components(grid(spark, d)).withColumn("region_id", F.col("component")))
    costs = F.array(*(F.sum(F.abs(F.col("v") - x) * 100) for x in (-0.2, 0.0, 0.2)))
    colours = g.groupBy("image_id", "region_id").agg(F.count("*").alias("area"), (F.avg("v") * 100 + 50).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), costs.alias("costs"))
    # contacts of pixels are counted once, for the perimeters and for the edges
    sides = graph.saved(raster.contacts(g).groupBy("image_id", F.least("l", "r").alias("lo"), F.greatest("l", "r").alias("hi")).agg(F.count("*").alias("shared_len")))
    inner = sides.where("lo = hi").select("image_id", F.col("lo").alias("region_id"), F.col("shared_len").alias("inner"))
    regions = colours.join(inner, ["image_id", "region_id"], "left").withColumn("perimeter", 4 * F.col("area") - 2 * F.coalesce("inner", F.lit(0))).drop("inner")
    edges = sides.where("lo <> hi AND lo <> 0 AND hi <> 0").withColumns({"evidence": F.least(F.lit(1.0), F.col("shared_len") / 20.0), "user_edge": F.col("lo") % 97 == 0})
    return regions, edges


def hierarchical_merge_summary(spark: SparkSession, d: str) -> DataFrame:
    joined, _ = contraction.merge_hierarchically(*_region_graph(spark, d), 400, 440, 3, 6.0, 1.0)
    return joined.groupBy("image_id", "merged_id").agg(F.count("*").alias("parts"))


def _options(g: DataFrame) -> DataFrame:
    mean = g.groupBy("image_id", "region_id").agg(F.avg("v").alias("m"))
    paints = F.explode(F.array(*(F.struct(F.lit(i).alias("color_id"), F.lit(x).alias("paint")) for i, x, _, _ in PALETTE))).alias("p")
    return mean.select("image_id", "region_id", "m", paints).select("image_id", "region_id", F.col("p.color_id").alias("color_id"), (F.abs(F.col("m") - F.col("p.paint")) * 20).alias("error"))


def _assigned(options: DataFrame) -> DataFrame:
    return options.groupBy("image_id", "region_id").agg(F.min_by("color_id", F.struct("error", "color_id")).alias("color_id"))


def _paints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, j, abs(x - y) * 20) for i, x, _, _ in PALETTE for j, y, _, _ in PALETTE], "one int, two int, paint_de double")


def palette_conflicts(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    return evidence.conflicts(_edges(g).select("image_id", "lo", "hi", "delta_e", "evidence"), _assigned(_options(g)), _paints(spark)).drop("image_id")


def faithful_recolour(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    o = _options(g)
    return evidence.faithful_paints(o, _edges(g).select("image_id", "lo", "hi", "delta_e", "evidence"), _assigned(o), _paints(spark)).drop("image_id")


def recolour_benefit(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    o = _options(g)
    return evidence.reconstruction_benefit(o, _edges(g).select("image_id", "lo", "hi"), _assigned(o)).select("region_id", F.round("benefit", 6).alias("benefit"))


def boundary_evidence(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    return evidence.boundary_evidence(g, "v", _edges(g).select("image_id", "lo", "hi", "delta_e")).select("lo", "hi", "shared_len", F.round("evidence", 6).alias("evidence"))


def absorbed_regions(spark: SparkSession, d: str) -> DataFrame:
    regions, edges = _region_graph(spark, d)
    to = contraction.absorbed(regions, edges, 12.0, 0.5, 2.0, 0.2)
    return regions.join(to, ["image_id", "region_id"]).groupBy("image_id", F.col("to").alias("region_id")).agg(F.sum("area").alias("area"))


def boundary_junctions(spark: SparkSession, d: str) -> DataFrame:
    return evidence.junctions(grid(spark, d)).groupBy("degree").agg(F.count("*").alias("n"))


def lloyd_palette(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(*(F.col("embedding")[i].alias(c) for i, c in enumerate("abc")), F.lit(1.0).alias("w"))
    return merging.lloyd(e, ["a", "b", "c"], "w", 6).select("cluster_id", *(F.round(c, 6).alias(c) for c in ("a", "b", "c", "weight")))


def label_positions(spark: SparkSession, d: str) -> DataFrame:
    return merging.label_places(grid(spark, d), 3.0, 3)


def raster_equality(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    return raster.differing_pixels(g, g.withColumn("region_id", F.floor(F.col("v") * SCALE + 0.001).cast("long") + 10), "region_id")


def _sobel() -> str:
    at = lambda c, by, d: f"coalesce({'lead' if d > 0 else 'lag'}({c}) OVER (PARTITION BY {by} ORDER BY {'x' if by == 'y' else 'y'}), {c})"
    inner = f"(SELECT *, {at('v', 'y', -1)} + 2 * v + {at('v', 'y', 1)} AS sx, {at('v', 'y', 1)} - {at('v', 'y', -1)} AS dx FROM {GRID})"
    return f"(SELECT *, sqrt(pow({at('dx', 'x', -1)} + 2 * dx + {at('dx', 'x', 1)}, 2) + pow({at('sx', 'x', 1)} - {at('sx', 'x', -1)}, 2)) AS g FROM {inner})"


MASK = f"(SELECT *, coalesce(lead(region_id) OVER r <> region_id, false) OR coalesce(lag(region_id) OVER r <> region_id, false) OR coalesce(lead(region_id) OVER c <> region_id, false) OR coalesce(lag(region_id) OVER c <> region_id, false) AS edge FROM {GRID} WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))"
EDGES = f"""(SELECT lo, hi, shared_len, coverage, abs(a.m - b.m) * 20 AS delta_e, least(1, abs(a.m - b.m) * 20 / 10) AS evidence FROM (SELECT lo, hi, count(*) AS shared_len, avg(greatest(CASE WHEN x < 32 THEN 1 ELSE 0.25 END, CASE WHEN x + (axis = 'right')::INT < 32 THEN 1 ELSE 0.25 END)) AS coverage FROM {BORDERS} GROUP BY lo, hi)
 JOIN (SELECT region_id, avg(v) AS m FROM {GRID} GROUP BY 1) a ON a.region_id = lo JOIN (SELECT region_id, avg(v) AS m FROM {GRID} GROUP BY 1) b ON b.region_id = hi)"""
FINE = f"(SELECT *, floor(v * 20)::BIGINT AS fine FROM {GRID})"
NEAREST = ", ".join(f"(pow(a - {a}, 2) + pow(b - {b}, 2) + pow(c - {c}, 2))" for _, a, b, c in PALETTE)

PAINTED = f"""o AS (SELECT region_id, i AS color_id, abs(m - x) * 20 AS error FROM (SELECT region_id, avg(v) AS m FROM {GRID} GROUP BY 1), (VALUES {', '.join(f'({i}, {x}::DOUBLE)' for i, x, _, _ in PALETTE)}) p(i, x)),
a AS (SELECT region_id, arg_min(color_id, error) AS color_id FROM o GROUP BY region_id),
pp AS (SELECT * FROM (VALUES {', '.join(f'({i}, {j}, {abs(x - y) * 20}::DOUBLE)' for i, x, _, _ in PALETTE for j, y, _, _ in PALETTE)}) q(one, two, paint_de))"""

REACH = f"""WITH RECURSIVE p AS (SELECT y * 64 + x AS id, y, x, region_id FROM {GRID}), reach(id, root) USING KEY (id) AS (SELECT id, id AS root FROM p UNION SELECT b.id, min(r.root) FROM reach r JOIN p a ON a.id = r.id JOIN p b ON a.region_id = b.region_id AND (b.id = a.id + 64 OR b.id = a.id - 64 OR (b.y = a.y AND abs(b.x - a.x) = 1)) JOIN recurring.reach o ON o.id = b.id WHERE r.root < o.root GROUP BY b.id)"""

SQL = {
    "raster_region_stats": f"SELECT region_id, area, l AS left, t AS top, r AS right, b AS bottom, 4 * area - 2 * coalesce(n, 0) AS perimeter, round(mean, 6) AS mean, round(med, 6) AS median, round(2 * area / greatest(4 * area - 2 * coalesce(n, 0), 1), 6) AS thickness FROM (SELECT region_id, count(*) AS area, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b, avg(v) AS mean, quantile_cont(v, 0.5) AS med FROM {GRID} GROUP BY region_id) LEFT JOIN (SELECT l AS region_id, count(*) AS n FROM {CONTACTS} WHERE l = r GROUP BY 1) USING (region_id)",
    "raster_shared_boundary": f"SELECT lo, hi, count(*) AS shared_len FROM {BORDERS} GROUP BY lo, hi",
    "raster_adjacency_degree": f"WITH p AS (SELECT DISTINCT lo, hi FROM {BORDERS}), e AS (SELECT lo AS region_id FROM p UNION ALL SELECT hi FROM p) SELECT region_id, count(e.region_id) AS degree FROM (SELECT DISTINCT region_id FROM {GRID}) LEFT JOIN e USING (region_id) GROUP BY region_id",
    "raster_boundary_mask_length": f"SELECT count(*) FILTER (edge) AS edge_pixels, round(avg(abs(v)) FILTER (edge), 6) AS alignment, (SELECT count(*) FROM {BORDERS}) AS boundary_length FROM {MASK}",
    "raster_dilated_retention": f"SELECT count(*) FILTER (near) AS near, round(count(*) FILTER (near AND edge) / count(*) FILTER (edge), 6) AS retention FROM (SELECT edge, max(a) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM (SELECT *, max(v > 0.3) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM {MASK}))",
    "raster_gradient_percentile": f"SELECT round(quantile_cont(g, 0.995), 6) AS p995, round(quantile_cont(g, 0.9), 6) AS p90, round(avg(g), 6) AS mean FROM {_sobel()}",
    "edge_selection_coverage": f"SELECT lo, hi, round(coverage, 6) AS coverage FROM {EDGES}",
    "edge_strongest_anchor": f"SELECT lo, hi, y, x, axis, round(greatest(v, v_r), 6) AS strength FROM {BORDERS} QUALIFY row_number() OVER (PARTITION BY lo, hi ORDER BY greatest(v, v_r) DESC, y, x, axis) = 1",
    "edge_evidence_boost": f"SELECT lo, hi, round(CASE WHEN hit THEN raised ELSE evidence END, 6) AS evidence, hit AND raised >= 0.7 AS hard FROM (SELECT *, coverage > 0 AND (delta_e >= 2 OR evidence >= 0.2) AS hit, least(1, greatest(evidence * (1 + 4.8 * coverage), least(0.7, 1.16 * coverage))) AS raised FROM {EDGES})",
    "region_protection_score": f"SELECT region_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT region_id FROM {GRID}) LEFT JOIN (SELECT region_id, round(least(1, 0.6 * max(evidence) + 0.4 * sum(evidence * shared_len) / sum(shared_len)), 6) AS score FROM (SELECT lo AS region_id, evidence, shared_len FROM {EDGES} UNION ALL SELECT hi, evidence, shared_len FROM {EDGES}) GROUP BY region_id) USING (region_id)",
    "label_compaction": f"SELECT region_id, dense_rank() OVER (ORDER BY region_id) AS label FROM (SELECT DISTINCT region_id FROM {GRID} WHERE region_id <> 0)",
    "label_overlap_remap": f"SELECT fine, region_id, n, area FROM (SELECT fine, region_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY fine)::BIGINT AS area FROM {FINE} GROUP BY fine, region_id) WHERE n >= 0.8 * area QUALIFY row_number() OVER (PARTITION BY fine ORDER BY n DESC, region_id) = 1",
    "label_first_pixel_remap": f"SELECT fine, arg_min(region_id, y * 1000 + x) AS region_id FROM {FINE} GROUP BY fine",
    "lut_gather": f"SELECT coalesce(paint, 255) AS paint, count(*) AS n FROM {GRID} LEFT JOIN (SELECT region_id, dense_rank() OVER (ORDER BY region_id) * 10 AS paint FROM (SELECT DISTINCT region_id FROM {GRID} WHERE region_id <> 0) QUALIFY dense_rank() OVER (ORDER BY region_id) % 3 <> 0) USING (region_id) GROUP BY 1",
    "nearest_palette_assign": f"SELECT vec_id, (list_position([{NEAREST}], least({NEAREST})))::INT AS color_id, round(sqrt(least({NEAREST})), 6) AS distance FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)",
    "pixel_paint_costs": f"SELECT region_id, p.i AS color_id, round(sum(n * abs(value - p.x)), 6) AS cost FROM (SELECT region_id, round(v, 2) AS value, count(*) AS n FROM {GRID} GROUP BY 1, 2), (VALUES {', '.join(f'({i}, {x}::DOUBLE)' for i, x, _, _ in PALETTE)}) p(i, x) GROUP BY region_id, p.i",
    "running_budget_skip": """WITH RECURSIVE r AS (SELECT p_brand, p_size::DOUBLE AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part),
f AS (SELECT DISTINCT p_brand, 0::BIGINT AS n, 0::DOUBLE AS used, 0::BIGINT AS kept FROM part UNION ALL SELECT f.p_brand, r.n, CASE WHEN used + s <= 100 THEN used + s ELSE used END, kept + (used + s <= 100)::BIGINT FROM f JOIN r ON r.p_brand = f.p_brand AND r.n = f.n + 1)
SELECT p_brand, used, kept FROM f QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC) = 1""",
    "undo_history": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10",
    "component_labels": f"{REACH} SELECT region_id, root AS component, count(*) AS area FROM reach JOIN p USING (id) GROUP BY 1, 2",
    "region_component_counts": f"{REACH} SELECT region_id, count(DISTINCT root) AS components FROM reach JOIN p USING (id) GROUP BY 1",
    "union_pairs_min_root": "WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey * 7 % 1000 + 1 AS b FROM customer), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS other FROM s UNION SELECT reach.node, s.b FROM reach JOIN s ON s.a = reach.other), r AS (SELECT node, min(other) AS root FROM reach GROUP BY node) SELECT node, root, dense_rank() OVER (ORDER BY root) AS label FROM r",
    "palette_conflicts": f"WITH {PAINTED} SELECT lo, hi, CASE WHEN x.color_id = y.color_id THEN 'same_paint' ELSE 'artificial' END AS kind FROM {EDGES} e JOIN a x ON x.region_id = lo JOIN a y ON y.region_id = hi JOIN pp ON one = x.color_id AND two = y.color_id WHERE x.color_id = y.color_id OR (delta_e < 2 AND evidence < 0.2 AND paint_de >= 5)",
    "faithful_recolour": f"""WITH {PAINTED}, b AS (SELECT lo AS region_id, hi AS n, delta_e, evidence FROM {EDGES} UNION ALL SELECT hi, lo, delta_e, evidence FROM {EDGES}),
near AS (SELECT * FROM o WHERE error <= 8 QUALIFY error <= min(error) OVER (PARTITION BY region_id) + 2),
spoiled AS (SELECT DISTINCT near.region_id, near.color_id FROM near JOIN b ON b.region_id = near.region_id JOIN a ON a.region_id = b.n JOIN pp ON one = near.color_id AND two = a.color_id WHERE near.color_id = a.color_id OR paint_de > greatest(5, 1.5 * delta_e + 2) OR (delta_e < 2 AND evidence < 0.2 AND paint_de >= 5))
SELECT region_id, color_id FROM near ANTI JOIN spoiled USING (region_id, color_id) QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY error, color_id) = 1""",
    "recolour_benefit": f"WITH {PAINTED}, b AS (SELECT lo AS region_id, hi AS n FROM {EDGES} UNION ALL SELECT hi, lo FROM {EDGES}) SELECT x.region_id, round(greatest(0, x.other - p.error), 6) AS benefit FROM (SELECT b.region_id, min(o.error) AS other FROM b JOIN a ON a.region_id = b.n JOIN o ON o.region_id = b.region_id AND o.color_id = a.color_id GROUP BY 1) x JOIN a USING (region_id) JOIN o p ON p.region_id = a.region_id AND p.color_id = a.color_id",
    "boundary_junctions": f"SELECT degree, count(*) AS n FROM (SELECT y, x, count(*) AS degree FROM (SELECT CASE axis WHEN 'right' THEN y ELSE y + 1 END AS y, CASE axis WHEN 'right' THEN x + 1 ELSE x END AS x FROM {BORDERS} UNION ALL SELECT y + 1, x + 1 FROM {BORDERS}) GROUP BY y, x) WHERE degree <> 2 GROUP BY degree",
    "raster_equality": f"SELECT count(*) AS differing FROM {GRID} WHERE region_id <> floor(v * {SCALE} + 0.001)::BIGINT + 10",
}

ROWS_ONLY = ("raster_gaussian_blur", "lasso_coverage", "region_holes", "hierarchical_merge_summary", "boundary_evidence", "absorbed_regions", "lloyd_palette", "label_positions")
QUERIES = {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}
