"""Registered queries of validation, candidate search and job events, with their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import graph, quantiles, raster, search, validation
from brindle.plans.raster_queries import BORDERS, GRID, grid
from brindle.plans.state_queries import EVENTS
from brindle.sources.tables import project_events, table
from brindle.streaming import jobs, machine


def _report(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    regions = raster.region_stats(g, "v").select("region_id", "area", "thickness", (F.col("region_id") % 4 + 1).alias("components"))
    edges = raster.borders(g).select("lo", "hi").distinct()
    assigned = regions.where("region_id <> 7").select("region_id", (F.col("region_id") % 3).alias("color_id"))
    palette = spark.createDataFrame([(0, 10, 10, 10), (1, 10, 10, 10), (5, 7, 8, 9)], "color_id long, r int, g int, b int")
    exempt = regions.where("region_id = 10").select("region_id")
    return validation.validate(regions, edges, assigned, palette, exempt, regions.where("region_id >= 10").select("region_id"), 900.0, 0.66, 2, 0.03)


def validation_issues(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


def validation_actions(spark: SparkSession, d: str) -> DataFrame:
    return validation.actions(_report(spark, d))


def validation_further(spark: SparkSession, d: str) -> DataFrame:
    """Rules with inputs of their own: details, budgets, labels, losses and the painted picture, all measured on the raster; paint 1 is painted once wrongly."""
    g = grid(spark, d)
    regions = raster.region_stats(g, "v").select("region_id", F.col("area") / 2000, F.col("thickness") * 0.8, F.lit(1).alias("components")).toDF("region_id", "area", "thickness", "components")
    assigned = regions.select("region_id", (F.col("region_id") % 3).alias("color_id")).unionByName(regions.agg((F.max("region_id") + 1).alias("region_id")).withColumn("color_id", F.lit(1).cast("long")))
    palette = spark.createDataFrame([(0, 10, 10, 10), (1, 40, 10, 10), (2, 7, 8, 9)], "color_id long, r int, g int, b int")
    some = lambda rule: regions.where(rule).select("region_id")
    edges = raster.borders(g, "v").groupBy("lo", "hi").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("v") - F.col("v_r"))).alias("contrast"))
    off = g.withColumn("off", 120 * F.abs(F.col("v") - (F.col("region_id") - 9.5) / 8)).withColumn("guarded", F.col("region_id") % 3 == 0)
    shown = F.when((F.col("region_id") % 3 == 1) & ~((F.col("y") == 0) & (F.col("x") == 0)), 40).when(F.col("region_id") % 3 == 2, 7).otherwise(10)
    pixels = g.select("y", "x", shown.cast("int").alias("r"), F.when(F.col("region_id") % 3 == 2, 8).otherwise(10).alias("g"), F.when(F.col("region_id") % 3 == 2, 9).otherwise(10).alias("b"))
    further = {
        "protected": some("region_id % 3 = 0"), "prefilled": some("region_id % 4 < 2"), "same_ids": True, "region_budget": 5, "least_regions": 1000, "placements": regions.select((F.col("area") / 2).alias("height_mm"), F.col("area").alias("font_pt")),
        "artificial": edges.agg(F.count_if((F.col("n") < 50) & (F.col("contrast") > 0.2))), "loss": off.agg(F.avg("off") + 3), "protected_recall": off.agg(F.avg((F.col("guarded") & (F.abs("v") > 0.1)).cast("int"))),
        "protected_mean": off.where("guarded").agg(F.avg("off") + 6), "protected_p90": quantiles.percentiles(off.where("guarded"), [], "off", p90=0.9).select(F.col("p90") + 10), "painted": (g, pixels), "page_sizes": ((64, 64), (64, 65)),
    }
    rows = validation.validate(regions, edges.select("lo", "hi"), assigned, palette, some("region_id = 10"), some("region_id < 0"), 0.0, 0.0, 9, 1.0, further)
    return rows.where("code <> 'same_color_adjacency'")


#: Region counts of candidates, with steps of just ten percent.
STEPS = [50, 55, 100, 110, 330, 363, 399]


def candidate_triplet_select(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    key = (F.col("p_partkey") / 15).cast("long")
    steps = F.element_at(F.array(*map(F.lit, STEPS)), (F.col("p_size") % len(STEPS) + 1).cast("int"))
    regions = F.when(key % 2 == 0, F.col("p_size") * 30 + 100).otherwise(steps)
    difficulty = F.element_at(F.array(*(F.lit(x) for x in search.ORDER)), (F.col("p_partkey") % 3 + 1).cast("int"))
    attempt = (F.floor(F.col("p_partkey") % 15 / 3) + 1).cast("int")
    loss = F.col("p_retailprice").cast("double") % 3
    c = p.select(key.alias("key"), difficulty.alias("difficulty"), attempt.alias("attempt"), regions.alias("regions"), loss.alias("loss"), (F.col("p_partkey") * 7 % 3 / 10).alias("recall"), (F.col("p_size") * 3 % 4 / 10).alias("retention"))
    return search.select_candidates(c)


def density_targets(spark: SparkSession, d: str) -> DataFrame:
    e = spark.range(15).select(F.element_at(F.array(*(F.lit(x) for x in search.ORDER)), (F.col("id") % 3 + 1).cast("int")).alias("difficulty"), (F.floor(F.col("id") / 3) + 1).cast("int").alias("attempt"))
    return e.select("difficulty", "attempt", search.density_target(F.col("difficulty"), F.col("attempt")).alias("target"))


def attempt_summary(spark: SparkSession, d: str) -> DataFrame:
    return search.attempt_summary(project_events(spark, d).withColumn("v", F.floor("value").cast("long")), "project_id", "v", "type", "seq")


def job_routing(spark: SparkSession, d: str) -> DataFrame:
    e = project_events(spark, d).select(F.when(F.col("type") == "click", "ai_image").when(F.col("type") == "view", "paint_options").otherwise(F.col("type")).alias("type"))
    return jobs.route(e).groupBy("handler").agg(F.count("*").alias("n"))


def job_retry(spark: SparkSession, d: str) -> DataFrame:
    e = project_events(spark, d).select("seq", "type", (F.col("seq") % 4).cast("int").alias("retry_count"), F.lit(2).alias("max_retries"))
    return jobs.after_failure(e, F.col("type") != "error").groupBy("outcome", "retry_count").agg(F.count("*").alias("n"))


def event_progress(spark: SparkSession, d: str) -> DataFrame:
    e = project_events(spark, d)
    return e.select("seq", jobs.progress(F.when(F.col("seq") % 2 == 0, F.floor(F.col("value")).cast("int") - 20), (F.col("seq") % 150).cast("int")).alias("progress"))


def stale_projects(spark: SparkSession, d: str) -> DataFrame:
    return jobs.stale(project_events(spark, d), F.to_timestamp(F.lit("2024-01-30 00:00:00")), 3600).select("project_id", "last")


def stream_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest_state(project_events(spark, d))


# What the kinds of events stand for as signs of a job.
SIGNS = {"signup": "submitted", "view": "started", "click": "progress", "purchase": "succeeded", "error": "failed"}


def job_steps(spark: SparkSession, d: str) -> DataFrame:
    """The table of events as a stream through the job machine: a worker that is silent for six hours is lost, a job is tried twice."""
    own = machine.stateful_session(spark)
    own.conf.set("spark.sql.session.timeZone", "UTC")  # for times without a zone
    e = own.readStream.schema(table(own, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, since the table may be one file
    kind = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in SIGNS.items()))
    signs = e.select(F.col("user_id").alias("project_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"), "value", F.lit("broken").alias("message"))
    folder = f"{graph.shared_folder(spark)}/steps-{uuid.uuid4().hex}"
    run = machine.written(machine.job_steps(signs, deadline=21600, keep=86400, max_retries=1), f"{folder}/rows", f"{folder}/progress")
    run.awaitTermination()
    return spark.read.schema("project_id long, seq long, at timestamp, status string, attempts int, progress int, error string").parquet(f"{folder}/rows").withColumn("at", F.unix_micros("at"))


ORDER_SQL = "['easy', 'medium', 'hard']"
TARGET_SQL = ", ".join(f"('{k}', {i + 1}, {n})" for k, v in search.TARGETS.items() for i, n in enumerate(v))
REGIONS = f"(SELECT region_id, count(*) AS area, 2 * count(*) / greatest(4 * count(*) - 2 * coalesce(any_value(n), 0), 1) AS thickness, region_id % 4 + 1 AS components FROM {GRID} LEFT JOIN (SELECT l AS region_id, count(*) AS n FROM (SELECT region_id AS l, lead(region_id) OVER (PARTITION BY y ORDER BY x) AS r FROM {GRID} UNION ALL SELECT region_id, lead(region_id) OVER (PARTITION BY x ORDER BY y) FROM {GRID}) WHERE l = r GROUP BY 1) USING (region_id) GROUP BY region_id)"
ISSUES = f"""WITH r AS (SELECT * FROM {REGIONS}), a AS (SELECT region_id, region_id % 3 AS color_id FROM r WHERE region_id <> 7), b AS (SELECT DISTINCT lo, hi FROM {BORDERS})
SELECT code, 'error' AS severity, message, region_id FROM (
SELECT 'disconnected_region' AS code, 'region is not connected' AS message, region_id FROM r WHERE components <> 1
UNION ALL SELECT 'tiny_region', 'region is too small', region_id FROM r WHERE region_id <> 10 AND area < 900 - 1e-6
UNION ALL SELECT 'thin_region', 'region is too thin', region_id FROM r WHERE region_id <> 10 AND thickness < 0.66 - 1e-6
UNION ALL SELECT 'unmapped_region', 'region has no paint', region_id FROM r WHERE region_id = 7
UNION ALL SELECT 'unnumbered_region', 'region has no number', region_id FROM r WHERE region_id > 10
UNION ALL SELECT 'invalid_palette_id', 'paint is not in the palette', NULL FROM (SELECT DISTINCT color_id FROM a) WHERE color_id NOT IN (0, 1, 5)
UNION ALL SELECT 'duplicate_palette_colour', 'paint repeats', NULL
UNION ALL SELECT 'same_color_adjacency', 'neighbours have one paint', lo FROM b JOIN a x ON x.region_id = lo JOIN a y ON y.region_id = hi WHERE x.color_id = y.color_id
UNION ALL SELECT 'palette_over_target', 'too many paints', NULL FROM a HAVING count(DISTINCT color_id) > 2
UNION ALL SELECT 'prefilled_area_exceeded', 'too much is filled', NULL FROM r HAVING sum(area) FILTER (region_id = 10) > 0.03 * sum(area))"""
CANDIDATES = f"(SELECT p_partkey // 15 AS key, {ORDER_SQL}[(p_partkey % 3 + 1)::INT] AS difficulty, (p_partkey % 15 // 3 + 1)::INT AS attempt, CASE WHEN p_partkey // 15 % 2 = 0 THEN p_size * 30 + 100 ELSE {STEPS}[(p_size % {len(STEPS)} + 1)::INT] END::INT AS regions, p_retailprice::DOUBLE % 3 AS loss, p_partkey * 7 % 3 / 10 AS recall, p_size * 3 % 4 / 10 AS retention FROM part)"
ONE = lambda d: f"(SELECT key, attempt, regions, loss, recall, retention FROM {CANDIDATES} WHERE difficulty = '{d}' UNION ALL SELECT DISTINCT key, NULL, NULL, NULL, NULL, NULL FROM {CANDIDATES})"
FOLLOWS = lambda a, b, more="": f"({a}.attempt IS NULL OR {b}.attempt IS NULL OR ({b}.regions * 10 >= {a}.regions * 11 AND {b}.loss <= {a}.loss + 0.25::DOUBLE + 1e-9 AND {b}.retention + 1e-9 >= {a}.retention{more}))"
SCORE = lambda x, budget: f"coalesce(CASE WHEN {x}.regions <= {budget} THEN {x}.regions ELSE {2 * budget} - {x}.regions END, -10000)"

STEPS_SQL = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS p, event_id AS seq, epoch_us(ts) AS t, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIGNS.items())} END AS kind, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL),
 s AS (SELECT DISTINCT p, 0::BIGINT AS k, -1::BIGINT AS seq, 0::BIGINT AS t, 'none' AS status, 0 AS attempts, 0 AS progress, NULL::VARCHAR AS error, FALSE AS new, FALSE AS lost, -1::BIGINT AS seq0, 0::BIGINT AS t0, 'none' AS status0, 0 AS attempts0 FROM e
  UNION ALL SELECT p, k, seq, t, CASE act WHEN 'submitted' THEN 'waiting' WHEN 'started' THEN 'running' WHEN 'succeeded' THEN 'ready' WHEN 'failed' THEN if(attempts0 < 1, 'waiting', 'failed') ELSE status0 END,
  CASE act WHEN 'submitted' THEN 0 WHEN 'failed' THEN least(attempts0 + 1, 1) ELSE attempts0 END, CASE act WHEN 'progress' THEN coalesce(greatest(0, least(100, trunc(value)::INT)), progress) WHEN 'succeeded' THEN 100 WHEN 'none' THEN if(lost, 0, progress) ELSE 0 END,
  CASE act WHEN 'failed' THEN 'broken' WHEN 'none' THEN if(lost, '{machine.LOST}', error) END, act <> 'none', lost, seq0, t0, status0, attempts0
  FROM (SELECT *, CASE WHEN kind = 'submitted' OR (kind = 'started' AND status0 = 'waiting') OR (kind IN ('progress', 'succeeded', 'failed') AND status0 = 'running') THEN kind ELSE 'none' END AS act
   FROM (SELECT e.*, s.progress, s.error, s.seq AS seq0, s.t AS t0, s.status = 'running' AND e.t > s.t + 21600000000 AS lost,
    CASE WHEN s.status = 'running' AND e.t > s.t + 21600000000 THEN if(s.attempts < 1, 'waiting', 'failed') ELSE s.status END AS status0, CASE WHEN s.status = 'running' AND e.t > s.t + 21600000000 THEN least(s.attempts + 1, 1) ELSE s.attempts END AS attempts0
    FROM s JOIN e ON e.p = s.p AND e.k = s.k + 1))),
 z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p ORDER BY k DESC) = 1)
 SELECT p AS project_id, seq, t AS at, status, attempts, progress, error FROM s WHERE new
 UNION ALL SELECT p, seq0, t0 + 21600000000, status0, attempts0, 0, '{machine.LOST}' FROM s WHERE lost
 UNION ALL SELECT p, seq, t + 21600000000, if(attempts < 1, 'waiting', 'failed'), least(attempts + 1, 1), 0, '{machine.LOST}' FROM z WHERE status = 'running' AND t + 21600001000 <= (SELECT max(t) FROM e) - 600000000"""

FURTHER_SQL = f"""WITH g AS MATERIALIZED (SELECT * FROM {GRID}), r AS MATERIALIZED (SELECT region_id, area / 2000 AS area, thickness * 0.8 AS thickness FROM {REGIONS}),
 o AS (SELECT v, region_id % 3 = 0 AS guarded, 120 * abs(v - (region_id - 9.5::DOUBLE) / 8) AS off FROM g), f AS (SELECT region_id % 3 = 0 AS protected, region_id % 4 < 2 AS prefilled, * FROM r),
 b AS (SELECT count(*) AS n, avg(abs(v - v_r)) AS contrast FROM {BORDERS} GROUP BY lo, hi), m AS (SELECT avg(off) AS loss, avg((guarded AND abs(v) > 0.1)::INT) AS recall, avg(off) FILTER (guarded) AS mean, quantile_cont(off, 0.9) FILTER (guarded) AS p90 FROM o)
 SELECT code, 'error' AS severity, message, region_id::BIGINT AS region_id FROM (
 SELECT 'missing_region_record' AS code, 'paint of an unknown region' AS message, max(region_id) + 1 AS region_id FROM r
 UNION ALL SELECT 'ordinary_region_prefilled', 'a region that is not protected is filled', NULL FROM f HAVING bool_or(prefilled AND NOT protected)
 UNION ALL SELECT 'protected_detail_too_small', 'protected detail is too small', region_id FROM f WHERE protected AND area < 0.5 - 1e-6
 UNION ALL SELECT 'protected_detail_too_thin', 'protected detail is too thin', region_id FROM f WHERE protected AND thickness < 0.5 - 1e-6
 UNION ALL SELECT 'prefilled_detail_too_small', 'prefilled detail is too small', region_id FROM f WHERE prefilled AND area < 0.5 - 1e-6
 UNION ALL SELECT 'prefilled_detail_too_thin', 'prefilled detail is too thin', region_id FROM f WHERE prefilled AND thickness < 0.5 - 1e-6
 UNION ALL SELECT 'region_mapping_mismatch', 'map and paints have different regions', NULL
 UNION ALL SELECT 'protected_budget_exceeded', 'too many regions', NULL FROM r HAVING count(*) > 6
 UNION ALL SELECT 'region_count_below_difficulty', 'too few regions', NULL FROM r HAVING count(*) < 1000
 UNION ALL SELECT 'label_height_too_small', 'a label is too low', NULL FROM f HAVING min(area / 2) < 1 - 1e-6 AND bool_or(NOT prefilled)
 UNION ALL SELECT 'label_font_too_small', 'a label''s font is too small', NULL FROM f HAVING min(area) < 72 / 25.4::DOUBLE - 1e-6 AND bool_or(NOT prefilled)
 UNION ALL SELECT 'artificial_boundary', 'a weak boundary has exaggerated contrast', NULL FROM b HAVING bool_or(n < 50 AND contrast > 0.2)
 UNION ALL SELECT 'global_reconstruction_loss', 'the picture has lost too much', NULL FROM m WHERE loss + 3 > 6 + 1e-6
 UNION ALL SELECT 'protected_boundary_loss', 'protected boundaries are lost', NULL FROM m WHERE recall < 0.9 - 1e-6
 UNION ALL SELECT 'protected_colour_mean_loss', 'protected colours are off in the mean', NULL FROM m WHERE mean + 6 > 8 + 1e-6
 UNION ALL SELECT 'protected_colour_p90_loss', 'protected colours are off at the 90th percentile', NULL FROM m WHERE p90 + 10 > 15 + 1e-6
 UNION ALL SELECT 'painted_reference_mismatch', 'the painted picture differs from map and palette', NULL FROM g HAVING bool_or(y = 0 AND x = 0 AND region_id % 3 = 1)
 UNION ALL SELECT 'page_size_mismatch', 'the template has another size than the page', NULL)"""

SQL = {
    "validation_further": FURTHER_SQL,
    "job_steps": STEPS_SQL,
    "validation_issues": ISSUES,
    "validation_actions": f"SELECT ordinal, code, action FROM (VALUES {', '.join(f'({i}, {c!r}, {a!r})' for i, c, a in validation.ACTIONS)}) t(ordinal, code, action) WHERE code IN (SELECT code FROM ({ISSUES}))",
    "candidate_triplet_select": f"""SELECT key, e.attempt AS easy, m.attempt AS medium, h.attempt AS hard FROM {ONE('easy')} e JOIN {ONE('medium')} m USING (key) JOIN {ONE('hard')} h USING (key)
WHERE coalesce(e.attempt, m.attempt, h.attempt) IS NOT NULL AND {FOLLOWS('e', 'm')} AND {FOLLOWS('m', 'h', ' AND h.recall + 1e-9 >= m.recall')} AND (m.attempt IS NOT NULL OR {FOLLOWS('e', 'h')})
QUALIFY row_number() OVER (PARTITION BY key ORDER BY (e.attempt IS NULL)::INT + (m.attempt IS NULL)::INT + (h.attempt IS NULL)::INT, h.attempt IS NULL, m.attempt IS NULL, e.attempt IS NULL, {SCORE('h', 1050)} DESC, {SCORE('m', 750)} DESC, coalesce(abs(e.regions - 300), 10000), coalesce(e.regions, 10000), round_even((coalesce(e.loss, 0) + coalesce(m.loss, 0) + coalesce(h.loss, 0)) * 1e6, 0), coalesce(e.attempt, 0) + coalesce(m.attempt, 0) + coalesce(h.attempt, 0), coalesce(e.attempt, 99), coalesce(m.attempt, 99), coalesce(h.attempt, 99)) = 1""",
    "density_targets": f"SELECT * FROM (VALUES {TARGET_SQL}) t(difficulty, attempt, target)",
    "attempt_summary": f"SELECT project_id, n, CASE WHEN low = high THEN low::VARCHAR ELSE low || '-' || high END AS range, stages, array_to_string(ids[1:12], ',') || CASE WHEN len(ids) > 12 THEN ',...' ELSE '' END AS ids FROM (SELECT project_id, count(*) AS n, min(floor(value)::BIGINT) AS low, max(floor(value)::BIGINT) AS high, string_agg(DISTINCT type, ',' ORDER BY type) AS stages, list_sort(list(DISTINCT seq)) AS ids FROM {EVENTS} GROUP BY project_id)",
    "job_routing": f"SELECT CASE type WHEN 'click' THEN 'image' WHEN 'view' THEN 'options' ELSE 'legacy' END AS handler, count(*) AS n FROM {EVENTS} GROUP BY 1",
    "job_retry": f"SELECT CASE WHEN ok THEN 'retry' ELSE 'dead' END AS outcome, (c + ok::INT)::INT AS retry_count, count(*) AS n FROM (SELECT seq % 4 AS c, type <> 'error' AND seq % 4 < 2 AS ok FROM {EVENTS}) GROUP BY 1, 2",
    "event_progress": f"SELECT seq, least(greatest(CASE WHEN seq % 2 = 0 THEN floor(value)::INT - 20 ELSE seq % 150 END, 0), 100)::INT AS progress FROM {EVENTS}",
    "stale_projects": f"SELECT project_id, max(ts) AS last FROM {EVENTS} GROUP BY project_id HAVING max(ts) < TIMESTAMP '2024-01-29 23:00:00'",
    "stream_latest_state": f"SELECT project_id, max(seq) AS seq, arg_max(type, seq) AS type, arg_max(value, seq) AS value FROM {EVENTS} GROUP BY project_id",
}
QUERIES = {name: globals()[name] for name in SQL}
