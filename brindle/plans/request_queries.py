"""Registered queries of request rules and of coarsened regions, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import requests
from brindle.operators import coarsening, raster
from brindle.plans.raster_queries import BORDERS, GRID, grid
from brindle.plans.state_queries import EVENTS
from brindle.sources.tables import project_events, table

BODIES = [
    '{"error": {"message": "too many requests", "type": "limit", "code": "rate", "request_id": "r1"}}',
    '{"error": {"message": 7, "code": "moderation_blocked", "moderation_details": {"moderation_stage": "input", "categories": ["a", "", 3, "b"], "other": "x"}}, "request_id": "r2"}',
    '{"error": "plain words", "request_id": 5}',
    '{"error": {"message": "", "moderation_details": {"moderation_stage": "", "categories": "none"}}}',
    "bad gateway",
    "[1, 2]",
]
STYLES = {"portrait": "Keep the face.", "landscape": "Keep the horizon."}


def explicit_crop_box(spark: SparkSession, d: str) -> DataFrame:
    """Crops of parts' sizes; most have the ratio asked for, and some leave the image."""
    width, height, w = F.col("p_size") * 10 + 7, (F.col("p_partkey") % 90 + 10) * 10, (F.col("p_partkey") % 7 + 1) / 10
    h = w * width / 0.75 / height + F.when(F.col("p_partkey") % 4 == 0, 0.05).otherwise(0.0)
    box = requests.explicit_crop((F.col("p_partkey") % 5) / 10, (F.col("p_size") % 3) / 10, w, h, width, height, 0.75)
    return table(spark, d, "part").select("p_partkey", box.alias("c")).select("p_partkey", "c.*")


def crop_rescale(spark: SparkSession, d: str) -> DataFrame:
    asked, got = F.col("p_size") * 10 + 1000, F.col("p_partkey") % 500 + 900
    return table(spark, d, "part").select("p_partkey", requests.rescaled(F.col("p_size") * 3, asked, got).alias("left"), requests.rescaled(asked - F.col("p_size"), asked, got).alias("right"))


def prompt_sections(spark: SparkSession, d: str) -> DataFrame:
    kept = F.split(F.col("p_name"), " ")
    style = F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv])
    chosen = F.coalesce(style[F.lower(F.when(F.col("p_size") % 2 == 0, "Portrait").otherwise("Still"))], F.lit(STYLES["landscape"]))
    keep = requests.listed(F.when(F.col("p_size") % 3 > 0, kept).otherwise(F.array()), "none")
    text = F.concat(F.lit("Keep: "), keep, F.lit(". "), chosen, requests.section("Guidance", F.when(F.col("p_size") % 5 == 0, "  ").when(F.col("p_size") % 5 < 4, F.concat(F.lit(" "), "p_type"))))
    return table(spark, d, "part").select("p_partkey", text.alias("prompt"))


def error_details(spark: SparkSession, d: str) -> DataFrame:
    body = F.element_at(F.array(*map(F.lit, BODIES)), (F.col("seq") % len(BODIES) + 1).cast("int"))
    detail = requests.error_detail(F.col("seq") % 5 + 500, body)
    return project_events(spark, d).select("seq", detail.alias("e")).select("seq", "e.*")


def public_ids(spark: SparkSession, d: str) -> DataFrame:
    """Form and number of distinct ids; the ids themselves differ from run to run."""
    ids = table(spark, d, "customer").select(requests.public_id(16).alias("id"))
    return ids.agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_distinct"), F.bool_and(F.col("id").rlike("^[a-z2-7]{16}$")).alias("well_formed"))


def _remap(g: DataFrame) -> DataFrame:
    return g.select("region_id").distinct().withColumn("new_id", F.floor(F.col("region_id") / 3).cast("long"))


def coarse_regions(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    regions = g.groupBy("region_id").agg(F.count("*").alias("area"), F.max("v").alias("score"), F.avg("v").alias("l"), F.min("v").alias("a"), F.avg("x").alias("b"))
    out = coarsening.coarsened_regions(regions, _remap(g))
    return out.select("region_id", "area", *(F.round(c, 6).alias(c) for c in ("score", "l", "a", "b")))


def coarse_edges(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    return coarsening.coarsened_edges(raster.shared_boundary(g).select("lo", "hi", F.col("shared_len").alias("evidence")), _remap(g))


QUERIES = {f.__name__: f for f in (explicit_crop_box, crop_rescale, prompt_sections, error_details, public_ids, coarse_regions, coarse_edges)}

BODY_SQL = "[" + ", ".join(f"'{b}'" for b in BODIES) + f"][(seq % {len(BODIES)} + 1)::INT]"
TEXT_SQL = lambda path: f"CASE WHEN json_type(j, '{path}') = 'VARCHAR' THEN json_extract_string(j, '{path}') END"
SQL = {
    "explicit_crop_box": """WITH p AS (SELECT p_partkey, p_size * 10 + 7 AS width, (p_partkey % 90 + 10) * 10 AS height, (p_partkey % 5) / 10 AS x, (p_size % 3) / 10 AS y, (p_partkey % 7 + 1) / 10 AS w FROM part),
q AS (SELECT *, w * width / 0.75::DOUBLE / height + CASE WHEN p_partkey % 4 = 0 THEN 0.05 ELSE 0 END::DOUBLE AS h FROM p),
e AS (SELECT *, round_even(x * width, 0)::BIGINT AS l, round_even(y * height, 0)::BIGINT AS t, round_even((x + w) * width, 0)::BIGINT AS r, round_even((y + h) * height, 0)::BIGINT AS b FROM q),
f AS (SELECT *, CASE WHEN x + w > 1.000001::DOUBLE OR y + h > 1.000001::DOUBLE THEN 'outside the image' WHEN abs((r - l) / greatest(1, b - t) - 0.75::DOUBLE) / 0.75::DOUBLE > 0.015::DOUBLE THEN 'another shape' END AS failure FROM e)
SELECT p_partkey, CASE WHEN failure IS NULL THEN l END AS left, CASE WHEN failure IS NULL THEN t END AS top, CASE WHEN failure IS NULL THEN r END AS right, CASE WHEN failure IS NULL THEN b END AS bottom, failure FROM f""",
    "crop_rescale": "SELECT p_partkey, round_even(p_size * 3 * scale, 0)::BIGINT AS left, round_even((p_size * 9 + 1000) * scale, 0)::BIGINT AS right FROM (SELECT *, (p_partkey % 500 + 900) / (p_size * 10 + 1000) AS scale FROM part)",
    "prompt_sections": f"SELECT p_partkey, 'Keep: ' || CASE WHEN p_size % 3 > 0 THEN replace(p_name, ' ', ', ') ELSE 'none' END || '. ' || CASE WHEN p_size % 2 = 0 THEN '{STYLES['portrait']}' ELSE '{STYLES['landscape']}' END || CASE WHEN p_size % 5 BETWEEN 1 AND 3 THEN chr(10) || chr(10) || 'Guidance:' || chr(10) || trim(p_type) ELSE '' END AS prompt FROM part",
    "error_details": f"""WITH b AS (SELECT seq, seq % 5 + 500 AS status, {BODY_SQL} AS body FROM {EVENTS}), p AS (SELECT *, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM b),
t AS (SELECT seq, status, CASE WHEN j IS NULL THEN body ELSE coalesce({TEXT_SQL('$.error.message')}, {TEXT_SQL('$.error')}) END AS said, {TEXT_SQL('$.error.type')} AS type, {TEXT_SQL('$.error.code')} AS code, coalesce({TEXT_SQL('$.error.request_id')}, {TEXT_SQL('$.request_id')}) AS request_id, {TEXT_SQL('$.error.moderation_details.moderation_stage')} AS stage, CASE WHEN seq % {len(BODIES)} = 1 THEN 'a,b' END AS categories FROM p)
SELECT seq, coalesce(nullif(said, ''), 'HTTP ' || status) AS message, type, code, request_id, nullif(stage, '') AS stage, categories, code IS DISTINCT FROM 'moderation_blocked' AS retryable FROM t""",
    "public_ids": "SELECT count(*) AS n, count(*) AS n_distinct, true AS well_formed FROM customer",
    "coarse_regions": f"SELECT region_id, sum(area)::BIGINT AS area, round(max(score), 6) AS score, round(sum(area * l) / sum(area), 6) AS l, round(sum(area * a) / sum(area), 6) AS a, round(sum(area * b) / sum(area), 6) AS b FROM (SELECT floor(region_id / 3)::BIGINT AS region_id, count(*) AS area, max(v) AS score, avg(v) AS l, min(v) AS a, avg(x) AS b FROM {GRID} g GROUP BY g.region_id) GROUP BY region_id",
    "coarse_edges": f"SELECT least(a, b) AS lo, greatest(a, b) AS hi, max(n) AS evidence FROM (SELECT floor(lo / 3)::BIGINT AS a, floor(hi / 3)::BIGINT AS b, count(*) AS n FROM {BORDERS} GROUP BY lo, hi) WHERE a <> b GROUP BY 1, 2",
}
