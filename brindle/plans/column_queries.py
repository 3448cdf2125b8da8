"""Registered queries of constraints, summaries and other column rules, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import raster, summaries
from brindle.plans.raster_queries import BORDERS, GRID, grid
from brindle.plans.state_queries import FILES, PROJECTS
from brindle.sources.tables import project_files, projects, table

# The statuses that end a project, and the words shown for some.
DONE = ["ai_completed", "ai_failed", "paint_failed", "paint_selection_failed", "failed"]
STATUS = {"O": "uploaded", "F": "ai_completed"}
LABELS = {"ai_completed": "Completed", "uploaded": "Uploaded"}
BINS = [4.0, 3.0, 2.0, 1.0]


def check_violations(spark: SparkSession, d: str) -> DataFrame:
    rules = {"status_known": F.col("status").isin("O", "F"), "price_bounded": F.col("price") < 200_000, "not_deleted": F.col("deleted_at").isNull()}
    return summaries.violations(projects(spark, d), "id", rules)


def marks_done(spark: SparkSession, d: str) -> DataFrame:
    status = F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("status")], "status")
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return projects(spark, d).select("id", status.alias("status")).select("id", F.col("status").isin(DONE).alias("done"), F.coalesce(label[F.col("status")], "status").alias("label"))


def owned_projects(spark: SparkSession, d: str) -> DataFrame:
    return summaries.owned(projects(spark, d), "client", " 1-URGENT ").select("id", "client")


def endpoint_protection(spark: SparkSession, d: str) -> DataFrame:
    edges = raster.shared_boundary(grid(spark, d)).select("lo", "hi", F.col("shared_len").cast("double").alias("score"))
    return summaries.endpoint_max(edges, "score")


def area_summary(spark: SparkSession, d: str) -> DataFrame:
    areas = grid(spark, d).groupBy("region_id").agg(F.count("*").alias("area"))
    both = summaries.summary(areas, "area").withColumn("of", F.lit("regions")).unionByName(summaries.summary(areas.where("area < 0"), "area").withColumn("of", F.lit("none")))
    return both.select("of", "least", F.round("mean", 6).alias("mean"), "median")


def label_height_bins(spark: SparkSession, d: str) -> DataFrame:
    return summaries.histogram(table(spark, d, "lineitem").select(F.col("l_linenumber").cast("double").alias("height")), "height", [*BINS, 99.0])


def score_majority_remap(spark: SparkSession, d: str) -> DataFrame:
    """Regions of the grid against coarser ones; a region's score is its id over ten."""
    g = grid(spark, d).select(F.col("region_id").alias("old"), F.floor(F.col("v") * 24).cast("long").alias("new"))
    overlap = g.groupBy("old", "new").agg(F.count("*").alias("pixels"))
    return summaries.remap_scores(overlap, g.select(F.col("old").alias("region_id")).distinct().withColumn("score", F.col("region_id") / 10))


def summed_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("moved"), F.col("l_linenumber").cast("long").alias("passes"), F.when(F.col("l_returnflag") == "R", F.lit(1)).alias("rejected"))
    return summaries.counters(rows, ["moved", "passes", "rejected"])


def reconstruction_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax")
    one = summaries.added_loss(rows, "l_quantity", "l_tax", "l_discount").withColumn("of", F.lit("worse"))
    other = summaries.added_loss(rows, "l_quantity", "l_discount", "l_tax").withColumn("of", F.lit("better"))
    return one.unionByName(other).select("of", F.round("loss", 9).alias("loss"))


def created_projects(spark: SparkSession, d: str) -> DataFrame:
    """New projects with their defaults, attached to a user where they name one."""
    new = projects(spark, d).where("status = 'O'").select((F.col("id") + 10_000_000).alias("id"), F.nullif("client", F.lit("5-LOW")).alias("client"), F.when(F.col("id") % 2 == 0, F.col("user_id")).alias("user_id"))
    return summaries.created(new, {"client": F.lit(""), "status": F.lit("uploaded"), "ai_settings": F.lit("{}")})


def replaced_originals(spark: SparkSession, d: str) -> DataFrame:
    """Projects with a new original lose what was derived from the old one; deleted ones stay."""
    p = projects(spark, d).select("id", "status", "deleted_at", F.concat(F.lit("f"), "id").alias("original"), F.col("price").cast("double").alias("quality"))
    changes = project_files(spark, d).where("line = 1").groupBy(F.col("project_id").alias("id")).agg(F.concat(F.lit("new"), F.min("part").cast("string")).alias("original"))
    out = summaries.reset(p, changes, "id", {"status": F.lit("uploaded"), "quality": F.lit(None).cast("double")})
    return out.select("id", "status", "original", "quality")


def base64_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Decoded size of a payload; null where it is no base64."""
    raw = F.when(F.col("id") % 3 == 0, F.lit("not base64!")).otherwise(F.base64(F.encode(F.concat(F.lit("p"), "id"), "UTF-8")))
    return projects(spark, d).select("id", F.octet_length(F.try_to_binary(raw, F.lit("base64"))).cast("long").alias("n_bytes"))


def rfc3339_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))


def mask_binarised(spark: SparkSession, d: str) -> DataFrame:
    gray = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + F.col("v") * 100)))
    on = summaries.binarised(gray)
    r, g, b = summaries.label_colour(F.col("region_id"))
    rows = grid(spark, d).select("y", on.alias("on"), gray.alias("gray"), (r + g + b).alias("colour"))
    return rows.groupBy("y").agg(F.count_if("on").alias("selected"), F.sum("gray").alias("gray"), F.sum("colour").alias("colour"))


def one_paint_palette(spark: SparkSession, d: str) -> DataFrame:
    """The palette of one paint: the mean of the regions' values, weighed by area and protection."""
    regions = grid(spark, d).groupBy("region_id").agg(F.count("*").alias("area"), F.avg("v").alias("v"), F.max("v").alias("protection"))
    weighed = regions.withColumn("w", summaries.sample_weight(F.col("area"), F.col("protection")))
    return summaries.one_paint(weighed, "w", ["v", "area"]).select(F.round("v", 6).alias("v"), F.round("area", 4).alias("area"))


QUERIES = {f.__name__: f for f in (check_violations, marks_done, owned_projects, endpoint_protection, area_summary, label_height_bins, score_majority_remap, summed_counters, reconstruction_loss, created_projects, replaced_originals, base64_payloads, rfc3339_times, mask_binarised, one_paint_palette)}

AREAS = f"(SELECT region_id, count(*) AS area, avg(v) AS v, max(v) AS protection FROM {GRID} GROUP BY region_id)"
SQL = {
    "check_violations": f"SELECT id, 'status_known' AS rule FROM {PROJECTS} WHERE status NOT IN ('O', 'F') UNION ALL SELECT id, 'price_bounded' FROM {PROJECTS} WHERE price >= 200000 UNION ALL SELECT id, 'not_deleted' FROM {PROJECTS} WHERE deleted_at IS NOT NULL",
    "marks_done": f"SELECT id, status = 'F' AS done, CASE status WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Uploaded' ELSE status END AS label FROM {PROJECTS}",
    "owned_projects": f"SELECT id, client FROM {PROJECTS} WHERE trim(client) = '1-URGENT'",
    "endpoint_protection": f"WITH e AS (SELECT lo, hi, count(*)::DOUBLE AS score FROM {BORDERS} GROUP BY lo, hi) SELECT region_id, max(score) AS score FROM (SELECT lo AS region_id, score FROM e UNION ALL SELECT hi, score FROM e) GROUP BY region_id",
    "area_summary": f"SELECT 'regions' AS of, min(area)::DOUBLE AS least, round(avg(area), 6) AS mean, median(area)::DOUBLE AS median FROM {AREAS} UNION ALL SELECT 'none', 0.0, 0.0, 0.0",
    "label_height_bins": "SELECT b.bin, count(l_linenumber) AS n FROM (VALUES (4.0::DOUBLE), (3.0), (2.0), (1.0), (99.0)) b(bin) LEFT JOIN lineitem ON l_linenumber = b.bin GROUP BY b.bin",
    "score_majority_remap": f"WITH o AS (SELECT region_id AS old, floor(v * 24)::BIGINT AS new, count(*) AS n FROM {GRID} GROUP BY ALL), t AS (SELECT old, new FROM o WHERE new > 0 QUALIFY row_number() OVER (PARTITION BY old ORDER BY n DESC, new) = 1) SELECT new AS region_id, greatest(max(old / 10), 0.0) AS score FROM t GROUP BY new",
    "summed_counters": "SELECT 'moved' AS metric, sum(l_quantity::BIGINT)::BIGINT AS total FROM lineitem UNION ALL SELECT 'passes', sum(l_linenumber)::BIGINT FROM lineitem UNION ALL SELECT 'rejected', count(*) FILTER (l_returnflag = 'R') FROM lineitem",
    "reconstruction_loss": "WITH m AS (SELECT sum(l_quantity * l_tax) / sum(l_quantity) AS tax, sum(l_quantity * l_discount) / sum(l_quantity) AS discount FROM lineitem) SELECT 'worse' AS of, round(greatest(discount - tax, 0.0), 9)::DOUBLE AS loss FROM m UNION ALL SELECT 'better', round(greatest(tax - discount, 0.0), 9)::DOUBLE FROM m",
    "created_projects": f"SELECT id + 10000000 AS id, CASE WHEN client = '5-LOW' THEN '' ELSE client END AS client, CASE WHEN id % 2 = 0 THEN user_id END AS user_id, 'uploaded' AS status, '{{}}' AS ai_settings FROM {PROJECTS} WHERE status = 'O'",
    "replaced_originals": f"SELECT p.id, CASE WHEN f.project_id IS NOT NULL AND deleted_at IS NULL THEN 'uploaded' ELSE status END AS status, CASE WHEN f.project_id IS NOT NULL AND deleted_at IS NULL THEN 'new' || part ELSE 'f' || p.id END AS original, CASE WHEN f.project_id IS NOT NULL AND deleted_at IS NULL THEN NULL ELSE price::DOUBLE END AS quality FROM {PROJECTS} p LEFT JOIN (SELECT project_id, min(part) AS part FROM {FILES} WHERE line = 1 GROUP BY project_id) f ON f.project_id = p.id",
    "base64_payloads": f"SELECT id, CASE WHEN id % 3 <> 0 THEN length('p' || id) END::BIGINT AS n_bytes FROM {PROJECTS}",
    "rfc3339_times": "SELECT event_id, strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events",
    "mask_binarised": f"SELECT y, count(*) FILTER (gray >= 128) AS selected, sum(gray)::BIGINT AS gray, sum((region_id * 37) % 255 + (region_id * 91) % 255 + (region_id * 151) % 255)::BIGINT AS colour FROM (SELECT y, region_id, greatest(0, least(255, floor(128 + v * 100)))::BIGINT AS gray FROM {GRID}) GROUP BY y",
    "one_paint_palette": f"SELECT round(sum(w * v) / sum(w), 6) AS v, round(sum(w * area) / sum(w), 4) AS area FROM (SELECT *, sqrt(area) * (1 + 2 * greatest(least(protection, 1.0), 0.0)) AS w FROM {AREAS})",
}
