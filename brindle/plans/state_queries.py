"""Registered queries of the relational layer and of the scalar rules, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import colour, scalar
from brindle.operators import state
from brindle.sources.tables import project_events, project_files, projects, table, users

ACTIVE = ["O", "F"]
PROJECTS = "(SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS status, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at, o_orderpriority AS client, o_totalprice AS price FROM orders)"
FILES = "(SELECT l_orderkey AS project_id, l_linenumber AS line, l_returnflag || l_linestatus AS file_type, l_partkey AS part, l_extendedprice AS size_bytes, l_shipdate AS created_at FROM lineitem)"
EVENTS = "(SELECT event_id AS seq, user_id AS project_id, event_type AS type, value, ts, props FROM events)"


def list_projects_page(spark: SparkSession, d: str) -> DataFrame:
    return state.list_projects(projects(spark, d), users(spark, d), project_files(spark, d), 2, 20).select("id", "status", "created_at", "username", "file_count")


def list_projects_total(spark: SparkSession, d: str) -> DataFrame:
    return state.live(projects(spark, d)).agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).cast("long").alias("total_pages"))


def get_project_by_key(spark: SparkSession, d: str) -> DataFrame:
    p = state.lookup(projects(spark, d), id=7).join(users(spark, d).select(F.col("id").alias("user_id"), "username"), "user_id", "left")
    return p.select("id", "user_id", "status", F.coalesce("username", F.lit("")).alias("username"))


def get_file_by_two_keys(spark: SparkSession, d: str) -> DataFrame:
    return state.lookup(project_files(spark, d), project_id=7, line=1).select("project_id", "line", "file_type", "size_bytes")


def get_user_case_insensitive(spark: SparkSession, d: str) -> DataFrame:
    return state.lookup_ignoring_case(users(spark, d), "username", "cUSTOMER#000000042").select("id", "username")


def count_active_by_client(spark: SparkSession, d: str) -> DataFrame:
    return state.live(projects(spark, d)).where(F.col("status").isin(ACTIVE)).groupBy("client").agg(F.count("*").alias("active"))


def list_files_of_project(spark: SparkSession, d: str) -> DataFrame:
    return state.lookup(project_files(spark, d), project_id=7).orderBy("created_at", "line", "part").select("line", "part", "file_type", "created_at")


def project_detail(spark: SparkSession, d: str) -> DataFrame:
    files = project_files(spark, d).groupBy("project_id").agg(F.array_sort(F.collect_set("file_type")).alias("types"), F.count("*").alias("files"))
    return projects(spark, d).join(files.withColumnRenamed("project_id", "id"), "id", "left").select("id", "status", F.array_join(F.coalesce("types", F.array()), ",").alias("types"), F.coalesce("files", F.lit(0).cast("long")).alias("files"))


def unapplied_anti(spark: SparkSession, d: str) -> DataFrame:
    return state.unapplied(projects(spark, d).select("id"), project_files(spark, d).select(F.col("project_id").alias("id")), "id")


def null_safe_backfill(spark: SparkSession, d: str) -> DataFrame:
    p = projects(spark, d).withColumn("version", F.nullif(F.col("status"), F.lit("P")))
    return p.select("id", F.when(~F.col("version").eqNullSafe("F"), "F").otherwise(F.col("version")).alias("version"), (~F.col("version").eqNullSafe("F")).alias("changed"))


def nullif_coalesce_patch(spark: SparkSession, d: str) -> DataFrame:
    p = projects(spark, d).select("id", "status", "client")
    changes = p.where("id % 10 = 3").select("id", F.when(F.col("id") % 20 == 3, "").otherwise("X").alias("status"), F.lit(None).cast("string").alias("client"))
    return state.patch(p, changes, "id", ["status", "client"])


TRANSITIONS = [("O", "run", False), ("O", "edit", False), ("F", "run", True), ("F", "proceed", False), ("P", "select", True)]


def status_transition_guard(spark: SparkSession, d: str) -> DataFrame:
    table_ = spark.createDataFrame(TRANSITIONS, "status string, action string, forces_clear boolean")
    return state.guarded(projects(spark, d), table_).groupBy("status", "action", "forces_clear").agg(F.count("*").alias("allowed"))


def error_message_rule(spark: SparkSession, d: str) -> DataFrame:
    e = project_events(spark, d)
    message = F.when(F.col("value") > 900, "explicit").when(F.col("type") == "error", F.col("type")).when(F.col("type").isin("click", "view"), "")
    return e.select("seq", message.alias("error_message"))


def append_log_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(project_events(spark, d).select("project_id", "seq", "type", "value"), "project_id", "seq")


def soft_delete_then_list(spark: SparkSession, d: str) -> DataFrame:
    p = projects(spark, d)
    gone = state.soft_delete(p, p.where("id % 3 = 0").select("id"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return state.live(gone).groupBy("status").agg(F.count("*").alias("n"))


def replace_files_of_key(spark: SparkSession, d: str) -> DataFrame:
    f = project_files(spark, d).select("project_id", "file_type", "size_bytes")
    new = f.where("project_id % 100 = 1").select("project_id").distinct().select("project_id", F.lit("new").alias("file_type"), F.lit(1.0).alias("size_bytes"))
    return state.replace_children(f, new, "project_id").groupBy("file_type").agg(F.count("*").alias("n"))


def dedupe_last_per_key_first_position(spark: SparkSession, d: str) -> DataFrame:
    return state.keep_last_per_key(project_events(spark, d).select("project_id", "type", "seq"), ["project_id"], "type", "seq")


def keyed_full_outer_merge(spark: SparkSession, d: str) -> DataFrame:
    e = state.keep_last_per_key(project_events(spark, d).select("project_id", "type", "seq", "value", "ts"), ["project_id"], "type", "seq").select("project_id", "type", "seq", "value")
    new = e.where("seq % 2 = 0").withColumn("value", F.when(F.col("seq") % 4 == 0, F.col("value")))
    return state.merge_by_key(e.where("seq % 3 <> 0"), new, ["project_id", "type"], ["seq", "value"])


PRIORITIES = ["RF", "NO", "AF"]


def priority_lookup(spark: SparkSession, d: str) -> DataFrame:
    return state.first_available(project_files(spark, d), "project_id", "file_type", PRIORITIES, "size_bytes")


def wildcard_subscription_join(spark: SparkSession, d: str) -> DataFrame:
    subs = spark.createDataFrame([("a", 5), ("b", None), ("c", 17), ("d", 5)], "subscriber string, project_id long")
    return state.deliver(project_events(spark, d).select("project_id", "seq"), subs).groupBy("subscriber").agg(F.count("*").alias("events"), F.max("seq").alias("last"))


def deny_set_anti(spark: SparkSession, d: str) -> DataFrame:
    return state.without_types(project_events(spark, d), "type", ["click", "error"]).groupBy("type").agg(F.count("*").alias("n"))


def json_settings_defaults(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    e = project_events(spark, d).select("seq", k.alias("k"))
    failure = scalar.first_failure([(F.col("k").isNotNull(), "k is missing"), (scalar.int_setting(F.col("k"), 8, 0, 1000) >= 10, "k is too small")])
    return e.select("seq", scalar.int_setting(F.col("k"), 8, 8, 40).alias("colours"), F.coalesce(F.nullif("k", F.lit("")), F.lit("none")).alias("style"), failure.alias("failure"))


def json_array_exists(spark: SparkSession, d: str) -> DataFrame:
    options = F.from_json(F.lit('[{"d": 1}, {"d": 4}, {"d": 9}]'), "array<struct<d: int>>")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return project_events(spark, d).select("seq", F.exists(options, lambda o: o["d"] == F.coalesce(k % 10, F.lit(-1))).alias("selectable"))


def mime_by_suffix(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", scalar.ending(path).alias("ending"), scalar.media_type(path).alias("mime"))


def ordered_ci_distinct_split(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("source", "r")).alias("i", "part")).withColumn("part", F.trim("part")).where("part <> ''")
    return parts.groupBy("doc_id", F.lower("part").alias("k")).agg(F.min_by("part", "i").alias("part"), F.min("i").cast("long").alias("place")).select("doc_id", "part", "place")


def suggestions_left(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "documents").select(F.lower(F.trim("source")).alias("item")).distinct()
    taken = spark.createDataFrame([("SRC0 ",), ("src3",), ("Src11",)], "item string").select(F.lower(F.trim("item")).alias("item"))
    return every.join(taken, "item", "left_anti")


def sha256_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.lit("v7"), F.col("doc_id").cast("string"), "text"), 256).alias("cache_key"))


def unit_conversion_bround(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scalar.millimetres_to_pixels(F.col("p_size").cast("double")).alias("px"), F.round(scalar.millimetres_per_pixel(F.col("p_size") + 100, F.col("p_size") * 2 + 50), 6).alias("mm_per_px"))


def cover_crop_box(spark: SparkSession, d: str) -> DataFrame:
    box = scalar.cover_crop(F.col("p_size") * 10 + 7, (F.col("p_partkey") % 90 + 10) * 10, 0.75)
    return table(spark, d, "part").select("p_partkey", box.alias("c")).select("p_partkey", *(F.col(f"c.{k}").cast("long").alias(k) for k in "xywh"))


def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(12).select(F.col("id").alias("failures"), scalar.backoff_ms(F.col("id")).alias("wait_ms"))


def names_and_slugs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", scalar.slug(F.col("p_type")).alias("slug"), scalar.safe_name(F.concat(F.lit("a/"), "p_name"), "image").alias("name"), scalar.provider(F.when(F.col("p_size") % 2 == 0, " GPT ").otherwise("google")).alias("provider"))


def colours_of_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 256).alias("r"), (F.col("p_partkey") * 91 % 256).alias("g"), (F.col("p_partkey") * 151 % 256).alias("b"))
    return p.withColumn("lab", colour.lab(F.col("r"), F.col("g"), F.col("b")))


def rgb_to_lab(spark: SparkSession, d: str) -> DataFrame:
    p = colours_of_parts(spark, d)
    return p.select("p_partkey", *(F.round(F.col(f"lab.{k}"), 5).alias(k) for k in "lab"), scalar.hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("hex"), scalar.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("packed"))


def ciede2000_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = colours_of_parts(spark, d)
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("lab").alias("next"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(colour.difference(F.col("lab.l"), F.col("lab.a"), F.col("lab.b"), F.col("next.l"), F.col("next.a"), F.col("next.b")), 5).alias("delta_e"))


def key_set_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return state.missing_keys(projects(spark, d).select("id"), project_files(spark, d).select(F.col("project_id").alias("id")), "id").groupBy("side").agg(F.count("*").alias("n"))


def cascade_invalidation(spark: SparkSession, d: str) -> DataFrame:
    e = project_events(spark, d).select("project_id", "type").distinct()
    depends = spark.createDataFrame([("purchase", "click"), ("view", "click"), ("view", "error")], "type string, on string")
    return state.cascade(e, e.where("project_id % 2 = 0 AND type = 'click'"), depends)


LAB = colour.lab_sql("r", "g", "b")
RGB = "(SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 91 % 256 AS g, p_partkey * 151 % 256 AS b FROM part)"
LABS = f"(SELECT p_partkey, r, g, b, {LAB[0]} AS l, {LAB[1]} AS a, {LAB[2]} AS bb FROM {RGB})"
MIME_SQL = "CASE " + " ".join(f"WHEN ending = '{k}' THEN '{v}'" for k, v in scalar.MEDIA_TYPES.items()) + " ELSE 'application/octet-stream' END"

SQL = {
    "list_projects_page": f"SELECT p.id, p.status, p.created_at, coalesce(c.c_name, '') AS username, (SELECT count(*) FROM lineitem f WHERE f.l_orderkey = p.id) AS file_count FROM {PROJECTS} p LEFT JOIN customer c ON c.c_custkey = p.user_id WHERE p.deleted_at IS NULL ORDER BY p.created_at DESC, p.id DESC LIMIT 20 OFFSET 20",
    "list_projects_total": f"SELECT count(*) AS total, ceil(count(*) / 20)::BIGINT AS total_pages FROM {PROJECTS} WHERE deleted_at IS NULL",
    "get_project_by_key": f"SELECT id, user_id, status, coalesce(c_name, '') AS username FROM {PROJECTS} LEFT JOIN customer ON c_custkey = user_id WHERE id = 7",
    "get_file_by_two_keys": f"SELECT project_id, line, file_type, size_bytes FROM {FILES} WHERE project_id = 7 AND line = 1",
    "get_user_case_insensitive": "SELECT c_custkey AS id, c_name AS username FROM customer WHERE lower(c_name) = lower('cUSTOMER#000000042')",
    "count_active_by_client": f"SELECT client, count(*) AS active FROM {PROJECTS} WHERE deleted_at IS NULL AND status IN ('O', 'F') GROUP BY client",
    "list_files_of_project": f"SELECT line, part, file_type, created_at FROM {FILES} WHERE project_id = 7 ORDER BY created_at, line, part",
    "project_detail": f"SELECT id, status, coalesce(types, '') AS types, coalesce(n, 0)::BIGINT AS files FROM {PROJECTS} LEFT JOIN (SELECT project_id, string_agg(DISTINCT file_type, ',' ORDER BY file_type) AS types, count(*) AS n FROM {FILES} GROUP BY 1) ON project_id = id",
    "unapplied_anti": "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "null_safe_backfill": f"SELECT id, CASE WHEN nullif(status, 'P') IS DISTINCT FROM 'F' THEN 'F' ELSE nullif(status, 'P') END AS version, nullif(status, 'P') IS DISTINCT FROM 'F' AS changed FROM {PROJECTS}",
    "nullif_coalesce_patch": f"SELECT id, CASE WHEN id % 10 = 3 THEN nullif(CASE WHEN id % 20 = 3 THEN '' ELSE 'X' END, '') ELSE status END AS status, client FROM {PROJECTS}",
    "status_transition_guard": f"SELECT t.status, t.action, t.forces_clear, count(*) AS allowed FROM {PROJECTS} p JOIN (VALUES {', '.join(f'({a!r}, {b!r}, {c})' for a, b, c in TRANSITIONS)}) t(status, action, forces_clear) ON t.status = p.status GROUP BY ALL",
    "error_message_rule": f"SELECT seq, CASE WHEN value > 900 THEN 'explicit' WHEN type = 'error' THEN type WHEN type IN ('click', 'view') THEN '' END AS error_message FROM {EVENTS}",
    "append_log_latest_state": f"SELECT project_id, max(seq) AS seq, arg_max(type, seq) AS type, arg_max(value, seq) AS value FROM {EVENTS} GROUP BY project_id",
    "soft_delete_then_list": f"SELECT status, count(*) AS n FROM {PROJECTS} WHERE deleted_at IS NULL AND id % 3 <> 0 GROUP BY status",
    "replace_files_of_key": f"SELECT file_type, count(*) AS n FROM (SELECT file_type FROM {FILES} WHERE project_id % 100 <> 1 UNION ALL SELECT 'new' FROM (SELECT DISTINCT project_id FROM {FILES} WHERE project_id % 100 = 1)) GROUP BY file_type",
    "dedupe_last_per_key_first_position": f"SELECT project_id, type, max(seq) AS seq, min(seq) AS place FROM {EVENTS} GROUP BY project_id, type",
    "keyed_full_outer_merge": f"WITH e AS (SELECT project_id, type, max(seq) AS seq, arg_max(value, seq) AS value FROM {EVENTS} GROUP BY ALL), a AS (SELECT * FROM e WHERE seq % 3 <> 0), b AS (SELECT project_id, type, seq, CASE WHEN seq % 4 = 0 THEN value END AS value FROM e WHERE seq % 2 = 0) SELECT project_id, type, coalesce(b.seq, a.seq) AS seq, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (project_id, type)",
    "priority_lookup": f"SELECT project_id, file_type AS type, size_bytes FROM {FILES} WHERE file_type IN ('RF', 'NO', 'AF') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY CASE file_type WHEN 'RF' THEN 0 WHEN 'NO' THEN 1 ELSE 2 END, size_bytes) = 1",
    "wildcard_subscription_join": f"SELECT subscriber, count(*) AS events, max(seq) AS last FROM {EVENTS} e JOIN (VALUES ('a', 5), ('b', NULL), ('c', 17), ('d', 5)) s(subscriber, p) ON s.p IS NULL OR s.p = e.project_id GROUP BY subscriber",
    "deny_set_anti": f"SELECT type, count(*) AS n FROM {EVENTS} WHERE type NOT IN ('click', 'error') GROUP BY type",
    "json_settings_defaults": f"SELECT seq, least(greatest(coalesce(try_cast(k AS INT), 8), 8), 40)::INT AS colours, coalesce(nullif(k, ''), 'none') AS style, CASE WHEN k IS NULL THEN 'k is missing' WHEN least(greatest(coalesce(try_cast(k AS INT), 8), 0), 1000) < 10 THEN 'k is too small' END AS failure FROM (SELECT seq, json_extract_string(props, '$.k') AS k FROM {EVENTS})",
    "json_array_exists": f"SELECT seq, coalesce(try_cast(json_extract_string(props, '$.k') AS INT) % 10, -1) IN (1, 4, 9) AS selectable FROM {EVENTS}",
    "mime_by_suffix": f"SELECT page_id, ending, {MIME_SQL} AS mime FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '(\\.[A-Za-z0-9]+)$', 1)) AS ending FROM pages)",
    "ordered_ci_distinct_split": "SELECT doc_id, arg_min(part, i) AS part, min(i) AS place FROM (SELECT doc_id, trim(p) AS part, i FROM (SELECT doc_id, unnest(string_split(source, 'r')) AS p, unnest(range(len(string_split(source, 'r')))) AS i FROM documents)) WHERE part <> '' GROUP BY doc_id, lower(part)",
    "suggestions_left": "SELECT DISTINCT lower(trim(source)) AS item FROM documents WHERE lower(trim(source)) NOT IN ('src0', 'src3', 'src11')",
    "sha256_cache_key": "SELECT doc_id, sha256('v7|' || doc_id || '|' || text) AS cache_key FROM documents",
    "unit_conversion_bround": "SELECT p_partkey, round_even(p_size::DOUBLE / 25.4::DOUBLE * 300, 0)::BIGINT AS px, round(least(2244::DOUBLE / (p_size + 100), 3272::DOUBLE / (p_size * 2 + 50)) * 25.4::DOUBLE / 300, 6) AS mm_per_px FROM part",
    "cover_crop_box": "SELECT p_partkey, ((w0 - w) // 2)::BIGINT AS x, ((h0 - h) // 2)::BIGINT AS y, w, h FROM (SELECT p_partkey, w0, h0, (CASE WHEN w0 > h0 * 0.75 THEN round_even(h0 * 0.75::DOUBLE, 0) ELSE w0 END)::BIGINT AS w, (CASE WHEN w0 > h0 * 0.75 THEN h0 ELSE round_even(w0 / 0.75::DOUBLE, 0) END)::BIGINT AS h FROM (SELECT p_partkey, p_size * 10 + 7 AS w0, (p_partkey % 90 + 10) * 10 AS h0 FROM part))",
    "backoff_schedule": "SELECT range AS failures, least(30000, 1000 * pow(2, least(range, 5)))::BIGINT AS wait_ms FROM range(12)",
    "names_and_slugs": "SELECT p_partkey, regexp_replace(lower(trim(p_type)), '[\\s-]+', '_', 'g') AS slug, regexp_replace('a/' || p_name, '[\\\\/]', '_', 'g') AS name, CASE WHEN p_size % 2 = 0 THEN 'openai' ELSE 'gemini' END AS provider FROM part",
    "rgb_to_lab": f"SELECT p_partkey, round(l, 5) AS l, round(a, 5) AS a, round(bb, 5) AS b, printf('#%02x%02x%02x', r, g, b) AS hex, (r * 65536 + g * 256 + b)::BIGINT AS packed FROM {LABS}",
    "ciede2000_pairs": f"SELECT p_partkey, round(de, 5) AS delta_e FROM ({colour.difference_steps_sql(f'(SELECT x.p_partkey, x.l AS l1, x.a AS a1, x.bb AS b1, y.l AS l2, y.a AS a2, y.bb AS b2 FROM {LABS} x JOIN {LABS} y ON y.p_partkey = x.p_partkey + 1)', 'p_partkey')})",
    "key_set_mismatch": "SELECT 'left' AS side, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) HAVING count(*) > 0 UNION ALL SELECT 'right', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) HAVING count(*) > 0",
    "cascade_invalidation": f"WITH e AS (SELECT DISTINCT project_id, type FROM {EVENTS}) SELECT * FROM e WHERE NOT (type IN ('purchase', 'view') AND project_id IN (SELECT project_id FROM e WHERE project_id % 2 = 0 AND type = 'click'))",
}

QUERIES = {name: globals()[name] for name in SQL}
