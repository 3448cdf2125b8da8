"""The registered queries of the llm operators and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.embedding_dedup import embedding_dedup
from brindle.llm import licenses
from brindle.llm.ngram_join import ngram_join
from brindle.llm.packing import pack_documents
from brindle.llm.periodic_runs import periodic_runs
from brindle.llm.piece_sampling import sample_segmentations
from brindle.llm.ranked_search import ranked_search
from brindle.llm.substring_dedup import substring_dedup
from brindle.llm.suffix_dedup import suffix_dedup
from brindle.llm.token_counts import token_counts
from brindle.llm.topk_search import topk_search
from brindle.llm.toxicity import toxicity
from brindle.llm.vector_search import vector_search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT low.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, low.vec_id = component_id AS kept FROM low LEFT JOIN n USING (vec_id)
"""


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 99, 0))) AS i FROM bytes),
win AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS k FROM starts),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM ranked WHERE r > 1),
runs AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, NULL FROM bytes ANTI JOIN spans USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, length(x) // 2) - a)), '' ORDER BY a) AS t FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
SELECT bytes.doc_id, (length(x) // 2)::BIGINT AS n_bytes, ((length(x) - length(t)) // 2)::BIGINT AS n_removed, coalesce(n.n, 0)::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM bytes JOIN kept USING (doc_id) LEFT JOIN n ON n.doc_id = bytes.doc_id
"""


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every text, and a digest of what their ids decode to."""
    back = sample_segmentations(table(spark, sf_dir, "documents"), decoded=True)
    return back.select("doc_id", "sample", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), "log_prob", "perturbed", "log_inclusion")


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH words AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM words),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM starts),
low AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
hit AS (SELECT win.doc_id, win.i FROM win JOIN low USING (k) WHERE win.doc_id > low.d),
gone AS (SELECT DISTINCT doc_id, i + o.o AS i FROM hit, range(13) AS o(o)),
every_word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
kept AS (SELECT every_word.doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM every_word ANTI JOIN gone ON every_word.doc_id = gone.doc_id AND every_word.i = gone.i GROUP BY every_word.doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are files: the address without scheme and query is the path."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return licenses.license_scan(table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), path.alias("path"), F.col("html").alias("text")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 3, 2)) END) AS i FROM words),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts),
n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT low.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM low LEFT JOIN n USING (doc_id)
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def planted(text: Column, doc_id: Column) -> Column:
    """The text as it is, or for a tenth of the documents with the words from a place on repeated in a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0), n - 1)
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.element_at(w, (1 + F.when(i < a, i).otherwise(a + (i - a) % p)).cast("int"))), " ")).otherwise(text)

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic_runs(table(spark, sf_dir, "documents").withColumn("text", planted(F.col("text"), F.col("doc_id"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    digest = F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256)
    exponent = F.floor(1000 * F.col("length") / F.col("period")).cast("long")
    return runs.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), digest.alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


OP11_SQL = r"""
WITH RECURSIVE step AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) AS r(i) UNION ALL SELECT i, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM step WHERE k < 8),
crc AS (SELECT doc_id, doc_id::VARCHAR AS s, 1 AS place, 4294967295::BIGINT AS c FROM documents
  UNION ALL SELECT doc_id, s, place + 1, xor(crc.c >> 8, step.c) FROM crc JOIN step ON k = 8 AND i = xor(crc.c & 255, ascii(substr(s, place, 1))) WHERE place <= length(s)),
h AS (SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE place > length(s)),
plain AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
sized AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS z FROM plain JOIN h USING (doc_id)),
places AS (SELECT doc_id, w, n, unnest(range(n)) AS i, changed, a, 1 + (n - a) // (3 + z) AS p FROM sized),
words AS (SELECT doc_id, n, i, w[1 + CASE WHEN changed AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM places),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
enough AS (SELECT doc_id, q FROM pairs GROUP BY doc_id, q HAVING count(*) >= greatest(12 - q, q)),
marked AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs SEMI JOIN enough USING (doc_id, q)),
stretches AS (SELECT doc_id, q, min(i) AS a, count(*) + q AS l FROM marked GROUP BY doc_id, q, island HAVING count(*) >= greatest(12 - q, q)),
runs AS (SELECT doc_id, a, l, min(q) AS q FROM stretches GROUP BY doc_id, a, l),
lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(a, ',', l, ',', q, chr(10)), '' ORDER BY a, q) AS t FROM runs GROUP BY doc_id),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, a, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a + q, a + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT sized.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, longest.a::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM sized LEFT JOIN lines USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS c FROM asked GROUP BY item_id, term),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
corpus AS (SELECT count(*) FILTER (len(t) > 0) AS big_n, sum(len(t))::BIGINT AS big_l FROM d),
w AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM w GROUP BY doc_id, n, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT doc_id, p.term, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))) AS s FROM p JOIN df USING (term), corpus),
score AS (SELECT item_id, doc_id, sum(c * s)::BIGINT AS score FROM q JOIN s USING (term) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM score WHERE score > 0 QUALIFY rank <= 20
"""


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_piece_sampling": op4_piece_sampling,
    "op5_vector_search": op5_vector_search,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_ngram_join": op9_ngram_join,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ranked_search": op12_ranked_search,
    "op13_topk_search": op13_topk_search,
}

SQL: dict[str, str] = {
    "op2_embedding_dedup": OP2_SQL,
    "op3_suffix_array_dedup": OP3_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op8_license_scan": licenses.sql(),
    "op9_ngram_join": OP9_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_topk_search": OP13_SQL,
}
