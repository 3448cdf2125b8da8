"""The corpus pipeline: four stages over documents, each written as Parquet and read again by the next.

Each stage works on all that its predecessor kept. The first three keep the columns of documents; the
last returns the packed pieces. doc_id is the key: the first stage leaves out rows without one, and of rows
that repeat one it keeps the one with the smallest text (a null text last), so later stages meet each key once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.ngram_join import ngram_join
from brindle.llm.packing import pack_documents
from brindle.llm.saved import folder
from brindle.llm.substring_dedup import substring_dedup
from brindle.llm.toxicity import toxicity


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """docs with doc_id as key."""
    known = docs.where("doc_id IS NOT NULL")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        return known
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    low = F.min(F.struct(F.col("text").isNull().alias("none"), "text", *rest)).alias("row")
    return known.groupBy("doc_id").agg(low).select("doc_id", "row.*").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    docs = one_row_per_id(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = toxicity(docs, labels).where("predicted = 1").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    gone = ngram_join(docs).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; a document that keeps all its words keeps its text as it is, one that keeps none goes."""
    cut = substring_dedup(docs).where("n_removed > 0").select("doc_id", "kept_text")
    text = F.coalesce("kept_text", "text")
    out = docs.join(cut, "doc_id", "left").where("kept_text IS NULL OR kept_text <> ''")
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("repeated_substrings", cut_repeats),
    ("packing", pack),
]

#: Scores and tokens can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, written between stages to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = folder(spark, name)
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
