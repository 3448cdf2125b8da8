"""Readers for the tables that the registered queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as projects: status P counts as deleted."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"), F.col("o_orderpriority").alias("client"), F.col("o_totalprice").alias("price"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("segment"))


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files; a line is no key, so the ordinal counts lines of an order by all their columns."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("line"), F.concat("l_returnflag", "l_linestatus").alias("file_type"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("size_bytes"), F.col("l_shipdate").alias("created_at"))


def project_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("project_id"), F.col("event_type").alias("type"), "value", "ts", "props")


def images(paths: str, spark: SparkSession) -> DataFrame:
    """Files of a folder with their bytes, sorted by name; decoding is left to a function of the caller."""
    return spark.read.format("binaryFile").load(paths).orderBy("path")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, whole files; what is no JSON object gives a row of nulls."""
    return spark.read.json(path, multiLine=True, mode="PERMISSIVE")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in ranges of a numeric key; filters are pushed to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def publish(df: DataFrame, path: str, key: str) -> None:
    """Replaces only the partitions of path that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
