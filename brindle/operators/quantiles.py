"""Exact percentiles over any number of values: ranges of sorted values on many tasks, of which only those with a wanted rank are looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.graph import saved


def percentiles(rows: DataFrame, keys: list[str], value: str, **shares: float) -> DataFrame:
    """(keys, names): for each name the percentile of that share, linear between ranks as in F.percentile; nulls count for nothing.

    No task holds the values of a key: equal ones are counted first, the rest is dealt by ranges. Without keys there is
    one row, of nulls if there is no value.
    """
    group = F.struct(*keys) if keys else F.lit(0)
    counts = saved(rows.where(F.col(value).isNotNull()).groupBy(group.alias("key"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    parts = saved(counts.repartitionByRange("key", "v").withColumn("part", F.spark_partition_id()))
    before = F.sum("size").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = parts.groupBy("key", "part").agg(F.sum("n").alias("size")).withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("size").over(Window.partitionBy("key"))})
    places = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(s)) * (F.col("total") - 1)).alias("place")) for name, s in shares.items())))
    ranks = sizes.select("*", places.alias("p")).select("*", "p.name", "p.place", F.explode(F.array(F.floor("p.place"), F.ceil("p.place"))).alias("rank"))
    asked = saved(ranks.where("rank >= before AND rank < before + size").select("key", "part", "before", "name", "place", "rank").distinct())
    some = parts.join(asked.select("key", "part", "before").distinct(), ["key", "part"])
    ends = some.withColumn("end", F.col("before") + F.sum("n").over(Window.partitionBy("key", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).drop("before")
    found = ends.join(asked, ["key", "part"]).where("rank >= end - n AND rank < end")
    low, high = (F.max(F.when(F.col("rank") == f(F.col("place")), F.col("v"))) for f in (F.floor, F.ceil))
    each = found.groupBy("key", "name").agg(low.alias("low"), high.alias("high"), F.first("place").alias("place"))
    lower, upper = F.floor("place"), F.ceil("place")
    each = each.withColumn("x", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((upper - F.col("place")) * F.col("low") + (F.col("place") - lower) * F.col("high")))
    return each.select(*(F.col(f"key.{k}").alias(k) for k in keys), "name", "x").groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in shares))
