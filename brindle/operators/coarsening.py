"""What regions and their edges become when regions are merged into coarser ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coarsened_regions(regions: DataFrame, remap: DataFrame) -> DataFrame:
    """(region_id, area, score, l, a, b) of the coarser regions: areas summed, the largest score, colours weighed by area.

    regions(region_id, area, score, l, a, b), remap(region_id, new_id). A region that remap lacks goes; a
    null score counts for nothing, and a coarser region without a score has 0. Colours of no area are null.
    """
    rows = regions.join(remap, "region_id").groupBy(F.col("new_id").alias("region_id"))
    mean = lambda c: (F.sum(F.col("area") * F.col(c)) / F.nullif(F.sum("area"), F.lit(0))).alias(c)
    return rows.agg(F.sum("area").alias("area"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"), *map(mean, "lab"))


def coarsened_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """(lo, hi, evidence) between coarser regions: the largest evidence of what they are made of; edges inside one are gone."""
    ends = lambda s: remap.select(F.col("region_id").alias(s), F.col("new_id").alias(f"new_{s}"))
    moved = edges.join(ends("lo"), "lo").join(ends("hi"), "hi").where("new_lo <> new_hi")
    return moved.groupBy(F.least("new_lo", "new_hi").alias("lo"), F.greatest("new_lo", "new_hi").alias("hi")).agg(F.max("evidence").alias("evidence"))
