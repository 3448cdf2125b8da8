"""Rules and summaries that are plain column work: constraints, defaults for empty inputs, fixed bins, losses, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that a row breaks; as in SQL a rule that is null is not broken."""
    broken = F.filter(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def owned(rows: DataFrame, column: str, client: str) -> DataFrame:
    """Rows of a client; names are trimmed, and an empty one owns nothing."""
    return rows.where((F.trim(column) == F.trim(F.lit(client))) & (F.trim(F.lit(client)) != ""))


def endpoint_max(edges: DataFrame, score: str) -> DataFrame:
    """(region_id, score): for both ends of edges(lo, hi) the largest score of an edge; null scores count for nothing."""
    ends = edges.select(F.explode(F.array("lo", "hi")).alias("region_id"), score)
    return ends.groupBy("region_id").agg(F.max(score).alias(score))


def summary(rows: DataFrame, value: str) -> DataFrame:
    """One row: least, mean and median of a column, 0 where there are no rows."""
    of = {"least": F.min(value), "mean": F.avg(value), "median": F.median(value)}
    return rows.agg(*[F.coalesce(x.cast("double"), F.lit(0.0)).alias(name) for name, x in of.items()])


def histogram(rows: DataFrame, value: str, bins: list[float], tolerance: float = 1e-6) -> DataFrame:
    """(bin, n) for each of some fixed values, those that do not occur included; other values fall in no bin."""
    return rows.agg(F.array(*[F.struct(F.lit(float(b)).alias("bin"), F.count_if(F.abs(F.col(value) - b) <= tolerance).alias("n")) for b in bins]).alias("all")).select(F.inline("all"))


def remap_scores(overlap: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of regions carried to the regions that most of their pixels became, ties to the smaller id; of several the largest, 0 at least.

    overlap(old, new, pixels), new 0 for none; scores(region_id, score). A region without pixels carries nothing.
    """
    target = overlap.where("new > 0").groupBy("old").agg(F.max_by("new", F.struct("pixels", -F.col("new"))).alias("new"))
    carried = scores.join(target.withColumnRenamed("old", "region_id"), "region_id")
    return carried.groupBy(F.col("new").alias("region_id")).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


def counters(rows: DataFrame, names: list[str]) -> DataFrame:
    """(metric, total): counters of all iterations summed; a null counts as 0."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")).alias("x")) for n in names])).alias("of")
    return rows.select(each).groupBy(F.col("of.metric").alias("metric")).agg(F.sum("of.x").alias("total"))


def added_loss(rows: DataFrame, area: str, before: str, after: str) -> DataFrame:
    """One row: by how much the area-weighted mean error grows, 0 at least and where there is no area."""
    mean = lambda c: F.sum(F.col(area) * F.col(c)) / F.nullif(F.sum(area), F.lit(0))
    return rows.agg(F.greatest(F.coalesce(mean(after) - mean(before), F.lit(0.0)), F.lit(0.0)).alias("loss"))


def sample_weight(area: Column, protection: Column) -> Column:
    """Weight of a region in the palette: the root of its area, up to three times as much where it is protected."""
    return F.sqrt(area) * (1 + 2 * F.greatest(F.least(F.coalesce(protection, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))


def one_paint(rows: DataFrame, weight: str, channels: list[str]) -> DataFrame:
    """The weighted mean of all rows, the palette of one paint; no row where there are none."""
    total = rows.agg(F.sum(weight).alias("w"), *[F.sum(F.col(weight) * F.col(c)).alias(c) for c in channels]).where("w > 0")
    return total.select(*[(F.col(c) / F.col("w")).alias(c) for c in channels])


def binarised(gray: Column, least: int = 128) -> Column:
    return F.coalesce(gray >= least, F.lit(False))


def label_colour(region: Column) -> list[Column]:
    """Red, green and blue of a region in a label map."""
    return [F.pmod(region * k, F.lit(255)) for k in (37, 91, 151)]


def created(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """New rows with their defaults: what a row lacks or leaves null."""
    return rows.withColumns({c: F.coalesce(F.col(c), x) if c in rows.columns else x for c, x in defaults.items()})


def reset(rows: DataFrame, changes: DataFrame, key: str, cleared: dict[str, Column]) -> DataFrame:
    """Rows that are not deleted and have a change take its columns, and cleared ones their first value; the others stay."""
    own = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in own], F.lit(True).alias("changed"))
    on = F.col("changed").isNotNull() & F.col("deleted_at").isNull()
    out = rows.join(new, key, "left")
    return out.select(*[F.when(on, F.col(f"new_{c}") if c in own else cleared[c]).otherwise(F.col(c)).alias(c) if c in own or c in cleared else c for c in rows.columns])
