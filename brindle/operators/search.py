"""Bounded search over candidates: selection of consistent combinations and summaries of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Region counts to aim at, by attempt, and the most regions that a harder level rewards.
TARGETS = {"easy": (300, 275, 325, 250, 350), "medium": (450, 425, 400, 375, 350), "hard": (650, 600, 550, 500, 450)}
BUDGETS = {"easy": 500, "medium": 750, "hard": 1050}
ORDER = ("easy", "medium", "hard")
#: By how much the loss of a harder candidate may exceed that of the one before.
SLACK = 0.25
#: Stands for the score of a missing candidate.
NONE = 10_000

CANDIDATE = "struct<attempt: int, regions: int, loss: double, recall: double, retention: double>"


def density_target(difficulty: Column, attempt: Column) -> Column:
    return F.coalesce(*(F.when((difficulty == k) & (attempt == i + 1), F.lit(n)) for k, v in TARGETS.items() for i, n in enumerate(v)))


def density_score(regions: Column, budget: int) -> Column:
    """Regions up to the budget; what goes beyond counts against it. Very low where there is no candidate."""
    return F.coalesce(F.when(regions <= budget, regions).otherwise(2 * budget - regions), F.lit(-NONE))


def select_candidates(candidates: DataFrame) -> DataFrame:
    """The best combination of one candidate, or none, of each difficulty for each key.

    candidates(key, difficulty, attempt, regions, loss, recall, retention). In a valid combination each
    harder candidate has at least 11/10 of the regions of the one before, a loss of at most SLACK more, no
    smaller retention, and the hard one no smaller recall than the medium one. Most candidates win, then hard
    before medium before easy ones, then denser ones within their budgets, the easy one nearest to its target
    and with fewer regions, the smaller summed loss, earlier attempts. A key has at most five attempts of
    each difficulty, so its lists are small and combined inside the row.
    """
    item = F.struct(*(F.col(c).cast(t).alias(c) for c, t in (("attempt", "int"), ("regions", "int"), ("loss", "double"), ("recall", "double"), ("retention", "double"))))
    lists = [F.concat(F.array(F.lit(None).cast(CANDIDATE)), F.collect_list(F.when(F.col("difficulty") == d, item))).alias(d) for d in ORDER]
    rows = candidates.groupBy("key").agg(*lists)
    for d in ORDER:
        rows = rows.withColumn(d, F.explode(d))  # 6 at most

    def follows(a: Column, b: Column, sharper: bool = False) -> Column:
        ok = (b["regions"] * 10 >= a["regions"] * 11) & (b["loss"] <= a["loss"] + SLACK + 1e-9) & (b["retention"] + 1e-9 >= a["retention"])
        return a.isNull() | b.isNull() | (ok & (b["recall"] + 1e-9 >= a["recall"]) if sharper else ok)

    e, m, h = (F.col(d) for d in ORDER)
    rows = rows.where((e.isNotNull() | m.isNotNull() | h.isNotNull()) & follows(e, m) & follows(m, h, True) & (m.isNotNull() | follows(e, h)))
    given = [F.col(d).isNotNull().cast("int") for d in ORDER]
    loss, attempts = (sum((F.coalesce(F.col(d)[c], F.lit(0)) for d in ORDER[1:]), F.coalesce(e[c], F.lit(0))) for c in ("loss", "attempt"))
    rank = [-(given[0] + given[1] + given[2]), *(-x for x in reversed(given)), -density_score(h["regions"], BUDGETS["hard"]), -density_score(m["regions"], BUDGETS["medium"])]
    rank += [F.coalesce(F.abs(e["regions"] - TARGETS["easy"][0]), F.lit(NONE)), F.coalesce(e["regions"], F.lit(NONE)), F.bround(loss * 1e6).cast("long"), attempts]
    rank += [F.coalesce(F.col(d)["attempt"], F.lit(99)) for d in ORDER]
    best = rows.groupBy("key").agg(F.min_by(F.struct(*ORDER), F.struct(*rank)).alias("b"))
    return best.select("key", *(F.col(f"b.{d}.attempt").alias(d) for d in ORDER))


def attempt_summary(attempts: DataFrame, key: str, value: str, stage: str, item: str, most: int = 12) -> DataFrame:
    """For each key: number, range of values as text, distinct stages, the first ids with dots for the rest."""
    g = attempts.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.array_sort(F.collect_set(stage)).alias("stages"), F.array_sort(F.collect_set(item)).alias("ids"))
    span = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high"))
    shown = F.concat(F.array_join(F.slice("ids", 1, most), ","), F.when(F.size("ids") > most, ",...").otherwise(""))
    return g.select(key, "n", span.alias("range"), F.array_join("stages", ",").alias("stages"), shown.alias("ids"))
