"""Settling paint conflicts between neighbouring regions: faithful recolouring in order, then merging by disjoint pairs.

All of it works on the region graph: tables of regions, edges and assignments. Steps that depend on an order are
taken in rounds. In each round goes what is first among everything that it could depend on, so the outcome is that
of the ordered walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.colour import difference, difference_of
from brindle.operators import evidence as rules
from brindle.operators.graph import saved

#: Below both, the source shows no boundary; paints that differ by more than this there would draw one.
WEAK_DIFFERENCE, WEAK_EVIDENCE, ARTIFICIAL = 2.0, 0.20, 5.0
#: From here on a boundary is only given up if it was selected, or nothing else is left.
HARD_EVIDENCE = 0.70

LAB = ("l", "a", "b")


def lab_of(suffix: str) -> list[Column]:
    return [F.col(f"{c}{suffix}") for c in LAB]


def paint_options(regions: DataFrame, paints: list[tuple[int, float, float, float]]) -> DataFrame:
    """(image_id, region_id, color_id, error) of every paint; the palette is a literal of a few entries."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("color_id"), *(F.lit(float(v)).alias(f"{c}_p") for c, v in zip(LAB, lab, strict=True))) for i, *lab in paints)))
    rows = regions.select("image_id", "region_id", *LAB, each.alias("p")).select("image_id", "region_id", *LAB, "p.*")
    return rows.select("image_id", "region_id", "color_id", difference(*lab_of(""), *lab_of("_p")).alias("error"))


def paint_pairs(regions: DataFrame, paints: list[tuple[int, float, float, float]]) -> DataFrame:
    """(one, two, paint_de) of all pairs of paints, equal ones included."""
    rows = [(a[0], b[0], float(difference_of(a[1:], b[1:]))) for a in paints for b in paints]
    return regions.sparkSession.createDataFrame(rows, "one int, two int, paint_de double")


def measured(regions: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with delta_e; an edge without evidence has the larger protection of its regions, and 0 as what is drawn."""
    e = rules.sided(edges, regions, *LAB, "protection")
    known = F.coalesce("evidence", F.greatest("protection_lo", "protection_hi"), F.lit(0.0))
    return e.select("image_id", "lo", "hi", difference(*lab_of("_lo"), *lab_of("_hi")).alias("delta_e"), known.alias("evidence"), F.coalesce("evidence", F.lit(0.0)).alias("drawn"), F.coalesce("user_edge", F.lit(False)).alias("user_edge"))


def _ends(edges: DataFrame, value: Column) -> DataFrame:
    """(image_id, region_id, other, v) for both ends of each edge."""
    ways = F.array(F.struct(F.col("lo").alias("region_id"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("region_id"), F.col("lo").alias("other")))
    return edges.select("image_id", F.explode(ways).alias("d"), value.alias("v")).select("image_id", "d.*", "v")


def recoloured(options: DataFrame, edges: DataFrame, assigned: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int]:
    """Assignments after edges of one paint, by (lo, hi), have each tried to give one end another faithful paint, and how many did.

    An edge waits for earlier ones that touch its regions or their neighbours: these are all that it reads.
    """
    best = options.groupBy("image_id", "region_id").agg(F.min("error").alias("best"))
    near = options.join(best, ["image_id", "region_id"]).where("error <= 8 AND error <= best + 2").groupBy("image_id", "region_id").agg(F.count("*").alias("ways"))
    ways = best.join(near, ["image_id", "region_id"], "left").fillna(0, ["ways"])
    # where neither end has a second paint near enough, there is nothing to try
    real = saved(rules.sided(edges.where(f"NOT (delta_e < {WEAK_DIFFERENCE} AND evidence < {WEAK_EVIDENCE})"), ways, "ways").where("ways_lo > 1 OR ways_hi > 1").select("image_id", "lo", "hi"))
    around = saved(_ends(edges, F.lit(0)).select("image_id", "region_id", "other"))
    tried, changes = None, 0
    while True:
        same = rules.sided(real, assigned, "color_id").where("color_id_lo = color_id_hi").select("image_id", "lo", "hi")
        open_ = saved(same if tried is None else same.join(tried, ["image_id", "lo", "hi"], "left_anti"))
        first = _ends(open_, F.struct("lo", "hi")).groupBy("image_id", "region_id").agg(F.min("v").alias("first"))
        beside = around.join(first.withColumnRenamed("region_id", "other"), ["image_id", "other"]).select("image_id", "region_id", "first")
        near = saved(first.unionByName(beside).groupBy("image_id", "region_id").agg(F.min("first").alias("first")))
        ready = saved(rules.sided(open_, near, "first").where((F.least("first_lo", "first_hi") == F.struct("lo", "hi"))).select("image_id", "lo", "hi"))
        if ready.isEmpty():
            return assigned, changes
        asked = _ends(ready, F.struct("lo", "hi")).select("image_id", "region_id", F.col("v").alias("edge"))
        found = rules.faithful_paints(options.join(asked.select("image_id", "region_id"), ["image_id", "region_id"]), edges, assigned, pairs)
        best = asked.join(found, ["image_id", "region_id"]).join(options, ["image_id", "region_id", "color_id"]).groupBy("image_id", "edge").agg(F.min(F.struct("error", "region_id", "color_id")).alias("x"))
        new = saved(best.select("image_id", "x.region_id", F.col("x.color_id").alias("new")))
        changes += new.count()
        assigned = saved(assigned.join(new, ["image_id", "region_id"], "left").select("image_id", "region_id", F.coalesce("new", "color_id").alias("color_id")))
        tried = saved(ready if tried is None else tried.unionByName(ready))


def disjoint_pairs(edges: DataFrame, order: Column) -> DataFrame:
    """Edges (image_id, lo, hi) that a walk by ``order`` takes when it skips what touches a taken one: in a round go those that are first at both ends."""
    left, taken = saved(edges.select("image_id", "lo", "hi", order.alias("o"))), None
    while True:
        first = _ends(left, F.col("o")).groupBy("image_id", "region_id").agg(F.min("v").alias("first"))
        now = saved(rules.sided(left, first, "first").where("o = first_lo AND o = first_hi").select("image_id", "lo", "hi"))
        if now.isEmpty():
            return now if taken is None else taken
        taken = saved(now if taken is None else taken.unionByName(now))
        gone = now.select("image_id", F.explode(F.array("lo", "hi")).alias("region_id"))
        for s in ("lo", "hi"):
            left = left.join(gone.withColumnRenamed("region_id", s), ["image_id", s], "left_anti")
        left = saved(left.select("image_id", "lo", "hi", "o"))


def violations(edges: DataFrame, assigned: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges whose regions have one paint, or paints that draw a boundary where the source has none."""
    e = rules.sided(edges, assigned, "color_id").join(F.broadcast(pairs), (F.col("color_id_lo") == F.col("one")) & (F.col("color_id_hi") == F.col("two"))).drop("one", "two")
    artificial = (F.col("delta_e") < WEAK_DIFFERENCE) & (F.col("evidence") < WEAK_EVIDENCE) & (F.col("paint_de") >= ARTIFICIAL)
    return e.where((F.col("color_id_lo") == F.col("color_id_hi")) | artificial)


def last_resort(broken: DataFrame, regions: DataFrame, options: DataFrame, paints: list[tuple[int, float, float, float]]) -> DataFrame:
    """For each image the pair (image_id, lo, hi, loss) whose merging costs least fit to the paints."""
    own = options.select("image_id", "region_id", "color_id", "error")
    e = rules.sided(broken, regions, "area", *LAB)
    for s in ("lo", "hi"):
        e = e.join(own.select("image_id", F.col("region_id").alias(s), F.col("color_id").alias(f"color_id_{s}"), F.col("error").alias(f"error_{s}")), ["image_id", s, f"color_id_{s}"])
    total = F.greatest(F.lit(1.0), F.col("area_lo") + F.col("area_hi"))
    mixed = saved(e.select("image_id", "lo", "hi", "evidence", "delta_e", *(((F.col(f"{c}_lo") * F.col("area_lo") + F.col(f"{c}_hi") * F.col("area_hi")) / total).alias(c) for c in LAB), ((F.col("error_lo") * F.col("area_lo") + F.col("error_hi") * F.col("area_hi")) / total).alias("apart")))
    fits = paint_options(mixed.select("image_id", F.struct("lo", "hi").alias("region_id"), *LAB), paints).groupBy("image_id", "region_id").agg(F.min("error").alias("best"))
    ranked = mixed.join(fits.select("image_id", "region_id.*", "best"), ["image_id", "lo", "hi"]).withColumn("loss", F.greatest(F.lit(0.0), F.col("best") - F.col("apart")))
    return ranked.groupBy("image_id").agg(F.min_by(F.struct("lo", "hi", "loss"), F.struct("loss", "evidence", "delta_e", "lo", "hi")).alias("x")).select("image_id", "x.*")


def merged(regions: DataFrame, edges: DataFrame, taken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions and edges after each hi of taken has gone into its lo: areas add up, colours are weighed by area, protection and evidence are the largest."""
    to = taken.select("image_id", F.col("hi").alias("region_id"), F.col("lo").alias("to"))
    mean = lambda c: (F.sum(F.col("area") * F.col(c)) / F.sum("area")).alias(c)
    rows = regions.join(to, ["image_id", "region_id"], "left").withColumn("region_id", F.coalesce("to", "region_id"))
    new_regions = saved(rows.groupBy("image_id", "region_id").agg(F.sum("area").alias("area"), *map(mean, LAB), F.max("protection").alias("protection")))
    for s in ("lo", "hi"):
        edges = edges.join(to.select("image_id", F.col("region_id").alias(s), "to"), ["image_id", s], "left").withColumn(s, F.coalesce("to", s)).drop("to")
    rows = edges.where("lo <> hi").groupBy("image_id", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"))
    return new_regions, saved(rows.agg(F.max("evidence").alias("evidence"), F.max("user_edge").alias("user_edge")))


def resolve_paints(regions: DataFrame, edges: DataFrame, paints: list[tuple[int, float, float, float]]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Paints for all regions without a conflict between neighbours: (assigned, joined, counts).

    regions(image_id, region_id, area, l, a, b, protection), edges(image_id, lo, hi, evidence, user_edge), paints
    (color_id, l, a, b), at least one. Each round gives every region its nearest paint (ties to the smaller
    number), recolours, and merges violating pairs by evidence, colour difference, paint difference, lo and hi;
    those of hard evidence only where they are selected. An image that has violations but no such pair merges
    the one that costs least. Rounds end when no violation is left. assigned(image_id, region_id, color_id) has
    the regions that remain, joined(image_id, region_id, to) the ones that went into others.
    """
    pairs = paint_pairs(regions, paints)
    regions = saved(regions.select("image_id", "region_id", F.col("area").cast("double").alias("area"), *LAB, F.coalesce("protection", F.lit(0.0)).alias("protection")))
    edges = saved(edges.select("image_id", "lo", "hi", "evidence", "user_edge"))
    joined = saved(regions.select("image_id", "region_id", F.col("region_id").alias("to")))
    counts, done = {"merges": 0, "recoloured": 0, "selected": 0, "forced": 0}, None
    while True:
        options = saved(paint_options(regions, paints))
        nearest = options.groupBy("image_id", "region_id").agg(F.min_by("color_id", F.struct("error", "color_id")).alias("color_id"))
        facts = saved(measured(regions, edges))
        assigned, n = recoloured(options, facts, saved(nearest), pairs)
        counts["recoloured"] += n
        broken = saved(violations(facts, assigned, pairs))
        images = saved(broken.select("image_id").distinct())
        settled = assigned.join(images, "image_id", "left_anti").select("image_id", "region_id", "color_id")
        done = saved(settled if done is None else done.unionByName(settled))
        if images.isEmpty():
            return done, joined.where("region_id <> to"), counts
        regions, edges = (saved(x.join(images, "image_id", "left_semi")) for x in (regions, edges))
        options, assigned = (x.join(images, "image_id", "left_semi") for x in (options, assigned))
        allowed = broken.where(f"drawn < {HARD_EVIDENCE} OR user_edge")
        taken = disjoint_pairs(allowed, F.struct("evidence", "delta_e", "paint_de", "lo", "hi"))
        stuck = broken.join(taken.select("image_id").distinct(), "image_id", "left_anti")
        forced = saved(last_resort(stuck, regions, options, paints))
        counts["forced"] += forced.count()
        counts["selected"] += taken.join(broken.where("user_edge").select("image_id", "lo", "hi"), ["image_id", "lo", "hi"]).count()
        taken = saved(taken.unionByName(forced.select("image_id", "lo", "hi")))
        counts["merges"] += taken.count()
        regions, edges = merged(regions, edges, taken)
        to = taken.select("image_id", F.col("hi").alias("to"), F.col("lo").alias("next"))
        joined = saved(joined.join(to, ["image_id", "to"], "left").select("image_id", "region_id", F.coalesce("next", "to").alias("to")))


def _kept_in_order(least: float):
    """Firsts of each image by (l, a, b, cluster_id), streamed: color_id of each. Only kept paints that a later one can still be near to stay in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        image, kept, numbers, n = None, np.empty((0, 3)), np.empty(0, np.int64), 0
        for batch in batches:
            found = []
            for name, *lab in zip(batch.image_id.tolist(), *(batch[c].tolist() for c in LAB), strict=True):
                if name != image:
                    image, kept, numbers, n = name, np.empty((0, 3)), np.empty(0, np.int64), 0
                here = np.array(lab, float)
                if np.isnan(here).any():  # near to none
                    n += 1
                    found.append(n)
                    continue
                if len(kept) and _beyond(kept[0, 0], lab[0], least):
                    left = ~_beyond(kept[:, 0], lab[0], least)
                    kept, numbers = kept[left], numbers[left]
                d = difference_of(kept, here) if len(kept) else np.empty(0)
                if len(d) and d.min() < least:
                    found.append(int(numbers[d.argmin()]))
                else:
                    n += 1
                    kept, numbers = np.vstack([kept, here]), np.append(numbers, n)
                    found.append(n)
            yield batch[["image_id", "r", "g", "bl"]].assign(color_id=found)

    return run


def _beyond(before: np.ndarray, light: float, least: float) -> np.ndarray:
    """Whether lightness alone keeps a paint at least ``least`` from this and every later one; from 0 on the gap over its weight grows with light."""
    low = ((before + light) / 2 - 50) ** 2
    return ((light - before) / (1 + 0.015 * low / np.sqrt(20 + low)) > least + 1e-6) & (before >= 0)


def consolidated(paints: DataFrame, least: float = WEAK_DIFFERENCE) -> DataFrame:
    """paints(image_id, cluster_id, l, a, b, r, g, bl) with color_id: paints that are the same, or closer than ``least`` to one that was kept, share its number.

    Paints go by (l, a, b, cluster_id). One of the same 8-bit colour as an earlier one shares what that one has; else
    it joins the nearest kept one (ties to the earlier) if that is closer than ``least``, or is kept. Kept paints are
    numbered 1, 2, ... in that order. Kept paints lie ``least`` apart, so a paint meets no more of them than have room
    near its lightness, however many paints there are; an image's distinct colours stream through one task.
    """
    colour = ["image_id", "r", "g", "bl"]
    firsts = paints.groupBy(*colour).agg(F.min(F.struct(*LAB, "cluster_id")).alias("p")).select(*colour, "p.*")
    ordered = firsts.repartition("image_id").sortWithinPartitions("image_id", *LAB, "cluster_id").select(*colour, *LAB)
    kinds = {c: firsts.schema[c].dataType.simpleString() for c in colour}
    numbers = saved(ordered.mapInPandas(_kept_in_order(least), ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", color_id int"))
    same = [paints[c].eqNullSafe(numbers[c]) for c in colour]
    return paints.join(numbers, same).select(*(paints[c] for c in paints.columns), numbers["color_id"])
