"""Ordered, greedy operators in rounds: budgets, palettes, and places for labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scalar import label_height_mm
from brindle.operators import distance, graph


def budget_with_skip(rows: DataFrame, key: str, size: str, order: list[Column], budget: float) -> DataFrame:
    """(key, used, kept): the items that are kept in order while they fit; an item that does not fit is skipped, not the rest.

    Each round keeps, by running sums over what could still fit, all items up to the first that does not; then what is
    larger than the rest of the budget leaves, and the next round goes on behind. Sums stream over a key's rows,
    none of which are gathered.
    """
    left = graph.saved(rows.select(key, F.col(size).cast("double").alias("s"), F.struct(*order, F.col("item")).alias("o")))
    used = graph.saved(left.select(key).distinct().select(key, F.lit(0.0).alias("used"), F.lit(0).cast("long").alias("kept")))
    while True:
        sums = F.sum("s").over(Window.partitionBy(key).orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
        open_ = left.join(used, key).where(F.col("s") <= budget - F.col("used")).withColumn("total", F.col("used") + sums)
        open_ = graph.saved(open_)
        stop = open_.where(F.col("total") > budget).groupBy(key).agg(F.min("o").alias("stop"))
        ahead = open_.join(stop, key, "left")
        more = graph.saved(ahead.where("stop IS NULL OR o < stop").groupBy(key).agg(F.max("total").alias("now"), F.count("*").alias("n")))
        if more.isEmpty():
            return used
        left = graph.saved(ahead.where("o > stop").select(key, "s", "o"))
        used = graph.saved(used.join(more, key, "left").select(key, F.coalesce("now", "used").alias("used"), (F.col("kept") + F.coalesce("n", F.lit(0))).alias("kept")))


def lloyd(points: DataFrame, columns: list[str], weight: str, k: int, rounds: int = 12) -> DataFrame:
    """(cluster_id, columns, weight): weighted k-means from farthest-first seeds, each round one aggregation.

    The centres, k rows, are literals of the next round's expression, so points are never moved.
    """
    points = points.select(*(F.col(c).cast("double") for c in columns), F.col(weight).cast("double").alias("w"))
    first = points.agg(*((F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in columns)).first()
    centres = [tuple(first)]
    while len(centres) < k:
        near = F.least(*_distances(columns, centres), F.lit(float("inf")))
        far = points.groupBy(*columns).agg(F.lit(1)).select(*columns, near.alias("d")).orderBy(F.desc("d"), *columns).first()
        if far is None or far.d <= 0:
            break
        centres.append(tuple(far[c] for c in columns))
    for _ in range(rounds):
        options = F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(_distances(columns, centres))))
        groups = points.withColumn("i", F.array_min(options)["i"]).groupBy("i").agg(*((F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in columns))
        moved = {r.i: tuple(r[c] for c in columns) for r in groups.collect()}  # k rows
        new = [moved.get(i, c) for i, c in enumerate(centres)]
        if max(abs(a - b) for x, y in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True)) < 1e-9:
            break
        centres = new
    options = F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(_distances(columns, sorted(centres)))))
    out = points.withColumn("cluster_id", F.array_min(options)["i"] + 1).groupBy("cluster_id").agg(*((F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in columns), F.sum("w").alias("weight"))
    return out


def _distances(columns: list[str], centres: list[tuple]) -> list[Column]:
    out = []
    for centre in centres:
        d = F.lit(0.0)
        for c, x in zip(columns, centre, strict=True):
            d = d + (F.col(c) - x) * (F.col(c) - x)
        out.append(d)
    return out


def label_places(pixels: DataFrame, spacing: float, most: int | Column, least_room: float = 0.0) -> DataFrame:
    """(image_id, region_id, ordinal, y, x, room): places for labels, deepest inside first, at least ``spacing`` apart, ``most`` at most.

    room is the distance to the nearest pixel outside the region. Only places of ``least_room`` count; a region without
    any has its deepest one. ``most`` may depend on left, top, right, bottom of the region. A round picks the deepest
    place that is left in each region (ties to the smaller y, then x) and drops what is too near to it.
    """
    room = graph.saved(distance.squared_room(pixels.where("region_id <> 0")).withColumn("room", F.sqrt("room")))
    boxes = room.groupBy("image_id", "region_id").agg(F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") + 1).alias("right"), (F.max("y") + 1).alias("bottom"), F.max("room").alias("deepest"))
    boxes = graph.saved(boxes.select("image_id", "region_id", (most if isinstance(most, Column) else F.lit(most)).cast("int").alias("most"), F.least("deepest", F.lit(float(least_room))).alias("floor")))
    left = graph.saved(room.join(boxes, ["image_id", "region_id"]).where("room >= floor").drop("floor"))
    found, turn = None, 1
    while True:
        place = F.struct((-F.col("room")).alias("r"), "y", "x")
        picks = graph.saved(left.where(F.col("most") >= turn).groupBy("image_id", "region_id").agg(F.min(place).alias("p")).select("image_id", "region_id", F.lit(turn).alias("ordinal"), "p.y", "p.x", (-F.col("p.r")).alias("room")))
        if picks.isEmpty():
            return found if found is not None else picks
        found = picks if found is None else found.unionByName(picks)
        near = picks.select("image_id", "region_id", F.col("y").alias("py"), F.col("x").alias("px"))
        apart = (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")) + (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) >= spacing * spacing
        left = graph.saved(left.where(F.col("most") > turn).join(near, ["image_id", "region_id"]).where(apart).drop("py", "px"))
        turn += 1


#: Labels repeat at this distance, so many in a region at most.
REPEAT_MM, MOST_LABELS = 35.0, 12


def label_plan(pixels: DataFrame, mm_per_pixel: float) -> DataFrame:
    """(image_id, region_id, ordinal, y, x, pocket_mm, height_mm): labels of regions, repeated along large ones; a region without a place that fits one has a row of nulls."""
    length = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")) * mm_per_pixel
    most = F.greatest(F.lit(1), F.least(F.lit(MOST_LABELS), F.floor(length / REPEAT_MM) + 1))
    places = label_places(pixels, REPEAT_MM / mm_per_pixel, most, 0.5)
    pocket = 2 * F.col("room") * mm_per_pixel
    fits = places.withColumns({"pocket_mm": pocket, "height_mm": label_height_mm(pocket)}).where("height_mm IS NOT NULL").drop("room")
    every = pixels.where("region_id <> 0").select("image_id", F.col("region_id").cast("long").alias("region_id")).distinct()
    return every.join(fits, ["image_id", "region_id"], "left")


def numbering(plan: DataFrame) -> DataFrame:
    """For each image: labels, those that repeat a region's, regions without one, regions with a label below 4 mm, and the least pocket and height (0 without labels)."""
    by_region = plan.groupBy("image_id", "region_id").agg(F.count("ordinal").alias("n"), F.min("pocket_mm").alias("pocket"), F.min("height_mm").alias("height"))
    return by_region.groupBy("image_id").agg(
        F.sum("n").alias("placed"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("repeated"), F.count_if(F.col("n") == 0).alias("unnumbered"), F.count_if(F.col("height") < 4).alias("adaptive"),
        F.coalesce(F.min("pocket"), F.lit(0.0)).alias("least_pocket_mm"), F.coalesce(F.min("height"), F.lit(0)).alias("least_height_mm"),
    )
