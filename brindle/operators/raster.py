"""Rasters as tables of pixels (image_id, y, x, ...): neighbours, region statistics, boundaries and stencils.

Neighbours come from windows along rows and columns, so a pixel is never joined with others. Windows are
partitioned by image and row (or column), which bounds them by the side of an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along_row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_column() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def contacts(pixels: DataFrame, *extra: str) -> DataFrame:
    """One row for each pair of pixels that touch to the right or below: their regions as l and r, and extra columns of both."""
    sides = []
    for axis, window in (("right", along_row()), ("down", along_column())):
        other = [F.lead(c).over(window).alias(f"{c}_r") for c in ("region_id", *extra)]
        side = pixels.select("image_id", "y", "x", "region_id", *extra, *other, F.lit(axis).alias("axis")).where("region_id_r IS NOT NULL")
        sides.append(side.withColumnRenamed("region_id", "l").withColumnRenamed("region_id_r", "r"))
    return sides[0].unionByName(sides[1])


def borders(pixels: DataFrame, *extra: str) -> DataFrame:
    """Contacts between different regions, none of them 0, with lo < hi."""
    c = contacts(pixels, *extra).where("l <> r AND l <> 0 AND r <> 0")
    return c.withColumn("lo", F.least("l", "r")).withColumn("hi", F.greatest("l", "r"))


def shared_boundary(pixels: DataFrame) -> DataFrame:
    return borders(pixels).groupBy("image_id", "lo", "hi").agg(F.count("*").alias("shared_len"))


def degrees(pixels: DataFrame) -> DataFrame:
    """Neighbours of each region; isolated regions have none."""
    pairs = borders(pixels).select("image_id", "lo", "hi").distinct()
    ends = pairs.select("image_id", F.col("lo").alias("region_id")).unionByName(pairs.select("image_id", F.col("hi").alias("region_id")))
    counts = ends.groupBy("image_id", "region_id").agg(F.count("*").alias("degree"))
    every = pixels.where("region_id <> 0").select("image_id", "region_id").distinct()
    return every.join(counts, ["image_id", "region_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def region_stats(pixels: DataFrame, value: str) -> DataFrame:
    """Area, box (right and bottom exclusive), perimeter over exposed sides, mean and median value, thickness."""
    inner = contacts(pixels).where("l = r").groupBy("image_id", F.col("l").alias("region_id")).agg(F.count("*").alias("inner"))
    stats = pixels.groupBy("image_id", "region_id").agg(
        F.count("*").alias("area"), F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") + 1).alias("right"), (F.max("y") + 1).alias("bottom"), F.avg(value).alias("mean"), F.median(value).alias("median")
    )
    out = stats.join(inner, ["image_id", "region_id"], "left")
    perimeter = 4 * F.col("area") - 2 * F.coalesce("inner", F.lit(0))
    return out.withColumn("perimeter", perimeter).withColumn("thickness", 2 * F.col("area") / F.greatest("perimeter", F.lit(1))).drop("inner")


def boundary_mask(pixels: DataFrame) -> DataFrame:
    """edge: the pixel differs from one of its four neighbours."""
    around = [f(c).over(w) for w in (along_row(), along_column()) for f in (F.lead, F.lag) for c in ("region_id",)]
    edge = F.lit(False)
    for other in around:
        edge = edge | F.coalesce(other != F.col("region_id"), F.lit(False))
    return pixels.withColumn("edge", edge)


def dilated(pixels: DataFrame, mask: str, reach: int, name: str) -> DataFrame:
    """A square dilation of 2 * reach + 1 pixels, as a maximum along rows, then columns; pixels must fill the raster."""
    across = F.max(F.col(mask)).over(along_row().rowsBetween(-reach, reach))
    return pixels.withColumn("across", across).withColumn(name, F.max("across").over(along_column().rowsBetween(-reach, reach))).drop("across")


def gradient(pixels: DataFrame, value: str) -> DataFrame:
    """Sobel magnitude; outside pixels repeat those of the border."""
    at = lambda c, w, d: F.coalesce((F.lead if d > 0 else F.lag)(c).over(w), F.col(c))
    along = pixels.withColumn("smooth_x", at(value, along_row(), -1) + 2 * F.col(value) + at(value, along_row(), 1)).withColumn("step_x", at(value, along_row(), 1) - at(value, along_row(), -1))
    gx = at("step_x", along_column(), -1) + 2 * F.col("step_x") + at("step_x", along_column(), 1)
    gy = at("smooth_x", along_column(), 1) - at("smooth_x", along_column(), -1)
    return along.withColumn("gradient", F.sqrt(gx * gx + gy * gy)).drop("smooth_x", "step_x")


def blurred(pixels: DataFrame, value: str, sigma: float, name: str) -> DataFrame:
    """Gaussian blur as weighted sums of lags and leads, reflected without the border pixel at the edges of the raster."""
    import math

    reach = max(1, round(3 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total = sum(weights)

    def along(c: str, w) -> Column:
        out = F.lit(0.0)
        for k, g in zip(range(-reach, reach + 1), weights, strict=True):
            out = out + (g / total) * (F.col(c) if k == 0 else F.coalesce((F.lead if k > 0 else F.lag)(c, abs(k)).over(w), (F.lag if k > 0 else F.lead)(c, abs(k)).over(w), F.col(c)))
        return out

    return pixels.withColumn("across", along(value, along_row())).withColumn(name, along("across", along_column())).drop("across")


def selection_coverage(pixels: DataFrame, weight: str) -> DataFrame:
    b = borders(pixels, weight)
    return b.groupBy("image_id", "lo", "hi").agg(F.avg(F.greatest(F.col(weight), F.col(f"{weight}_r"))).alias("coverage"))


def strongest_anchor(pixels: DataFrame, strength: str) -> DataFrame:
    """The contact of each pair of regions with the largest strength; ties to the smaller (y, x, axis)."""
    b = borders(pixels, strength).withColumn("s", F.greatest(F.col(strength), F.col(f"{strength}_r")))
    best = b.groupBy("image_id", "lo", "hi").agg(F.min_by(F.struct("y", "x", "axis", "s"), F.struct(-F.col("s"), "y", "x", "axis")).alias("b"))
    return best.select("image_id", "lo", "hi", *(F.col(f"b.{c}").alias(c) for c in ("y", "x", "axis")), F.col("b.s").alias("strength"))


def boosted_evidence(edges: DataFrame, multiplier: float) -> DataFrame:
    """Boundary evidence raised where a selection covers it; hard where it reaches 0.7."""
    e, c = F.col("evidence"), F.col("coverage")
    raised = F.least(F.lit(1.0), F.greatest(e * (1 + (multiplier - 1) * c), F.least(F.lit(0.70), 0.20 * multiplier * c)))
    applies = (c > 0) & ((F.col("delta_e") >= 2) | (e >= 0.20))
    return edges.withColumn("evidence", F.when(applies, raised).otherwise(e)).withColumn("hard", applies & (F.col("evidence") >= 0.70))


def compact_labels(pixels: DataFrame) -> DataFrame:
    """old region_id to 1, 2, ... in ascending order within each image: ranges of ids on many tasks, each counted on from those before it."""
    from brindle.operators.graph import saved

    ids = pixels.where("region_id <> 0").select("image_id", "region_id").distinct()
    parts = saved(ids.repartitionByRange("image_id", "region_id").withColumn("part", F.spark_partition_id()))
    before = F.sum("size").over(Window.partitionBy("image_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = parts.groupBy("image_id", "part").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(before, F.lit(0))).drop("size")
    within = F.row_number().over(Window.partitionBy("image_id", "part").orderBy("region_id"))
    return parts.join(sizes, ["image_id", "part"]).withColumn("label", (F.col("before") + within).cast("long")).select("image_id", "region_id", "label")


def overlap_remap(pixels: DataFrame, old: str, new: str, share: float = 0.8) -> DataFrame:
    """Each new id with the old id that covers most of it (ties to the smaller), if it covers this share of the new region."""
    n = pixels.groupBy("image_id", old, new).agg(F.count("*").alias("n"))
    best = n.groupBy("image_id", new).agg(F.min_by(F.struct(F.col(old).alias("o"), "n"), F.struct(-F.col("n"), old)).alias("b"), F.sum("n").alias("area"))
    return best.where(F.col("b.n") >= share * F.col("area")).select("image_id", new, F.col("b.o").alias(old), F.col("b.n").alias("n"), "area")


def first_pixel_remap(pixels: DataFrame, old: str, new: str) -> DataFrame:
    return pixels.groupBy("image_id", old).agg(F.min_by(new, F.struct("y", "x")).alias(new))


def looked_up(pixels: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Gathers a value for each pixel from a table by key; the optimizer broadcasts small tables."""
    return pixels.join(table.select("image_id", key, value), ["image_id", key], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def nearest_paint(points: DataFrame, palette: list[tuple[int, float, float, float]], x: Column, y: Column, z: Column) -> DataFrame:
    """The nearest palette entry to each point by squared distance; the palette is a literal, so nothing is joined."""
    options = F.array(*(F.struct(((x - a) * (x - a) + (y - b) * (y - b) + (z - c) * (z - c)).alias("d"), F.lit(i).alias("color_id")) for i, a, b, c in palette))
    return points.withColumn("best", F.array_min(options)).withColumn("color_id", F.col("best.color_id")).withColumn("distance", F.sqrt("best.d")).drop("best")


def inside_polygon(pixels: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    """selected: the pixel's centre lies inside a closed polygon (odd number of crossings); fewer than three points select nothing."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, [*points[1:], points[0]], strict=True) if len(points) >= 3 else []:
        if y1 == y2:
            continue
        at = F.lit(x1) + (F.col("y") + 0.5 - y1) * ((x2 - x1) / (y2 - y1))
        crossings = crossings + ((F.lit(y1 <= 1e18) & ((F.col("y") + 0.5 >= min(y1, y2)) & (F.col("y") + 0.5 < max(y1, y2))) & (F.col("x") + 0.5 < at)).cast("int"))
    return pixels.withColumn("selected", crossings % 2 == 1)


def brushed(pixels: DataFrame, strokes: list[tuple[float, float, float, float, float, bool]], mask: str) -> DataFrame:
    """Paints or erases within half the width of each stroke (x1, y1, x2, y2, width, paint); the last stroke wins."""
    value = F.col(mask)
    for x1, y1, x2, y2, width, paint in strokes:
        dx, dy = x2 - x1, y2 - y1
        length = dx * dx + dy * dy
        px, py = F.col("x") + 0.5 - x1, F.col("y") + 0.5 - y1
        t = F.least(F.greatest((px * dx + py * dy) / length, F.lit(0.0)), F.lit(1.0)) if length else F.lit(0.0)
        near = F.pow(px - t * dx, 2) + F.pow(py - t * dy, 2) <= (width / 2) ** 2
        value = F.when(near, F.lit(paint)).otherwise(value)
    return pixels.withColumn(mask, value)


def differing_pixels(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    other = b.select("image_id", "y", "x", F.col(column).alias("other"))
    return a.join(other, ["image_id", "y", "x"], "full").where(~F.col(column).eqNullSafe(F.col("other"))).agg(F.count("*").alias("differing"))
