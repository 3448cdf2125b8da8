"""Evidence for boundaries, physical merges and paint conflicts, as joins and aggregations over edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.scalar import clamp
from brindle.operators import raster


def sided(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with columns of both ends, as column_lo and column_hi."""
    for s in ("lo", "hi"):
        edges = edges.join(nodes.select("image_id", F.col("region_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns)), ["image_id", s])
    return edges


def boundary_evidence(pixels: DataFrame, gray: str, edges: DataFrame) -> DataFrame:
    """Score in [0, 1] of each boundary; edges(image_id, lo, hi, delta_e) has the colour difference of its regions.

    Contrast, the median gradient that lasts over three blurs, contact, and few neighbours count for a
    boundary; a dense texture counts against it.
    """
    lasting = None
    for sigma in (0.0, 1.0, 2.0):
        p = pixels if not sigma else raster.blurred(pixels, gray, sigma, gray)
        g = raster.borders(raster.gradient(p, gray), "gradient").groupBy("image_id", "lo", "hi").agg(F.median("gradient").alias(f"g{int(sigma)}"), F.count("*").alias("shared_len"))
        lasting = g if lasting is None else lasting.join(g.drop("shared_len"), ["image_id", "lo", "hi"])
    area = pixels.groupBy("image_id", "region_id").agg(F.count("*").alias("area"))
    nodes = area.join(raster.degrees(pixels), ["image_id", "region_id"])
    e = sided(edges.join(lasting, ["image_id", "lo", "hi"]), nodes, "area", "degree")
    contrast = clamp((F.col("delta_e") - 2) / 10, 0.0, 1.0)
    persistence = clamp(F.least("g0", "g1", "g2") / 0.18, 0.0, 1.0)
    contact = F.least(F.lit(1.0), F.col("shared_len") / F.greatest(F.lit(1.0), 2.5 * F.sqrt(F.least("area_lo", "area_hi"))))
    fewest = F.least("degree_lo", "degree_hi")
    topology = F.when(fewest <= 2, 1.0).when(fewest == 3, 0.5).otherwise(0.0)
    density = F.least(F.lit(1.0), (F.col("degree_lo") + F.col("degree_hi")) / 16)
    texture = 0.5 * density + 0.5 * (1 - contact)
    score = clamp(0.35 * contrast + 0.25 * persistence + 0.20 * contact + 0.20 * topology - 0.25 * texture, 0.0, 1.0)
    return e.select("image_id", "lo", "hi", "shared_len", score.alias("evidence"))


def physical_loss(delta_e: Column, evidence: Column, degree: Column, area: Column, other: Column) -> Column:
    return 0.45 * F.least(F.lit(1.0), delta_e / 20) + 0.30 * evidence + 0.15 * (degree <= 2).cast("double") + 0.10 * F.least(F.lit(1.0), F.abs(area - other) / (area + other))


def conflicts(edges: DataFrame, assigned: DataFrame, paints: DataFrame) -> DataFrame:
    """Edges whose regions have one paint, or clearly different ones where the source shows no boundary.

    edges(image_id, lo, hi, delta_e, evidence), assigned(image_id, region_id, color_id), paints(one, two, paint_de).
    """
    e = sided(edges, assigned, "color_id").join(paints, (F.col("color_id_lo") == F.col("one")) & (F.col("color_id_hi") == F.col("two")), "left")
    kind = F.when(F.col("color_id_lo") == F.col("color_id_hi"), "same_paint").when((F.col("delta_e") < 2) & (F.col("evidence") < 0.20) & (F.col("paint_de") >= 5), "artificial")
    return e.withColumn("kind", kind).where("kind IS NOT NULL").select("image_id", "lo", "hi", "kind")


def faithful_paints(options: DataFrame, edges: DataFrame, assigned: DataFrame, paints: DataFrame) -> DataFrame:
    """For each region the best paint that suits its source and all its neighbours, where there is one.

    options(image_id, region_id, color_id, error). A paint suits if no neighbour has it, its error is 8 and
    the best error + 2 at most, and towards every neighbour it differs no more than the source allows.
    """
    both = edges.select("image_id", F.col("lo").alias("region_id"), F.col("hi").alias("n"), "delta_e", "evidence").unionByName(edges.select("image_id", F.col("hi").alias("region_id"), F.col("lo").alias("n"), "delta_e", "evidence"))
    around = both.join(assigned.select("image_id", F.col("region_id").alias("n"), F.col("color_id").alias("two")), ["image_id", "n"])
    best = options.groupBy("image_id", "region_id").agg(F.min("error").alias("best"))
    near = options.join(best, ["image_id", "region_id"]).where("error <= 8 AND error <= best + 2")
    tried = near.join(around, ["image_id", "region_id"]).join(paints.withColumnRenamed("one", "color_id"), ["color_id", "two"], "left")
    bad = (F.col("color_id") == F.col("two")) | (F.col("paint_de") > F.greatest(F.lit(5.0), 1.5 * F.col("delta_e") + 2)) | ((F.col("delta_e") < 2) & (F.col("evidence") < 0.20) & (F.col("paint_de") >= 5))
    spoiled = tried.where(bad).select("image_id", "region_id", "color_id").distinct()
    good = near.join(spoiled, ["image_id", "region_id", "color_id"], "left_anti")
    return good.groupBy("image_id", "region_id").agg(F.min_by("color_id", F.struct("error", "color_id")).alias("color_id"))


def reconstruction_benefit(options: DataFrame, edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """How much worse each region would be in the best paint of a neighbour, 0 at least."""
    both = edges.select("image_id", F.col("lo").alias("region_id"), F.col("hi").alias("n")).unionByName(edges.select("image_id", F.col("hi").alias("region_id"), F.col("lo").alias("n")))
    own = assigned.join(options, ["image_id", "region_id", "color_id"]).select("image_id", "region_id", F.col("error").alias("own"))
    other = both.join(assigned.select("image_id", F.col("region_id").alias("n"), "color_id"), ["image_id", "n"]).join(options, ["image_id", "region_id", "color_id"])
    least = other.groupBy("image_id", "region_id").agg(F.min("error").alias("other"))
    return own.join(least, ["image_id", "region_id"]).select("image_id", "region_id", F.greatest(F.lit(0.0), F.col("other") - F.col("own")).alias("benefit"))


def junctions(pixels: DataFrame) -> DataFrame:
    """Corners of the pixel grid where boundaries meet or end: (image_id, y, x, degree), degree other than 2.

    Every boundary side gives both of its corners; lines between junctions can then be traced one by one.
    """
    c = raster.contacts(pixels).where("l <> r")
    upright, y, x = F.col("axis") == "right", F.col("y"), F.col("x")
    ends = F.array(F.when(upright, F.struct(y.alias("y"), (x + 1).alias("x"))).otherwise(F.struct((y + 1).alias("y"), x.alias("x"))), F.struct((y + 1).alias("y"), (x + 1).alias("x")))
    corners = c.select("image_id", F.explode(ends).alias("p")).groupBy("image_id", "p.y", "p.x").agg(F.count("*").alias("degree"))
    return corners.where("degree <> 2")
