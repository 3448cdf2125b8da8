"""Components and closures over tables of edges and pixels."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import raster

#: Rows of an image whose runs are joined in one task.
BAND = 256


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where a session names none, only a master on one machine gets one, in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = context.getConf().get("spark.checkpoint.dir")
        if not path:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        context.setCheckpointDir(path)
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, written once below spark.checkpoint.dir and read from there.

    A table that is read again has neither lineage nor constraints of earlier rounds; these a checkpoint keeps, and
    planning gets slower with each.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each reaches over edges(a, b).

    Every round takes the smallest label of the neighbours and then jumps to the label's label, so long
    chains shorten by powers of two; rounds are saved.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(nodes.select("node", F.col("node").alias("root")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("low")).withColumnRenamed("a", "node")
        low = labels.join(around, "node", "left").select("node", "root", F.least("root", F.coalesce("low", "root")).alias("next"))
        jump = low.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        new = saved(low.join(jump, "next", "left").select("node", "root", F.least("next", F.coalesce("jump", "next")).alias("next")))
        if new.where("root <> next").isEmpty():
            return labels
        labels = new.select("node", F.col("next").alias("root"))


def _smallest_in_band(edges: pd.DataFrame) -> pd.DataFrame:
    """Each node of a band of rows with the smallest one that it reaches by the band's own edges."""
    nodes, at = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            return pd.DataFrame({"image_id": edges.image_id.iloc[0], "node": nodes, "low": nodes[low]})
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def pixel_components(pixels: DataFrame) -> DataFrame:
    """4-connected components of equal region_id: pixels with component, the smallest pixel number (y * width + x) of each.

    Runs of equal pixels in a row are found by windows. The runs of a band of rows are joined in one task, so
    the rounds over the whole image only have the contacts between bands.
    """
    from pyspark.sql import Window

    start = F.when(F.coalesce(F.lag("region_id").over(raster.along_row()) != F.col("region_id"), F.lit(True)), F.col("x"))
    run = F.max(start).over(raster.along_row().rowsBetween(Window.unboundedPreceding, 0))
    width = pixels.agg((F.max("x") + 1).alias("width"))
    rows = saved(pixels.join(F.broadcast(width)).withColumn("run", run).withColumn("node", F.col("y") * F.col("width") + F.col("run")).drop("width"))  # one row
    below = rows.select("image_id", "x", "y", "node", "region_id", F.lead("node").over(raster.along_column()).alias("b"), F.lead("region_id").over(raster.along_column()).alias("other"))
    band = F.expr(f"y div {BAND}")
    edges = below.where("region_id = other").select("image_id", F.col("node").alias("a"), "b", band.alias("band"), (F.expr(f"(y + 1) div {BAND}") == band).alias("inside")).distinct()
    edges = saved(edges)
    local = saved(edges.where("inside").groupBy("image_id", "band").applyInPandas(_smallest_in_band, "image_id string, node long, low long"))
    low = lambda name: local.select("image_id", F.col("node").alias(name), F.col("low").alias(f"low_{name}"))
    across = edges.where("NOT inside").join(low("a"), ["image_id", "a"], "left").join(low("b"), ["image_id", "b"], "left")
    across = across.select(F.struct("image_id", F.coalesce("low_a", "a").alias("node")).alias("a"), F.struct("image_id", F.coalesce("low_b", "b").alias("node")).alias("b")).distinct()
    ends = across.select(F.col("a").alias("node")).unionByName(across.select(F.col("b").alias("node"))).distinct()
    roots = smallest_reachable(ends, across).select(F.col("node.image_id").alias("image_id"), F.col("node.node").alias("low"), F.col("root.node").alias("component"))
    found = rows.join(local, ["image_id", "node"], "left").withColumn("low", F.coalesce("low", "node")).join(roots, ["image_id", "low"], "left")
    return found.withColumn("component", F.coalesce("component", "low")).drop("node", "run", "low")


def holes(pixels: DataFrame) -> DataFrame:
    """Components of other pixels that one region encloses: (image_id, region_id, holes).

    A component that does not touch the edge of the raster and has one neighbouring region fills a hole of it.
    """
    parts = saved(pixel_components(pixels))
    as_region = parts.withColumn("kind", F.col("region_id")).withColumn("region_id", F.col("component"))
    c = raster.contacts(as_region, "kind").where("l <> r")
    sides = c.select("image_id", F.col("l").alias("component"), F.col("kind_r").alias("outer"), F.col("r").alias("outer_part")).unionByName(c.select("image_id", F.col("r").alias("component"), F.col("kind").alias("outer"), F.col("l").alias("outer_part")))
    size = parts.agg(F.max("x").alias("w"), F.max("y").alias("h"))
    rim = parts.join(F.broadcast(size)).where("x = 0 OR y = 0 OR x = w OR y = h").select("image_id", "component").distinct()  # one row
    inner = sides.join(rim, ["image_id", "component"], "left_anti").groupBy("image_id", "component").agg(F.min("outer_part").alias("low"), F.max("outer_part").alias("high"), F.min("outer").alias("region_id"))
    return inner.where("low = high").groupBy("image_id", "region_id").agg(F.count("*").alias("holes"))


def union_pairs(pairs: DataFrame) -> DataFrame:
    """Transitive closure of merge pairs(a, b): every node with the smallest one of its class, numbered 1, 2, ... in order."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    roots = smallest_reachable(nodes, pairs)
    return roots.join(numbered(roots.select("root").distinct(), "root", "label"), "root").select("node", "root", "label")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with a number 1, 2, ... by ``order``: ranges on many tasks, each counted on from the sizes of those before it."""
    from pyspark.sql import Window

    parts = saved(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("part").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.join(F.broadcast(sizes), "part").withColumn(name, (F.col("before") + within).cast("long")).drop("part", "size", "before")
