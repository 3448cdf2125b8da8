"""Exact Euclidean distances on rasters: one pass along rows by windows, one along columns as lower envelopes of parabolas."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import raster


def envelope(heights: np.ndarray, places: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """min over i of (q - places[i])**2 + heights[i] for each q asked; places and asked ascend, infinite heights count for nothing."""
    some = np.isfinite(heights)
    heights, places = heights[some].tolist(), places[some].tolist()
    out = np.full(len(asked), np.inf)
    if not places:
        return out
    stack, from_ = [0], [-np.inf]
    for i in range(1, len(places)):
        while True:
            j = stack[-1]
            cut = ((heights[i] + places[i] ** 2) - (heights[j] + places[j] ** 2)) / (2 * (places[i] - places[j]))
            if cut > from_[-1]:
                break
            stack.pop(), from_.pop()
        stack.append(i), from_.append(cut)
    k = np.searchsorted(np.array(from_), asked, side="right") - 1
    low = np.array(stack)[np.maximum(k, 0)]
    return (asked - np.array(places)[low]) ** 2 + np.array(heights)[low]


def _lines(group: bool, rim: bool = True):
    """Columns of an image in order; ``group``: a line is cut where region_id changes, and what lies beyond counts as outside, beyond the raster only with ``rim``."""
    beyond = 0.0 if rim else np.inf

    def one(p: pd.DataFrame) -> pd.DataFrame:
        y, h = p.y.to_numpy(np.float64), p.across.to_numpy(np.float64) ** 2
        if not group:
            return p.assign(square=envelope(h, y, y))
        cuts = np.flatnonzero(np.diff(p.region_id.to_numpy())) + 1
        parts = zip([0, *cuts.tolist()], [*cuts.tolist(), len(y)], strict=True)
        return p.assign(square=np.concatenate([envelope(np.concatenate([[0.0 if a else beyond], h[a:b], [0.0 if b < len(y) else beyond]]), np.concatenate([[y[a] - 1], y[a:b], [y[b - 1] + 1]]), y[a:b]) for a, b in parts]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = np.flatnonzero((held.x.to_numpy()[1:] != held.x.to_numpy()[:-1]) | (held.image_id.to_numpy()[1:] != held.image_id.to_numpy()[:-1])) + 1
            edges = [0, *new.tolist()]
            for a, b in zip(edges, edges[1:], strict=False):
                yield one(held.iloc[a:b])
            held = held.iloc[edges[-1] :]
        if held is not None and len(held):
            yield one(held)

    return run


def _down_columns(rows: DataFrame, group: bool, name: str, rim: bool = True) -> DataFrame:
    lines = rows.repartition("image_id", "x").sortWithinPartitions("image_id", "x", "y")
    return lines.mapInPandas(_lines(group, rim), f"image_id string, y long, x long, {'region_id long, ' if group else ''}across double, square double").drop("across").withColumnRenamed("square", name)


def squared_to(pixels: DataFrame, seed: Column, name: str) -> DataFrame:
    """(image_id, y, x, name): the squared distance of each pixel to the nearest one where seed holds; infinite in an image without any."""
    row = raster.along_row()
    place = F.when(seed, F.col("x"))
    before = F.last(place, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(place, ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
    across = F.coalesce(F.least(F.col("x") - before, after - F.col("x")).cast("double"), F.lit(float("inf")))
    return _down_columns(pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), across.alias("across")), False, name)


def squared_within(pixels: DataFrame, seed: Column, name: str, reach: float) -> DataFrame:
    """pixels with the squared distance to the nearest one where seed holds, infinite beyond ``reach``: windows only, along rows, then ``reach`` pixels up and down."""
    row, column, most = raster.along_row(), raster.along_column(), math.floor(reach)
    place = F.when(seed, F.col("x"))
    before = F.last(place, ignorenulls=True).over(row.rowsBetween(-most, 0))
    after = F.first(place, ignorenulls=True).over(row.rowsBetween(0, most))
    across = F.coalesce(F.least(F.col("x") - before, after - F.col("x")).cast("double"), F.lit(float("inf")))
    rows = pixels.withColumns({"across": across, "at": F.col("y").cast("double")})
    square = F.col("across") * F.col("across")
    for step in (f(c, k).over(column) for k in range(1, most + 1) for f in (F.lag, F.lead) for c in (F.struct("at", "across"),)):
        square = F.least(square, (step["at"] - F.col("at")) * (step["at"] - F.col("at")) + step["across"] * step["across"])  # null beyond the rim counts for nothing
    return rows.withColumn(name, F.when(square <= reach * reach, square).otherwise(float("inf"))).drop("across", "at")


def squared_room(pixels: DataFrame, name: str = "room", rim: bool = True) -> DataFrame:
    """(image_id, y, x, region_id, name): the squared distance of each pixel to the nearest one outside its region; the raster's outside is outside only with ``rim``, else a region that fills its image has infinite room."""
    row = raster.along_row()
    differs = lambda f: F.coalesce(f("region_id").over(row) != F.col("region_id"), F.lit(rim))
    start = F.max(F.when(differs(F.lag), F.col("x"))).over(row.rowsBetween(Window.unboundedPreceding, 0))
    end = F.min(F.when(differs(F.lead), F.col("x"))).over(row.rowsBetween(0, Window.unboundedFollowing))
    across = F.coalesce(F.least(F.col("x") - start, end - F.col("x")).cast("double") + 1, F.lit(float("inf")))
    return _down_columns(pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("region_id").cast("long").alias("region_id"), across.alias("across")), True, name, rim)


def feathered(pixels: DataFrame, mask: str, transition: float) -> DataFrame:
    """pixels with weight: 1 on the mask, falling to 0 over ``transition`` pixels and one more outside it; 0 in an image without mask."""
    far = squared_to(pixels, F.col(mask), "square")
    weight = F.greatest(F.lit(0.0), 1 - F.sqrt("square") / (transition + 1))
    return pixels.join(far.select("image_id", "y", "x", weight.alias("weight")), ["image_id", "y", "x"])


def label_pockets(pixels: DataFrame, mm_per_pixel: float) -> DataFrame:
    """(image_id, region_id, pocket_mm): the width of the widest place of each region."""
    widest = squared_room(pixels.where("region_id <> 0")).groupBy("image_id", "region_id").agg(F.max("room").alias("room"))
    return widest.select("image_id", "region_id", F.greatest(F.lit(0.0), (2 * F.sqrt("room") - 1) * mm_per_pixel).alias("pocket_mm"))
