"""Rasters in square tiles with a rim of their neighbours' pixels.

A tile is one task's work. What a tile can't settle by what it sees waits for a round in which the tiles around
it have settled more, so no result depends on where tiles end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 256


def dealt(pixels: DataFrame, side: int, rim: int = 1) -> DataFrame:
    """Each pixel once for its own tile and once for every tile that it is at most ``rim`` pixels away from; rim is at most side."""
    near = [F.struct(F.floor((F.col("y") + dy) / side).alias("ty"), F.floor((F.col("x") + dx) / side).alias("tx")) for dy in (-rim, 0, rim) for dx in (-rim, 0, rim)]
    inner = F.expr(f"pmod(y, {side}) BETWEEN {rim} AND {side - 1 - rim} AND pmod(x, {side}) BETWEEN {rim} AND {side - 1 - rim}")
    rows = pixels.withColumn("t", F.explode(F.when(inner, F.array(near[4])).otherwise(F.array_distinct(F.array(*near))))).select("*", "t.ty", "t.tx").drop("t")
    return rows.withColumn("own", (F.floor(F.col("y") / side) == F.col("ty")) & (F.floor(F.col("x") / side) == F.col("tx")))


def overlaid(base: DataFrame, later: DataFrame | None, side: int) -> DataFrame:
    """base with the tiles that ``later`` has in place of its own."""
    if later is None:
        return base
    again = placed(later, side).select("image_id", "ty", "tx").distinct()
    return placed(base, side).join(again, ["image_id", "ty", "tx"], "left_anti").select(*base.columns).unionByName(later)


class Tile:
    """The pixels of a tile on a grid with one more pixel on all sides; ``here`` marks pixels, ``own`` those of the tile."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows
        self.y0, self.x0 = int(rows.y.min()) - 1, int(rows.x.min()) - 1
        self.shape = (int(rows.y.max()) - self.y0 + 2, int(rows.x.max()) - self.x0 + 2)
        self.at = (rows.y.to_numpy() - self.y0, rows.x.to_numpy() - self.x0)
        self.own = self.grid("own", False, bool)
        self.here = np.zeros(self.shape, bool)
        self.here[self.at] = True

    def grid(self, column: str, default: object, kind: type) -> np.ndarray:
        out = np.full(self.shape, default, kind)
        out[self.at] = self.rows[column].to_numpy()
        return out


def placed(pixels: DataFrame, side: int) -> DataFrame:
    """pixels with the tile (ty, tx) where they lie."""
    return pixels.withColumns({"ty": F.floor(F.col("y") / side), "tx": F.floor(F.col("x") / side)})


def around(some: DataFrame) -> DataFrame:
    """These tiles (image_id, ty, tx) and the eight around each."""
    rows = some.select("image_id", F.explode(F.expr("array(ty - 1, ty, ty + 1)")).alias("ty"), "tx")
    return rows.select("image_id", "ty", F.explode(F.expr("array(tx - 1, tx, tx + 1)")).alias("tx")).distinct()


def each_tile(pixels: DataFrame, side: int, schema: str, run: Callable[[Tile], dict[str, np.ndarray]], others: DataFrame | None = None, only: DataFrame | None = None, rim: int = 1) -> DataFrame:
    """run(tile) gives grids by column name; the rows of a tile's own pixels are returned with them.

    others: rows by (image_id, ty, tx) that go to the tile as ``tile.others``. only: the tiles (image_id, ty, tx) that run, if not all. rim: how far a tile sees beyond its sides.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def work(key: tuple, rows: pd.DataFrame, more: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(rows) or not rows.own.any():
            return rows.iloc[:0].reindex(columns=names)
        tile = Tile(rows)
        tile.others, tile.place = more, (int(key[1]), int(key[2]))
        found = run(tile)
        mine = rows.own.to_numpy()
        at = tuple(x[mine] for x in tile.at)
        return pd.DataFrame({x: found[x][at] if x in found else key[0] if x == "image_id" else rows[x].to_numpy()[mine] for x in names})

    if only is not None:
        pixels = placed(pixels, side).join(around(only), ["image_id", "ty", "tx"], "left_semi").drop("ty", "tx")
    rows = dealt(pixels, side, rim)
    grouped = (rows if only is None else rows.join(only, ["image_id", "ty", "tx"], "left_semi")).groupBy("image_id", "ty", "tx")
    if others is None:
        return grouped.applyInPandas(lambda key, rows: work(key, rows), schema)
    apart = others.select(*(F.col(c).alias(c) for c in others.columns))  # both may come from the same rows
    return grouped.cogroup(apart.groupBy("image_id", "ty", "tx")).applyInPandas(work, schema)
