"""Boundary lines of region maps: every side between two regions in exactly one line, and fewer vertices within a tolerance.

Lines end where other than two sides meet. A tile ranks the sides that it owns; what leaves a tile is ranked by pointer
doubling over the pieces, whose number grows with the rims of tiles and not with their sides. No task holds a line.

A walk along a side is known by its dart: the corner where it begins and its direction, in one number that orders
darts by corner (rows first) and then by the corner where they lead. Corners are below 2**30 in both coordinates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import raster
from brindle.operators.graph import saved
from brindle.operators.tiles import SIDE

UP, LEFT, RIGHT, DOWN = range(4)


def sides(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, upright): sides between different regions, from corner (y, x) down or to the right."""
    c = raster.contacts(pixels).where("l <> r")
    upright = F.col("axis") == "right"
    return c.select("image_id", F.when(upright, F.col("y")).otherwise(F.col("y") + 1).alias("y"), F.when(upright, F.col("x") + 1).otherwise(F.col("x")).alias("x"), upright.alias("upright"))


def _doubled(after: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each dart the number of darts from it to the end, the last one and the smallest one on the way, and whether it ends at all."""
    n = len(after)
    after, length = np.append(after, n), np.append(np.ones(n, np.int64), 0)
    low, last = np.arange(n + 1), np.arange(n + 1)
    for _ in range(max(1, n).bit_length() + 1):
        on = after != n
        length = length + np.where(on, length[after], 0)
        low, last = np.where(on, np.minimum(low, low[after]), low), np.where(on, last[after], last)
        after = after[after]
    return length[:n], last[:n], low[:n], after[:n] == n


def _pieces(key: tuple, rows: pd.DataFrame, side: int) -> pd.DataFrame:
    """The sides of a tile along pieces, which end where other than two sides meet or where another tile's sides may."""
    y, x, upright = rows.y.to_numpy(), rows.x.to_numpy(), rows.upright.to_numpy()
    n = len(rows)
    at_y, at_x = np.concatenate([y, y + upright]), np.concatenate([x, x + ~upright])  # the corners where darts begin
    code = ((at_y << 31 | at_x) << 2) | np.concatenate([np.where(upright, DOWN, RIGHT), np.where(upright, UP, LEFT)])
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    _, corner = np.unique(np.stack([at_y, at_x]), axis=1, return_inverse=True)
    corner = corner.reshape(-1)
    top, left = key[1] * side, key[2] * side
    open_ = (at_y == top) | (at_x == left) | (at_y == top + side) | (at_x == left + side)
    through = np.bincount(corner) == 2
    through[corner[open_]] = False
    both = np.zeros(len(through), np.int64)
    np.add.at(both, corner, np.arange(2 * n))
    head = corner[back]
    after = np.where(through[head], both[head] - back, 2 * n)
    length, last, low, ends = _doubled(after)
    if not ends.all():  # loops are cut before their smallest dart
        after = np.where(~ends & (after == low), 2 * n, after)
        length, last, _, _ = _doubled(after)
        first = np.where(ends, back[last[back]], low)
        other = np.where(ends, back[last], low[back])
    else:
        first, other = back[last[back]], back[last]
    mine = np.flatnonzero(code[first] < code[other])
    first, total = first[mine], length[first[mine]]
    return pd.DataFrame({
        "image_id": key[0], "piece": code[first], "at": total - length[mine], "n": total, "end": code[other[mine]], "loop": ~ends[mine],
        "y": at_y[mine], "x": at_x[mine], "to_y": at_y[back[mine]], "to_x": at_x[back[mine]],
    })


PIECE = "image_id string, piece long, at long, n long, end long, loop boolean, y long, x long, to_y long, to_x long"


def _corner(dart: str) -> Column:
    return F.shiftright(dart, 2)


def _ranked(darts: DataFrame) -> DataFrame:
    """darts(image_id, dart, after, n, end) with the sides that are left to the end of the line, the reverse of its last dart and the smallest dart ahead.

    Each round doubles how far a dart sees. Open lines are done when nothing is ahead; on loops nothing changes
    any more once every dart knows the smallest one: ``after`` is null for open lines only.
    """
    now = saved(darts.select("image_id", "dart", "after", F.col("n").alias("ahead"), "end", F.col("dart").alias("low")))
    before = None
    while True:
        counts = now.agg(F.count("after").alias("open"), F.sum(F.when(F.col("after").isNotNull(), F.col("low").cast("decimal(38, 0)"))).alias("low")).first()
        if not counts.open or counts == before:
            return now
        before = counts
        next_ = now.select("image_id", F.col("dart").alias("after"), F.col("after").alias("far"), F.col("ahead").alias("more"), F.col("end").alias("far_end"), F.col("low").alias("far_low"))
        on = F.col("after").isNotNull()
        # on a loop lengths only grow; they are counted anew once it is cut
        ahead = F.when(on, F.least(F.col("ahead") + F.col("more"), F.lit(1 << 60))).otherwise(F.col("ahead"))
        now = saved(now.join(next_, ["image_id", "after"], "left").select("image_id", "dart", F.col("far").alias("after"), ahead.alias("ahead"), F.coalesce("far_end", "end").alias("end"), F.least("low", "far_low").alias("low")))


def _lines_of_pieces(pieces: DataFrame) -> DataFrame:
    """(image_id, piece, line, offset, turned, loop) of pieces(image_id, piece, n, end) that end at corners: the line that each is part of."""
    both = pieces.select("image_id", F.col("piece").alias("dart"), F.col("end").alias("back"), "n").unionByName(pieces.select("image_id", F.col("end").alias("dart"), F.col("piece").alias("back"), "n"))
    corners = both.groupBy("image_id", _corner("dart").alias("corner")).agg(F.min("dart").alias("one"), F.max("dart").alias("two"), F.count("*").alias("degree")).where("degree = 2")
    darts = both.withColumn("corner", _corner("back")).join(corners, ["image_id", "corner"], "left")
    darts = saved(darts.select("image_id", "dart", "back", "n", F.when(F.col("one") == F.col("back"), F.col("two")).otherwise(F.col("one")).alias("after")))
    ranked = _ranked(darts.withColumn("end", F.col("back")))
    far = ranked.select("image_id", "dart", "ahead", "end", F.col("after").isNotNull().alias("loop"), "low")
    turned = far.select("image_id", F.col("dart").alias("back"), F.col("ahead").alias("ahead_back"), F.col("end").alias("first"), F.col("low").alias("low_back"))
    known = saved(darts.join(far, ["image_id", "dart"]).join(turned, ["image_id", "back"]))
    open_ = known.where("NOT loop AND first < end").select("image_id", "dart", "back", F.col("first").alias("line"), (F.col("ahead_back") - F.col("n")).alias("offset"), F.lit(False).alias("loop"))
    cut = saved(known.where("loop AND low < low_back").withColumn("after", F.when(F.col("after") != F.col("low"), F.col("after"))))
    if not cut.isEmpty():
        left = _ranked(cut.select("image_id", "dart", "after", "n", F.col("back").alias("end"))).select("image_id", "dart", F.col("ahead").alias("left"))
        rows = cut.join(left, ["image_id", "dart"])
        whole = rows.where("dart = low").select("image_id", "low", F.col("left").alias("total"))
        loops = rows.join(whole, ["image_id", "low"]).select("image_id", "dart", "back", F.col("low").alias("line"), (F.col("total") - F.col("left")).alias("offset"), F.lit(True).alias("loop"))
        open_ = open_.unionByName(loops)
    sides_ = pieces.select("image_id", "piece", "end")
    straight = sides_.join(open_.withColumnRenamed("dart", "piece"), ["image_id", "piece"]).select("image_id", "piece", "line", "offset", F.lit(False).alias("turned"), "loop")
    back = sides_.join(open_.withColumnRenamed("dart", "end").drop("back"), ["image_id", "end"]).select("image_id", "piece", "line", "offset", F.lit(True).alias("turned"), "loop")
    return straight.unionByName(back)


def boundary_lines(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    """(image_id, line, closed, at, y, x): the vertices of each line, numbered from 0 along it.

    Every side between different regions is in exactly one line. A line begins at the smaller of its two ends (rows
    first), one that comes back to its junction at the smaller neighbour; a loop without a junction at its smallest
    corner, to the right. ``line`` is the dart of the first side. The first vertex of a closed line isn't repeated
    at its end. Maps of one region have no lines; pixels must fill their rectangle.
    """
    s = sides(pixels).withColumns({"ty": F.floor(F.col("y") / side), "tx": F.floor(F.col("x") / side)})
    parts = saved(s.groupBy("image_id", "ty", "tx").applyInPandas(lambda key, rows: _pieces(key, rows, side), PIECE))
    pieces = parts.where("at = 0 AND NOT loop").select("image_id", "piece", "n", "end")
    of = saved(_lines_of_pieces(pieces)).withColumnRenamed("loop", "ring")
    placed = parts.join(of, ["image_id", "piece"], "left")
    turned = F.coalesce("turned", F.lit(False))
    at = F.when(F.col("line").isNull(), F.col("at")).when(turned, F.col("offset") + F.col("n") - 1 - F.col("at")).otherwise(F.col("offset") + F.col("at"))
    ends = {"y": F.when(turned, F.col("to_y")).otherwise(F.col("y")), "x": F.when(turned, F.col("to_x")).otherwise(F.col("x")), "to_y": F.when(turned, F.col("y")).otherwise(F.col("to_y")), "to_x": F.when(turned, F.col("x")).otherwise(F.col("to_x"))}
    walked = saved(placed.select("image_id", F.coalesce("line", "piece").alias("line"), F.coalesce("ring", "loop").alias("loop"), at.alias("at"), *(v.alias(k) for k, v in ends.items())))
    loops = walked.where("loop")
    # loops turn clockwise (rows grow downwards) when they leave their smallest corner to the right
    how = loops.groupBy("image_id", "line").agg(F.min_by(F.struct("at", "y", "x"), F.struct("y", "x")).alias("s"), F.count("*").alias("n"), (F.sum(F.col("x") * F.col("to_y") - F.col("to_x") * F.col("y")) > 0).alias("clockwise"))
    rotated = loops.join(how, ["image_id", "line"]).select(
        "image_id", F.expr("((s.y << 31 | s.x) << 2) | 2").alias("line"), F.lit(True).alias("closed"), F.when(F.col("clockwise"), F.pmod(F.col("at") - F.col("s.at"), "n")).otherwise(F.pmod(F.col("s.at") - F.col("at"), "n")).alias("at"), "y", "x"
    )
    rest = walked.where("NOT loop")
    last = rest.groupBy("image_id", "line").agg(F.max_by(F.struct((F.col("at") + 1).alias("at"), F.col("to_y").alias("y"), F.col("to_x").alias("x")), "at").alias("e"))
    last = last.withColumn("closed", F.expr("(e.y << 31 | e.x) = shiftright(line, 2)"))
    opened = rest.join(last.select("image_id", "line", "closed"), ["image_id", "line"]).select("image_id", "line", "closed", "at", "y", "x")
    final = last.where("NOT closed").select("image_id", "line", "closed", "e.at", "e.y", "e.x")
    return opened.unionByName(final).unionByName(rotated)


def simplified(lines: DataFrame, tolerance: float) -> DataFrame:
    """The vertices that lines keep within a tolerance, numbered as before: each stretch is cut at its farthest vertex while that is farther from the chord.

    A closed line is cut first at its vertex 0 and the one farthest from it. Distances are from the chord's straight
    line (from its point, if it has no length); ties go to the earlier vertex. All stretches are cut in one round, so
    rounds are as many as cuts lie within one another.
    """
    key = ["image_id", "line"]
    size = lines.groupBy(*key).agg(F.max("at").alias("n"), F.min_by(F.struct("y", "x"), "at").alias("a"), F.max_by(F.struct("y", "x"), "at").alias("b"), F.first("closed").alias("closed"))
    rows = saved(lines.join(size.drop("closed"), key))
    from_start = F.pow(F.col("y") - F.col("a.y"), 2) + F.pow(F.col("x") - F.col("a.x"), 2)
    far = rows.where("closed").groupBy(*key).agg(F.max_by(F.struct("at", "y", "x"), F.struct(from_start, -F.col("at"))).alias("f"))
    rows = rows.join(far, key, "left")
    beyond = F.col("at") > F.col("f.at")
    lo = F.when(F.col("closed") & beyond, F.col("f")).otherwise(F.struct(F.lit(0).cast("long").alias("at"), F.col("a.y").alias("y"), F.col("a.x").alias("x")))
    hi = F.when(~F.col("closed"), F.struct(F.col("n").alias("at"), F.col("b.y").alias("y"), F.col("b.x").alias("x"))).when(beyond, F.struct((F.col("n") + 1).alias("at"), F.col("a.y").alias("y"), F.col("a.x").alias("x"))).otherwise(F.col("f"))
    shape = ("closed", "at", "y", "x")
    rows = saved(rows.withColumns({"lo": lo, "hi": hi}).select(*key, *shape, "lo", "hi"))
    keep = [rows.where("at = lo.at OR at = hi.at").select(*key, *shape)]
    rows = rows.where("at > lo.at AND at < hi.at")
    dy, dx = F.col("hi.y") - F.col("lo.y"), F.col("hi.x") - F.col("lo.x")
    oy, ox = F.col("y") - F.col("lo.y"), F.col("x") - F.col("lo.x")
    cross, chord = dy * ox - dx * oy, dy * dy + dx * dx
    while True:
        measured = rows.withColumn("off", F.when(chord == 0, oy * oy + ox * ox).otherwise(F.abs(cross))).withColumn("bound", F.when(chord == 0, F.lit(tolerance**2)).otherwise(tolerance * F.sqrt(chord.cast("double"))))
        worst = measured.groupBy(*key, F.col("lo.at").alias("stretch")).agg(F.max_by(F.struct("at", "y", "x"), F.struct("off", -F.col("at"))).alias("w"), F.max("off").alias("off"), F.first("bound").alias("bound"), F.first("closed").alias("closed"))
        cuts = saved(worst.where("off > bound").drop("off", "bound"))
        if cuts.isEmpty():
            out = keep[0]
            for more in keep[1:]:
                out = out.unionByName(more)
            return out
        keep.append(cuts.select(*key, "closed", "w.at", "w.y", "w.x"))
        rows = rows.withColumn("stretch", F.col("lo.at")).join(cuts.drop("closed"), [*key, "stretch"]).where("at <> w.at").drop("stretch")
        after = F.col("at") > F.col("w.at")
        rows = saved(rows.withColumns({"lo": F.when(after, F.col("w")).otherwise(F.col("lo")), "hi": F.when(after, F.col("hi")).otherwise(F.col("w"))}).drop("w"))
