"""Segmentation of rasters by the local graph criterion, in tiles and rounds.

Pixels are nodes, contacts of the eight neighbours are edges with the distance of the two colours as weight. Taken
by ascending weight, an edge joins two components if it is below internal + scale / size of both, internal
being the largest weight inside a component. The order matters, but only locally: what an edge does is settled as
soon as all lower edges of its two components are. So

* a component whose lowest open edge is not below its own bound is final, and all its edges are settled;
* the lowest open edge of two components that are not final joins them.

A tile settles all it can by its own edges; a component waits once its lowest open edge leaves the tile, and so does
what touches a waiting one. What is left is a smaller graph, dealt in tiles of twice the side. Where that would
make tiles too large, a round over the whole graph joins what is lowest at both ends. Results are the same as
those of one sorted pass over all edges, whatever the tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import graph, raster

SIDE = 256
#: Open edges of a tile, on average, that are settled in one task.
OPEN = 1_000_000

SETTLED = "image_id string, kind int, a long, b long, w double, tie long, copies int, size long"
JOINED, WAITING, EDGE = range(3)


def node_at(y: Column, x: Column) -> Column:
    return F.shiftleft(y.cast("long"), 32) + x


def contacts(pixels: DataFrame, channels: list[str], *extra: str) -> DataFrame:
    """(image_id, a, b, w, tie) of all pairs of the eight neighbours, extra columns of both ends as x_a, x_b; pixels must fill the raster."""
    here = F.struct("x", *channels, *extra)
    row, column = raster.along_row(), raster.along_column()
    pixels = pixels.select("image_id", "y", "x", *channels, *extra)
    sides = pixels.select("image_id", "y", "x", here.alias("c"), F.lag(here).over(row).alias("left"), F.lead(here).over(row).alias("right"))
    below = F.lead(F.struct("left", "c", "right")).over(column)
    ways = F.array(F.struct(F.col("right").alias("o"), F.lit(0).alias("dy")), *(F.struct(F.col(f"below.{c}").alias("o"), F.lit(1).alias("dy")) for c in ("left", "c", "right")))
    each = sides.withColumn("below", below).select("image_id", "y", "x", "c", F.posexplode(ways).alias("way", "n")).where("n.o IS NOT NULL")
    square = sum(((F.col(f"c.{c}") - F.col(f"n.o.{c}")).cast("double") ** 2 for c in channels), F.lit(0.0))
    a = node_at(F.col("y"), F.col("x"))
    ends = [F.col(f"{side}.{c}").alias(f"{c}_{name}") for c in extra for side, name in (("c", "a"), ("n.o", "b"))]
    return each.select("image_id", a.alias("a"), node_at(F.col("y") + F.col("n.dy"), F.col("n.o.x")).alias("b"), F.sqrt(square).alias("w"), (4 * a + F.col("way")).alias("tie"), *ends)


def _tile(node: str, side: int) -> Column:
    return F.struct(F.expr(f"shiftright({node}, 32) div {side}").alias("ty"), F.expr(f"({node} & 4294967295) div {side}").alias("tx"))


def settle(edges: pd.DataFrame, states: dict[int, tuple[int, float]], inside: np.ndarray, scale: float) -> tuple[dict[int, int], dict[int, tuple[int, float]], np.ndarray]:
    """Edges of one tile by ascending weight: what joins (component: joined into), what waits (component: size, internal), and which edges stay open.

    inside: two columns, whether an edge's ends lie in the tile. Components without a state are single pixels.
    """
    names, at = np.unique(edges[["a", "b"]].to_numpy(), return_inverse=True)
    order = np.lexsort((edges.tie, edges.w))
    ends = at.reshape(-1, 2)
    known = [states.get(x, (1, 0.0)) for x in names.tolist()]
    size, internal = [k[0] for k in known], [k[1] for k in known]
    up, waits, left = list(range(len(names))), [False] * len(names), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for e, a, b, w, own_a, own_b in zip(order.tolist(), *(ends[order, i].tolist() for i in (0, 1)), edges.w.to_numpy()[order].tolist(), *(inside[order, i].tolist() for i in (0, 1)), strict=True):
        a, b = root(a), root(b)
        if a == b:
            continue
        if (own_a and not waits[a] and w >= internal[a] + scale / size[a]) or (own_b and not waits[b] and w >= internal[b] + scale / size[b]):
            continue  # one of both is final
        if own_a and own_b and not waits[a] and not waits[b]:
            up[b] = a
            size[a] += size[b]
            internal[a] = w
        else:
            waits[a] = waits[b] = True
            left.append(e)
    names = names.tolist()
    own = np.unique(ends[inside]).tolist()
    joined = {names[i]: names[root(i)] for i in own if root(i) != i}
    waiting = {names[i]: (size[i], internal[i]) for i in own if up[i] == i and waits[i]}
    return joined, waiting, np.array(left, np.int64)


def _settled(side: int, scale: float):
    def run(key: tuple, edges: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        image, ty, tx = key
        known = dict(zip(states.node.tolist(), zip(states["size"].tolist(), states.internal.tolist(), strict=True), strict=True))
        ends = edges[["a", "b"]].to_numpy()
        inside = ((ends >> 32) // side == ty) & ((ends & 0xFFFFFFFF) // side == tx)
        joined, waiting, left = settle(edges, known, inside, scale)
        some = edges.iloc[left]
        parts = [
            pd.DataFrame({"kind": JOINED, "a": list(joined), "b": list(joined.values()), "w": 0.0, "tie": 0, "copies": 0, "size": 0}),
            pd.DataFrame({"kind": WAITING, "a": list(waiting), "b": 0, "w": [x[1] for x in waiting.values()], "tie": 0, "copies": 0, "size": [x[0] for x in waiting.values()]}),
            pd.DataFrame({"kind": EDGE, "a": some.a, "b": some.b, "w": some.w, "tie": some.tie, "copies": some.copies, "size": 0}),
        ]
        out = pd.concat([x for x in parts if len(x)] or parts[:1])
        out.insert(0, "image_id", image)
        return out

    return run


def lowest_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair of components, the lowest."""
    low = F.min(F.struct("w", "tie")).alias("e")
    return edges.where("a <> b").groupBy("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(low).select("image_id", "a", "b", "e.w", "e.tie")


def moved(edges: DataFrame, joined: DataFrame) -> DataFrame:
    """Edges between the components that joined(image_id, node, to) has left."""
    for s in ("a", "b"):
        edges = edges.join(joined.select("image_id", F.col("node").alias(s), "to"), ["image_id", s], "left").withColumn(s, F.coalesce("to", s)).drop("to")
    return lowest_edges(edges)


def tile_round(edges: DataFrame, states: DataFrame, side: int, scale: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, states, joined) after each tile has settled what it can."""
    tiles = F.array_distinct(F.array(_tile("a", side), _tile("b", side)))
    dealt = edges.withColumn("tiles", tiles).select("image_id", "a", "b", "w", "tie", F.size("tiles").alias("copies"), F.explode("tiles").alias("t")).select("*", "t.ty", "t.tx").drop("t")
    held = states.withColumn("t", _tile("node", side)).select("image_id", "node", "size", "internal", "t.ty", "t.tx")
    out = graph.saved(dealt.groupBy("image_id", "ty", "tx").cogroup(held.groupBy("image_id", "ty", "tx")).applyInPandas(_settled(side, scale), SETTLED))
    joined = out.where(f"kind = {JOINED}").select("image_id", F.col("a").alias("node"), F.col("b").alias("to"))
    agreed = out.where(f"kind = {EDGE}").groupBy("image_id", "tie").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("w").alias("w"), F.first("copies").alias("copies"), F.count("*").alias("n"))
    left = graph.saved(moved(agreed.where("n = copies").select("image_id", "a", "b", "w", "tie"), joined))
    return left, out.where(f"kind = {WAITING}").select("image_id", F.col("a").alias("node"), "size", F.col("w").alias("internal")), joined


def whole_round(edges: DataFrame, states: DataFrame, scale: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, states, joined) after one round over the whole graph: final components leave, and what is lowest at both ends joins."""
    ends = edges.select("image_id", F.explode(F.array("a", "b")).alias("node"), F.struct("w", "tie").alias("e"))
    low = ends.groupBy("image_id", "node").agg(F.min("e").alias("e")).join(states, ["image_id", "node"], "left").fillna({"size": 1, "internal": 0.0})
    low = graph.saved(low.withColumn("final", F.col("e.w") >= F.col("internal") + F.lit(scale) / F.col("size")))
    for s in ("a", "b"):
        edges = edges.join(low.select("image_id", F.col("node").alias(s), F.col("e.tie").alias(f"low_{s}"), F.col("final").alias(f"final_{s}"), F.col("size").alias(f"size_{s}")), ["image_id", s])
    edges = graph.saved(edges.where("NOT final_a AND NOT final_b"))
    pairs = edges.where("tie = low_a AND tie = low_b")
    joined = pairs.select("image_id", F.col("b").alias("node"), F.col("a").alias("to"))
    grown = pairs.select("image_id", F.col("a").alias("node"), (F.col("size_a") + F.col("size_b")).alias("size"), F.col("w").alias("internal"))
    rest = low.where("NOT final").select("image_id", "node", "size", "internal").join(pairs.select("image_id", F.explode(F.array("a", "b")).alias("node")), ["image_id", "node"], "left_anti")
    return graph.saved(moved(edges.select("image_id", "a", "b", "w", "tie"), joined)), graph.saved(grown.unionByName(rest)), graph.saved(joined)


def composed(steps: list[DataFrame]) -> DataFrame:
    """(image_id, node, to) over all steps; each step's components are few against those of the step before."""
    total = steps[-1]
    for step in reversed(steps[:-1]):
        later = total.select("image_id", F.col("node").alias("to"), F.col("to").alias("last"))
        first = step.join(later, ["image_id", "to"], "left").select("image_id", "node", F.coalesce("last", "to").alias("to"))
        total = graph.saved(first.unionByName(total))
    return total


def criterion_components(pixels: DataFrame, channels: list[str], scale: float, side: int = SIDE, most_open: int = OPEN) -> DataFrame:
    """pixels with root, the component that the criterion gives each pixel."""
    edges = contacts(pixels, channels)
    states = edges.sparkSession.createDataFrame([], "image_id string, node long, size long, internal double")
    steps: list[DataFrame] = []
    while True:
        n_tiles = 0
        if steps:
            n_open = edges.count()
            if not n_open:
                break
            n_tiles = edges.select("image_id", _tile("a", 2 * side)).distinct().count()
        if not steps or n_open <= n_tiles * most_open:
            side = 2 * side if steps else side
            edges, states, joined = tile_round(edges, states, side, scale)
        else:
            edges, states, joined = whole_round(edges, states, scale)
        steps.append(joined)
    root = composed(steps).select("image_id", "node", F.col("to").alias("root"))
    return pixels.withColumn("node", node_at(F.col("y"), F.col("x"))).join(root, ["image_id", "node"], "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def join_small(pixels: DataFrame, channels: list[str], least: int) -> DataFrame:
    """Components below ``least`` pixels join over their lowest edge, round by round until none with a neighbour is left.

    A small component stays as it is until its lowest edge, which joins it in any case: so all of them join at once,
    with the same result as one by one.
    """
    pairs = graph.saved(lowest_edges(contacts(pixels, channels, "root").select("image_id", F.col("root_a").alias("a"), F.col("root_b").alias("b"), "w", "tie")))
    sizes = graph.saved(pixels.groupBy("image_id", F.col("root").alias("node")).agg(F.count("*").alias("size")))
    steps = []
    while True:
        small = sizes.where(F.col("size") < least).select("image_id", "node")
        ends = pairs.select("image_id", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("d"), "w", "tie").select("image_id", "d.node", "d.to", "w", "tie")
        picks = graph.saved(ends.join(small, ["image_id", "node"]).groupBy("image_id", "node").agg(F.min_by("to", F.struct("w", "tie")).alias("to")))
        if picks.isEmpty():
            break
        links = picks.select(F.struct("image_id", "node").alias("a"), F.struct("image_id", F.col("to").alias("node")).alias("b"))
        nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
        joined = graph.saved(graph.smallest_reachable(nodes, links).select("node.*", F.col("root.node").alias("to")).where("node <> to"))
        pairs = graph.saved(moved(pairs, joined))
        sizes = graph.saved(sizes.join(joined, ["image_id", "node"], "left").groupBy("image_id", F.coalesce("to", "node").alias("node")).agg(F.sum("size").alias("size")))
        steps.append(joined)
    if not steps:
        return pixels
    last = composed(steps).select("image_id", F.col("node").alias("root"), "to")
    return pixels.join(last, ["image_id", "root"], "left").withColumn("root", F.coalesce("to", "root")).drop("to")


def segments(pixels: DataFrame, channels: list[str], scale: float = 400.0, least: int = 1, side: int = SIDE, most_open: int = OPEN) -> DataFrame:
    """pixels(image_id, y, x, channels) with region_id: 1, 2, ... in each image by first pixel, every region 4-connected.

    The criterion over eight neighbours first, then components below ``least`` pixels join over their lowest edge, and
    what only touches at a corner is parted. Edges of equal weight go by pixel (row, then column) and direction:
    right, below left, below, below right.
    """
    found = graph.saved(criterion_components(pixels, channels, scale, side, most_open))
    merged = graph.saved(join_small(found, channels, least)) if least > 1 else found
    parts = graph.saved(graph.pixel_components(merged.withColumn("region_id", F.col("root"))))
    labels = raster.compact_labels(parts.select("image_id", (F.col("component") + 1).alias("region_id")))
    named = labels.select("image_id", (F.col("region_id") - 1).alias("component"), F.col("label").alias("number"))
    return parts.join(named, ["image_id", "component"]).withColumn("region_id", F.col("number")).drop("number", "component", "root")
