"""Moving region boundaries to the edges of the source: flooding from markers, and moves that keep the topology."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.colour import difference
from brindle.operators import distance, graph, raster, tiles
from brindle.operators.tiles import SIDE, Tile, each_tile

#: From this share of pixels below the lowest marker on, their components are looked for first.
WIDE = 0.25
LAB = ("l", "a", "b")
#: The label of water from beyond what a tile sees, below all others.
NO_NAME = -(1 << 63)
FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
AROUND = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def _flooded(tile: Tile) -> dict[str, np.ndarray]:
    """Floods a tile from what is held and from what its rim has reached so far. changed: the pixel is new and lies beside another tile's pixel that is not held."""
    v, held, label = tile.grid("v", np.inf, float), tile.grid("held", True, bool), tile.grid("label", 0, np.int64)
    level, steps = tile.grid("level", np.inf, float), tile.grid("steps", 0, np.int64)
    before = (label.copy(), level.copy(), steps.copy())
    beside = lambda mask: np.logical_or.reduce([np.roll(mask, d, (0, 1)) for d in FOUR])
    free = tile.own & ~held
    heap = [(level[p], int(steps[p]), int(label[p]), *p) for p in zip(*(x.tolist() for x in np.nonzero((label != 0) & ~free & beside(free))), strict=True)]
    label[free], level[free], steps[free] = 0, np.inf, 0
    open_ = free.copy()
    heapq.heapify(heap)
    while heap:
        c, h, name, y, x = heapq.heappop(heap)
        if free[y, x]:
            if not open_[y, x]:
                continue
            open_[y, x] = False
            level[y, x], steps[y, x], label[y, x] = c, h, name
        for dy, dx in FOUR:
            p = (y + dy, x + dx)
            if 0 <= p[0] < tile.shape[0] and 0 <= p[1] < tile.shape[1] and open_[p]:
                heapq.heappush(heap, (v[p], 0, name, *p) if v[p] > c else (c, h + 1, name, *p))
    changed = (label != before[0]) | (level != before[1]) | (steps != before[2])
    return {"label": label, "level": level, "steps": steps, "changed": changed & beside(tile.here & ~tile.own & ~held)}


def _flooded_once(side: int, rim: int):
    """Floods a tile and ``rim`` pixels around it. Water of no name enters at the outermost ones, as early as any can and before all other at a tie: what it does not reach first is settled, and held from then on."""

    def run(tile: Tile) -> dict[str, np.ndarray]:
        held, w = tile.grid("held", True, bool), tile.shape[1]
        grids = {c: tile.grid(c, d, k) for c, d, k in (("v", np.inf, float), ("level", np.inf, float), ("steps", 0, np.int64), ("label", 0, np.int64))}
        beside = lambda mask: np.logical_or.reduce([np.roll(mask, d, (0, 1)) for d in FOUR])
        free = tile.here & ~held
        seeds = np.flatnonzero((grids["label"] != 0) & held & beside(free))
        (top, left), (bottom, right) = ([t * side + d - at for t, at in zip(tile.place, (tile.y0, tile.x0), strict=True)] for d in (-rim, side + rim - 1))
        ys, xs = np.nonzero(free)
        last = (ys <= top) | (ys >= bottom) | (xs <= left) | (xs >= right)
        entered = (ys * w + xs)[last]
        v, level, steps, label = (g.ravel().tolist() for g in grids.values())
        heap = [(level[p], steps[p], label[p], p) for p in seeds.tolist()] + [(v[p], 0, NO_NAME, p) for p in entered.tolist()]
        for p in np.flatnonzero(free).tolist():
            label[p], level[p], steps[p] = 0, float("inf"), 0
        open_, mine = bytearray(free.tobytes()), free.ravel().tolist()
        around = [dy * w + dx for dy, dx in FOUR]
        heapq.heapify(heap)
        while heap:
            c, h, name, p = heapq.heappop(heap)
            if mine[p]:
                if not open_[p]:
                    continue
                open_[p] = 0
                level[p], steps[p], label[p] = c, h, name
            for o in around:
                q = p + o
                if open_[q]:
                    heapq.heappush(heap, (v[q], 0, name, q) if v[q] > c else (c, h + 1, name, q))
        named = np.array(label, np.int64).reshape(tile.shape)
        known = named != NO_NAME
        return {"held": known, "label": np.where(known, named, 0), "level": np.where(known, np.array(level).reshape(tile.shape), np.inf), "steps": np.where(known, np.array(steps, np.int64).reshape(tile.shape), 0), "changed": np.zeros(tile.shape, bool)}

    return run


def _lowest_level(pixels: DataFrame) -> DataFrame:
    """pixels with label and level where the lowest level of an image's markers gives them: (..., name, lowest).

    Pixels up to that level that are connected with a marker at it are taken at it, and by that marker if it is the only
    one there. This takes any distance in one step; else name is null.
    """
    low = graph.saved(pixels.groupBy("image_id").agg(F.min(F.when(F.col("marker") != 0, F.col("v"))).alias("lowest")))
    under = pixels.join(F.broadcast(low), "image_id").withColumn("under", F.coalesce(F.col("v") <= F.col("lowest"), F.lit(False)))  # a row for each image
    share = under.agg(F.avg(F.col("under").cast("int")).alias("s")).first().s
    if not share or share < WIDE:
        return pixels.withColumns({"name": F.lit(None).cast("long"), "lowest": F.lit(None).cast("double")})
    parts = graph.saved(graph.pixel_components(under.withColumn("region_id", F.col("under").cast("long"))))
    marked = parts.where("under AND marker <> 0").groupBy("image_id", "component").agg(F.min("marker").alias("name"), F.max("marker").alias("most"))
    one = graph.saved(marked.where("name = most").select("image_id", "component", "name", F.lit(1).cast("long").alias("region_id")))
    return parts.join(one, ["image_id", "component", "region_id"], "left").select(*pixels.columns, "name", "lowest")


def flooded(pixels: DataFrame, side: int = SIDE, rim: int | None = None) -> DataFrame:
    """pixels(image_id, y, x, v, marker) with label: the marker that a flood over v brings to each pixel first.

    Water rises from all markers (marker 0: none) at once. A pixel is taken at the lowest level that reaches it, the
    largest v on the way; at one level after the fewest steps since that level was reached, then by the smaller
    marker. Labels spread over the four neighbours. What the lowest level of an image's markers takes is known from
    components, where that is much of the raster. Tiles flood the rest by what they see ``rim`` pixels around them (a
    quarter of a side of 64 or more, else none). What may depend on more is flooded by rounds, in which those tiles run
    again whose rims have changed; the result is that of one flood over the whole image. Pixels that no marker reaches
    have label 0.
    """
    schema = "image_id string, y long, x long, v double, marker long, held boolean, label long, level double, steps long, changed boolean"
    first = pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"), F.col("marker").cast("long").alias("marker"))
    taken = F.col("marker") != 0
    level = F.when(taken, F.col("v")).otherwise(F.coalesce("lowest", F.lit(float("inf"))))
    known = _lowest_level(first).select(*first.columns, (taken | F.col("name").isNotNull()).alias("held"), F.when(taken, F.col("marker")).otherwise(F.coalesce("name", F.lit(0))).alias("label"), F.when(taken | F.col("name").isNotNull(), level).otherwise(F.lit(float("inf"))).alias("level"), F.lit(0).cast("long").alias("steps"))
    rim = (side // 4 if side >= 64 else 0) if rim is None else rim
    if rim:
        known = graph.saved(each_tile(known.withColumn("changed", F.lit(False)), side, schema, _flooded_once(side, rim), rim=rim))
        if known.where("NOT held").isEmpty():
            return known.select("image_id", "y", "x", "v", "marker", "label")
    base = graph.saved(each_tile(known, side, schema, _flooded))
    later, new = None, base
    while True:
        only = graph.saved(tiles.dealt(new.where("changed"), side).where("NOT own").select("image_id", "ty", "tx").distinct())
        if only.isEmpty():
            return tiles.overlaid(base, later, side).select("image_id", "y", "x", "v", "marker", "label")
        new = graph.saved(each_tile(tiles.overlaid(base, later, side), side, schema, _flooded, only=only))
        later = new if later is None else graph.saved(tiles.overlaid(later, new, side))


def _parts(cells: list[tuple[int, int]], diagonal: bool) -> list[set[tuple[int, int]]]:
    left, out = set(cells), []
    while left:
        group, new = set(), [left.pop()]
        while new:
            y, x = new.pop()
            group.add((y, x))
            near = {(y + dy, x + dx) for dy, dx in (AROUND if diagonal else FOUR)} & left
            left -= near
            new += near
        out.append(group)
    return out


def _simple() -> np.ndarray:
    """For each pattern of the eight neighbours that belong to a region (bits in the order of AROUND): whether the
    centre can join or leave it without changing the number of the region's 4-connected parts or of its holes."""
    out = np.zeros(256, bool)
    for pattern in range(256):
        inside = [c for i, c in enumerate(AROUND) if pattern >> i & 1]
        outside = [c for c in AROUND if c not in inside]
        touching = [p for p in _parts(inside, False) if p & set(FOUR)]
        out[pattern] = len(touching) == 1 and len(_parts(outside, True)) == 1
    return out


def _moved(backwards: bool):
    simple = _simple()

    def run(tile: Tile) -> dict[str, np.ndarray]:
        label, target, open_ = tile.grid("region_id", 0, np.int64), tile.grid("target", 0, np.int64), tile.grid("open", False, bool)
        benefit = tile.grid("benefit", 0.0, float)
        pairs = set(zip(tile.others.lo.tolist(), tile.others.hi.tolist(), strict=True))
        ys, xs = np.nonzero(open_)
        order = np.lexsort((xs, ys, -benefit[ys, xs]))
        waits, moves = np.zeros(tile.shape, bool), np.zeros(tile.shape, bool)
        for y, x in zip(*(z[order[::-1] if backwards else order].tolist() for z in (ys, xs)), strict=True):
            if not tile.own[y, x] or waits[y - 1 : y + 2, x - 1 : x + 2].any():
                waits[y, x] = True
                continue
            here, to = label[y, x], target[y, x]
            sides = {int(label[y + dy, x + dx]) for dy, dx in FOUR} - {0, int(to)}
            if all((min(to, s), max(to, s)) in pairs for s in sides):
                near = [label[y + dy, x + dx] for dy, dx in AROUND]
                if simple[sum((n == here) << i for i, n in enumerate(near))] and simple[sum((n == to) << i for i, n in enumerate(near))]:
                    label[y, x] = to
                    moves[y, x] = True
        wide = lambda mask: np.logical_or.reduce([mask, *(np.roll(mask, d, (0, 1)) for d in AROUND)])
        again = tile.grid("again", False, bool) | wide(open_ & (label != target))
        return {"region_id": label, "open": waits, "moves": moves, "near": wide(waits), "again": again}

    return run


def _all_passes(passes: int, side: int, rim: int):
    """All passes over a tile and ``rim`` pixels around it. settled: the pixel's label depends on nothing beyond that."""
    simple = _simple().tolist()

    def run(tile: Tile) -> dict[str, np.ndarray]:
        pairs = set(zip(tile.others.lo.tolist(), tile.others.hi.tolist(), strict=True))
        open_, benefit, w = tile.grid("open", False, bool), tile.grid("benefit", 0.0, float), tile.shape[1]
        label, target = (tile.grid(c, 0, np.int64).ravel().tolist() for c in ("region_id", "target"))
        ys, xs = np.nonzero(open_)
        low, high = ([t * side - rim - at for t, at in zip(tile.place, (tile.y0, tile.x0), strict=True)], [(t + 1) * side + rim - 1 - at for t, at in zip(tile.place, (tile.y0, tile.x0), strict=True)])
        last = (ys <= low[0]) | (ys >= high[0]) | (xs <= low[1]) | (xs >= high[1])  # what lies around them is not seen
        unknown, touched = np.zeros(tile.shape, bool), bytearray(open_.tobytes())
        unknown[ys[last], xs[last]] = True
        unknown = bytearray(unknown.tobytes())
        order = np.lexsort((xs, ys, -benefit[ys, xs]))
        order = (ys * w + xs)[order].tolist()
        around, four = [dy * w + dx for dy, dx in AROUND], [dy * w + dx for dy, dx in FOUR]
        bits = [(o, 1 << i) for i, o in enumerate(around)]
        for turn in range(passes):
            # a pixel is tried again only if one around it has moved since; the rest would stay as they are
            order = [p for p in order if label[p] != target[p] and not unknown[p]]
            if not any(touched[p] for p in order):
                break
            for p in order if turn % 2 == 0 else reversed(order):
                if not touched[p]:
                    continue
                touched[p] = 0
                if any(unknown[p + o] for o in around):
                    unknown[p] = 1
                else:
                    here, to = label[p], target[p]
                    mine = theirs = 0
                    for o, bit in bits:
                        n = label[p + o]
                        if n == here:
                            mine += bit
                        elif n == to:
                            theirs += bit
                    if not (simple[mine] and simple[theirs]) or any((to, s) not in pairs and (s, to) not in pairs for s in {label[p + o] for o in four} - {0, to}):
                        continue
                    label[p] = to
                for o in around:
                    touched[p + o] = 1
        return {"region_id": np.array(label, np.int64).reshape(tile.shape), "settled": np.frombuffer(unknown, bool).reshape(tile.shape) == 0}

    return run


def safe_moves(pixels: DataFrame, pairs: DataFrame, passes: int = 8, side: int = SIDE, frozen: DataFrame | None = None, rim: int | None = None) -> DataFrame:
    """Gives pixels their target region one by one where that keeps every region's parts and holes and makes no new neighbours.

    pixels(image_id, y, x, region_id, target, benefit), target null or equal to region_id where nothing is to
    move; pairs(image_id, lo, hi): regions that may touch; frozen(image_id, region_id): regions that neither lose nor
    get pixels, beside which others still move. Moves are tried in the order of -benefit, y, x, and in
    the opposite order every second pass, until a pass moves nothing. The result is that of one pass after another over
    the whole image. A tile takes all passes at once over its pixels and ``rim`` around them (a quarter of a side of 64
    or more, else none), and knows which of its pixels depend on more than it sees; tiles with such pixels run again
    with a rim as wide as the side. Images where that is not enough go by rounds, and so do all without a rim.
    """
    state = pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("region_id").cast("long").alias("region_id"), F.coalesce("target", "region_id").cast("long").alias("target"), F.coalesce("benefit", F.lit(0.0)).cast("double").alias("benefit"))
    known = graph.saved(pairs.select("image_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")))

    def met(some: DataFrame, rim: int = 1) -> DataFrame:
        """The pairs whose regions both occur in a tile of these pixels."""
        present = tiles.dealt(some, side, rim).select("image_id", "ty", "tx", F.explode(F.array("region_id", "target")).alias("r")).distinct()
        ends = lambda s: present.withColumnRenamed("r", s)
        return graph.saved(known.join(ends("lo"), ["image_id", "lo"]).join(ends("hi"), ["image_id", "ty", "tx", "hi"]))

    allowed = known
    if frozen is not None:
        for end in ("lo", "hi"):
            allowed = allowed.join(frozen.select("image_id", F.col("region_id").alias(end)).distinct(), ["image_id", end], "left_anti")
    allowed = graph.saved(allowed).select("image_id", F.col("lo").alias("one"), F.col("hi").alias("two"), F.lit(True).alias("may"))
    columns = state.columns

    def opened(some: DataFrame) -> DataFrame:
        """open: the pixel asks for another region and may get it."""
        asks = some.where("region_id <> target").withColumns({"one": F.least("region_id", "target"), "two": F.greatest("region_id", "target")})
        can = asks.join(allowed, ["image_id", "one", "two"], "left").select(*columns, F.col("may").isNotNull().alias("open"))
        return can.unionByName(some.where("region_id = target").withColumn("open", F.lit(False)))

    rim = (side // 4 if side >= 64 else 0) if rim is None else rim
    if not rim:
        return _rounds(state, opened, met, passes, side)
    first, only, all_ = graph.saved(opened(state)), None, "image_id string, y long, x long, region_id long, target long, benefit double, settled boolean"
    done = None
    while True:
        found = graph.saved(each_tile(first, side, all_, _all_passes(passes, side, rim), met(first if only is None else _seen(first, only, side), rim), only=only, rim=rim))
        done = found if done is None else tiles.overlaid(done, found, side)
        only = graph.saved(tiles.placed(found.where("NOT settled"), side).select("image_id", "ty", "tx").distinct())
        if only.isEmpty():
            return done.select(*columns)
        if rim == side:
            break
        rim = side
    left = only.select("image_id").distinct()
    rest = _rounds(first.join(left, "image_id", "left_semi").select(*columns), opened, met, passes, side)
    return done.join(left, "image_id", "left_anti").select(*columns).unionByName(rest)


def _seen(pixels: DataFrame, only: DataFrame, side: int) -> DataFrame:
    """The pixels of these tiles and of the eight around each."""
    return tiles.placed(pixels, side).join(tiles.around(only), ["image_id", "ty", "tx"], "left_semi").drop("ty", "tx")


def _rounds(state: DataFrame, opened, met, passes: int, side: int) -> DataFrame:
    """Pass after pass, each in rounds. Within a pass a pixel depends on its eight neighbours only: a tile settles its
    pixels in order, those next to a pixel that waits wait for the next round, which has only what waits and the pixels
    around it (near). Later passes have only the pixels that have not moved yet and those around them (again)."""
    schema = "image_id string, y long, x long, region_id long, target long, benefit double, open boolean, moves boolean, near boolean, again boolean"
    columns, over, rest = state.columns, None, state
    by_tile = met(state)
    for turn in range(passes):
        rest = opened(rest).withColumn("again", F.lit(False))
        pairs_met, settled, any_moves = by_tile, None, False
        while True:
            done = graph.saved(each_tile(rest, side, schema, _moved(turn % 2 == 1), pairs_met))
            left = done.agg(F.max("open").alias("open"), F.max("moves").alias("moves")).first()
            any_moves |= bool(left.moves)
            if not left.open:
                break
            rest, kept = done.where("near"), done.where("NOT near")
            settled, pairs_met = (kept, met(rest)) if settled is None else (settled.unionByName(kept), pairs_met)
        state = done if settled is None else settled.unionByName(done)
        if not any_moves or turn == passes - 1:
            break
        kept, rest = state.where("NOT again").select(*columns), graph.saved(state.where("again").select(*columns))
        over, by_tile = kept if over is None else over.unionByName(kept), met(rest)
    state = state.select(*columns)
    return state if over is None else over.unionByName(state)


def projected(pixels: DataFrame, pairs: DataFrame, centres: DataFrame, frozen: DataFrame | None = None, side: int = SIDE) -> DataFrame:
    """(image_id, y, x, region_id, target) after the safe moves of a proposal: pixels(..., region_id, target, l, a, b).

    A pixel's benefit is how much nearer (CIEDE2000) its colour is to the target's centre than to that of its own region;
    centres(image_id, region_id, l_m, a_m, b_m).
    """
    to = centres.select("image_id", F.col("region_id").alias("target"), *(F.col(f"{c}_m").alias(f"{c}_t") for c in LAB))
    wanted = pixels.where("target <> region_id").join(centres, ["image_id", "region_id"], "left").join(to, ["image_id", "target"], "left")
    gain = difference(*(F.col(c) for c in LAB), *(F.col(f"{c}_m") for c in LAB)) - difference(*(F.col(c) for c in LAB), *(F.col(f"{c}_t") for c in LAB))
    stay = pixels.where("NOT coalesce(target <> region_id, false)").withColumn("benefit", F.lit(None).cast("double"))
    return safe_moves(wanted.select(*pixels.columns, gain.alias("benefit")).unionByName(stay), pairs, side=side, frozen=frozen).select("image_id", "y", "x", "region_id", "target")


def medians_of(pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, l_m, a_m, b_m): the colours that regions are painted with."""
    return pixels.groupBy("image_id", "region_id").agg(*(F.median(c).alias(f"{c}_m") for c in LAB))


def proposal(pixels: DataFrame, strength: str, radius: float, frozen: DataFrame | None = None, side: int = SIDE) -> DataFrame:
    """pixels with target: the region that a flood over the edge strength gives each pixel within ``radius`` of a boundary.

    The contact with the strongest edge of each pair of regions stays, and so do regions of frozen(image_id,
    region_id). A region that would lose all its pixels keeps the one deepest inside.
    """
    p = graph.saved(distance.squared_within(raster.boundary_mask(pixels), F.col("edge"), "far", radius).drop("edge"))
    a = raster.strongest_anchor(pixels, strength)
    held = a.select("image_id", F.explode(F.array(F.struct("y", "x"), F.when(F.col("axis") == "right", F.struct("y", (F.col("x") + 1).alias("x"))).otherwise(F.struct((F.col("y") + 1).alias("y"), "x")))).alias("p")).select("image_id", "p.y", "p.x", F.lit(True).alias("held")).distinct()
    p = p.join(held, ["image_id", "y", "x"], "left")
    if frozen is not None:
        p = p.join(frozen.select("image_id", "region_id", F.lit(True).alias("frozen")).distinct(), ["image_id", "region_id"], "left")
    else:
        p = p.withColumn("frozen", F.lit(None).cast("boolean"))
    free = (F.col("far") <= radius * radius) & F.col("held").isNull() & F.col("frozen").isNull()
    p = graph.saved(p.withColumn("marker", F.when(free, F.lit(0)).otherwise(F.col("region_id"))))
    lost = p.groupBy("image_id", "region_id").agg(F.max("marker").alias("m"), F.min_by(F.struct("y", "x"), F.struct(-F.col("far"), "y", "x")).alias("p")).where("m = 0")
    kept = lost.select("image_id", "p.y", "p.x", F.col("region_id").alias("only"))
    p = p.join(kept, ["image_id", "y", "x"], "left").withColumn("marker", F.coalesce("only", "marker")).drop("only", "far", "held", "frozen")
    found = flooded(p.select("image_id", "y", "x", F.col(strength).alias("v"), "marker"), side)
    return pixels.join(found.select("image_id", "y", "x", F.col("label").alias("target")), ["image_id", "y", "x"])


def _shape(pixels: DataFrame, strength: str, centres: DataFrame) -> dict[str, float]:
    """Measures of a region map: mean edge strength on boundaries, mean difference to the regions' colours."""
    p = raster.boundary_mask(pixels).join(centres, ["image_id", "region_id"])
    error = difference(*(F.col(c) for c in LAB), *(F.col(f"{c}_m") for c in LAB))
    r = p.agg(F.avg(F.when(F.col("edge"), F.col(strength))).alias("support"), F.avg(error).alias("error")).first()
    return {"support": r.support or 0.0, "error": r.error or 0.0}


def same_topology(before: DataFrame, after: DataFrame) -> bool:
    """Whether two region maps have the same regions, neighbours, parts of each region, and holes."""

    def facts(p: DataFrame) -> DataFrame:
        parts = graph.pixel_components(p.select("image_id", "y", "x", "region_id")).groupBy("image_id", F.col("region_id").alias("a")).agg(F.countDistinct("component").alias("n"))
        pairs = raster.shared_boundary(p).select("image_id", F.col("lo").alias("a"), F.col("hi").alias("b"), F.lit(0).cast("long").alias("n"))
        gaps = graph.holes(p.select("image_id", "y", "x", "region_id")).select("image_id", F.col("region_id").alias("a"), F.lit(-2).cast("long").alias("b"), F.col("holes").alias("n"))
        return parts.select("image_id", "a", F.lit(-1).cast("long").alias("b"), "n").unionByName(pairs).unionByName(gaps)

    one, two = graph.saved(facts(before)), graph.saved(facts(after))
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def aligned(pixels: DataFrame, strength: str, most: int, frozen: DataFrame | None = None, floor_ok=None, side: int = SIDE) -> tuple[DataFrame, list[dict[str, object]]]:
    """The region map moved to the source's edges by the best radius of 1 .. most, and what was found for each radius.

    pixels(image_id, y, x, region_id, l, a, b, strength), one image or several that move by one radius. A radius is accepted
    if the topology is the same, floor_ok(candidate) holds, the edges' support does not fall, the colour
    difference to the regions' medians does not rise by more than 0.05, and, where the flood asks for moves, some
    can be made. The largest support wins, then the smallest difference, then the fewest moves. If no radius is
    accepted the map stays as it is.
    """
    pixels = graph.saved(pixels)
    pairs = graph.saved(raster.shared_boundary(pixels).select("image_id", "lo", "hi"))
    centres = graph.saved(medians_of(pixels))
    base = _shape(pixels, strength, centres)
    log, accepted = [], []
    rest = [c for c in pixels.columns if c != "region_id"]
    for radius in range(most, 0, -1):
        p = graph.saved(proposal(pixels, strength, radius, frozen, side))
        moved = projected(p, pairs, centres, frozen, side).select("image_id", "y", "x", F.col("region_id").alias("to"))
        candidate = graph.saved(p.join(moved, ["image_id", "y", "x"]).withColumn("from", F.col("region_id")).withColumn("region_id", F.col("to")).drop("to"))
        counts = candidate.agg(F.count(F.when(F.col("region_id") != F.col("from"), 1)).alias("moved"), F.count(F.when(F.col("target") != F.col("from"), 1)).alias("asked")).first()
        shape, reasons = _shape(candidate, strength, centres), []
        if counts.moved and not same_topology(pixels, candidate):
            reasons.append("topology_changed")
        if floor_ok is not None and not floor_ok(candidate):
            reasons.append("printer_floor_violated")
        if shape["support"] + 1e-9 < base["support"]:
            reasons.append("source_edge_support_decreased")
        if shape["error"] > base["error"] + 0.05 + 1e-9:
            reasons.append("geometry_reconstruction_worsened")
        if counts.asked and not counts.moved:
            reasons.append("no_safe_beneficial_movement")
        log.append({"radius": radius, "changed": counts.moved, "support": shape["support"], "error": shape["error"], "reasons": reasons})
        if not reasons:
            accepted.append(((shape["support"], -shape["error"], -counts.moved), candidate.select(*rest, "region_id")))
    best = max(accepted, key=lambda x: x[0])[1] if accepted else pixels
    return best, log
