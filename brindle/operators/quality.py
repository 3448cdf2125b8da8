"""Superpixels and an estimate of how well an image can be painted: colour loss, small parts, number of regions.

Pixels are (image_id, y, x, l, a, b), images are rectangles without gaps. Per image, only rows of superpixels and
of palette entries are gathered into arrays, nine and at most the size of the palette.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.colour import difference
from brindle.operators import distance, graph, quantiles, raster

# What the report warns of, and the least area and width of a part that can be painted and labelled.
MEAN_LOSS, P90_LOSS, MICRO_PERCENT, REGIONS = 6.0, 12.0, 3.0, 1155
LEAST_MM2, LEAST_WIDTH_MM, LEAST_POCKET_MM = 12.0, 1.5, 4.0
COMPACTNESS = 10.0
PLACE = ("image_id", "cy", "cx")
FEATURES = ("l", "a", "b", "y", "x")
#: Side of the largest block of a cell's pixels: one row of a table.
BLOCK = 64


def cells(pixels: DataFrame, wanted: int) -> DataFrame:
    """pixels with the side of a cell (step) so that an image has about ``wanted``, and their cell (cy, cx)."""
    sizes = pixels.groupBy("image_id").agg(F.sqrt((F.max("y") + 1) * (F.max("x") + 1) / F.lit(float(wanted))).alias("step"))
    placed = pixels.join(sizes.withColumn("step", F.greatest("step", F.lit(1.0))), "image_id")
    return placed.withColumns({"cy": F.floor(F.col("y") / F.col("step")), "cx": F.floor(F.col("x") / F.col("step"))})


def first_centres(placed: DataFrame) -> DataFrame:
    """The mean of each cell; spread, the largest squared colour distance met so far, starts at the compactness."""
    return placed.groupBy(*PLACE).agg(*(F.avg(c).alias(c) for c in FEATURES), F.lit(COMPACTNESS**2).alias("spread"))


def blocks(placed: DataFrame) -> DataFrame:
    """placed in blocks of one cell, BLOCK x BLOCK pixels at most: (image_id, cy, cx, step, block), block with the structs y, x, l, a, b in order."""
    pixel = F.struct(*(F.col(c).cast("long").alias(c) for c in "yx"), *(F.col(c).cast("double").alias(c) for c in "lab"))
    part = [F.floor(F.col(c) / BLOCK).alias(f"part_{c}") for c in "yx"]
    return placed.groupBy(*PLACE, "step", *part).agg(F.sort_array(F.collect_list(pixel)).alias("block")).drop("part_y", "part_x")


def _with_near(packed: DataFrame, centres: DataFrame) -> DataFrame:
    """Blocks with near: the centres of the 3 x 3 cells around, nine at most, in the order of their cells, eight numbers for each."""
    row = F.array(*(F.col(c).cast("double") for c in ("cy", "cx", "y", "x", "l", "a", "b", "spread")))
    moved = centres.select("image_id", row.alias("row"), F.explode(F.expr("array(cy - 1, cy, cy + 1)")).alias("cy"), "cx")
    moved = moved.select("image_id", "row", "cy", F.explode(F.expr("array(cx - 1, cx, cx + 1)")).alias("cx"))
    return packed.join(moved.groupBy(*PLACE).agg(F.flatten(F.sort_array(F.collect_list("row"))).alias("near")), list(PLACE))


def _nearest(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: its row, its pixels, the centres near it, and each pixel's nearest one (ties to the smaller cell) with its squared colour distance."""
    block, near, step = batch.column("block"), batch.column("near"), batch.column("step").to_numpy()
    values = block.values.flatten()
    pixels = {f.name: v.to_numpy() for f, v in zip(block.type.value_type, values, strict=True)}
    start, other = block.offsets.to_numpy(), near.offsets.to_numpy()
    numbers = near.values.to_numpy()
    for i in range(batch.num_rows):
        p = {k: v[start[i] : start[i + 1]] for k, v in pixels.items()}
        c = numbers[other[i] : other[i + 1]].reshape(-1, 8)
        square = lambda k, j: (p[k][:, None] - c[None, :, j]) ** 2  # noqa: B023, E731
        colour = square("l", 4) + square("a", 5) + square("b", 6)
        far = colour / c[:, 7] + (square("y", 2) + square("x", 3)) / (step[i] * step[i])
        best = np.argmin(np.where(np.isnan(far), np.inf, far), 1)
        yield i, p, c, best, colour[np.arange(len(best)), best]


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pixel."""
    for batch in batches:
        for i, p, c, best, colour in _nearest(batch):
            keys = {k: pa.repeat(batch.column(k)[i], len(best)) for k in (*PLACE, "step")}
            home = pa.StructArray.from_arrays([pa.array(c[best, j].astype(np.int64)) for j in (0, 1)], ["cy", "cx"])
            yield pa.RecordBatch.from_pydict({**{k: pa.array(v) for k, v in p.items()}, **keys, "home": home, "colour": pa.array(colour)})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and centre that has pixels of it: their number, sums and largest squared colour distance."""
    for batch in batches:
        for i, p, c, best, colour in _nearest(batch):
            n = np.bincount(best, minlength=len(c))
            some, met = n > 0, np.full(len(c), -np.inf)
            np.maximum.at(met, best, colour)
            cells = {k: pa.array(c[some, j].astype(np.int64)) for j, k in enumerate(("cy", "cx"))}
            sums = {k: pa.array(np.bincount(best, p[k], len(c))[some]) for k in FEATURES}
            yield pa.RecordBatch.from_pydict({"image_id": pa.repeat(batch.column("image_id")[i], int(some.sum())), **cells, "n": pa.array(n[some]), **sums, "met": pa.array(met[some])})


def assigned(placed: DataFrame, centres: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x, l, a, b, step, cy, cx) with their nearest centre among those of the 3 x 3 cells around (home: struct cy, cx) and its squared colour distance; ties to the smaller cell."""
    return _assigned(blocks(placed), centres)


def _assigned(packed: DataFrame, centres: DataFrame) -> DataFrame:
    schema = "y long, x long, l double, a double, b double, image_id string, cy long, cx long, step double, home struct<cy: long, cx: long>, colour double"
    rows = _with_near(packed, centres).mapInArrow(_homes, schema)
    return rows.select("image_id", *"yxlab", "step", "cy", "cx", "home", "colour")


def superpixels(pixels: DataFrame, wanted: int, rounds: int = 10) -> DataFrame:
    """pixels (image_id, y, x, l, a, b) with region_id: connected superpixels, each at least half a cell where it has a neighbour.

    k-means in colour and place; a centre's colour distances are divided by the largest that it met, so flat and
    structured parts get even shapes. A centre stays with the cell where it began: pixels meet the centres of the
    nine cells around, wherever these have moved. Pixels are shuffled once, into blocks; a round sends a block's sums.
    Parts that are too small join the largest neighbour, on the graph of parts. region_id is the smallest pixel number
    of the part that the others joined.
    """
    placed = cells(pixels, wanted)
    packed = graph.saved(blocks(placed))
    centres = graph.saved(first_centres(packed.select(*PLACE, F.inline("block"))))
    for _ in range(rounds):
        found = _with_near(packed, centres).mapInArrow(_sums, "image_id string, cy long, cx long, n long, l double, a double, b double, y double, x double, met double")
        means = found.groupBy(*PLACE).agg(*((F.sum(c) / F.sum("n")).alias(c) for c in FEATURES), F.max("met").alias("met"))
        spread = centres.select(*PLACE, "spread")
        centres = graph.saved(means.join(spread, list(PLACE)).select(*PLACE, *FEATURES, F.greatest("spread", "met").alias("spread")))
    last = _assigned(packed, centres).withColumn("region_id", F.col("home.cy") * (1 << 31) + F.col("home.cx"))
    parts = graph.saved(graph.pixel_components(last.select("image_id", "y", "x", "l", "a", "b", "step", "region_id")))
    roots = joined_parts(parts)
    return parts.join(roots, ["image_id", "component"]).select("image_id", "y", "x", "l", "a", "b", F.col("root").alias("region_id"))


def joined_parts(parts: DataFrame) -> DataFrame:
    """(image_id, component, root): parts below half a cell linked to the largest neighbour (ties to the smaller number), until none is left that has one."""
    as_region = parts.withColumn("region_id", F.col("component"))
    c = raster.contacts(as_region).where("l <> r").select("image_id", F.least("l", "r").alias("lo"), F.greatest("l", "r").alias("hi")).distinct()
    edges = graph.saved(c)
    sizes = graph.saved(parts.groupBy("image_id", "component").agg(F.count("*").alias("area"), (F.first("step") * F.first("step") / 2).alias("least")))
    roots = graph.saved(sizes.select("image_id", "component", F.col("component").alias("root")))
    while True:
        both = edges.select("image_id", F.col("lo").alias("component"), F.col("hi").alias("to")).unionByName(edges.select("image_id", F.col("hi").alias("component"), F.col("lo").alias("to")))
        target = sizes.select("image_id", F.col("component").alias("to"), F.col("area").alias("to_area"))
        small = sizes.where("area < least").join(both, ["image_id", "component"]).join(target, ["image_id", "to"])
        links = graph.saved(small.groupBy("image_id", "component").agg(F.min(F.struct((-F.col("to_area")).alias("less"), "to")).alias("best")).select("image_id", "component", F.col("best.to").alias("to")))
        if links.isEmpty():
            return roots
        # a link goes to a larger part or, of equal ones, to the smaller number, so each class has one largest part
        node = lambda name: F.struct("image_id", F.col(name).alias("component"))
        pairs = links.select(node("component").alias("a"), node("to").alias("b"))
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        classes = graph.smallest_reachable(ends, pairs).select(F.col("node.image_id").alias("image_id"), F.col("node.component").alias("component"), F.col("root.component").alias("new"))
        mapped = lambda df, name: df.join(classes.withColumnRenamed("component", name), ["image_id", name], "left").withColumn(name, F.coalesce("new", name)).drop("new")
        roots = graph.saved(mapped(roots, "root"))
        edges = graph.saved(mapped(mapped(edges, "lo"), "hi").where("lo <> hi").select("image_id", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct())
        sizes = graph.saved(mapped(sizes, "component").groupBy("image_id", "component").agg(F.sum("area").alias("area"), F.max("least").alias("least")))


def complexity(pixels: DataFrame, mm_per_pixel: float) -> DataFrame:
    """(image_id, parts, micro_percent): connected parts of equal region_id, and the share of pixels in parts too small or narrow to paint.

    The width of a part is that of its widest place; the rim of the image is no border.
    """
    parts = graph.saved(graph.pixel_components(pixels.select("image_id", "y", "x", "region_id")))
    room = distance.squared_room(parts, rim=False).select("image_id", "y", "x", "room")
    each = parts.join(room, ["image_id", "y", "x"]).groupBy("image_id", "component").agg(F.count("*").alias("area"), F.max("room").alias("room"))
    width = F.greatest(F.lit(0.0), 2 * F.sqrt("room") - 1) * mm_per_pixel
    small = (F.col("area") * mm_per_pixel**2 < LEAST_MM2) | (width < LEAST_WIDTH_MM) | (width < LEAST_POCKET_MM)
    return each.groupBy("image_id").agg(F.count("*").alias("parts"), (100 * F.sum(F.when(small, F.col("area")).otherwise(0)) / F.sum("area")).alias("micro_percent"))


def palettes(regions: DataFrame, size: int, rounds: int = 12) -> DataFrame:
    """(image_id, centres): at most ``size`` colours for each image's regions(l, a, b, area), weighed by the root of the area.

    k-means from even shares of the distinct colours, sorted; a round is one aggregation, and an image's centres are one array.
    """
    rounded = F.struct(*(F.round(c, 5) for c in "lab"))
    rank = F.dense_rank().over(Window.partitionBy("image_id").orderBy(rounded)) - 1
    ranked = graph.saved(regions.select("image_id", "l", "a", "b", F.sqrt("area").alias("w"), rank.alias("rank")))
    distinct = ranked.groupBy("image_id").agg((F.max("rank") + 1).alias("n"))
    first = ranked.join(distinct, "image_id").withColumn("i", F.floor(F.col("rank") * F.least(F.col("n"), F.lit(size)) / F.col("n")))

    def gathered(groups: DataFrame) -> DataFrame:
        means = groups.groupBy("image_id", "i").agg(*((F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in "lab"))
        return graph.saved(means.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("l", "a", "b"))).alias("centres")))  # size entries at most

    centres = gathered(first)
    for _ in range(rounds):
        new = gathered(ranked.join(centres, "image_id").withColumn("i", nearest_entry()))
        if new.exceptAll(centres).isEmpty():
            break
        centres = new
    return centres


def nearest_entry():
    """The place of the entry of the column centres that is nearest to (l, a, b)."""
    far = lambda c, i: F.struct(sum(((F.col(k) - c[k]) * (F.col(k) - c[k]) for k in "lab"), F.lit(0.0)).alias("far"), i.alias("i"))
    return F.array_min(F.transform("centres", far))["i"]


def medians(pixels: DataFrame) -> DataFrame:
    """(image_id, region_id, l, a, b): the median of each channel of a region, which may be as large as its image."""
    each = pixels.select("image_id", "region_id", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in "lab"))).alias("e")).select("image_id", "region_id", "e.*")
    found = quantiles.percentiles(each, ["image_id", "region_id", "channel"], "value", median=0.5)
    return found.groupBy("image_id", "region_id").agg(*(F.max(F.when(F.col("channel") == c, F.col("median"))).alias(c) for c in "lab"))


def source_quality(pixels: DataFrame, palette_size: int, mm_per_pixel: float, wanted: int = 1225, rounds: int = 10) -> DataFrame:
    """A row for each image: status (warn or pass), codes, mean_loss and p90_loss (CIEDE2000), regions, micro_percent.

    Superpixels are painted with the nearest of palette_size colours fitted to their medians. Where an image has no
    more colours than the palette, regions counts the painted parts, else the superpixels. A table without pixels
    gives no rows; colours must not be null.
    """
    fine = graph.saved(superpixels(pixels.select("image_id", "y", "x", "l", "a", "b"), wanted, rounds))
    regions = graph.saved(medians(fine).join(fine.groupBy("image_id", "region_id").agg(F.count("*").alias("area")), ["image_id", "region_id"]))
    centres = palettes(regions, palette_size)
    paint = regions.join(centres, "image_id").withColumn("i", nearest_entry()).select("image_id", "region_id", F.col("i").alias("paint"), *(F.get("centres", F.col("i"))[c].alias(f"p{c}") for c in "lab"))
    painted = graph.saved(fine.join(paint, ["image_id", "region_id"]))
    loss = graph.saved(painted.select("image_id", difference(*(F.col(c) for c in ("l", "a", "b", "pl", "pa", "pb"))).alias("loss")))
    loss = loss.groupBy("image_id").agg(F.avg("loss").alias("mean_loss")).join(quantiles.percentiles(loss, ["image_id"], "loss", p90_loss=0.9), "image_id")
    colours = pixels.select("image_id", "l", "a", "b").distinct().groupBy("image_id").agg(F.count("*").alias("colours"))
    parts = complexity(painted.select("image_id", "y", "x", F.col("paint").cast("long").alias("region_id")), mm_per_pixel)
    counts = regions.groupBy("image_id").agg(F.count("*").alias("superpixels"))
    out = loss.join(colours, "image_id").join(parts, "image_id").join(counts, "image_id")
    out = out.withColumn("regions", F.when(F.col("colours") <= palette_size, F.col("parts")).otherwise(F.col("superpixels")))
    codes = F.array_compact(F.array(
        F.when((F.col("mean_loss") > MEAN_LOSS) | (F.col("p90_loss") > P90_LOSS), "palette_mismatch"),
        F.when(F.col("micro_percent") > MICRO_PERCENT, "micro_detail_density"),
        F.when(F.col("regions") > REGIONS, "region_complexity"),
    ))
    return out.select("image_id", F.when(F.size(codes) > 0, "warn").otherwise("pass").alias("status"), F.array_join(codes, ",").alias("codes"), "mean_loss", "p90_loss", "regions", "micro_percent")
