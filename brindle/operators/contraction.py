"""Contraction of whole region graphs in rounds: stars around mutually best pairs, sums and edges aggregated anew each round.

A round lets every region pick its best neighbour. Two regions that pick each other are a pair, and all that pick one of
the two join it as well, so a round takes large areas in at once; what is chained behind waits for the next round,
with new sums. Pixels are not touched: the result is a table from regions to what they became.

Where few regions can still merge, rounds work on these, their edges and their neighbours only (``narrowed``). A
neighbour that something joins is called in with its own edges first, so every round gives what it would over the whole
graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.colour import difference
from brindle.operators.evidence import physical_loss, sided
from brindle.operators.graph import saved
from brindle.operators.paints import LAB, lab_of
from brindle.operators.segmentation import composed

WEAK_DIFFERENCE, WEAK_EVIDENCE, HARD_EVIDENCE = 2.0, 0.20, 0.70
#: Rounds are narrowed where the regions that can merge are fewer than one in so many, and again when so many times fewer are left.
NARROW, AGAIN = 4, 8


class Regions:
    """regions(image_id, region_id, area, perimeter, l, a, b, protection, costs), edges(image_id, lo, hi, shared_len, evidence, user_edge), and the steps (image_id, node, to) by which regions went."""

    def __init__(self, regions: DataFrame, edges: DataFrame, n_paints: int = 0):
        self.n_paints = n_paints
        costs = F.col("costs") if "costs" in regions.columns else F.array().cast("array<double>")
        protection = F.coalesce("protection", F.lit(0.0)) if "protection" in regions.columns else F.lit(0.0)
        user = F.coalesce("user_edge", F.lit(False)) if "user_edge" in edges.columns else F.lit(False)
        self.regions = saved(regions.select("image_id", "region_id", F.col("area").cast("double").alias("area"), F.col("perimeter").cast("double").alias("perimeter"), *LAB, protection.alias("protection"), costs.alias("costs")))
        self.edges = saved(edges.select("image_id", "lo", "hi", F.col("shared_len").cast("double").alias("shared_len"), "evidence", user.alias("user_edge")))
        self.every, self.steps, self.own = self.regions.select("image_id", "region_id"), [], None

    def joined(self) -> DataFrame:
        """(image_id, region_id, to): what each region became."""
        if not self.steps:
            return self.every.withColumn("to", F.col("region_id"))
        gone = composed(self.steps).withColumnRenamed("node", "region_id")
        return self.every.join(gone, ["image_id", "region_id"], "left").withColumn("to", F.coalesce("to", "region_id"))

    def narrowed(self, own: DataFrame) -> None:
        """From here on only own(image_id, region_id), which must have all that can merge, with their edges and neighbours."""
        self.widened()
        self.own, self.cold_regions, self.cold_edges = saved(own), self.regions, self.edges
        self.edges = saved(_either(_marked(self.cold_edges, self.own)))
        self.regions = saved(self.cold_regions.join(_ids(self.edges).unionByName(self.own).distinct(), ["image_id", "region_id"], "left_semi"))

    def widened(self) -> None:
        """All regions and edges again."""
        if self.own is not None:
            key = ["image_id", "region_id"]
            self.regions = saved(self.cold_regions.join(self.own, key, "left_anti").unionByName(self.regions.join(self.own, key, "left_semi")))
            self.edges = saved(_neither(_marked(self.cold_edges, self.own)).unionByName(self.edges))
            self.own = None

    def _called(self, to: DataFrame) -> None:
        """Neighbours that take part in to(image_id, region_id, to) join own, with their edges and what these touch."""
        key = ["image_id", "region_id"]
        ends = to.select("image_id", "region_id").unionByName(to.select("image_id", F.col("to").alias("region_id"))).distinct()
        new = saved(ends.join(self.own, key, "left_anti"))
        if new.isEmpty():
            return
        more = saved(_either(_marked(_neither(_marked(self.cold_edges, self.own)), new)))
        ids = _ids(more).distinct().join(self.regions.select(*key), key, "left_anti")
        self.edges = self.edges.unionByName(more)
        self.regions = saved(self.regions.unionByName(self.cold_regions.join(ids, key, "left_semi")))
        self.own = saved(self.own.unionByName(new))

    def measured(self) -> DataFrame:
        """Edges with what both ends have; an edge without evidence has the larger protection of its regions."""
        e = sided(self.edges, self.regions, "area", "perimeter", "protection", "costs", *LAB)
        e = e.withColumn("evidence", F.coalesce("evidence", F.greatest("protection_lo", "protection_hi"))).withColumn("delta_e", difference(*lab_of("_lo"), *lab_of("_hi")))
        total = F.greatest(F.lit(1.0), F.col("area_lo") + F.col("area_hi"))
        least = lambda c: F.coalesce(F.array_min(c), F.lit(0.0))
        loss = (least(F.zip_with("costs_lo", "costs_hi", lambda x, y: x + y)) - least(F.col("costs_lo")) - least(F.col("costs_hi"))) / total
        contact = F.col("shared_len") / F.greatest(F.lit(1.0), F.sqrt(F.least("area_lo", "area_hi")))
        return e.withColumns({"loss": F.greatest(F.lit(0.0), loss), "contact": contact, "uneven": F.abs(F.col("area_lo") - F.col("area_hi")) / total})

    def stars(self, ways: DataFrame, quota: DataFrame | None = None) -> bool:
        """Contracts by ways(image_id, region_id, other, key, must, user): each region's way of the smallest key counts. quota(image_id,
        left, left_user): no more than so many of an image's smallest keys, fewer for selected pairs, besides those that must.
        False if nothing was to do."""
        picks = saved(ways.groupBy("image_id", "region_id").agg(F.min(F.struct("key", "other", "must", "user")).alias("p")).select("image_id", "region_id", "p.*"))
        back = picks.select("image_id", F.col("region_id").alias("other"), F.col("other").alias("picked"))
        pairs = picks.join(back, ["image_id", "other"]).where("picked = region_id").select("image_id", "region_id", F.least("region_id", "other").alias("centre"))
        leaves = picks.join(pairs.withColumnRenamed("region_id", "other"), ["image_id", "other"]).where("region_id <> centre")
        if quota is not None:
            leaves = _within(leaves, quota)
        to = saved(leaves.select("image_id", "region_id", F.col("centre").alias("to")))
        if to.isEmpty():
            return False
        if self.own is not None:
            self._called(to)
        renamed = lambda s: to.select("image_id", F.col("region_id").alias(s), F.col("to").alias(f"{s}_to"))
        edges = self.edges.join(renamed("lo"), ["image_id", "lo"], "left").join(renamed("hi"), ["image_id", "hi"], "left").withColumns({"lo": F.coalesce("lo_to", "lo"), "hi": F.coalesce("hi_to", "hi")})
        inner = edges.where("lo = hi").groupBy("image_id", F.col("lo").alias("region_id")).agg(F.sum("shared_len").alias("inner"))
        known = F.col("evidence").isNotNull()
        outer = edges.where("lo <> hi").groupBy("image_id", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).agg(
            F.sum("shared_len").alias("shared_len"), (F.sum(F.col("evidence") * F.col("shared_len")) / F.sum(F.when(known, F.col("shared_len")))).alias("evidence"), F.max("user_edge").alias("user_edge")
        )
        mean = lambda c: (F.sum(F.col("area") * F.col(c)) / F.sum("area")).alias(c)
        sums = F.array(*(F.sum(F.col("costs")[i]) for i in range(self.n_paints))) if self.n_paints else F.array().cast("array<double>")
        rows = self.regions.join(to, ["image_id", "region_id"], "left").groupBy("image_id", F.coalesce("to", "region_id").alias("region_id"))
        rows = rows.agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), *map(mean, LAB), F.max("protection").alias("protection"), sums.alias("costs")).join(inner, ["image_id", "region_id"], "left")
        self.regions = saved(rows.withColumn("perimeter", F.col("perimeter") - 2 * F.coalesce("inner", F.lit(0.0))).drop("inner"))
        self.edges = saved(outer)
        self.steps.append(to.select("image_id", F.col("region_id").alias("node"), "to"))
        return True


def _marked(edges: DataFrame, some: DataFrame) -> DataFrame:
    """edges with the columns at_lo and at_hi: whether that end is one of some(image_id, region_id)."""
    for s in ("lo", "hi"):
        edges = edges.join(some.select("image_id", F.col("region_id").alias(s), F.lit(True).alias(f"at_{s}")), ["image_id", s], "left")
    return edges


def _either(marked: DataFrame) -> DataFrame:
    return marked.where("at_lo IS NOT NULL OR at_hi IS NOT NULL").drop("at_lo", "at_hi")


def _neither(marked: DataFrame) -> DataFrame:
    return marked.where("at_lo IS NULL AND at_hi IS NULL").drop("at_lo", "at_hi")


def _ids(edges: DataFrame) -> DataFrame:
    return edges.select("image_id", F.explode(F.array("lo", "hi")).alias("region_id"))


def _within(leaves: DataFrame, quota: DataFrame) -> DataFrame:
    """The leaves of an image's smallest keys that quota lets go, and those that must; ranges of keys are counted on many tasks, and only where there are too many."""
    leaves = saved(leaves)
    counts = leaves.groupBy("image_id").agg(F.count("*").alias("n"))
    crowded = saved(counts.join(quota, "image_id").where("n > least(left, left_user)").drop("n"))
    if crowded.isEmpty():
        return leaves
    rows = leaves.join(F.broadcast(crowded), "image_id")  # a row for each image
    parts = saved(rows.repartitionByRange("image_id", "key", "region_id").withColumn("part", F.spark_partition_id()))
    before = F.sum("size").over(Window.partitionBy("image_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = parts.groupBy("image_id", "part").agg(F.count("*").alias("size")).withColumn("before", F.coalesce(before, F.lit(0)))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("image_id", "part").orderBy("key", "region_id"))
    ranked = parts.join(sizes.drop("size"), ["image_id", "part"]).withColumn("rank", rank).where("must OR rank <= if(user, left_user, left)")
    return leaves.join(crowded, "image_id", "left_anti").unionByName(ranked.select(*leaves.columns))


def both_ways(edges: DataFrame, key: Column, must: Column) -> DataFrame:
    """(image_id, region_id, other, key, must, user) for both ends; the key ends with the pair, so that it is the same seen from either."""
    ends = F.array(F.struct(F.col("lo").alias("region_id"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("region_id"), F.col("lo").alias("other")))
    return edges.select("image_id", F.explode(ends).alias("e"), key.alias("key"), must.alias("must"), F.col("user_edge").alias("user")).select("image_id", "e.*", "key", "must", "user")


def _thin(s: str, least_area: float, least_width: float) -> Column:
    return (F.col(f"area{s}") < least_area) | (2 * F.col(f"area{s}") / F.greatest(F.lit(1.0), F.col(f"perimeter{s}")) < least_width)


def merge_hierarchically(regions: DataFrame, edges: DataFrame, target: int, most: int, n_paints: int, least_area: float = 0.0, least_width: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(joined, over): what each region became (image_id, region_id, merged_id), and images that stay above ``most`` (image_id, regions).

    First neighbours without source support merge, then by cost down to ``target`` regions an image: selected pairs
    only above ``most``, regions below the floor in any case; then, above ``most``, whatever costs least. costs has the
    cost of each of ``n_paints`` paints for a region.
    """
    g = Regions(regions, edges, n_paints)
    pair = [F.col("lo"), F.col("hi")]
    is_weak = (F.col("delta_e") < WEAK_DIFFERENCE) & (F.col("evidence") < WEAK_EVIDENCE)
    some = saved(_ids(g.measured().where(is_weak)).distinct())
    if NARROW * some.count() < g.regions.count():
        g.narrowed(some)
    while True:
        weak = g.measured().where(is_weak)
        if not g.stars(both_ways(weak, F.struct("evidence", "loss", "delta_e", (-F.col("contact")).alias("contact"), *pair), F.lit(False))):
            break
    g.widened()
    for goal, selected_too in ((target, False), (most, True)):
        while True:
            count = saved(g.regions.groupBy("image_id").agg(F.count("*").alias("regions")))
            e = g.measured().join(count, "image_id")
            below = _thin("_lo", least_area, least_width) | _thin("_hi", least_area, least_width)
            cost = F.col("loss") + F.col("evidence") * F.col("delta_e") * F.when(F.col("user_edge"), 2.0).otherwise(1.0)
            open_ = below if not selected_too else F.lit(False)
            free = F.lit(True) if selected_too else (~F.col("user_edge") | (F.col("regions") > most))
            e = e.where(open_ | ((F.col("regions") > goal) & free))
            key = F.struct((~below).cast("int").alias("strong"), cost.alias("cost"), "evidence", "loss", "delta_e", "uneven", (-F.col("contact")).alias("contact"), *pair)
            quota = count.select("image_id", (F.col("regions") - goal).alias("left"), (F.col("regions") - most).alias("left_user"))
            if not g.stars(both_ways(e, key, open_), quota):
                break
    over = g.regions.groupBy("image_id").agg(F.count("*").alias("regions")).where(F.col("regions") > most)
    return g.joined().withColumnRenamed("to", "merged_id"), over


def absorbed(regions: DataFrame, edges: DataFrame, least_area: float, least_width: float, floor_area: float = 0.0, floor_width: float = 0.0, rounds: int = 50) -> DataFrame:
    """(image_id, region_id, to) after regions below the limits have joined a neighbour, round by round.

    A region joins a larger neighbour (of equal ones that of the smaller number) whose boundary is below hard
    evidence, the one of least loss, ties to the larger and then the smaller number. Where there is none, it
    joins any neighbour whose boundary is below hard evidence, and below the printable floor any at all. Regions without
    such a neighbour stay.
    """
    g = Regions(regions, edges)
    most = g.regions.count() // NARROW
    for _ in range(rounds):
        below = g.regions.where(_thin("", least_area, least_width)).select("image_id", "region_id")
        n_below = below.count()
        if n_below < most:
            g.narrowed(below)
            most = n_below // AGAIN
        degree = F.count(F.lit(1)).over(Window.partitionBy("image_id", "region_id"))
        ends = F.array(*(F.struct(F.col(s).alias("region_id"), F.col(t).alias("other"), *(F.col(f"{c}_{s}").alias(c) for c in ("area", "perimeter")), F.col(f"area_{t}").alias("size")) for s, t in (("lo", "hi"), ("hi", "lo"))))
        ways = g.measured().select("image_id", "lo", "hi", "delta_e", "evidence", F.explode(ends).alias("e")).select("image_id", "lo", "hi", "delta_e", "evidence", "e.*")
        small = ways.where(_thin("", least_area, least_width)).withColumn("degree", degree)  # all of a region's ways stay or go
        soft = F.col("evidence") < HARD_EVIDENCE
        larger = (F.col("size") > F.col("area")) | ((F.col("size") == F.col("area")) & (F.col("other") < F.col("region_id")))
        rank = F.when(larger & soft, 0).when(soft | _thin("", floor_area, floor_width), 1)
        loss = physical_loss(F.col("delta_e"), F.col("evidence"), F.col("degree"), F.col("area"), F.col("size"))
        asked = small.withColumn("rank", rank).where("rank IS NOT NULL").select("image_id", "region_id", "other", F.struct("rank", loss.alias("loss"), (-F.col("size")).alias("size"), F.col("other").alias("o")).alias("key"))
        best = saved(asked.groupBy("image_id", "region_id").agg(F.min_by("other", "key").alias("other"), F.min("key").alias("key")))
        # a neighbour that is not small itself answers the first of those that ask for it, so that pairs are mutual
        answers = best.join(best.select("image_id", F.col("region_id").alias("other")), ["image_id", "other"], "left_anti").groupBy("image_id", F.col("other").alias("region_id")).agg(F.min_by("region_id", F.struct("key", "region_id")).alias("other"), F.min("key").alias("key"))
        if not g.stars(_free(best.unionByName(answers))) and not g.stars(_free(_broken_ring(best))):
            break
    return g.joined()


def _broken_ring(best: DataFrame) -> DataFrame:
    """Picks of each image's first region and of what it picks, where all picks run in rings of three or more."""
    first = best.groupBy("image_id").agg(F.min_by(F.struct("region_id", "other", "key"), F.struct("key", "region_id")).alias("p")).select("image_id", "p.*")
    return first.unionByName(first.select("image_id", F.col("other").alias("region_id"), F.col("region_id").alias("other"), "key"))


def _free(ways: DataFrame) -> DataFrame:
    return ways.withColumns({"must": F.lit(False), "user": F.lit(False)})
