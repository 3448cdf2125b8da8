"""Constraint checks: each rule is a query for rows (code, severity, message, region_id) that break it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What to do about a code.
ACTIONS = [
    (1, "unnumbered_region", "Merge or enlarge regions without a number"),
    (2, "same_color_adjacency", "Merge neighbours of one paint"),
    (3, "disconnected_region", "Split a region into its parts"),
    (4, "tiny_region", "Merge regions below the smallest area"),
    (5, "thin_region", "Merge regions below the smallest width"),
    (6, "duplicate_palette_colour", "Remove paints that repeat"),
    (7, "prefilled_area_exceeded", "Prefill less"),
    (8, "palette_over_target", "Use fewer paints"),
]


Measure = float | int | DataFrame


def issue(rows: DataFrame, code: str, message: str, region: Column | None = None) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), F.lit("error").alias("severity"), F.lit(message).alias("message"), (F.lit(None) if region is None else region).cast("long").alias("region_id"))


def validate(regions: DataFrame, edges: DataFrame, assigned: DataFrame, palette: DataFrame, exempt: DataFrame, unnumbered: DataFrame, least_area: float, least_width: float, most_paints: int, prefilled_share: float, further: dict | None = None) -> DataFrame:
    """Broken rules; a report passes when there are none.

    regions(region_id, area, thickness, components), edges(lo, hi), assigned(region_id, color_id),
    palette(color_id, r, g, b), exempt(region_id): filled before painting, unnumbered(region_id). These give 11
    of the survey's 28 codes. The other 17 need inputs of their own, ``further`` (see further_rules); without
    one its rules are not checked.
    """
    further = further or {}
    id_ = F.col("region_id")
    free = exempt.select("region_id").unionByName(further["protected"].select("region_id")) if "protected" in further else exempt
    prefilled = further.get("prefilled", exempt)
    bare = regions.join(free, "region_id", "left_anti")
    used = assigned.select("color_id").distinct()
    ends = lambda s: assigned.select(id_.alias(s), F.col("color_id").alias(f"paint_{s}"))
    same = edges.join(ends("lo"), "lo").join(ends("hi"), "hi").where("paint_lo = paint_hi")
    total = regions.agg(F.sum("area").alias("total"))
    filled = regions.join(prefilled, "region_id", "left_semi").agg(F.sum("area").alias("filled"))
    rules = [
        issue(regions.where("components <> 1"), "disconnected_region", "region is not connected", id_),
        issue(bare.where(F.col("area") < least_area - 1e-6), "tiny_region", "region is too small", id_),
        issue(bare.where(F.col("thickness") < least_width - 1e-6), "thin_region", "region is too thin", id_),
        issue(regions.join(assigned, "region_id", "left_anti"), "unmapped_region", "region has no paint", id_),
        issue(assigned.join(regions, "region_id", "left_anti"), "missing_region_record", "paint of an unknown region", id_),
        issue(unnumbered.join(free, "region_id", "left_anti"), "unnumbered_region", "region has no number", id_),
        issue(used.join(palette, "color_id", "left_anti"), "invalid_palette_id", "paint is not in the palette"),
        issue(palette.groupBy("r", "g", "b").count().where("count > 1"), "duplicate_palette_colour", "paint repeats"),
        issue(same, "same_color_adjacency", "neighbours have one paint", F.col("lo")),
        issue(used.agg(F.count("*").alias("n")).where(F.col("n") > most_paints), "palette_over_target", "too many paints"),
        issue(total.crossJoin(filled).where(F.coalesce("filled", F.lit(0)) > prefilled_share * F.col("total")), "prefilled_area_exceeded", "too much is filled"),  # one row each
    ]
    return reduce(DataFrame.unionByName, rules + further_rules(regions, assigned, palette, prefilled, **further))


# The least area and width of details, the greatest share of regions to the budget, label sizes, losses.
DETAIL = 0.5
OVERFLOW_PERCENT = 110
LABEL_HEIGHT_MM, LABEL_FONT_PT = 1.0, 72 / 25.4
LOSS, PROTECTED_RECALL, PROTECTED_MEAN, PROTECTED_P90 = 6.0, 0.9, 8.0, 15.0


def further_rules(
    regions: DataFrame, assigned: DataFrame, palette: DataFrame, exempt: DataFrame, *, protected: DataFrame | None = None, prefilled: DataFrame | None = None, same_ids: bool = False, region_budget: int | None = None,
    least_regions: int | None = None, placements: DataFrame | None = None, artificial: Measure | None = None, loss: Measure | None = None, protected_recall: Measure | None = None, protected_mean: Measure | None = None,
    protected_p90: Measure | None = None, painted: tuple[DataFrame, DataFrame] | None = None, page_sizes: tuple[tuple[int, int], tuple[int, int]] | None = None,
) -> list[DataFrame]:
    """Broken rules of the inputs that are given.

    protected(region_id), prefilled(region_id; exempt if not given), same_ids: the map and the paints have
    the same regions, placements(font_pt, height_mm), artificial: weak boundaries with exaggerated contrast,
    loss, protected_mean and protected_p90: CIEDE2000, painted: labels(y, x, region_id) and pixels(y, x, r, g, b),
    page_sizes: of the template and of the page. Areas and widths of details are in mm. A measure is a number or
    a table of one row and one column, as an aggregate gives it; null breaks no rule.
    """
    spark, id_, rules = regions.sparkSession, F.col("region_id"), []
    filled = exempt if prefilled is None else prefilled

    def measured(value: Measure, broken: Callable[[Column], Column], code: str, message: str) -> None:
        one = value if isinstance(value, DataFrame) else spark.range(1).select(F.lit(value).alias("value"))
        rules.append(issue(one.toDF("value").where(broken(F.col("value"))), code, message))

    if protected is not None:
        rules.append(issue(filled.join(protected, "region_id", "left_anti").agg(F.count("*").alias("n")).where("n > 0"), "ordinary_region_prefilled", "a region that is not protected is filled"))
    for kind, some in (("protected", protected), ("prefilled", prefilled)):
        if some is not None:
            details = regions.join(some, "region_id", "left_semi")
            rules.append(issue(details.where(F.col("area") < DETAIL - 1e-6), f"{kind}_detail_too_small", f"{kind} detail is too small", id_))
            rules.append(issue(details.where(F.col("thickness") < DETAIL - 1e-6), f"{kind}_detail_too_thin", f"{kind} detail is too thin", id_))
    if same_ids:
        apart = regions.join(assigned, "region_id", "left_anti").select("region_id").unionByName(assigned.join(regions, "region_id", "left_anti").select("region_id"))
        rules.append(issue(apart.agg(F.count("*").alias("n")).where("n > 0"), "region_mapping_mismatch", "map and paints have different regions"))
    n_regions = regions.agg(F.count("*").alias("n"))
    if region_budget is not None:
        rules.append(issue(n_regions.where(F.col("n") > -(-region_budget * OVERFLOW_PERCENT // 100)), "protected_budget_exceeded", "too many regions"))
    if least_regions is not None:
        rules.append(issue(n_regions.where(F.col("n") < least_regions), "region_count_below_difficulty", "too few regions"))
    if placements is not None:
        painted_by_hand = regions.join(filled, "region_id", "left_anti").limit(1).select(F.lit(1).alias("one"))
        least = placements.agg(F.min("height_mm").alias("height"), F.min("font_pt").alias("font")).crossJoin(painted_by_hand)  # one row each
        rules.append(issue(least.where((F.col("height") > 0) & (F.col("height") < LABEL_HEIGHT_MM - 1e-6)), "label_height_too_small", "a label is too low"))
        rules.append(issue(least.where((F.col("font") > 0) & (F.col("font") < LABEL_FONT_PT - 1e-6)), "label_font_too_small", "a label's font is too small"))
    if artificial is not None:
        measured(artificial, lambda v: v > 0, "artificial_boundary", "a weak boundary has exaggerated contrast")
    if loss is not None:
        measured(loss, lambda v: v > LOSS + 1e-6, "global_reconstruction_loss", "the picture has lost too much")
    if protected_recall is not None:
        measured(protected_recall, lambda v: v < PROTECTED_RECALL - 1e-6, "protected_boundary_loss", "protected boundaries are lost")
    if protected_mean is not None:
        measured(protected_mean, lambda v: v > PROTECTED_MEAN + 1e-6, "protected_colour_mean_loss", "protected colours are off in the mean")
    if protected_p90 is not None:
        measured(protected_p90, lambda v: v > PROTECTED_P90 + 1e-6, "protected_colour_p90_loss", "protected colours are off at the 90th percentile")
    if painted is not None:
        labels, pixels = painted
        colours = assigned.join(palette, "color_id").select("region_id", *(F.col(c).alias(f"want_{c}") for c in "rgb"))
        want = labels.join(colours, "region_id", "left").select("y", "x", *(F.coalesce(f"want_{c}", F.lit(255)).alias(f"want_{c}") for c in "rgb"))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"want_{c}")) for c in "rgb"))
        differing = want.join(pixels, ["y", "x"], "full").where(~same).agg(F.count("*").alias("n"))
        rules.append(issue(differing.where("n > 0"), "painted_reference_mismatch", "the painted picture differs from map and palette"))
    if page_sizes is not None:
        measured(int(tuple(page_sizes[0]) != tuple(page_sizes[1])), lambda v: v > 0, "page_size_mismatch", "the template has another size than the page")
    return rules


def actions(issues: DataFrame) -> DataFrame:
    table = issues.sparkSession.createDataFrame(ACTIONS, "ordinal int, code string, action string")
    return table.join(issues.select("code").distinct(), "code", "left_semi")
