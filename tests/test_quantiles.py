"""Percentiles dealt by ranges against those of Spark."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import quality, quantiles


@pytest.fixture
def values(spark):
    rng = random.Random(4)
    rows = [("a", rng.random()) for _ in range(997)] + [("b", float(rng.randrange(3))) for _ in range(500)] + [("c", 2.5), ("d", None), ("b", None)]
    return spark.createDataFrame(rows, "image_id string, v double")


def test_same_as_percentile(values):
    got = {r.image_id: (r.low, r.half, r.high) for r in quantiles.percentiles(values, ["image_id"], "v", low=0.0, half=0.5, high=0.9).collect()}
    want = {r.image_id: tuple(r)[1:] for r in values.groupBy("image_id").agg(*(F.percentile("v", F.lit(s)) for s in (0.0, 0.5, 0.9))).collect()}
    del want["d"]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert quantiles.percentiles(values, [], "v", x=0.995).first().x == pytest.approx(values.agg(F.percentile("v", F.lit(0.995)).alias("x")).first().x, abs=1e-12)
    assert [tuple(r) for r in quantiles.percentiles(values.where("v > 9"), [], "v", x=0.5).collect()] == [(None,)]

def test_report_holds_no_values_of_a_group(spark, monkeypatch):
    """The report's medians and percentile are taken without the aggregates that gather a group's values in one task."""
    def refused(*_):
        raise AssertionError("gathers all values")

    monkeypatch.setattr(F, "percentile", refused)
    monkeypatch.setattr(F, "median", refused)
    p = spark.createDataFrame([("a", y, x, float(50 + y + x), 0.0, 0.0) for y in range(12) for x in range(12)], "image_id string, y long, x long, l double, a double, b double")
    assert quality.source_quality(p, 3, 1.0, 9, 1).first().regions > 0
