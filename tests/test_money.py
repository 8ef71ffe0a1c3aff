"""Sums and means against exact arithmetic."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tallyward.functions.money import mean, mean_ratio_pct, ratio_pct, total


@pytest.fixture(scope="module")
def amounts():
    pick = random.Random(7)
    return [(f"g{pick.randrange(300)}", None if pick.random() < 0.1 else Decimal(pick.randrange(-500_000, 2_000_000)) / 100,
             pick.randrange(50)) for _ in range(3000)]


@pytest.mark.parametrize("scale", [0, 1, 2])
def test_means_and_totals_round_half_up_once(spark, amounts, scale):
    df = spark.createDataFrame(amounts, "g string, x decimal(18,2), n int").repartition(7)
    out = {r.g: r for r in df.groupBy("g").agg(
        mean("x", scale).alias("mean"), total("x", scale).alias("total"),
        mean("n", scale).alias("count_mean")).collect()}
    step = Decimal(1).scaleb(-scale)
    for group in {g for g, _, _ in amounts}:
        known = [x for g, x, _ in amounts if g == group and x is not None]
        counts = [n for g, _, n in amounts if g == group]
        if known:
            assert out[group].mean == float((sum(known) / len(known)).quantize(step, ROUND_HALF_UP))
            assert out[group].total == float(sum(known).quantize(step, ROUND_HALF_UP))
        else:
            assert out[group].mean is None and out[group].total is None
        assert out[group].count_mean == float((Decimal(sum(counts)) / len(counts)).quantize(step, ROUND_HALF_UP))


def test_ratios_without_a_whole_are_null(spark):
    df = spark.createDataFrame([(Decimal(1), Decimal(0)), (Decimal(0), Decimal(0))], "p decimal(18,2), w decimal(18,2)")
    row = df.agg(ratio_pct("p", "w").alias("r"), mean_ratio_pct("p", "w").alias("m")).first()
    assert row.r is None and row.m is None


def test_large_sums_stay_exact(spark):
    df = spark.range(1000).select(F.lit(Decimal("9999999999999999.99")).alias("x"))
    assert df.agg(F.sum("x").alias("s")).first().s == Decimal("9999999999999999990.00")
    assert df.agg(mean("x", 2).alias("m")).first().m == 1e16
