"""Numbering of whole tables by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.plans.numbering import numbered


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_numbers_equal_a_sort(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, 1.0, 1.0, 1.0, float("nan"), rng.random(), -0.0]), f"T{i:05d}") for i in range(n)]
    df = spark.createDataFrame(rows, "x double, ticker string").repartition(7)
    got, total = numbered(df, F.col("x").desc_nulls_last(), F.asc("ticker"), name="place")
    want = [r.ticker for r in df.orderBy(F.col("x").desc_nulls_last(), "ticker").collect()]
    assert total == n and [r.ticker for r in sorted(got.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in got.collect()) == list(range(1, n + 1))


def test_no_window_over_the_whole_table(spark):
    df = spark.range(100).selectExpr("id % 3 AS x", "id AS ticker")
    got, _ = numbered(df, F.asc("x"), F.asc("ticker"))
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
