"""Running totals, leads and quantiles: the split way against the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import metrics, quantiles
from wayfold.operators.ordered import first_rows, leads, number_rows, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; one key is null."""
    rng = random.Random(3)
    data = [("hot", i, float(rng.randrange(60))) for i in range(3000)]
    data += [(f"k{i % 40}", 5000 + i, float(rng.randrange(9))) for i in range(200)]
    data += [(None, 9000 + i, float(i)) for i in range(30)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, id long, v double").repartition(6)


def test_running_totals_split(skewed, rows):
    order = [F.col("id")]
    measures = {"total": F.col("v"), "place": F.lit(1)}
    plain = running_totals(skewed, ["k"], order, measures)
    split = running_totals(skewed, ["k"], order, measures, limit=50)
    assert rows(plain) == rows(split)


def test_running_totals_without_key(skewed, rows):
    order = [F.col("v").desc(), F.col("id")]
    assert rows(number_rows(skewed, [], order)) == rows(number_rows(skewed, [], order, limit=50))


def test_leads_split(skewed, rows):
    order = [F.col("id")]
    plain = leads(skewed, ["k"], order, ["v", "id"])
    split = leads(skewed, ["k"], order, ["v", "id"], limit=50)
    assert rows(plain) == rows(split.select(*plain.columns))


def test_first_rows_limits_before_the_shuffle(skewed, rows):
    few = first_rows(skewed, ["k"], [F.col("id")], 2)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert ("hot", 0) in rows(few, "k", "id") and ("hot", 2) not in rows(few, "k", "id")


def test_quantiles_split(skewed, rows):
    counts = quantiles.value_counts_by(quantiles.long_values(skewed, ["k"], ["v"]), ["k"])
    fractions = {"lo": 0.05, "mid": 0.5, "hi": 0.95}
    plain = quantiles.quantiles_of_counts(counts, ["k"], fractions)
    split = quantiles.quantiles_of_counts(counts, ["k"], fractions, limit=5)
    digits = lambda df: rows(df.withColumns({c: F.round(c, 9) for c in fractions}))
    assert digits(plain) == digits(split)
    assert digits(plain) == digits(
        skewed.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(c) for c, q in fractions.items()])
    )


def test_medians_split_keep_empty_groups(spark, rows):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", None, 4.0)], "k string, x double, y double")
    expected = [("a", 2.0, None), ("b", None, 4.0)]
    assert rows(quantiles.medians_by(df, ["k"], ["x", "y"])) == expected
    assert rows(quantiles.medians_by(df, ["k"], ["x", "y"], limit=1)) == expected


def test_mode_tie_takes_the_smallest(spark, rows):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None)], "k string, c string")
    counts = quantiles.value_counts_by(quantiles.long_values(df, ["k"], ["c"], "string"), ["k"])
    assert rows(quantiles.modes_of_counts(counts, ["k"])) == [("a", "x")]


def test_bounds_split(skewed, rows):
    assert rows(quantiles.bounds(skewed, ["v", "id"])) == rows(quantiles.bounds(skewed, ["v", "id"], limit=20))


def test_limits_change_neither_names_order_types_nor_rows(spark, rows):
    """All-null, NaN and infinite columns on both sides of the limit."""
    inf, nan = float("inf"), float("nan")
    data = [(k, k % 3, float(k), None, nan if k % 5 == 0 else 1.0, inf if k > 20 else -inf) for k in range(40)]
    df = spark.createDataFrame(data, "o int, k int, v double, e double, n double, i double")
    for run in (
        lambda limit: quantiles.bounds(df, ["v", "e", "n", "i"], limit=limit),
        lambda limit: quantiles.medians_by(df, ["k"], ["v", "e", "n", "i"], limit=limit),
        lambda limit: leads(df, ["k"], [F.col("o")], ["v", "e"], limit=limit),
        lambda limit: number_rows(df, ["k"], [F.col("o")], limit=limit),
    ):
        small, large = run(8), run(1_000_000)
        assert small.dtypes == large.dtypes
        assert repr(rows(small)) == repr(rows(large))


def test_auc_with_ties_and_one_class(spark, rows):
    data = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.2), (0, 0.4)]
    df = spark.createDataFrame(data, "y int, s double")
    pairs = [(a, b) for (ya, a) in data for (yb, b) in data if ya == 1 and yb == 0]
    expected = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(expected)
    assert metrics.roc_auc(df, "y", "s", limit=1).first()[0] == pytest.approx(expected)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None
    assert rows(metrics.roc_curve(df, "y", "s")) == rows(metrics.roc_curve(df, "y", "s", limit=1))
