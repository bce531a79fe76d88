import math
import random

import numpy as np
import pytest
from conftest import records
from pyspark.sql import functions as F

from hierfeat.operators import slices
from hierfeat.operators.quantiles import column_quantiles, quantiles
from hierfeat.operators.skew import find_hot_keys, split_hot


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("parts", [1, 2, 7, 50])
def test_running_totals_of_a_dominant_group(spark, parts):
    rng = random.Random(parts)
    rows = [("big" if i % 3 else f"g{i % 11}", float(i), rng.randint(0, 9)) for i in range(400)]
    df = make(spark, rows, "g string, at double, v int")
    got = slices.running_totals(slices.by_value(df, "at", parts), {"before": F.col("v")}, ["at"], ["g"])
    expected = []
    seen = {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        expected.append((g, at, v, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + v
    assert sorted((r.g, r.at, r.v, r.before) for r in got.collect()) == sorted(expected)


def test_running_totals_keep_a_null_group(spark):
    df = make(spark, [(None, 1.0), (None, 2.0), ("a", 1.0)], "g string, at double")
    got = slices.row_index(slices.by_value(df, "at", 4), ["at"], ["g"])
    assert sorted((str(r.g), r.at, r.row_idx) for r in got.collect()) == [
        ("None", 1.0, 0),
        ("None", 2.0, 1),
        ("a", 1.0, 0),
    ]


def test_row_index_counts_on_over_slices(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7 % 1000).repartition(5)
    got = slices.row_index(slices.by_value(df, "k", 16), ["k"])
    assert got.filter("row_idx <> k").count() == 0


def nearest(values, q):
    return sorted(values)[math.floor((len(values) - 1) * q + 0.5)]


@pytest.mark.parametrize("accuracy", [50, 10_000])
@pytest.mark.parametrize("shape", ["uniform", "ties", "skewed", "few"])
def test_quantiles_are_exact(spark, accuracy, shape):
    rng = random.Random(7)
    n = {"few": 5}.get(shape, 3000)
    draw = {
        "uniform": rng.random,
        "ties": lambda: float(rng.randint(0, 3)),
        "skewed": lambda: rng.random() ** 30 * 1e9,
        "few": rng.random,
    }[shape]
    values = {"a": [draw() for _ in range(n)], "b": [draw() for _ in range(n // 2 + 1)]}
    df = make(spark, [(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    fractions = [0.0, 0.25, 0.5, 0.75, 1.0]
    for row in quantiles(df, ["g"], "v", fractions, "nearest", accuracy).collect():
        assert [row[f"q{i}"] for i in range(5)] == [nearest(values[row.g], q) for q in fractions]
        assert row.n == len(values[row.g])
    for row in quantiles(df, ["g"], "v", fractions, "linear", accuracy).collect():
        expected = np.quantile(values[row.g], fractions)
        np.testing.assert_allclose([row[f"q{i}"] for i in range(5)], expected, rtol=1e-12)


@pytest.mark.parametrize("accuracy", [40, 10_000])
def test_nan_sorts_last_and_null_is_left_out(spark, accuracy):
    nan, inf = float("nan"), float("inf")
    rows = [(None,)] * 50 + [(float(i),) for i in range(100)] + [(inf,)] * 20 + [(-inf,)] * 20 + [(nan,)] * 260
    df = make(spark, rows, "v double")
    row = column_quantiles(df, ["v"], [0.0, 0.2, 0.33, 0.9], "nearest", accuracy).first()
    assert row.n == 400 and row.q0 == -inf
    assert row.q1 == 60.0  # rank 80 of 20 low, 100 whole, 20 high, 260 NaN
    assert row.q2 == inf
    assert math.isnan(row.q3)


@pytest.mark.parametrize("collected", [100, 1])
def test_hot_keys_are_split_exactly(spark, collected):
    df = make(spark, [(1, i) for i in range(50)] + [(None, i) for i in range(40)] + [(2, 0), (3, 0)], "k int, v int")
    hot = find_hot_keys(df, ["k"], columns=2, cells=40, collected=collected, giant=0.5)
    assert sorted((str(r.k), r._giant) for r in hot.table.collect()) == [("1", True), ("None", False)]
    assert [r.k for r in hot.only(giant=True).table.collect()] == [1]
    ordinary, heavy = split_hot(df, ["k"], hot)
    assert ordinary.count() == 2 and heavy.count() == 90
    assert find_hot_keys(df, ["k"], cells=50) is None
    # at most two keys can hold more than half of the rows each
    assert find_hot_keys(df, ["k"], cells=0, most=2).table.count() == 1


@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_quantiles_of_values_cut_into_many_slices(spark, monkeypatch, method):
    """Brackets narrow enough that ranks lie between gaps and slices."""
    n = 30_000
    df = spark.range(n).selectExpr("id % 2 AS g", "double(pmod(id * 7919, 30000)) AS v")
    found = quantiles(df, ["g"], "v", [0.1, 0.25, 0.5, 0.9], method, accuracy=500)
    for g, rows in df.toPandas().groupby("g"):
        values = np.sort(rows["v"].to_numpy())
        want = np.quantile(values, [0.1, 0.25, 0.5, 0.9], method="linear" if method == "linear" else "closest_observation")
        got = found.filter(F.col("g") == int(g)).first()
        if method == "linear":
            assert [got[f"q{i}"] for i in range(4)] == pytest.approx(want)
        else:
            assert [got[f"q{i}"] for i in range(4)] == [values[round((len(values) - 1) * q)] for q in (0.1, 0.25, 0.5, 0.9)]
