import random

import numpy as np
import pytest
from conftest import records
from pyspark.sql import functions as F

from hierfeat.operators import evaluate

FIXTURE = [0.1, 0.9, 0.2, 0.8, 0.3, 0.7, 0.4, 0.6, 0.5, 0.5, 0.4, 0.6]


def fixture(spark):
    rows = [(i // 4, i % 2, p) for i, p in enumerate(FIXTURE)]
    return spark.createDataFrame(rows, "WEEK_NUM int, target int, score double").repartition(3)


def test_three_weeks(spark):
    weekly = {r.WEEK_NUM: r.gini for r in evaluate.weekly_gini(fixture(spark)).collect()}
    assert weekly == {0: 1.0, 1: 1.0, 2: 0.75}
    row = evaluate.gini_stability(fixture(spark)).first()
    assert row.falling_rate == pytest.approx(-0.125)
    assert row.std_residuals == pytest.approx(0.0589255, abs=1e-6)
    assert row.stability_metric == pytest.approx(2.75 / 3 - 88 * 0.125 - 0.5 * 0.0589255, abs=1e-5)


def test_one_valid_week_gives_zeros(spark):
    df = fixture(spark).withColumn("target", F.when(F.col("WEEK_NUM") > 0, 1).otherwise(F.col("target")))
    assert evaluate.weekly_gini(df).count() == 1
    row = evaluate.gini_stability(df).first()
    assert (row.stability_metric, row.mean_gini, row.falling_rate, row.std_residuals) == (0, 0, 0, 0)


def auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_a_week_with_most_rows(spark):
    rng = random.Random(2)
    rows = [(1 if i % 4 else i % 9, rng.randint(0, 1), rng.choice([rng.random(), 0.5, 0.25])) for i in range(1500)]
    df = spark.createDataFrame(rows, "WEEK_NUM int, target int, score double").repartition(4)
    for r in evaluate.weekly_gini(df).collect():
        mine = [(s, y) for w, y, s in rows if w == r.WEEK_NUM]
        assert r.auc == pytest.approx(auc(mine), abs=1e-12)


def test_average_precision(spark):
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.2), round(rng.random(), 2)) for _ in range(800)]
    got = evaluate.average_precision(spark.createDataFrame(rows, "target int, score double")).first()
    area, last = 0.0, 0.0
    positives = sum(y for y, _ in rows)
    for cut in sorted({s for _, s in rows}, reverse=True):
        caught = [y for y, s in rows if s >= cut]
        recall = sum(caught) / positives
        area += (recall - last) * sum(caught) / len(caught)
        last = recall
    assert got.average_precision == pytest.approx(area, abs=1e-12)


def test_calibration(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (0, 0.3), (1, 0.8)], "target int, score double")
    assert [tuple(r) for r in evaluate.calibration_curve(df, bins=2).orderBy("bin").collect()] == [
        (0, 2, 0.2, 0.0),
        (1, 2, pytest.approx(0.85), 1.0),
    ]
    tied = spark.createDataFrame([(0, 0.5)] * 6 + [(1, 0.7)], "target int, score double")
    assert evaluate.calibration_curve(tied).count() == 2


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=500), "b": np.full(7, 2.5)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    got = evaluate.histogram(spark.createDataFrame(rows, "population string, energy double"), bins=20)
    for name, vs in values.items():
        bars = got.filter(F.col("population") == name).orderBy("bin").collect()
        density, edges = np.histogram(vs, bins=20, density=True)
        np.testing.assert_allclose([r.density for r in bars], density, atol=1e-12)
        np.testing.assert_allclose([r.low for r in bars], edges[:-1], atol=1e-12)


def test_periods_drift_and_trajectory(spark):
    rows = [(1, float(i)) for i in range(5)] + [(2, 10.0)]
    df = spark.createDataFrame(rows, "MONTH int, energy double")
    got = {r["MONTH"]: r for r in records(evaluate.energy_by_period(df, "MONTH"))}
    assert got[1]["mean"] == 2.0 and got[1]["p50"] == 2.0 and got[1]["p05"] == pytest.approx(0.2)
    assert got[1]["std"] == pytest.approx(2.0**0.5) and got[2]["std"] == 0.0
    drift = evaluate.energy_drift(df, evaluate.energy_summary(df.filter("MONTH = 1")))
    summary = {r["MONTH"]: r for r in records(evaluate.drift_summary(drift, "MONTH"))}
    assert summary[1]["n_ood"] == 0 and summary[2]["share_ood"] == 1.0
    log = spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, 4.0)], "step int, e_real double, e_fake double")
    assert records(evaluate.energy_trajectory(log)) == [{"step": 0, "e_real": 2.0, "e_fake": 3.0}]


def test_any_number_of_populations_and_periods(spark):
    df = spark.range(6000).selectExpr("id % 3000 AS population", "id % 3000 AS MONTH", "double(id) AS energy")
    bins = evaluate.histogram(df, bins=2)
    assert bins.count() == 6000 and bins.filter("n <> 1").count() == 0
    months = evaluate.energy_by_period(df, "MONTH")
    assert months.count() == 3000 and months.filter("abs(p50 - mean) > 1e-9").count() == 0


def test_infinite_scores(spark):
    infinite = float("inf")
    rows = [(1, s, y) for s, y in [(-infinite, 0), (0.1, 1), (0.2, 0), (0.3, 1), (infinite, 1), (infinite, 0)] * 9]
    df = spark.createDataFrame(rows, "WEEK_NUM int, score double, target int")
    pairs = [(a, b) for _, a, y in rows if y for _, b, z in rows if not z]
    auc = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert evaluate.weekly_gini(df).first()["auc"] == pytest.approx(auc)
    assert 0 < evaluate.average_precision(df).first()["average_precision"] < 1


def test_calibration_bins_count_known_targets_only(spark):
    rows = [(i / 100, i % 2 if i < 50 else None) for i in range(100)]
    curve = evaluate.calibration_curve(spark.createDataFrame(rows, "score double, target int"))
    assert [r["n"] for r in curve.orderBy("bin").collect()] == [5] * 10


def test_loss_terms(spark):
    real = spark.createDataFrame([(1, [0.0, 1.0], 2.0), (0, [0.5, -0.5], 1.0)], "target int, logits array<double>, w double")
    fake = spark.createDataFrame([([0.0, 0.0],)], "logits array<double>")
    row = evaluate.loss_terms(real, fake, weight="w").first()
    lse = np.log([1 + np.e, np.exp(0.5) + np.exp(-0.5)])
    entropy = lse - np.array([1.0, 0.5])
    assert row.clf_loss == pytest.approx((entropy * [2, 1]).mean())
    assert row.clf_loss_normed == pytest.approx((entropy * [2, 1]).sum() / 3)
    assert row.gen_loss == pytest.approx(-lse.mean() + np.log(2))
    assert row.l2_loss == pytest.approx(1e-4 * ((lse**2).mean() + np.log(2) ** 2))
    assert row.total_loss == pytest.approx(row.clf_loss + row.gen_loss + row.l2_loss)


def test_reconstruction_error(spark):
    rows = [([1.0] * 3, [0.0] * 3, w) for w in (1.0, 2.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>, w double")
    assert evaluate.reconstruction_error(df, "x", "y", "w").first().weighted_mse == 1.125
    two = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([3.0, 4.0], [3.5, 4.5])], "x array<double>, y array<double>")
    assert evaluate.reconstruction_error(two, "x", "y").first().mse == 0.125
