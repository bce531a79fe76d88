import numpy as np
import pytest
from conftest import records
from pyspark.sql import functions as F

from hierfeat.operators.prepare import (
    add_chunk_weights,
    add_class_weights,
    chunk_class_weights,
    class_counts,
    drop_low_variance,
    feature_columns,
    inverse_class_weight,
    prepare_features,
    split_by_week,
)
from hierfeat.operators.profile import describe
from hierfeat.operators.scale import ScalerModel, merge_moments, moments


def test_feature_columns_and_fills(spark):
    df = spark.createDataFrame(
        [(1, 1.1, "x", 0, 1, 202401, 5), (2, None, None, 1, 2, 202401, 5), (None, 3.3, "z", 0, 3, 202401, 5)],
        "a int, b double, c string, target int, case_id int, MONTH int, WEEK_NUM int",
    )
    assert feature_columns(df) == ["a", "b"]
    got = prepare_features(df, ["a", "b"])
    assert got.schema["a"].dataType.simpleString() == "float"
    assert [tuple(r) for r in got.orderBy("case_id").select("a", "b").collect()] == [
        (1.0, pytest.approx(1.1)),
        (2.0, 0.0),
        (0.0, pytest.approx(3.3)),
    ]
    nan = spark.createDataFrame([(float("nan"),)], "a double")
    assert prepare_features(nan, ["a"]).first().a == 0.0


def test_low_variance(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, 1.001, None)], "a double, b double, c double")
    assert drop_low_variance(df, ["a", "b", "c"]) == ["a"]


def test_split_by_week(spark):
    df = spark.createDataFrame([(w,) for w in range(20)] + [(None,)], "WEEK_NUM int")
    train, val = split_by_week(df)
    assert sorted(r[0] for r in train.collect()) == list(range(8))
    assert sorted(r[0] for r in val.collect()) == list(range(8, 20))


def test_class_weights(spark):
    df = spark.createDataFrame([(1, 0)] * 8 + [(1, 1)] * 2 + [(2, 0)] * 3, "chunk int, target int")
    weights = {(r.chunk, r.target): (r.n, r.weight) for r in chunk_class_weights(df).collect()}
    assert weights == {(1, 0): (8, 0.625), (1, 1): (2, 2.5), (2, 0): (3, 0.5), (2, 1): (0, 1.5)}
    assert add_chunk_weights(df).agg(F.sum("weight")).first()[0] == pytest.approx(10 + 1.5)
    assert {r.label: r.n for r in class_counts(df).collect()} == {0: 11, 1: 2}
    assert {r.target: r.weight for r in inverse_class_weight(df).collect()} == {0: 1 / 11, 1: 0.5}
    assert add_class_weights(df).agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_any_number_of_classes(spark):
    df = spark.range(3000).selectExpr("id % 1500 AS target", "id")
    weighted = add_class_weights(df)
    assert weighted.count() == 3000 and weighted.filter("abs(weight - 1) > 1e-12").count() == 0
    none = spark.createDataFrame([(None,), (1,)], "target int")
    assert sorted(r.weight or 0.0 for r in add_class_weights(none).collect()) == [0.0, 1.0]


def test_scaler_numbers(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0), (7.0, 8.0, 9.0), (10.0, 11.0, 12.0)], "a double, b double, c double")
    model = ScalerModel.fit(df, ["a", "b", "c"])
    assert model.mean == [5.5, 6.5, 7.5] and model.var == pytest.approx([15.0] * 3)


def test_scaler_transform_clamp_and_constant_columns(spark):
    train = spark.createDataFrame([(10.0, 1.0), (10.0, 3.0)], "a double, b double")
    model = ScalerModel.fit(train, ["a", "b"])
    got = model.transform(train).collect()
    assert [tuple(r) for r in got] == [(0.0, pytest.approx(-(0.5**0.5))), (0.0, pytest.approx(0.5**0.5))]
    far = spark.createDataFrame([(1e9, -1e9), (float("nan"), None)], "a double, b double")
    first, second = model.transform(far).collect()
    assert tuple(first) == (10.0, -10.0)
    assert np.isnan(second.a) and second.b is None


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(3.0,)], "a double")
    assert ScalerModel.fit(one, ["a"]).var == [0.0]
    with pytest.raises(ValueError, match="no values"):
        ScalerModel.fit(one.limit(0), ["a"])


@pytest.mark.parametrize("sizes", [(200, 200, 200), (300,), (100, 300, 50, 0)])
def test_merged_moments_equal_a_full_fit(spark, sizes):
    rng = np.random.default_rng(1)
    values = rng.normal(1e6, 1.0, size=(sum(sizes), 3))
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    rows = [(int(c), *map(float, v)) for c, v in zip(chunk, values, strict=True)]
    df = spark.createDataFrame(rows, "chunk int, f0 double, f1 double, f2 double")
    columns = ["f0", "f1", "f2"]
    parts = moments(df, columns, by=["chunk"]).unionByName(
        moments(df.limit(0), columns).withColumn("chunk", F.lit(-1))
    )
    model = ScalerModel.from_moments(parts.drop("chunk"))
    np.testing.assert_allclose(model.mean, values.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(model.var, values.var(axis=0, ddof=1), rtol=1e-8)
    assert merge_moments(parts).count() == 3


def test_scaler_round_trip_and_checks(spark, tmp_path):
    model = ScalerModel(["b", "a"], [1.0, 2.0], [3.0, 4.0])
    model.save(spark, str(tmp_path / "s"))
    assert ScalerModel.load(spark, str(tmp_path / "s")) == model
    raw = spark.createDataFrame([(0, "b", 1.0, 3.0), (1, "a", 2.0, 4.0)], "pos int, col string, mean double, var double")
    raw.write.parquet(str(tmp_path / "raw"))
    assert ScalerModel.load(spark, str(tmp_path / "raw")) == model
    assert ScalerModel(["a", "b"], [0.0, 1.0], [1e-5, 2.0]).varying() == ScalerModel(["b"], [1.0], [2.0])
    with pytest.raises(ValueError, match="3 features"):
        model.check(["a", "b", "c"])
    with pytest.raises(ValueError, match="order"):
        model.check(["a", "b"])


def test_describe(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", None), (3, None, 4.0), (4, "c", 2.0)], "i int, t string, x double")
    got = {r["col"]: r for r in records(describe(df))}
    assert got["i"]["q50"] == 3.0 and got["i"]["mean"] == 2.5 and got["i"]["q25"] == 2.0
    assert got["x"]["null_count"] == 1 and got["x"]["count"] == 3 and got["x"]["max"] == 4.0
    assert got["t"]["min_text"] == "a" and got["t"]["max_text"] == "c" and got["t"]["mean"] is None
    assert {r["col"]: r["q50"] for r in records(describe(df, "linear"))} == {"i": 2.5, "x": 2.0, "t": None}
    assert records(describe(df.select("t")))[0]["q50"] is None
