import math

import pytest
from conftest import records
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from hierfeat.operators import impute
from hierfeat.operators.impute import Imputer, ImputerModel


def test_median_state_and_drifted_test_table(spark):
    train = spark.createDataFrame(
        [(1, 0, 10.0), (2, 1, 20.0), (3, 0, None)], "case_id bigint, target bigint, feature1 double"
    )
    model = Imputer().fit(train)
    assert model.medians == {"feature1": 15.0}
    assert model.final_columns == ["case_id", "feature1", "feature1_is_null"]
    done = records(model.transform_training(train))
    assert done[2] == {"case_id": 3, "target": 0, "feature1": 15.0, "feature1_is_null": 1}
    test = spark.createDataFrame([(6, 999.0)], "case_id bigint, feature2 double")
    assert records(model.transform(test)) == [{"case_id": 6, "feature1": 15.0, "feature1_is_null": 0}]


def mixed(spark):
    rows = [(1, 0, 1.0, "A", True), (2, 1, float("nan"), "A", False), (3, 0, 3.0, None, None)]
    rows += [(4, 1, None, "B", True), (5, 0, 5.0, "B", False)]
    return spark.createDataFrame(rows, "case_id int, target int, num float, cat string, flag boolean")


def test_missing_values_categories_and_unseen_ones(spark):
    model = Imputer().fit(mixed(spark))
    # NaN sorts last in the median, as in 1, 3, 5, NaN.
    assert model.medians["num"] == 4.0
    done = {r["case_id"]: r for r in records(model.transform_training(mixed(spark)))}
    assert [done[i]["num_is_null"] for i in range(1, 6)] == [0, 1, 0, 1, 0]
    assert done[2]["num"] == done[4]["num"] == 4.0
    assert [done[i]["cat"] for i in range(1, 6)] == [2, 2, 1, 2, 2]
    assert [done[i]["flag"] for i in range(1, 6)] == [2, 2, 1, 2, 2]
    new = spark.createDataFrame([(9, 7.0, "Z")], "case_id int, num float, cat string")
    assert records(model.transform(new)) == [{"case_id": 9, "num": 7.0, "cat": 1, "flag": 1, "num_is_null": 0}]


def test_state_round_trip(spark, tmp_path):
    model = Imputer().fit(mixed(spark))
    model.save(str(tmp_path))
    again = ImputerModel.load(spark, str(tmp_path))
    assert (again.numeric, again.categorical, again.medians, again.final_columns) == (
        model.numeric,
        model.categorical,
        model.medians,
        model.final_columns,
    )
    assert records(again.transform(mixed(spark))) == records(model.transform(mixed(spark)))
    with pytest.raises(AnalysisException):
        ImputerModel.load(spark, str(tmp_path / "nowhere"))


def test_alignment_fills_unknown_columns_with_zero(spark):
    train = spark.createDataFrame([(1, 5, "2020-01-01", 1.0)], "case_id int, WEEK_NUM int, d string, x double")
    train = train.withColumn("d", F.to_date("d"))
    model = Imputer().fit(train)
    assert model.final_columns == ["case_id", "WEEK_NUM", "d", "x", "x_is_null"]
    assert records(model.transform(train.drop("WEEK_NUM"))) == [
        {"case_id": 1, "WEEK_NUM": 0, "d": 0, "x": 1.0, "x_is_null": 0}
    ]


def test_rejects_tables_that_cannot_be_aligned(spark):
    model = Imputer().fit(mixed(spark))
    with pytest.raises(ValueError, match="case_id"):
        model.transform(mixed(spark).drop("case_id"))
    with pytest.raises(ValueError, match="numeric in training"):
        model.transform(mixed(spark).withColumn("num", F.lit("x")))


def test_a_column_of_nulls_gets_zero(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "case_id int, x double")
    assert Imputer().fit(df).medians == {"x": 0.0}
    assert math.isclose(Imputer(medians="approx").fit(df.fillna(3.0)).medians["x"], 3.0)


@pytest.mark.parametrize(
    ("literal", "broadcast", "size"), [(64, 100_000, 2**20), (2, 100_000, 2**20), (2, 3, 2**20), (2, 100_000, 5)]
)
def test_every_lookup_gives_the_same_counts(spark, monkeypatch, literal, broadcast, size):
    """Few values, many values, and very many with a hot one and nulls."""
    monkeypatch.setattr(impute, "LITERAL_LEVELS", literal)
    monkeypatch.setattr(impute, "BROADCAST_LEVELS", broadcast)
    monkeypatch.setattr(impute, "BROADCAST_BYTES", size)
    rows = [(i, None if i % 10 == 0 else ("hot" if i % 3 == 0 else f"v{i % 7}"), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a string, b string").repartition(3)
    counts = {}
    for _, a, _ in rows:
        counts[a] = counts.get(a, 0) + 1
    got = impute.frequency_encode(df, ["a", "b"], "id").collect()
    assert len(got) == 300
    assert {r.id: r.a for r in got} == {i: counts[a] for i, a, _ in rows}
    assert {r.b for r in got} == {300}
    freqs = impute.value_counts(df, ["a"])
    unseen = spark.createDataFrame([(1, "new"), (2, "hot")], "id int, a string")
    coded = records(impute.encode_counts(unseen, freqs, ["a"], F.col("id")))
    assert coded == [{"id": 1, "a": 1}, {"id": 2, "a": counts["hot"]}]


def test_many_large_columns_take_one_join_and_long_hot_values_are_salted(spark, monkeypatch):
    """Repeated rows, nulls and a hot value too long for a literal; the plan does not grow with the columns."""
    monkeypatch.setattr(impute, "LITERAL_LEVELS", 0)
    monkeypatch.setattr(impute, "LITERAL_BYTES", 20)
    hot, names = "long " * 9, ["a", "b", "c", "d"]
    rows = [(i % 50, *[None if i % 11 == 0 else hot if i % 3 == j % 3 else f"{n}{i % (5 + j)}" for j, n in enumerate(names)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string, d string").repartition(3)
    got = impute.frequency_encode(df, names, "id", broadcast_bytes=0)
    want = []
    for r in rows:
        want.append((r[0], *[sum(o[1 + j] == r[1 + j] for o in rows) for j in range(4)]))
    assert sorted(map(tuple, got.collect())) == sorted(want)

    def joins(columns):
        plan = impute.frequency_encode(df, columns, "id", broadcast_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Join ")

    assert joins(names) == joins(names[:1]) == 2


def test_broadcast_tables_are_bounded_together(monkeypatch):
    monkeypatch.setattr(impute, "LITERAL_LEVELS", 2)
    sizes = {c: {"levels": n, "bytes": 10 * n, "total": 100} for c, n in [("a", 50), ("b", 60), ("c", 2), ("d", 70)]}
    assert impute._lookup_kinds(["d", "a", "b", "c", "new"], sizes, 1_200) == (["c", "new"], ["d"])
    assert impute._lookup_kinds(["d", "a", "b", "c"], sizes, 600) == (["c"], ["d", "b"])
    monkeypatch.setattr(impute, "BROADCAST_LEVELS", 49)
    assert impute._lookup_kinds(["a", "c"], sizes, 10**6) == (["c"], ["a"])
