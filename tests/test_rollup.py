import random
from collections import Counter

import numpy as np
import pytest
from conftest import records
from pyspark.sql import functions as F

from hierfeat.operators.rollup import (
    rollup_categories,
    rollup_children,
    rollup_history,
    rollup_numeric,
    split_columns,
)
from hierfeat.operators.skew import find_hot_keys


def test_columns_by_kind(spark):
    df = spark.createDataFrame(
        [], "case_id int, num_group1 int, a double, b boolean, c date, x_joined_flag int, d decimal(5,1)"
    )
    assert split_columns(df) == (["x_joined_flag"], ["a", "d"], ["b", "c"])


def test_children_take_maximum_and_last(spark):
    rows = [
        (1, 0, 1, 5.0, "a", 1),
        (1, 0, 2, float("nan"), None, 1),
        (1, 1, 0, None, "b", 1),
        (2, 0, 0, 1.0, "x", 1),
        (2, 0, 0, 2.0, "y", 1),
    ]
    df = spark.createDataFrame(
        rows, "case_id int, num_group1 int, num_group2 int, v double, t string, y_joined_flag int"
    )
    for parts in (1, 7):
        got = records(rollup_children(df.repartition(parts)))
        assert got == [
            {"case_id": 1, "num_group1": 0, "v": 5.0, "t": None, "y_joined_flag": 1},
            {"case_id": 1, "num_group1": 1, "v": None, "t": "b", "y_joined_flag": 1},
            # equal in order: the greater value wins, whatever the partitioning
            {"case_id": 2, "num_group1": 0, "v": 2.0, "t": "y", "y_joined_flag": 1},
        ]


def test_nan_policies(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan"))], "case_id int, v double")
    assert rollup_numeric(df, ["case_id"], ["v"], iqr=None).first().v_max == 1.0
    assert np.isnan(rollup_numeric(df, ["case_id"], ["v"], iqr=None, nan_policy="propagate").first().v_max)
    with pytest.raises(ValueError):
        rollup_numeric(df, ["case_id"], ["v"], nan_policy="other")


def test_key_only_tables_become_distinct_keys(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 1)], "case_id int, num_group1 int, num_group2 int")
    assert records(rollup_children(df)) == [{"case_id": 1, "num_group1": 1}, {"case_id": 2, "num_group1": 1}]
    assert records(rollup_history(df)) == [{"case_id": 1}, {"case_id": 2}]


@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_hot_keys_give_the_same_numbers(spark, method):
    rng = random.Random(3)
    rows = [(1 if i % 3 else i % 17, rng.choice([None, rng.gauss(0, 100)]), rng.randint(0, 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "case_id int, a double, b int").repartition(5)
    nothing = None
    everything = find_hot_keys(df, ["case_id"], cells=0)
    many = find_hot_keys(df, ["case_id"], cells=0, collected=3, giant=0.5)
    some = find_hot_keys(df, ["case_id"], columns=2, cells=400)
    assert many.only(giant=True).table.count() == some.table.count() == 1
    assert many.table.count() == everything.table.count() == 17
    results = [
        records(
            rollup_numeric(df, ["case_id"], ["a", "b"], iqr=method, hot=hot).withColumns(
                {c: F.round(c, 8) for c in ("a_mean", "a_std", "a_iqr", "b_mean", "b_std", "b_iqr")}
            )
        )
        for hot in (nothing, everything, many, some)
    ]
    assert results[0] == results[1] == results[2] == results[3]
    for row in results[0]:
        a = [x for k, x, _ in rows if k == row["case_id"] and x is not None]
        if a and method == "linear":
            assert row["a_iqr"] == pytest.approx(np.quantile(a, 0.75) - np.quantile(a, 0.25), abs=1e-6)


def test_many_columns_give_the_same_numbers(spark, monkeypatch):
    rng = random.Random(8)
    rows = [
        (i % 9, rng.choice([None, rng.gauss(0, 9)]), rng.randint(0, 99), 2**60 + rng.randint(0, 9), rng.randint(0, 9))
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "case_id int, a double, b int, c bigint, d int")
    df = df.withColumn("d", F.col("d").cast("decimal(9,2)")).withColumn("e", F.col("a").cast("float"))
    columns = ["a", "b", "c", "d", "e"]

    def rolled(width):
        monkeypatch.setattr("hierfeat.operators.rollup.WIDE_COLUMNS", width)
        got = rollup_numeric(df, ["case_id"], columns, hot=None)
        names = [f"{c}_{s}" for c in columns for s in ("mean", "std", "iqr")]
        return got.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names}).select(*sorted(got.columns))

    wide, long = rolled(20), rolled(0)
    assert dict(wide.dtypes) == dict(long.dtypes)
    assert records(wide) == records(long)


def test_many_columns_shuffle_rows_not_cells(spark, monkeypatch):
    """Rows of ordinary keys are shuffled once, before they become cells; the missing key and other hot ones are combined first."""
    monkeypatch.setattr("hierfeat.operators.rollup.HOT_CELLS", 0)
    df = spark.range(600).selectExpr("nullif(id % 150, 0) AS case_id", *[f"double(id + {i}) AS a{i}" for i in range(25)])
    plan = rollup_numeric(df, ["case_id"], df.columns[1:], iqr=None, hot=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    # From the last step up to the first: the cells are made after the exchange.
    assert plan.index("Generate posexplode") < plan.index("Exchange hashpartitioning")
    skewed = df.union(df.withColumn("case_id", F.lit(None).cast("bigint")))
    hot = find_hot_keys(skewed.select("case_id"), ["case_id"], cells=100)
    for iqr in (None, "nearest"):
        split = rollup_numeric(skewed, ["case_id"], df.columns[1:], iqr=iqr, hot=hot)
        whole = rollup_numeric(skewed, ["case_id"], df.columns[1:], iqr=iqr, hot=None)
        names = [c for c in whole.columns if c.endswith(("_mean", "_std"))]
        rounded = [x.withColumns({c: F.round(c, 6) for c in names}) for x in (split, whole)]
        assert split.columns == whole.columns and records(rounded[0]) == records(rounded[1])
    exchanges = [line for line in split._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(case_id" in line]
    assert any("_pos" in line for line in exchanges)


def brute(rows):
    """Seven statistics of (order, value) rows."""
    rows = sorted(rows)
    values = [v for _, v in rows]
    counts = Counter(v for v in values if v is not None)
    top = max(counts.values(), default=0)
    modes = [v for v, n in counts.items() if n == top]
    return {
        "last": values[-1],
        "first": values[0],
        "mode": max(modes, default=None),
        "mode_count": top,
        "last_count": counts.get(values[-1], 0),
        "first_count": counts.get(values[0], 0),
        "n_modes": len(modes),
    }


def test_categories_against_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (1 if i % 3 else i % 40, i, rng.choice(["a", "b", "c", None]), rng.choice([True, False, None]))
        for i in range(600)
    ]
    schema = "case_id int, num_group1 int, t string, b boolean"
    for parts in (1, 6):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        got = rollup_categories(df, ["case_id"], ["t", "b"], ["num_group1"]).collect()
        assert len(got) == len({r[0] for r in rows})
        for row in got:
            for at, name in ((2, "t"), (3, "b")):
                expected = brute([(r[1], r[at]) for r in rows if r[0] == row.case_id])
                assert {k: row[f"{name}_{k}"] for k in expected} == expected


def test_a_column_of_nulls_counts_nothing(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None)], "case_id int, num_group1 int, t string")
    assert records(rollup_categories(df, ["case_id"], ["t"], ["num_group1"])) == [
        {"case_id": 1, "t_last": None, "t_first": None, "t_mode": None, "t_mode_count": 0, "t_last_count": 0}
        | {"t_first_count": 0, "t_n_modes": 0}
    ]


def test_no_categories_of_nested_types(spark):
    df = spark.createDataFrame([(1, 1, [1])], "case_id int, num_group1 int, t array<int>")
    with pytest.raises(ValueError, match="array"):
        rollup_categories(df, ["case_id"], ["t"], ["num_group1"])


def test_history_columns_follow_the_table(spark):
    df = spark.createDataFrame(
        [(1, 1, "a", 2.0, 1)], "case_id int, num_group1 int, t string, v double, x_joined_flag int"
    )
    got = rollup_history(df)
    assert got.columns[:4] == ["case_id", "t_last", "t_first", "t_mode"]
    assert got.columns[-6:] == ["v_max", "v_min", "v_mean", "v_std", "v_iqr", "x_joined_flag"]
    row = got.first()
    assert row.v_std is None and row.v_iqr == 0.0 and row.x_joined_flag == 1


def test_null_key_is_a_group_whatever_the_width_and_size(spark):
    rows = [(k, i, float(i * i % 7), i, "ab"[i % 2]) for i, k in enumerate([1, 1, 2, None, None, None, 2] * 3)]
    df = spark.createDataFrame(rows, "case_id int, num_group1 int, a double, b bigint, c string")
    wide = df.select("*", *[(F.col("a") + i).alias(f"a{i}") for i in range(25)])
    for table in (df, wide, wide.drop("c"), wide.drop("b", "c")):
        found = rollup_history(table)
        forced = rollup_history(table, hot=find_hot_keys(table.select("case_id"), ["case_id"], cells=1))
        assert sorted(r["case_id"] or 0 for r in found.collect()) == [0, 1, 2]
        assert records(forced) == records(found)
        assert rollup_history(table, null_keys=False).count() == 2


def test_category_values_keep_their_type_in_any_time_zone(spark):
    """Two instants of the hour that is repeated when daylight saving ends stay two values."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [(1, 0, 1604206800), (1, 1, 1604210400), (1, 2, 1604210400)]
        df = spark.createDataFrame(rows, "case_id int, num_group1 int, s bigint")
        df = df.selectExpr("case_id", "num_group1", "timestamp_seconds(s) AS at", "s > 1604206800 AS flag", "string(num_group1) AS t")
        row = rollup_categories(df, ["case_id"], ["at", "flag", "t"], ["num_group1"]).selectExpr(
            "unix_seconds(at_last) AS last", "at_last_count", "at_n_modes", "unix_seconds(at_mode) AS mode", "flag_mode", "t_n_modes", "t_mode"
        )
        assert tuple(row.first()) == (1604210400, 2, 1, 1604210400, True, 3, "2")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_ordinary_categories_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, 1, "a", True)], "case_id int, num_group1 int, c string, d boolean")
    plan = rollup_categories(df, ["case_id"], ["c", "d"], ["num_group1"], hot=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
