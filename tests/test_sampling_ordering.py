import pytest
from conftest import records
from pyspark.sql import functions as F

from hierfeat.operators import ordering
from hierfeat.operators.assemble import (
    add_joined_flag,
    attach_children,
    fill_joined_flags,
    join_to_base,
    restrict,
)
from hierfeat.operators.skew import find_hot_keys
from hierfeat.operators.sampling import balanced_resample, random_subset, stratified_sample


@pytest.fixture(scope="module")
def base(spark):
    return spark.range(1000).select(
        F.col("id").alias("case_id"),
        F.when(F.col("id") % 100 == 7, None).when(F.col("id") % 10 == 0, 1).otherwise(0).alias("target"),
    )


@pytest.mark.parametrize("ratio", [0.05, 0.3, 0.999])
@pytest.mark.parametrize("digits", [1, 4])
def test_exact_share_per_class(spark, base, ratio, digits, monkeypatch):
    monkeypatch.setattr("hierfeat.operators.sampling.SLICE_DIGITS", digits)
    ids = stratified_sample(base, ratio)
    got = restrict(base, ids).groupBy("target").count().collect()
    assert {r.target: r["count"] for r in got} == {0: int(890 * ratio), 1: int(100 * ratio)}
    again = stratified_sample(base.repartition(7), ratio)
    assert records(ids) == records(again)


def test_larger_samples_hold_smaller_ones(spark, base):
    for exact in (True, False):
        small = {r.case_id for r in stratified_sample(base, 0.1, exact=exact).collect()}
        large = {r.case_id for r in stratified_sample(base, 0.4, exact=exact).collect()}
        other = {r.case_id for r in stratified_sample(base, 0.1, random_state=1, exact=exact).collect()}
        assert small < large and small != other


@pytest.mark.parametrize("ratio", [1.0, 2.0, 0.0, -1.0])
def test_other_ratios_keep_every_id(base, ratio):
    assert stratified_sample(base, ratio).count() == 1000


def test_independent_sample_is_a_filter(spark, base):
    ids = stratified_sample(base, 0.5, exact=False)
    assert "Exchange" not in ids._jdf.queryExecution().executedPlan().toString()
    assert 400 < ids.count() < 590


def test_balanced_draws(spark, base):
    rows = base.filter("target IS NOT NULL")
    got = balanced_resample(rows, "case_id", draws=4000).cache()
    assert got.count() == 4000 and got.select("draw").distinct().count() == 4000
    counts = {r.target: r["count"] for r in got.groupBy("target").count().collect()}
    assert abs(counts[0] - counts[1]) < 300
    # every drawn row is a row of the table, and rare ones come back often
    assert got.join(rows, ["case_id", "target"], "left_anti").count() == 0
    assert got.filter("target = 1").select("case_id").distinct().count() == 100
    assert records(got) == records(balanced_resample(rows.repartition(5), "case_id", draws=4000))
    assert balanced_resample(rows, "case_id").count() == 990


def test_random_subset(base):
    got = random_subset(base, "case_id", 10)
    assert got.count() == 10 and records(got) == records(random_subset(base.repartition(4), "case_id", 10))


def test_epochs_hold_every_row_once_in_their_own_order(spark, base):
    orders = [[r.case_id for r in ordering.epoch_shuffle(base, epoch=e).collect()] for e in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2]
    assert sorted(orders[2]) == list(range(1000))
    assert orders[0] == [r.case_id for r in ordering.epoch_shuffle(base.repartition(6)).collect()]
    placed = ordering.epoch_position(base).orderBy("position").collect()
    assert [r.position for r in placed] == list(range(1000))
    assert [r.case_id for r in placed] == orders[0]


def test_chunks_batches_and_workers(spark, base):
    chunks = ordering.assign_chunks(base.repartition(5), 300)
    sizes = {r.chunk: (r.n, r.low) for r in chunks.groupBy("chunk").agg(
        F.count("*").alias("n"), F.min("case_id").alias("low")).collect()}
    assert sizes == {1: (300, 0), 2: (300, 300), 3: (300, 600), 4: (100, 900)}
    shares = ordering.assign_workers(chunks, 3).select("chunk", "worker").distinct().orderBy("chunk").collect()
    assert [r.worker for r in shares] == [0, 0, 1, 1]
    split = ordering.split_by_worker(chunks, 3)
    assert split.rdd.getNumPartitions() == 3
    assert split.count() == 1000 and "_worker" not in split.columns
    assert ordering.assign_batches(base, 256).count() == 1000
    assert ordering.assign_batches(base, 256, drop_last=True).count() == 768
    with pytest.raises(ValueError):
        ordering.assign_chunks(base, 0)


def test_last_chunk_is_held_out(spark, base):
    train, val = ordering.hold_out_last_chunk(ordering.assign_chunks(base, 300))
    assert (train.count(), val.count()) == (900, 100)
    train, val = ordering.hold_out_last_chunk(ordering.assign_chunks(base, 5000))
    assert (train.count(), val.count()) == (1000, 1000)


def test_table_ends(base):
    assert [r.case_id for r in ordering.head(base, ["case_id"], 2).collect()] == [0, 1]
    assert [r.case_id for r in ordering.tail(base, ["case_id"], 2).collect()] == [999, 998]


def test_hot_rows_are_restricted_too(spark):
    rows = [(1, i) for i in range(30)] + [(2, i) for i in range(30)] + [(None, i) for i in range(30)] + [(3, 0), (4, 0)]
    df = spark.createDataFrame(rows, "case_id int, v int")
    ids = spark.createDataFrame([(1,), (3,), (5,)], "case_id int")
    hot = find_hot_keys(df.select("case_id"), ["case_id"], cells=10)
    assert hot.table.count() == 3
    assert records(restrict(df, ids, hot=hot)) == records(restrict(df, ids))
    assert restrict(df, ids, hot=hot).count() == 31


def test_flags_and_joins(spark):
    base = spark.createDataFrame([(1,), (2,)], "case_id int")
    table = add_joined_flag(spark.createDataFrame([(1, 5)], "case_id int, x int"), "train_t")
    got = fill_joined_flags(join_to_base(base, {"t": table}))
    assert records(got) == [
        {"case_id": 1, "x": 5, "t_joined_flag": 1},
        {"case_id": 2, "x": None, "t_joined_flag": 0},
    ]
    again = join_to_base(got, [table.drop("t_joined_flag")])
    assert again.columns == ["case_id", "x", "t_joined_flag", "x_right"]
    with pytest.raises(ValueError, match="third time"):
        join_to_base(again, [table])
    parent = spark.createDataFrame([(1, 1), (1, 2)], "case_id int, num_group1 int")
    children = [parent.filter("num_group1 = 2").withColumn(c, F.lit(1)) for c in ("a", "b")]
    assert records(attach_children(parent, children)) == [
        {"case_id": 1, "num_group1": 1, "a": None, "b": None},
        {"case_id": 1, "num_group1": 2, "a": 1, "b": 1},
    ]


def test_a_column_of_the_own_name_is_not_lost(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "case_id int, row_idx int")
    with pytest.raises(ValueError, match="row_idx"):
        ordering.number_rows(df)
    text = spark.createDataFrame([("a",), ("b",)], "case_id string")
    with pytest.raises(TypeError, match="numeric"):
        ordering.assign_chunks(text, 1)


def test_chunk_windows_move_no_row(spark, tmp_path):
    """Chunks stay whole, windows hold several, rows in them are mixed, and the plan shuffles nothing."""
    rows = spark.range(4000).selectExpr("id AS case_id", "id div 100 + 1 AS chunk")
    rows.repartition(4).write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    first, again, other = (ordering.chunk_windows(stored, size=5, epoch=e) for e in (0, 0, 1))
    got = first.collect()
    assert got == again.collect() and sorted(r.case_id for r in got) == list(range(4000))
    windows = {}
    for r in got:
        windows.setdefault(r.chunk, set()).add(r.window)
    assert all(len(w) == 1 for w in windows.values()) and {w for s in windows.values() for w in s} <= set(range(8))
    assert {r.case_id: r.window for r in got} != {r.case_id: r.window for r in other.collect()}
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Repartition" not in plan and "Sort [window" in plan and ", false" in plan
    placed = ordering.chunk_window_position(stored, size=5).collect()
    by_place = [(r.window, r.case_id) for r in sorted(placed, key=lambda r: r.position)]
    assert [r.position for r in sorted(placed, key=lambda r: r.position)] == list(range(4000))
    assert [w for w, _ in by_place] == sorted(w for w, _ in by_place)
    inside = [c for w, c in by_place if w == by_place[0][0]]
    assert inside != sorted(inside)
    assert ordering.chunk_windows(stored.limit(0)).count() == 0
