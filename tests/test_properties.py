"""Random small tables against plain Python."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hierfeat.operators.quantiles import column_quantiles
from hierfeat.operators.rollup import rollup_history
from hierfeat.operators.slices import by_value, row_index
from test_rollup import brute

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
NUMBERS = st.one_of(st.none(), st.floats(-1e6, 1e6, width=32), st.just(float("nan")))


@FEW
@given(values=st.lists(NUMBERS, min_size=1, max_size=40), q=st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]))
def test_column_quantile(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    row = column_quantiles(df, ["v"], [q]).first()
    known = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    if not known:
        assert row is None
        return
    expected = known[math.floor((len(known) - 1) * q + 0.5)]
    assert row.n == len(known)
    assert row.q0 == expected or (math.isnan(row.q0) and math.isnan(expected))


@FEW
@given(
    rows=st.lists(
        st.tuples(st.integers(0, 2), NUMBERS, st.sampled_from(["a", "b", None, ""])), min_size=1, max_size=40
    ),
    parts=st.integers(1, 5),
)
def test_history(spark, rows, parts):
    table = [(case, i, v, t) for i, (case, v, t) in enumerate(rows)]
    df = spark.createDataFrame(table, "case_id int, num_group1 int, v double, t string").repartition(parts)
    got = {r.case_id: r for r in rollup_history(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for case, row in got.items():
        numbers = [v for c, _, v, _ in table if c == case and v is not None and not math.isnan(v)]
        assert (row.v_max, row.v_min) == (max(numbers, default=None), min(numbers, default=None))
        expected = brute([(i, t) for c, i, _, t in table if c == case])
        assert {k: row[f"t_{k}"] for k in expected} == expected


@FEW
@given(ids=st.sets(st.integers(-(2**40), 2**40), min_size=1, max_size=60), parts=st.integers(1, 30))
def test_row_index(spark, ids, parts):
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(3)
    got = row_index(by_value(df, "id", parts), ["id"]).collect()
    assert sorted((r.row_idx, r.id) for r in got) == list(enumerate(sorted(ids)))
