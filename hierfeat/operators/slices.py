"""Running totals and row numbers over groups of any size.

A window over a whole group is one task's work, so a group holding a third of the
table would end on one core. Here each group is cut into slices along its order:
slice totals are summed up over the few slices of the group, and windows run inside a
slice, starting from the total before it. Slices are a pure function of the row, so a
lost executor recomputes the same result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from hierfeat.functions.hashing import hex_word
from hierfeat.session import shuffle_width

SLICE = "_slice"
#: Slices that edges inside a plan are made for, at most.
MOST_EDGES = 1_024


def by_value(
    df: DataFrame, column: str, parts: int | None = None, edges_from: DataFrame | None = None
) -> DataFrame:
    """Add slices of about equal row count along a numeric column.

    The edges are approximate quantiles (one scan of one column, a bounded number of
    values on the driver); the slices they cut are used exactly. ``edges_from`` reads the
    edges off a cheaper table whose rows outnumber those of ``df`` in every value range.
    """
    if not isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
        raise TypeError(f"{column} has no numeric order: {df.schema[column].dataType.simpleString()}")
    source = df if edges_from is None else edges_from
    parts = parts or shuffle_width(df.sparkSession)
    inner: list[float] = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        values = source.select(F.col(column).cast("double").alias(column))
        # Infinite values fall into the first and the last slice.
        inner = sorted({v for v in values.approxQuantile(column, shares, 0.25 / parts) if math.isfinite(v)})
    if not inner:
        return df.withColumn(SLICE, F.lit(0))
    key = "_slice_key"
    cutter = Bucketizer(
        splits=[float("-inf"), *inner, float("inf")],
        inputCol=key,
        outputCol=SLICE,
        handleInvalid="keep",
    )
    cut = cutter.transform(df.withColumn(key, F.col(column).cast("double")))
    return cut.withColumn(SLICE, F.col(SLICE).cast("int")).drop(key)


def by_sketch(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """Add slices of about equal row count along a numeric column, cut inside the plan.

    The edges are a mergeable sketch of the table's own rows, a subquery of the plan: no job runs while the plan is built,
    and a table that ends in a shuffle is shuffled once for both. Edges are searched in two steps, so the
    work per row is twice the square root of the number of slices.
    """
    parts = parts or min(shuffle_width(df.sparkSession), MOST_EDGES)
    if parts <= 1:
        return df.withColumn(SLICE, F.lit(0))
    value, step = F.col(column).cast("double"), math.isqrt(parts - 1) + 1
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    sketch = df.agg(F.percentile_approx(value, shares, F.lit(4 * parts)).alias("edges")).scalar()
    edges, heads = F.col("_edges"), F.col("_heads")

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda e: e < value))

    start = F.greatest(below(heads) - 1, F.lit(0)) * step
    place = start + below(F.slice(edges, start + 1, F.lit(step)))
    # Without rows there are no edges.
    known = df.withColumn("_edges", sketch).withColumn("_heads", F.filter(edges, lambda _, i: i % step == 0))
    return known.withColumn(SLICE, F.when(edges.isNull(), F.lit(0)).otherwise(place).cast("int")).drop("_edges", "_heads")


def by_hash(df: DataFrame, digits: str, length: int | None = None) -> DataFrame:
    """Add slices along a column of hash hex digits; uniform, so no edges are needed.

    As many digits decide as it takes to make a slice for every shuffle partition, if ``length`` is not given.
    """
    if length is None:
        length = 1
        while 16**length < shuffle_width(df.sparkSession):
            length += 1
    return df.withColumn(SLICE, hex_word(F.col(digits), 1, length).cast("int"))


def running_totals(
    sliced: DataFrame,
    sums: dict[str, Column],
    order: Sequence[str],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Add, per row, the sum over all earlier rows of its group.

    ``sliced`` carries slices that follow ``order``, and ``order`` is unique in a group. A
    column that already has the name of a sum is an error.
    """
    groups = list(groups)
    taken = {*sums, "_row", *(f"_{n}" for n in sums)} & set(sliced.columns)
    if taken:
        raise ValueError(f"the table has columns of these names already: {sorted(taken)}")
    group = Window.partitionBy(*(groups or [F.lit(0)]))
    earlier = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*groups, SLICE).orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, -1)

    totals = sliced.groupBy(*groups, SLICE).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    # What came before a slice goes in as its first row, so one window does the rest.
    heads = totals.select(
        *groups,
        SLICE,
        F.lit(0).alias("_row"),
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums],
    )
    rows = sliced.withColumn("_row", F.lit(1)).withColumns({f"_{n}": c for n, c in sums.items()})
    both = rows.unionByName(heads, allowMissingColumns=True)
    summed = both.withColumns({n: F.sum(f"_{n}").over(inside) for n in sums}).filter("_row = 1")
    return summed.select(*[c for c in sliced.columns if c != SLICE], *sums)


def row_index(
    sliced: DataFrame, order: Sequence[str], groups: Sequence[str] = (), name: str = "row_idx"
) -> DataFrame:
    """Add the 0-based position of each row in its group, consecutive over all slices."""
    return running_totals(sliced, {name: F.lit(1).cast("bigint")}, order, groups)

