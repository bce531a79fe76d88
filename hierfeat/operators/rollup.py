"""Type-driven rollups of history tables to their parent grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierfeat.functions.missing import nan_as_null
from hierfeat.operators.quantiles import list_quantile, quantiles
from hierfeat.operators.skew import HOT_CELLS, HotKeys, find_hot_keys, listed_in, split_hot
from hierfeat.spec import CASE, FLAG_SUFFIX, GROUP1, KEYS

NUMERIC_STATS = ("max", "min", "mean", "std", "iqr")
DETECT = "detect"
# More columns than this go through long form: the generated code of hundreds of
# aggregates is slower than a few aggregates over more rows.
WIDE_COLUMNS = 20
CATEGORY_STATS = ("last", "first", "mode", "mode_count", "last_count", "first_count", "n_modes")


def split_columns(df: DataFrame, keys: Sequence[str] = KEYS) -> tuple[list[str], list[str], list[str]]:
    """Value columns by kind: joined flags, numeric, everything else."""
    flags, numeric, other = [], [], []
    for field in df.schema.fields:
        if field.name in keys:
            continue
        if field.name.endswith(FLAG_SUFFIX):
            flags.append(field.name)
        elif isinstance(field.dataType, T.NumericType):
            numeric.append(field.name)
        else:
            other.append(field.name)
    return flags, numeric, other


def _value(df: DataFrame, column: str, nan_policy: str) -> Column:
    if nan_policy not in ("as_null", "propagate"):
        raise ValueError(f"nan_policy must be 'as_null' or 'propagate', not {nan_policy!r}")
    col = F.col(f"`{column}`")
    return nan_as_null(col, df.schema[column].dataType) if nan_policy == "as_null" else col


def rollup_children(
    df: DataFrame,
    keys: Sequence[str] = (CASE, GROUP1),
    order: Sequence[str] = ("num_group2",),
    nan_policy: str = "as_null",
) -> DataFrame:
    """Depth 2 to depth 1: maximum of numbers and flags, last value of the rest.

    Names stay as they are. "Last" is the row with the greatest ``order``; rows equal in
    it are told apart by their values, so the result does not depend on partitioning.
    """
    flags, numeric, other = split_columns(df)
    if not (flags or numeric or other):
        return distinct_keys(df, keys)
    aggs = [F.max(_value(df, c, nan_policy)).alias(c) for c in flags + numeric]
    if other:
        # Values follow the order columns inside one struct: one comparison for all columns.
        row = F.struct(
            *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
            *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(other)],
        )
        aggs.append(F.max(row).alias("_last"))
    place = {c: F.col(f"_last.v{i}") for i, c in enumerate(other)}
    rolled = df.groupBy(*keys).agg(*aggs)
    return rolled.select(
        *keys, *[place.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns if c in {*flags, *numeric, *other}]
    )


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def rollup_numeric(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    flags: Sequence[str] = (),
    iqr: str | None = "nearest",
    nan_policy: str = "as_null",
    hot: HotKeys | str | None = DETECT,
    null_keys: bool = True,
) -> DataFrame:
    """Max, min, mean, sample std and interquartile range per key; flags keep their maximum.

    All but the range merge in constant space. The range needs the sorted values of a
    group, so ordinary groups sort theirs in the same aggregation, and hot keys go
    through exact quantiles spread over the cluster. In long form, rows of ordinary keys are
    shuffled before they become cells, and only cells of hot keys are combined first. ``hot`` lists
    the hot keys, None says there are none, and by default they are looked for in ``df``. Rows whose key is
    null form a group of their own, whatever the number of columns or the size of the
    group; ``null_keys=False`` leaves them out, which saves a shuffle of the result.
    """
    keys = list(keys)
    df = df if null_keys else df.dropna(subset=keys)
    values = {c: _value(df, c, nan_policy) for c in columns}
    long = _in_long_form(df, columns)
    if not iqr and not long or not columns:
        return _statistics(df, keys, values, flags, None, null_keys, nan_policy)
    if isinstance(hot, str):
        hot = find_hot_keys(df.select(*keys), keys, min(len(columns), WIDE_COLUMNS))
    if hot is None:
        # So that hot keys give the same last digits as others where either way is cheap.
        few = bool(long) and df.select(*keys).offset(HOT_CELLS // len(columns)).isEmpty()
        return _statistics(df, keys, values, flags, iqr, null_keys, nan_policy, combine=few)
    ordinary, heavy = split_hot(df, keys, hot)
    light = _statistics(ordinary, keys, values, flags, iqr, null_keys, nan_policy)
    loaded = _statistics(heavy, keys, values, flags, None, null_keys, nan_policy, combine=True)
    if not iqr:
        return light.unionByName(loaded)
    # Giant keys are few: their brackets are broadcast and their rows stay where they are.
    # The others are each less than a task's work.
    ranges = _large_ranges(heavy, keys, values, iqr, hot.only(giant=True), few=True).unionByName(
        _large_ranges(heavy, keys, values, iqr, hot.only(giant=False), few=False)
    )
    return light.unionByName(_by_key(loaded, ranges, keys, "left", null_keys))


def _by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, null_keys: bool) -> DataFrame:
    """Join two tables with one row per key; null keys meet too, as equal fields of a struct do."""
    if not null_keys:
        return left.join(right, list(keys), how)
    key, values = F.struct(*keys).alias("_key"), [c for c in right.columns if c not in keys]
    both = left.withColumn("_key", key).join(right.select(key, *[F.col(f"`{c}`") for c in values]), "_key", how)
    return both.drop("_key")


def _aggregates(v: Column, iqr: str | None) -> dict[str, Column]:
    found = {"max": F.max(v), "min": F.min(v), "mean": F.avg(v), "std": F.stddev_samp(v)}
    if iqr:
        ordered = F.sort_array(F.collect_list(v.cast("double")))
        found["iqr"] = list_quantile(ordered, 0.75, iqr) - list_quantile(ordered, 0.25, iqr)
    return found


def _in_long_form(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The kinds of numbers with so many columns that they go through long form, and these columns."""
    kinds: dict[str, list[str]] = {"bigint": [], "double": []}
    for c in columns:
        dtype = df.schema[c].dataType
        if not isinstance(dtype, T.DecimalType):
            kinds["bigint" if isinstance(dtype, T.LongType) else "double"].append(c)
    return {kind: found for kind, found in kinds.items() if len(found) > WIDE_COLUMNS}


def _statistics(
    df: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    flags: Sequence[str],
    iqr: str | None,
    null_keys: bool,
    nan_policy: str,
    combine: bool = False,
) -> DataFrame:
    """Statistics of all columns; kinds with many columns in long form, the rest side by side.

    ``combine`` is for groups of more rows than one task should hold: see :func:`_long_statistics`.
    """
    many = _in_long_form(df, list(values))
    apart = {c for columns in many.values() for c in columns}
    wide = [F.max(f"`{f}`").alias(f) for f in flags]
    for c, v in values.items():
        if c not in apart:
            wide += [a.alias(f"{c}_{name}") for name, a in _aggregates(v, iqr).items()]
    parts = [df.groupBy(*keys).agg(*wide)] if wide else []
    for kind, columns in many.items():
        parts.append(_long_statistics(df, keys, columns, kind, iqr, nan_policy, combine))
    result = parts[0]
    for part in parts[1:]:
        result = _by_key(result, part, keys, "inner", null_keys)
    return result


def _long_statistics(
    df: DataFrame, keys: list[str], columns: list[str], kind: str, iqr: str | None, nan_policy: str, combine: bool
) -> DataFrame:
    """A cell for each row and column, grouped by key and column, then by key.

    Rows of few cells a key shrink little when cells are combined before a shuffle, and a cell's statistics with
    its key are many times a value. So rows are shuffled once, as arrays, and both groupings run where they lie;
    with ``combine`` cells are combined before they are shuffled, and no group is collected in one task.
    """
    rows = df.select(*keys, F.array(*[F.col(f"`{c}`").cast(kind) for c in columns]).alias("_cells"))
    if not combine:
        rows = rows.repartition(*keys)
    found = _aggregates(F.col("_v"), iqr)
    # No row is without cells; "outer" keeps Spark from checking that with a filter that makes the array once more.
    cells = rows.select(*keys, F.posexplode_outer("_cells").alias("_pos", "_v"))
    cells = cells.withColumn("_v", _value(cells, "_v", nan_policy))
    each = cells.groupBy(*keys, "_pos").agg(*[a.alias(name) for name, a in found.items()])
    # One entry per column, so the list is as long as the table is wide.
    rows = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", *found))).alias("_rows"))
    out = []
    for i, c in enumerate(columns):
        row = F.get("_rows", F.lit(i))
        for name in found:
            stat = row[name]
            out.append((stat.cast(df.schema[c].dataType) if name in ("max", "min") else stat).alias(f"{c}_{name}"))
    return rows.select(*keys, *out)


def _large_ranges(
    df: DataFrame, keys: list[str], values: dict[str, Column], iqr: str, hot: HotKeys, few: bool
) -> DataFrame:
    rows = listed_in(df, keys, hot.table, "left_semi")
    cells = F.posexplode(F.array(*[v.cast("double") for v in values.values()])).alias("_pos", "_v")
    ends = quantiles(rows.select(*keys, cells), [*keys, "_pos"], "_v", [0.25, 0.75], iqr, few_groups=few)
    entry = F.struct("_pos", (F.col("q1") - F.col("q0")).alias("iqr"))
    ranges = ends.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_by"))
    return ranges.select(
        *keys, *[F.try_element_at("_by", F.lit(i)).alias(f"{c}_iqr") for i, c in enumerate(values)]
    )


def rollup_categories(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: Sequence[str],
    hot: HotKeys | str | None = DETECT,
) -> DataFrame:
    """Last, first and most frequent value per key, how often each occurs, and the number of modes.

    Values keep their types; ties for the mode go to the greatest value. Rows of ordinary
    keys are shuffled once and everything is grouped where they are. Rows of hot keys go
    through aggregations that combine before they shuffle and spread a key over its values
    and counts; ``hot`` is as in :func:`rollup_numeric`.
    """
    keys = list(keys)
    for c in columns:
        if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            raise ValueError(f"{c}: no first, last or mode for type {df.schema[c].dataType.simpleString()}")
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    rows = df.select(*keys, place.alias("_at"), *[F.col(f"`{c}`") for c in columns])
    if isinstance(hot, str):
        hot = find_hot_keys(df.select(*keys), keys, min(max(len(columns), 1), WIDE_COLUMNS))
    if hot is None:
        return _category_statistics(rows.repartition(*keys), keys, columns)
    ordinary, heavy = split_hot(rows, keys, hot)
    light = _category_statistics(ordinary.repartition(*keys), keys, columns)
    return light.unionByName(_category_statistics(heavy, keys, columns))


def _cells(df: DataFrame, columns: Sequence[str]) -> tuple[Column, dict[str, str]]:
    """All values as one array, and the field each column has in its entries.

    An entry is a struct with a field per type, all null but one; it is null where the
    value is, and compares like the value.
    """
    kinds = list(dict.fromkeys(df.schema[c].dataType.simpleString() for c in columns))
    fields = {c: f"t{kinds.index(df.schema[c].dataType.simpleString())}" for c in columns}
    entries = []
    for c in columns:
        value = F.col(f"`{c}`")
        parts = [(value if fields[c] == f"t{i}" else F.lit(None).cast(k)).alias(f"t{i}") for i, k in enumerate(kinds)]
        entries.append(F.when(value.isNotNull(), F.struct(*parts)))
    return F.array(*entries), fields


def _category_statistics(df: DataFrame, keys: list[str], columns: Sequence[str]) -> DataFrame:
    """The statistics, in four groupings; on rows that lie together by key none of them shuffles."""
    entries, fields = _cells(df, columns)
    cells = df.select(*keys, "_at", F.posexplode(entries).alias("_pos", "_val"))
    per_value = cells.groupBy(*keys, "_pos", "_val").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last")
    )
    per_count = per_value.groupBy(*keys, "_pos", "_n").agg(
        F.min(F.struct("_first", "_val")).alias("_first"),
        F.max(F.struct("_last", "_val")).alias("_last"),
        F.max("_val").alias("_top"),
        F.count("_val").alias("_values"),
    )
    each = per_count.groupBy(*keys, "_pos").agg(
        F.min(F.struct("_first", "_n")).alias("f"),
        F.max(F.struct("_last", "_n")).alias("l"),
        F.max(F.when(F.col("_values") > 0, F.struct("_n", "_top", "_values"))).alias("m"),
    )
    rows = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", "f", "l", "m"))).alias("_rows"))

    def counted(value: Column, n: Column) -> Column:
        return F.when(value.isNotNull(), n).otherwise(F.lit(0)).cast("bigint")

    out = []
    for i, c in enumerate(columns):
        row = F.get("_rows", F.lit(i))
        first, last, mode = row["f"]["_first"]["_val"], row["l"]["_last"]["_val"], row["m"]
        out += [
            last[fields[c]].alias(f"{c}_last"),
            first[fields[c]].alias(f"{c}_first"),
            mode["_top"][fields[c]].alias(f"{c}_mode"),
            F.coalesce(mode["_n"], F.lit(0)).cast("bigint").alias(f"{c}_mode_count"),
            counted(last, row["l"]["_n"]).alias(f"{c}_last_count"),
            counted(first, row["f"]["_n"]).alias(f"{c}_first_count"),
            F.coalesce(mode["_values"], F.lit(0)).cast("bigint").alias(f"{c}_n_modes"),
        ]
    return rows.select(*keys, *out)


def rollup_history(
    df: DataFrame,
    keys: Sequence[str] = (CASE,),
    order: Sequence[str] = (GROUP1,),
    iqr: str | None = "nearest",
    nan_policy: str = "as_null",
    hot: HotKeys | str | None = DETECT,
    null_keys: bool = True,
) -> DataFrame:
    """Depth 1 to one row per entity, the statistics chosen by column type.

    ``null_keys=False`` leaves out rows without a key, which a join to a base never finds.
    """
    keys = list(keys)
    df = df if null_keys else df.dropna(subset=keys)
    ignored = {*KEYS, *keys}
    flags, numeric, other = split_columns(df, ignored)
    if not (flags or numeric or other):
        return distinct_keys(df, keys)
    if isinstance(hot, str):
        hot = find_hot_keys(df.select(*keys), keys, WIDE_COLUMNS)
    parts = []
    if flags or numeric:
        parts.append(rollup_numeric(df, keys, numeric, flags, iqr, nan_policy, hot, null_keys))
    if other:
        parts.append(rollup_categories(df, keys, other, order, hot))
    rolled = parts[0] if len(parts) == 1 else _by_key(parts[0], parts[1], keys, "inner", null_keys)
    names = []
    for c in df.columns:
        if c in flags:
            names.append(c)
        elif c in numeric:
            names += [f"{c}_{s}" for s in NUMERIC_STATS if iqr or s != "iqr"]
        elif c in other:
            names += [f"{c}_{s}" for s in CATEGORY_STATS]
    return rolled.select(*keys, *[f"`{n}`" for n in names])
