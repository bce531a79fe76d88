"""Missing-value imputation and frequency encoding with a state that replays on new data."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierfeat.functions.missing import category, filled, null_indicator
from hierfeat.operators.quantiles import column_quantiles
from hierfeat.session import stored
from hierfeat.spec import CASE, GROUP1, GROUP2, MISSING, NULL_SUFFIX, TARGET, WEEK

logger = logging.getLogger(__name__)

NOT_FEATURES = (CASE, WEEK, TARGET, GROUP1, GROUP2)
# Columns with few short values use a literal map; broadcast joins keep within the next bounds
# all together; the rest go through one shuffled join.
LITERAL_LEVELS, LITERAL_BYTES = 64, 10_000
BROADCAST_LEVELS, BROADCAST_BYTES = 100_000, 64 * 2**20
# A value above this share of the rows is hot in a shuffled join; at most 1 / share exist.
HOT_VALUE_SHARE = 0.01
# Tasks that share the rows of a hot value too long for a literal.
SALTS = 32
UNSEEN = 1


def classify(df: DataFrame, exclude=NOT_FEATURES) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns; other types are reported and left alone."""
    numeric, categorical = [], []
    for field in df.schema.fields:
        if field.name in exclude:
            continue
        if isinstance(field.dataType, T.NumericType):
            numeric.append(field.name)
        elif isinstance(field.dataType, (T.StringType, T.BooleanType)):
            categorical.append(field.name)
        else:
            logger.warning("column %s of type %s is left as it is", field.name, field.dataType.simpleString())
    return numeric, categorical


def median_table(df: DataFrame, columns: list[str], method: str = "exact") -> DataFrame:
    """Medians as ``col, value``; columns without values have no row."""
    if method == "exact":
        return column_quantiles(df, columns, [0.5], "linear").select("col", F.col("q0").alias("value"))
    if method != "approx":
        raise ValueError(f"method must be 'exact' or 'approx', not {method!r}")
    wide = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), 0.5).alias(c) for c in columns])
    return wide.unpivot([], columns, "col", "value").filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of every column as ``col, value, n``, in one job; null counts as a value."""
    texts = df.select(*[category(F.col(f"`{c}`")).alias(c) for c in columns])
    return texts.unpivot([], columns, "col", "value").groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))


def encode_counts(
    df: DataFrame, freqs: DataFrame, columns: list[str], spread: Column, broadcast_bytes: int | None = None
) -> DataFrame:
    """Replace each categorical column by the count its value has in ``freqs``, 1 if unseen.

    The number and the bytes of the values per column are looked up first and decide how the lookup runs:
    a literal map, a broadcast join as long as all broadcast tables together keep within
    ``broadcast_bytes`` (``BROADCAST_BYTES`` if not given) and ``BROADCAST_LEVELS``, or for all other columns
    one shuffled join in long form. ``freqs`` must be stored: it is read several times. ``spread`` is
    any well-spread column; it deals the rows of long hot values over the tasks of the shuffled join.
    """
    if not columns:
        return df
    sizes = {
        r["col"]: r
        for r in freqs.filter(F.col("col").isin(columns))
        .groupBy("col")
        .agg(
            F.count(F.lit(1)).alias("levels"),
            F.sum("n").alias("total"),
            F.sum(F.octet_length("value")).alias("bytes"),
        )
        .collect()
    }
    small, large = _lookup_kinds(columns, sizes, BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)
    wanted = F.col("col").isin(small)
    for c in large:
        wanted = wanted | ((F.col("col") == c) & (F.col("n") > HOT_VALUE_SHARE * sizes[c]["total"]))
    short = F.octet_length("value") <= LITERAL_BYTES
    listed = freqs.filter(wanted).select(
        "col", "n", F.when(short, F.col("value")).alias("value"), F.xxhash64("value").alias("hash")
    )
    known: dict[str, dict[str, int]] = {}
    salted: set[int] = set()
    for r in listed.collect():
        if r["value"] is None:
            salted.add(r["hash"])
        else:
            known.setdefault(r["col"], {})[r["value"]] = r["n"]

    order = df.columns
    if large:
        df = _long_lookup(df, freqs, large, known, sorted(salted), spread)
    for c in columns:
        value = F.col(f"`{c}`")
        if c in large:
            continue
        if c in small:
            count = _lookup(known.get(c, {}), value)
        else:
            table = freqs.filter(F.col("col") == c).select(F.col("value").alias("_k"), F.col("n").alias("_c"))
            df = df.join(F.broadcast(table), value == F.col("_k"), "left")
            count = F.col("_c")
        df = df.withColumn(c, _seen(count)).drop("_k", "_c")
    return df.select(*[f"`{c}`" for c in order])


def _lookup_kinds(columns: list[str], sizes: dict, most_bytes: int) -> tuple[list[str], list[str]]:
    """Columns for literal maps and columns for the shuffled join; the others are broadcast, smallest first."""
    found = {c: (sizes[c]["levels"], sizes[c]["bytes"]) if c in sizes else (0, 0) for c in columns}
    small = [c for c, (levels, size) in found.items() if levels <= LITERAL_LEVELS and size <= LITERAL_BYTES]
    large, all_levels, all_bytes = [], 0, 0
    for c in sorted(set(columns) - set(small), key=lambda c: (found[c][1], c)):
        levels, size = found[c]
        if all_levels + levels > BROADCAST_LEVELS or all_bytes + size > most_bytes:
            large.append(c)
        else:
            all_levels, all_bytes = all_levels + levels, all_bytes + size
    return small, [c for c in columns if c in large]


def _long_lookup(
    df: DataFrame, freqs: DataFrame, columns: list[str], known: dict[str, dict[str, int]], salted: list[int], spread: Column
) -> DataFrame:
    """Counts of the values of many columns by one join, whatever their number.

    Cells that no short hot value answers become rows of number, column and value. They meet the counts
    in one shuffle and are gathered by row in another; the wide rows are stored once, so that their
    numbers stay, and move once. Values in ``salted`` (their hashes) are hot and too long for a literal: their
    cells are dealt over ``SALTS`` tasks and their counts are repeated for each.
    """
    row, salt = "_row", F.lit(0)
    rows = stored(df.withColumn(row, F.monotonically_increasing_id()), "encoded")
    answered = {c: _lookup(known.get(c, {}), F.col(f"`{c}`")) for c in columns}
    cells = [
        F.when(answered[c].isNull(), F.struct(F.lit(i).alias("pos"), F.col(f"`{c}`").alias("value")))
        for i, c in enumerate(columns)
    ]
    open_cells = rows.select(
        row, spread.alias("_spread"), F.inline(F.filter(F.array(*cells), lambda cell: cell.isNotNull()))
    )
    names = F.array(*[F.lit(c) for c in columns])
    table = freqs.filter(F.col("col").isin(columns)).select(
        (F.array_position(names, F.col("col")) - 1).cast("int").alias("pos"), "value", "n"
    )
    if salted:
        hot = F.xxhash64("value").isin(salted)
        salt = F.when(hot, F.pmod(F.xxhash64("_spread"), F.lit(SALTS))).otherwise(0).cast("int")
        each = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        table = table.withColumn("salt", F.explode(each))
    else:
        table = table.withColumn("salt", F.lit(0))
    met = open_cells.withColumn("salt", salt).join(table, ["pos", "value", "salt"])
    counts = met.groupBy(row).agg(
        *[F.max(F.when(F.col("pos") == i, F.col("n"))).alias(f"_n{i}") for i in range(len(columns))]
    )
    done = {c: _seen(F.coalesce(answered[c], F.col(f"_n{i}"))) for i, c in enumerate(columns)}
    return rows.join(counts, row, "left").withColumns(done)


def _seen(count: Column) -> Column:
    return F.coalesce(count, F.lit(UNSEEN)).cast("bigint")


def _lookup(counts: dict[str, int], value: Column) -> Column:
    if not counts:
        return F.lit(None).cast("bigint")
    pairs = [F.lit(x) for item in sorted(counts.items()) for x in item]
    return F.try_element_at(F.create_map(*pairs), value).cast("bigint")


@dataclass
class Imputer:
    """Learns medians and value counts. ``medians`` is ``"exact"`` or ``"approx"``."""

    medians: str = "exact"
    exclude: tuple[str, ...] = NOT_FEATURES

    def fit(self, df: DataFrame) -> ImputerModel:
        numeric, categorical = classify(df, self.exclude)
        medians = dict.fromkeys(numeric, 0.0)
        if numeric:
            # One row per column reaches the driver.
            medians.update({r["col"]: r["value"] for r in median_table(df, numeric, self.medians).collect()})
        if categorical:
            freqs = stored(value_counts(df, categorical), "frequencies")
        else:
            freqs = df.sparkSession.createDataFrame([], "col string, value string, n bigint")
        final = [c for c in df.columns if c != TARGET] + [f"{c}{NULL_SUFFIX}" for c in numeric]
        return ImputerModel(numeric, categorical, medians, freqs, final)


@dataclass
class ImputerModel:
    """Imputation state. ``freqs`` is a stored table ``col, value, n``."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    freqs: DataFrame
    final_columns: list[str]

    def transform_training(self, df: DataFrame) -> DataFrame:
        """Impute and encode the table the state was learnt from; every column stays."""
        filled_up = self._fill(df)
        return encode_counts(filled_up, self.freqs, self.categorical, F.col(CASE))

    def transform(self, df: DataFrame) -> DataFrame:
        """Impute and encode new data and give it the columns of the training table.

        In this order: missing columns come in with their default (so their indicator is
        0), unknown ones go out, indicators, fills, counts, and last the column order.
        """
        if CASE not in df.columns:
            raise ValueError(f"{CASE} is missing")
        for c in self.numeric:
            if c in df.columns and not isinstance(df.schema[c].dataType, T.NumericType):
                raise ValueError(f"{c} was numeric in training but is {df.schema[c].dataType.simpleString()}")
        absent = {c: F.lit(self.medians[c]) for c in self.numeric if c not in df.columns}
        absent.update({c: F.lit(MISSING) for c in self.categorical if c not in df.columns})
        df = df.withColumns(absent) if absent else df
        known = {*self.numeric, *self.categorical, *NOT_FEATURES}
        df = df.select(*[f"`{c}`" for c in df.columns if c in known])
        df = encode_counts(self._fill(df), self.freqs, self.categorical, F.col(CASE))
        rest = [c for c in self.final_columns if c not in df.columns]
        return df.withColumns({c: F.lit(0) for c in rest}).select(*[f"`{c}`" for c in self.final_columns])

    def _fill(self, df: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        columns = []
        for c in df.columns:
            col = F.col(f"`{c}`")
            if c in self.medians:
                col = filled(col, kinds[c], self.medians[c])
            elif c in self.categorical:
                col = category(col)
            columns.append(col.alias(c))
        flags = [null_indicator(F.col(f"`{c}`"), kinds[c]).alias(f"{c}{NULL_SUFFIX}") for c in self.numeric]
        return df.select(*columns, *flags)

    def save(self, path: str) -> None:
        spark = self.freqs.sparkSession
        medians = [(c, float(v)) for c, v in self.medians.items()]
        spark.createDataFrame(medians, "col string, value double").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/medians"
        )
        columns = [(i, c, "numeric") for i, c in enumerate(self.numeric)]
        columns += [(i, c, "categorical") for i, c in enumerate(self.categorical)]
        columns += [(i, c, "final") for i, c in enumerate(self.final_columns)]
        spark.createDataFrame(columns, "pos int, col string, kind string").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/columns")
        self.freqs.write.mode("overwrite").parquet(f"{path}/freqs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ImputerModel:
        """Read a stored state; a missing one is an error, never a reason to refit."""
        columns = spark.read.parquet(f"{path}/columns").collect()
        medians = {r["col"]: r["value"] for r in spark.read.parquet(f"{path}/medians").collect()}

        def named(kind: str) -> list[str]:
            return [r["col"] for r in sorted(columns, key=lambda r: r["pos"]) if r["kind"] == kind]

        numeric = named("numeric")
        return cls(
            numeric,
            named("categorical"),
            {c: medians[c] for c in numeric},
            spark.read.parquet(f"{path}/freqs"),
            named("final"),
        )


def frequency_encode(df: DataFrame, columns: list[str], key: str, broadcast_bytes: int | None = None) -> DataFrame:
    """Replace values by how often they occur in this same table, without keeping a state."""
    texts = df.withColumns({c: category(F.col(f"`{c}`")) for c in columns})
    return encode_counts(texts, stored(value_counts(df, columns), "frequencies"), columns, F.col(key), broadcast_bytes)
