"""Feature selection, splits and class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierfeat.functions.missing import feature_float
from hierfeat.spec import CASE, MONTH, TARGET, WEEK

META = (CASE, MONTH, WEEK, TARGET)
# Tables of up to so many classes are broadcast, larger ones joined by shuffle.
MOST_CLASSES = 1_000


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither ids, time axis nor target."""
    return [
        f.name for f in df.schema.fields if f.name not in META and isinstance(f.dataType, T.NumericType)
    ]


def prepare_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as 32-bit floats, 0 where missing."""
    return df.withColumns({c: feature_float(F.col(f"`{c}`")) for c in features})


def variances(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sample variance per feature as ``col, variance``."""
    wide = df.agg(*[F.var_samp(F.col(f"`{c}`").cast("double")).alias(c) for c in features])
    return wide.unpivot([], list(features), "col", "variance")


def drop_low_variance(df: DataFrame, features: Sequence[str], threshold: float = 1e-4) -> list[str]:
    """Features that vary, judged on the rows of ``df``; one row per feature reaches the driver."""
    found = {r["col"]: r["variance"] for r in variances(df, features).collect()}
    return [c for c in features if found[c] is not None and not found[c] < threshold]


def split_by_week(df: DataFrame, val_weeks: int = 12, week: str = WEEK) -> tuple[DataFrame, DataFrame]:
    """Rows up to ``val_weeks`` before the last week, and the later ones."""
    last = df.agg(F.max(week)).scalar()
    return df.filter(F.col(week) <= last - val_weeks), df.filter(F.col(week) > last - val_weeks)


def class_counts(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows per class, as ``label``, ``n``; null is no class."""
    known = df.filter(F.col(target).isNotNull())
    return known.groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def few_or_joined(table: DataFrame, most: int = MOST_CLASSES) -> DataFrame:
    """Mark a table for broadcast if it is counted to have few rows; else a join shuffles it."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def inverse_class_weight(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Sampling weight per class: ``target, n, weight`` with weight 1 / n."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", 1.0 / F.col("n"))


def balanced_weight(n: Column, count: Column, classes: int = 2) -> Column:
    """Weight with mean 1 over a table in which every class occurs."""
    return n / (F.lit(classes) * F.greatest(count, F.lit(1)))


def chunk_class_weights(
    df: DataFrame, chunk: str = "chunk", target: str = TARGET, classes: Sequence[int] = (0, 1)
) -> DataFrame:
    """Class weights per chunk, also for classes a chunk lacks: ``chunk, target, n, weight``."""
    wide = df.groupBy(chunk).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.when(F.col(target) == c, 1)).alias(f"_n{c}") for c in classes],
    )
    each = F.inline(F.array(*[F.struct(F.lit(c).alias(target), F.col(f"_n{c}").alias("n")) for c in classes]))
    long = wide.select(chunk, "_rows", each)
    return long.withColumn("weight", balanced_weight(F.col("_rows"), F.col("n"), len(classes))).drop("_rows")


def add_chunk_weights(df: DataFrame, chunk: str = "chunk", target: str = TARGET) -> DataFrame:
    """Give every row the weight of its class in its chunk."""
    weights = chunk_class_weights(df, chunk, target).select(chunk, target, "weight")
    return df.join(weights, [chunk, target], "left")


def add_class_weights(df: DataFrame, target: str = TARGET, name: str = "weight") -> DataFrame:
    """Give every row the weight of its class in the whole table."""
    counts = class_counts(df, target)
    n, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    weights = counts.select(F.col("label").alias("_label"), (n / (classes * F.col("n"))).alias(name))
    return df.drop(name).join(few_or_joined(weights), F.col(target) == F.col("_label"), "left").drop("_label")
