"""Column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierfeat.operators.quantiles import column_quantiles


def describe(df: DataFrame, method: str = "nearest") -> DataFrame:
    """Count, nulls, mean, std, extremes and quartiles, one row per column.

    Extremes of columns without numbers are in ``min_text`` and ``max_text``. NaN is a
    value here, as in the data.
    """
    fields = list(enumerate(df.schema.fields))
    numeric = [(i, f.name) for i, f in fields if isinstance(f.dataType, T.NumericType)]
    parts = []
    if numeric:
        parts.append(_numbers(df, numeric, method))
    if len(numeric) < len(fields):
        parts.append(_texts(df, [(i, f) for i, f in fields if not isinstance(f.dataType, T.NumericType)]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _numbers(df: DataFrame, columns: list[tuple[int, str]], method: str) -> DataFrame:
    entries = [
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("_v"))
        for i, c in columns
    ]
    v = F.col("_v")
    stats = (
        df.select(F.inline(F.array(*entries)))
        .groupBy("pos", "col")
        .agg(
            F.count(v).alias("count"),
            F.count(F.when(v.isNull(), 1)).alias("null_count"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        )
    )
    quartiles = column_quantiles(df, [c for _, c in columns], [0.25, 0.5, 0.75], method).drop("n")
    none = F.lit(None).cast("string")
    return stats.withColumns({"min_text": none, "max_text": none}).join(
        quartiles.withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"}), "col", "left"
    )


def _texts(df: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    aggs, states = [], []
    for i, field in fields:
        col = F.col(f"`{field.name}`")
        ordered = not isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))
        aggs += [F.count(col).alias(f"_c{i}"), F.count(F.when(col.isNull(), 1)).alias(f"_z{i}")]
        if ordered:
            aggs += [F.min(col).cast("string").alias(f"_l{i}"), F.max(col).cast("string").alias(f"_h{i}")]
        states.append(
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(field.name).alias("col"),
                F.col(f"_c{i}").alias("count"),
                F.col(f"_z{i}").alias("null_count"),
                *[F.lit(None).cast("double").alias(s) for s in ("mean", "std", "min", "max")],
                (F.col(f"_l{i}") if ordered else F.lit(None).cast("string")).alias("min_text"),
                (F.col(f"_h{i}") if ordered else F.lit(None).cast("string")).alias("max_text"),
                *[F.lit(None).cast("double").alias(s) for s in ("q25", "q50", "q75")],
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*states)))
