"""Missing-value expressions. Missing means null, and for floats also NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierfeat.spec import MISSING


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_missing(col: Column, dtype: T.DataType) -> Column:
    return col.isNull() | F.isnan(col) if is_float(dtype) else col.isNull()


def null_indicator(col: Column, dtype: T.DataType) -> Column:
    return is_missing(col, dtype).cast("byte")


def nan_as_null(col: Column, dtype: T.DataType) -> Column:
    return F.when(~F.isnan(col), col) if is_float(dtype) else col


def filled(col: Column, dtype: T.DataType, value: float) -> Column:
    """``value`` where missing. Whole-number columns become double, as the value may be a midpoint."""
    kind = "float" if isinstance(dtype, T.FloatType) else "double"
    return F.when(is_missing(col, dtype), F.lit(value).cast(kind)).otherwise(col.cast(kind))


def category(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(MISSING))


def feature_float(col: Column) -> Column:
    """Feature value for learning: 32-bit float, 0 where missing."""
    return F.coalesce(F.nanvl(col.cast("float"), F.lit(0.0).cast("float")), F.lit(0.0).cast("float"))
