"""Expressions over array<double> columns and class logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def mean_squared_error(left: Column, right: Column) -> Column:
    """Mean over features of the squared difference, per row."""
    squares = F.zip_with(left, right, lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2))
    return total(squares) / F.size(left)


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(total(F.transform(logits, lambda x: F.exp(x - top))))


def energy(logits: Column) -> Column:
    return -log_sum_exp(logits)


def softmax_at(logits: Column, position: int | Column) -> Column:
    return F.exp(F.get(logits, F.lit(position) if isinstance(position, int) else position) - log_sum_exp(logits))
