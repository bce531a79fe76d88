"""Splitting off keys with very many rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierfeat.session import stored

# Values of one group that one task may hold in memory, over all columns.
HOT_CELLS = 1_000_000
# Hot keys are broadcast, so the threshold rises with the table to keep them this few.
MOST_HOT = 5_000_000
# Up to this many pass through the driver; more are stored.
MOST_COLLECTED = 100_000
# A key with a larger share of the rows is giant, more than one task's work by itself;
# at most 1 / share exist.
GIANT_SHARE = 1e-4


@dataclass
class HotKeys:
    """Keys of large groups, at most ``MOST_HOT``, with ``_giant`` marking the largest."""

    table: DataFrame

    def only(self, giant: bool) -> HotKeys:
        return HotKeys(self.table.filter(F.col("_giant") == F.lit(giant)))


def find_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    columns: int = 1,
    cells: int = HOT_CELLS,
    most: int = MOST_HOT,
    collected: int = MOST_COLLECTED,
    giant: float = GIANT_SHARE,
) -> HotKeys | None:
    """Keys whose groups exceed ``cells`` values in ``columns`` columns; None without any.

    One job that counts the key columns, combined before it shuffles.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    # The total is a sum of the same counts, so the table is read and shuffled once.
    total = sizes.agg(F.sum("_rows")).scalar()
    limit = F.greatest(F.lit(cells // max(1, columns)), total / F.lit(most))
    counts = sizes.filter(F.col("_rows") > limit)
    found = counts.select(*keys, (F.col("_rows") > total * F.lit(giant)).alias("_giant"))
    rows = found.limit(collected + 1).collect()
    if not rows:
        return None
    if len(rows) <= collected:
        return HotKeys(df.sparkSession.createDataFrame(rows, found.schema))
    return HotKeys(stored(found, "hot-keys"))


def listed_in(df: DataFrame, keys: Sequence[str], table: DataFrame, how: str) -> DataFrame:
    """Rows whose keys are (``left_semi``) or are not (``left_anti``) in a bounded list."""
    listed = F.broadcast(table.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    same: Column = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_hot_{key}"))
    return df.join(listed, same, how)


def split_hot(df: DataFrame, keys: Sequence[str], hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and rows of hot keys."""
    return listed_in(df, keys, hot.table, "left_anti"), listed_in(df, keys, hot.table, "left_semi")
