"""Restricting tables to sampled entities and joining them onto the base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hierfeat.operators.skew import HotKeys, listed_in
from hierfeat.spec import CASE, FLAG_SUFFIX, GROUP1, flag_name


def restrict(df: DataFrame, ids: DataFrame, key: str = CASE, hot: HotKeys | None = None) -> DataFrame:
    """Rows of the listed entities. Runs ahead of every rollup, so less is aggregated.

    Rows of ``hot`` keys are not shuffled by their key: the few hot ids that are listed
    are broadcast to them.
    """
    wanted = ids.select(key)
    if hot is None:
        return df.join(wanted, key, "left_semi")
    ordinary = listed_in(df, [key], hot.table, "left_anti").join(wanted, key, "left_semi")
    kept = hot.table.join(wanted, key, "left_semi")
    return ordinary.unionAll(listed_in(df.filter(F.col(key).isNotNull()), [key], kept, "left_semi"))


def add_joined_flag(df: DataFrame, table: str) -> DataFrame:
    return df.withColumn(flag_name(table), F.lit(1).cast("byte"))


def fill_joined_flags(df: DataFrame) -> DataFrame:
    flags = [c for c in df.columns if c.endswith(FLAG_SUFFIX)]
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("byte") for c in flags})


def left_join_named(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join; a value column present on both sides comes out with ``_right`` appended."""
    taken = set(left.columns)
    renames = {}
    for c in right.columns:
        if c in keys or c not in taken:
            continue
        if f"{c}_right" in taken or f"{c}_right" in right.columns:
            raise ValueError(f"column {c} comes up a third time; rename it at its source")
        renames[c] = f"{c}_right"
    return left.join(right.withColumnsRenamed(renames), list(keys), "left")


def attach_children(parent: DataFrame, children: Sequence[DataFrame]) -> DataFrame:
    """Join rolled-up depth-2 tables to their depth-1 parent rows."""
    for child in children:
        parent = left_join_named(parent, child, [CASE, GROUP1])
    return parent


def join_to_base(base: DataFrame, tables: dict[str, DataFrame] | Sequence[DataFrame]) -> DataFrame:
    """Left-join tables of one row per entity onto the base, in the given order."""
    for table in tables.values() if isinstance(tables, dict) else tables:
        base = left_join_named(base, table, [CASE])
    return base
