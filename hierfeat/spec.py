"""Names, key columns and configuration of a table hierarchy."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

# Fixed column names of the data model.
CASE = "case_id"
GROUP1 = "num_group1"
GROUP2 = "num_group2"
TARGET = "target"
WEEK = "WEEK_NUM"
MONTH = "MONTH"
KEYS = (CASE, GROUP1, GROUP2)
FLAG_SUFFIX = "_joined_flag"
NULL_SUFFIX = "_is_null"
MISSING = "MISSING"

# Types of columns that are null in every shard, by last letter.
SUFFIX_TYPES = {
    "D": T.StringType(),
    "A": T.DoubleType(),
    "L": T.DoubleType(),
    "P": T.DoubleType(),
    "M": T.StringType(),
    "T": T.StringType(),
}


@dataclass(frozen=True)
class TableSpec:
    """One source table: its depth, its parent (depth 2) and its row order."""

    name: str
    depth: int
    parent: str | None = None
    order: tuple[str, ...] = ()

    def __post_init__(self):
        if self.depth not in (0, 1, 2):
            raise ValueError(f"{self.name}: depth must be 0, 1 or 2, not {self.depth}")
        if self.depth == 2 and not self.parent:
            raise ValueError(f"{self.name}: a depth-2 table needs its parent")

    @property
    def order_columns(self) -> tuple[str, ...]:
        return self.order or {0: (), 1: (GROUP1,), 2: (GROUP2,)}[self.depth]

    @property
    def flag(self) -> str:
        return flag_name(self.name)

    def for_mode(self, inference: bool) -> TableSpec:
        return replace(
            self,
            name=mode_name(self.name, inference),
            parent=self.parent and mode_name(self.parent, inference),
        )


@dataclass(frozen=True)
class HierarchySpec:
    """A base table and the tables below it, in the order they are joined."""

    tables: tuple[TableSpec, ...]
    base: str = "train_base"

    def __post_init__(self):
        parents = {t.name for t in self.tables if t.depth == 1}
        for table in self.at_depth(2):
            if table.parent not in parents:
                raise ValueError(f"{table.name}: parent {table.parent} is not a listed depth-1 table")

    def at_depth(self, depth: int) -> list[TableSpec]:
        return [t for t in self.tables if t.depth == depth]

    def for_mode(self, inference: bool) -> HierarchySpec:
        return HierarchySpec(
            tables=tuple(t.for_mode(inference) for t in self.tables),
            base=mode_name(self.base, inference),
        )


@dataclass(frozen=True)
class BuildConfig:
    """Settings of one feature build."""

    data_dir: str
    sample_ratio: float = 1.0
    is_inference: bool = False
    artifact_dir: str = "models/artifacts"
    output_dir: str = "data/processed"
    chunk_size: int = 200_000
    chunked_export: bool = True
    exact_sample: bool = True
    seed: int = 42


def mode_name(table: str, inference: bool) -> str:
    return table.replace("train_", "test_") if inference else table


def flag_name(table: str) -> str:
    for part in ("train_", "test_", ".parquet"):
        table = table.replace(part, "")
    return table + FLAG_SUFFIX
