"""Logical tables kept as many parquet shards whose column types may drift."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hierfeat.session import stored
from hierfeat.sources.files import file_table
from hierfeat.spec import SUFFIX_TYPES

NULL = "null"
# Whole-number types from narrow to wide.
WHOLE = ["tinyint", "smallint", "int", "bigint", "decimal(20,0)"]
# Digits that a whole number of each type may have.
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
MOST_DIGITS = 38


def list_shards(spark: SparkSession, table: str, data_dir: str) -> list[str]:
    """Sorted paths of the files ``{table}*.parquet`` anywhere below a folder."""
    found = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"{table}*.parquet")
        .parquet(data_dir)
    )
    return sorted(found.inputFiles())


def relevant_files(spark: SparkSession, data_dir: str) -> list[str]:
    """Sorted paths of all train and test tables below a folder."""
    found = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*{train_,test_}*.parquet")
        .parquet(data_dir)
    )
    return sorted(found.inputFiles())


def read_footers(spark: SparkSession, paths: list[str]) -> list[tuple[set[str], list[str]]]:
    """Distinct sets of stored column types: the columns stored as null, and the sorted paths.

    The footers are read by the executors, and each set of types reaches the driver once.
    Spark itself shows a column stored as null as a number; the footer tells them apart.
    """

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch["path"]:
                system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
                schema = pq.read_schema(inner, filesystem=system)
                rows.append(json.dumps([[f.name, str(f.type)] for f in schema]))
            yield pd.DataFrame({"path": batch["path"], "types": rows})

    width = min(len(paths), spark.sparkContext.defaultParallelism * 4)
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(width)
    alike = (
        listed.mapInPandas(footers, "path string, types string")
        .groupBy("types")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
        .collect()
    )
    found = [({n for n, t in json.loads(r["types"]) if t == NULL}, r["paths"]) for r in alike]
    return sorted(found, key=lambda kind: kind[1])


def common_type(column: str, names: Iterable[str]) -> str | None:
    """Type that holds the values of all shards; None leaves the column as it is.

    A column that is null in every shard is typed by the last letter of its name.
    """
    kinds = set(names) - {NULL}
    if not kinds:
        kind = SUFFIX_TYPES.get(column[-1:])
        return kind.simpleString() if kind else None
    if len(kinds) == 1:
        return next(iter(kinds))
    if "string" in kinds:
        return "string"
    if kinds <= {*WHOLE, "boolean"}:
        return max(kinds - {"boolean"}, key=WHOLE.index)
    if all(k in (*WHOLE, "boolean", "float", "double") or k.startswith("decimal") for k in kinds):
        return wider_decimal(kinds - {"boolean"}) or "double"
    if kinds <= {"date", "timestamp", "timestamp_ntz"}:
        return "timestamp" if "timestamp" in kinds else "timestamp_ntz"
    raise ValueError(f"{column}: no common type for {sorted(kinds)}")


def wider_decimal(kinds: set[str]) -> str | None:
    """The decimal that holds all digits of decimals and whole numbers; None if there is none."""
    before, after = 0, 0
    for kind in kinds:
        if kind in DIGITS:
            whole, scale = DIGITS[kind], 0
        elif kind.startswith("decimal"):
            precision, scale = map(int, kind[len("decimal(") : -1].split(","))
            whole = precision - scale
        else:
            return None
        before, after = max(before, whole), max(after, scale)
    return f"decimal({before + after},{after})" if before + after <= MOST_DIGITS else None


def common_types(tables: list[dict[str, str]], allow_missing: bool = False) -> dict[str, str | None]:
    """The common type of each column, in the order in which columns come up."""
    columns = list(dict.fromkeys(c for types in tables for c in types))
    if not allow_missing:
        for types in tables:
            lacking = [c for c in columns if c not in types]
            if lacking:
                raise ValueError(f"shards differ in columns: {lacking}")
    return {c: common_type(c, [types[c] for types in tables if c in types]) for c in columns}


def union_tables(
    tables: list[tuple[DataFrame, dict[str, str]]], allow_missing: bool = False
) -> DataFrame:
    """Stack tables after casting each column to the type all of them share.

    Each table comes with its stored types, in which ``null`` marks an untyped column.
    """
    target = common_types([types for _, types in tables], allow_missing)
    columns = list(target)
    cast = [
        df.select(
            *[
                (F.lit(None) if types[c] == NULL and target[c] else F.col(f"`{c}`"))
                .cast(target[c] or df.schema[c].dataType)
                .alias(c)
                for c in columns
                if c in types
            ]
        )
        for df, types in tables
    ]
    result = cast[0]
    for df in cast[1:]:
        result = result.unionByName(df, allowMissingColumns=allow_missing)
    return result


def declared_types(df: DataFrame) -> dict[str, str]:
    """Types of a DataFrame in the form :func:`union_tables` takes."""
    return {
        f.name: NULL if isinstance(f.dataType, T.NullType) else f.dataType.simpleString() for f in df.schema.fields
    }


def footer_table(spark: SparkSession, files: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """``path`` and ``types`` (a JSON list of column and stored type) of every file of a table with ``path``.

    Executors read the footers, and the result stays a table. A store that their client cannot open is read
    through Spark: then ``contents`` (``path``, ``content``) gives the footers from whole files.
    """

    def by_path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
                    rows.append(json.dumps([[f.name, str(f.type)] for f in pq.read_schema(inner, filesystem=system)]))
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
                    rows.append(None)
            yield pd.DataFrame({"path": batch["path"], "types": rows})

    def by_content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pyarrow.parquet as pq

        for batch in batches:
            schemas = [pq.read_schema(io.BytesIO(c)) for c in batch["content"]]
            types = [json.dumps([[f.name, str(f.type)] for f in schema]) for schema in schemas]
            yield pd.DataFrame({"path": batch["path"], "types": types})

    found = stored(files.select("path").mapInPandas(by_path, "path string, types string"), "footers")
    unread = found.filter("types IS NULL")
    if contents is None or unread.isEmpty():
        return found
    whole = contents.join(unread.select("path"), "path", "left_semi").mapInPandas(by_content, "path string, types string")
    return stored(found.filter("types IS NOT NULL").union(whole), "footers")


def readable(kind: str, target: str) -> bool:
    """Whether Spark's reader gives a column stored as ``kind`` as ``target`` by itself.

    It widens whole numbers, to doubles too if these hold them exactly, floats, decimals and dates.
    """
    if kind == target:
        return True
    if kind == NULL:
        return target in (*DIGITS, "double", "date")
    if kind in DIGITS and target in DIGITS:
        return WHOLE.index(kind) <= WHOLE.index(target)
    if kind in DIGITS and target == "double":
        return kind != "bigint"
    if target.startswith("decimal"):
        return (kind in DIGITS or kind.startswith("decimal")) and wider_decimal({kind, target}) == target
    return (kind, target) in {("float", "double"), ("date", "timestamp_ntz")}


def scan_table(spark: SparkSession, table: str, data_dir: str, allow_missing: bool = False) -> DataFrame:
    """All shards of a table as one DataFrame.

    The footers of all files are a table; only the different sets of types, each with one of its files, reach the driver.
    Where Spark's reader can widen every stored type to the common one, the plan is one scan of the folder, and no
    paths are listed. What it cannot (a column stored as null that holds texts elsewhere, a whole number that became a
    text) is cast instead: then there is one scan per set of types.
    """
    pattern = f"{table}*.parquet"
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    footers = footer_table(spark, file_table(spark, data_dir, pattern), contents.load(data_dir).select("path", "content"))
    kinds = sorted(footers.groupBy("types").agg(F.min("path").alias("path")).collect(), key=lambda r: r["path"])
    if not kinds:
        return whole.parquet(data_dir)  # an error that names the folder
    schemas = [spark.read.parquet(r["path"]).schema for r in kinds]
    nulls = [{n for n, t in json.loads(r["types"]) if t == NULL} for r in kinds]
    types = [
        {f.name: NULL if f.name in none else f.dataType.simpleString() for f in schema.fields}
        for schema, none in zip(schemas, nulls)
    ]
    target = common_types(types, allow_missing)
    if all(readable(kind, target[c] or kind) for own in types for c, kind in own.items()):
        known = {(f.name, f.dataType.simpleString()): f.dataType for schema in schemas for f in schema.fields}
        fields = []
        for c, kind in target.items():
            own = next(schema[c].dataType for schema in schemas if c in schema.names)
            fields.append(T.StructField(c, own if kind is None else known.get((c, kind)) or T.DataType.fromDDL(kind)))
        return whole.schema(T.StructType(fields)).parquet(data_dir)
    tables = []
    for kind, own in zip(kinds, types):
        paths = footers.filter(F.col("types") == kind["types"]).select("path").toLocalIterator()
        tables.append((spark.read.parquet(*sorted(r["path"] for r in paths)), own))
    return union_tables(tables, allow_missing)
