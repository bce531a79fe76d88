"""Writing feature tables, chunks, scores and profiles."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hierfeat.operators.ordering import assign_chunks, number_rows
from hierfeat.operators.profile import describe
from hierfeat.sources.files import Folder
from hierfeat.spec import CASE


def export_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_chunks(
    df: DataFrame, path: str, chunk_size: int = 200_000, prefix: str = "train_chunk", order: str = CASE
) -> list[str]:
    """Write consecutive rows in chunks of a fixed size, one folder per chunk.

    Chunk ``i`` is ``{path}/{prefix}={i}``, rows in ``order``. Returns the folders. A
    chunk is one task's work, so ``chunk_size`` bounds every writer.
    """
    numbered = assign_chunks(df, chunk_size, order, prefix)
    numbered.repartition(F.col(prefix)).sortWithinPartitions(prefix, order).write.mode("overwrite").partitionBy(
        prefix
    ).parquet(path)
    return [f"{path}/{prefix}={i}" for i in chunk_numbers(df.sparkSession, path, prefix)]


def chunk_numbers(spark: SparkSession, path: str, prefix: str = "train_chunk") -> list[int]:
    """Sorted numbers of the chunks at a path; none when it does not exist."""
    named = [chunk_number(name, prefix) for name in Folder(spark, path).names()]
    if any(named):
        return sorted(n for n in named if n)
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        return []
    if prefix not in stored.columns:
        return []
    return [r[0] for r in stored.select(prefix).distinct().orderBy(prefix).collect()]


def export_chunk_files(
    df: DataFrame, path: str, chunk_size: int = 200_000, prefix: str = "train_chunk", order: str = CASE
) -> list[str]:
    """Write consecutive rows in chunks of a fixed size, one file ``{path}/{prefix}_NNN.parquet`` per chunk.

    ``order`` is a unique number. Only its values are numbered; where each chunk begins then tells every wide row its
    chunk, so wide rows move once, each chunk to a partition of its own. Files are written to a folder aside, where
    Spark commits one per chunk however often tasks are tried again, and get their names at the end; files of these
    names from an earlier export go then. Returns the paths.
    """
    spark = df.sparkSession
    starts = number_rows(df.select(order), order).filter(F.col("row_idx") % int(chunk_size) == 0)
    firsts = np.sort(np.array([r[0] for r in starts.select(order).collect()]))
    numbered = df.withColumn("_chunk", chunk_of(F.col(order), firsts))
    aside = f"_writing-{uuid.uuid4().hex}"
    (
        numbered.repartitionById(max(len(firsts), 1), F.col("_chunk") - 1)
        .sortWithinPartitions("_chunk", order)
        .write.partitionBy("_chunk")
        .option("maxRecordsPerFile", 0)
        .parquet(f"{path}/{aside}")
    )
    folder = Folder(spark, path)
    for name in folder.names():
        if chunk_number(name, prefix):
            folder.delete(name)
    names = [f"{prefix}_{i:03d}.parquet" for i in range(1, len(firsts) + 1)]
    for i, name in enumerate(names, 1):
        made = folder.child(aside).child(f"_chunk={i}")
        parts = [x for x in made.names() if x.endswith(".parquet")]
        if len(parts) != 1:
            raise OSError(f"chunk {i} has {len(parts)} files")
        folder.take(made.child(parts[0]), name)
    folder.delete(aside)
    return [f"{path}/{name}" for name in names]


def chunk_of(order: Column, firsts: np.ndarray) -> Column:
    """Number of the chunk, from 1, that a value lies in; ``firsts`` holds the first value of each."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array(np.searchsorted(firsts, values.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    return F.arrow_udf(run, "int")(order)


def chunk_number(name: str, prefix: str) -> int | None:
    found = re.fullmatch(re.escape(prefix) + r"_(\d+)\.parquet", name)
    return int(found[1]) if found else None


def read_chunks(spark: SparkSession, path: str, prefix: str = "train_chunk") -> DataFrame:
    """Chunks as one table with their number in ``chunk``; files by name, or folders of chunk numbers."""
    if not any(chunk_number(name, prefix) for name in Folder(spark, path).names()):
        return spark.read.parquet(path).withColumnRenamed(prefix, "chunk")
    rows = spark.read.option("pathGlobFilter", f"{prefix}_*.parquet").parquet(path)
    number = F.regexp_extract("_metadata.file_name", r"_(\d+)\.parquet$", 1).cast("int")
    return rows.withColumn("chunk", number)


def export_latents(latents: DataFrame, path: str, chunk: str = "chunk") -> None:
    """Latent vectors with class and week, one folder per input chunk, in one job."""
    latents.repartition(F.col(chunk)).write.mode("overwrite").partitionBy(chunk).parquet(path)


def read_latents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_scores(scored: DataFrame, path: str) -> None:
    """``case_id,score`` as CSV with a header."""
    scored.select(CASE, "score").write.mode("overwrite").option("header", True).csv(path)


def export_profile(df: DataFrame, path: str) -> None:
    """Column statistics as CSV, one row per column."""
    describe(df).orderBy("pos").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
