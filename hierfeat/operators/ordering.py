"""Epoch orders, batches, chunks, worker shares and table ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hierfeat.functions.hashing import hash_hex, hex_word
from hierfeat.operators import slices
from hierfeat.session import shuffle_width
from hierfeat.spec import CASE


def epoch_shuffle(df: DataFrame, key: str = CASE, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Every row once, in an order fixed by ``seed + epoch``, as ordered partitions."""
    return (
        df.withColumn("_hash", hash_hex(seed + epoch, F.col(key)))
        .repartitionByRange("_hash", key)
        .sortWithinPartitions("_hash", key)
        .drop("_hash")
    )


def epoch_position(df: DataFrame, key: str = CASE, seed: int = 42, epoch: int = 0) -> DataFrame:
    """The same order as a column: ``position`` counts from 0."""
    hashed = df.withColumn("_hash", hash_hex(seed + epoch, F.col(key)))
    return slices.row_index(slices.by_hash(hashed, "_hash"), ["_hash", key], name="position").drop("_hash")


def chunk_windows(
    df: DataFrame, chunk: str = "chunk", key: str = CASE, size: int = 8, seed: int = 42, epoch: int = 0
) -> DataFrame:
    """An epoch order in two levels that moves no row: whole chunks go into windows, rows are shuffled inside them.

    ``window`` (from 0) is a hash of the chunk and ``seed + epoch``, so that a window holds ``size`` chunks on average;
    rows lie where they were read, sorted in their partition by window and hash. A reader that takes window by
    window sees chunks in a new order each epoch, and the rows of about ``size`` chunks mixed. Chunks
    without rows may leave a window empty; rows without a chunk have no window and come first.
    """
    hashed = _windowed(df, chunk, key, size, seed, epoch)
    return hashed.sortWithinPartitions("window", "_hash", key).drop("_hash", "_windows")


def chunk_window_position(
    df: DataFrame, chunk: str = "chunk", key: str = CASE, size: int = 8, seed: int = 42, epoch: int = 0
) -> DataFrame:
    """The same order over all windows as a column: ``position`` counts from 0, next to ``window``."""
    hashed = _windowed(df, chunk, key, size, seed, epoch)
    place = F.coalesce(F.floor(F.col("window") * shuffle_width(df.sparkSession) / F.col("_windows")), F.lit(0))
    sliced = hashed.withColumn(slices.SLICE, place.cast("int")).drop("_windows")
    return slices.row_index(sliced, ["window", "_hash", key], name="position").drop("_hash")


def _windowed(df: DataFrame, chunk: str, key: str, size: int, seed: int, epoch: int) -> DataFrame:
    _positive(size)
    # A subquery over one column; on stored chunks it reads no data.
    windows = df.agg(F.ceil((F.max(chunk) - F.min(chunk) + 1) / size).cast("bigint").alias("windows")).scalar()
    window = F.pmod(hex_word(hash_hex(seed + epoch, F.col(chunk))), F.col("_windows"))
    return df.withColumn("_windows", windows).withColumns(
        {"window": window.cast("bigint"), "_hash": hash_hex(seed + epoch, F.col(key))}
    )


def number_rows(df: DataFrame, order: str = CASE, name: str = "row_idx") -> DataFrame:
    """Consecutive numbers from 0 in the order of a unique numeric column."""
    return slices.row_index(slices.by_value(df, order), [order], name=name)


def assign_chunks(df: DataFrame, chunk_size: int, order: str = CASE, name: str = "chunk") -> DataFrame:
    """Chunk numbers from 1, ``chunk_size`` consecutive rows each."""
    _positive(chunk_size)
    return number_rows(df, order).withColumn(name, F.expr(f"row_idx div {int(chunk_size)}") + 1).drop("row_idx")


def assign_batches(
    df: DataFrame, batch_size: int, order: str = CASE, drop_last: bool = False, name: str = "batch"
) -> DataFrame:
    """Batch numbers from 0; ``drop_last`` leaves out an incomplete final batch."""
    _positive(batch_size)
    rows = number_rows(df, order).withColumn(name, F.expr(f"row_idx div {int(batch_size)}"))
    if drop_last:
        count = df.agg(F.count(F.lit(1))).scalar()
        rows = rows.filter(F.col(name) < F.floor(count / F.lit(batch_size)))
    return rows.drop("row_idx")


def assign_workers(df: DataFrame, workers: int, chunk: str = "chunk", name: str = "worker") -> DataFrame:
    """Contiguous shares of ``ceil(chunks / workers)`` chunks; chunk numbers start at 1."""
    _positive(workers)
    _, chunks = chunk_span(df, chunk)
    share = max(1, -(-chunks // workers))
    return df.withColumn(name, F.floor((F.col(chunk) - 1) / share).cast("bigint"))


def split_by_worker(df: DataFrame, workers: int, chunk: str = "chunk") -> DataFrame:
    """One partition per worker, holding its chunks."""
    assigned = assign_workers(df, workers, chunk, "_worker")
    return assigned.repartitionById(workers, F.col("_worker").cast("int")).drop("_worker")


def hold_out_last_chunk(df: DataFrame, chunk: str = "chunk") -> tuple[DataFrame, DataFrame]:
    """Train on all chunks but the last, validate on the last; a single chunk serves both."""
    low, high = chunk_span(df, chunk)
    train = df if low == high else df.filter(F.col(chunk) < high)
    return train, df.filter(F.col(chunk) == high)


def chunk_span(df: DataFrame, chunk: str = "chunk") -> tuple[int, int]:
    """First and last chunk number; on stored chunks this reads no data columns."""
    row = df.agg(F.min(chunk), F.max(chunk)).first()
    return row[0] or 0, row[1] or 0


def head(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def _positive(size: int) -> None:
    if size < 1:
        raise ValueError(f"size must be at least 1, not {size}")
