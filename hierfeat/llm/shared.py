"""Folders that all executors see, and tables written there to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below the checkpoint folder of the session.

    Where the session names none, the warehouse, which a cluster shares as well, is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to a shared folder and read it back.

    Later steps then start from the files: a lost executor costs no recomputation of
    what came before, and unused columns are not read.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def removed(df: DataFrame | None) -> None:
    """Delete the files of a table that ``stored`` has returned and that no later step reads."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of the table has, whatever the case of its letters."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        taken.add(name)
        found.append(name)
    return found


def made_once(shipped: Broadcast, make: Callable[..., Any]) -> Any:
    """``make(*value)`` of a broadcast tuple; a Python worker keeps it for its later tasks.

    The tuple holds plain values only: broadcasts are pickled by reference, and executors need
    no copy of this package.
    """
    if not hasattr(shipped, "_made"):
        shipped._made = make(*shipped.value)
    return shipped._made
