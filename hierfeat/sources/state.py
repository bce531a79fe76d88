"""Ordered feature lists as stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def save_features(spark: SparkSession, features: Sequence[str], artifact_dir: str) -> None:
    rows = list(enumerate(features))
    spark.createDataFrame(rows, "pos int, col string").coalesce(1).write.mode("overwrite").json(
        f"{artifact_dir}/feature_cols"
    )


def load_features(spark: SparkSession, artifact_dir: str) -> list[str]:
    """The stored feature list in its order."""
    path = f"{artifact_dir}/feature_cols"
    try:
        stored = spark.read.schema("pos int, col string").json(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"no feature list at {path}; run the training build first") from error
    return [r["col"] for r in stored.orderBy("pos").collect()]
