"""Folding arriving chunk files into a scaler state, and scoring them as they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hierfeat.operators.scale import ScalerModel, moments
from hierfeat.operators.score import ScoringModel
from hierfeat.spec import CASE


def chunk_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Chunk files below a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def fold_moments(
    stream: DataFrame, columns: Sequence[str], state_path: str, checkpoint: str
) -> StreamingQuery:
    """Store one partial state per micro-batch; a repeated batch overwrites its own state."""

    def store(batch: DataFrame, batch_id: int) -> None:
        moments(batch, columns).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def folded_scaler(spark: SparkSession, state_path: str) -> ScalerModel:
    """Scaler of all states stored so far, without reading the data again."""
    return ScalerModel.from_moments(spark.read.parquet(state_path).drop("batch"))


def score_stream(
    stream: DataFrame, model: ScoringModel, output: str, checkpoint: str, keep: Sequence[str] = (CASE,)
) -> StreamingQuery:
    """Score chunks as they arrive, exactly once."""
    return (
        model.score(stream, keep)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
