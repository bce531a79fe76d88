"""Which steps of a run are done, so that a job that died goes on after the last finished one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hierfeat.sources.files import file_table


def files_digest(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> str:
    """A digest of the paths, sizes and times of all files of a folder; the files are not opened."""
    entry = F.xxhash64("path", "length", "modificationTime")
    n, size, mixed = file_table(spark, folder, pattern).agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(entry)).first()
    return f"{n}:{size}:{mixed}"


class RunManifest:
    """Finished steps of one run, a small table each below a folder.

    A step is known by its name and a digest of its inputs: configuration, files, digests of the steps before it. It is
    recorded after its work has been written, so a step that died halfway is done again, and a changed
    input does it and all that build on it again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def recorded(self, name: str) -> str | None:
        try:
            found = self.spark.read.schema("digest string").json(f"{self.folder}/step={name}").first()
        except AnalysisException:
            return None
        return found["digest"] if found else None

    def step(self, name: str, inputs: Sequence[str], work: Callable[[], object]) -> str:
        """Do ``work`` unless it is recorded for the same inputs; returns the digest for steps that follow."""
        digest = hashlib.sha256("\n".join([name, *map(str, inputs)]).encode()).hexdigest()
        if self.recorded(name) != digest:
            work()
            row = self.spark.createDataFrame([(digest,)], "digest string")
            row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/step={name}")
        return digest
