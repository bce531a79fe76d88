"""Listing and naming files with the file system client of Spark itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def file_table(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path``, ``length`` and ``modificationTime`` of all files of a name pattern below a folder.

    A table like any other: rows are spread over tasks, and the files are not opened.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return found.load(folder).select("path", "length", "modificationTime")


class Folder:
    """A folder in any store that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._at = spark, spark._jvm.org.apache.hadoop.fs.Path(path)
        self._system = self._at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self) -> list[str]:
        """Sorted names of what lies in the folder; none when it does not exist."""
        if not self._system.exists(self._at):
            return []
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._at))

    def child(self, name: str) -> Folder:
        return Folder(self._spark, f"{self._at}/{name}")

    def take(self, source: Folder, name: str) -> None:
        """Rename ``source`` to ``name`` in this folder."""
        if not self._system.rename(source._at, self.child(name)._at):
            raise OSError(f"cannot rename {source._at} to {self._at}/{name}")

    def delete(self, name: str) -> None:
        self._system.delete(self.child(name)._at, True)
