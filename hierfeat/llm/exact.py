"""Exact dedup against a digest index that outlives a run.

The index is a table with one row for each distinct text seen so far, bucketed and sorted by
the digest. A batch of new documents is reduced to one row per digest, and a sort-merge
anti-join finds the digests the index lacks; the index side is read bucket by bucket, without
a shuffle. What is missing is appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hierfeat.llm.shared import fresh, shared_folder, stored

SPACES = r"[\x20\x09-\x0D]+"
BUCKETS = 64


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of a text with runs of white space made one space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256)


class DigestIndex:
    """Digests seen so far and the document that was kept for each.

    ``folder`` is a path all executors share; an index found there goes on. Its table has the
    columns ``digest``, ``keep_id``, ``batch``. Appending a batch that was appended before
    changes nothing, since its digests are there.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.table = "digest_index_" + folder.rstrip("/").rsplit("/", 1)[-1].replace("-", "_").lower()
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'"
            )

    def by_bucket(self) -> DataFrame:
        """The index as a bucketed table: joins on the digest need no shuffle of it."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def rows(self) -> DataFrame:
        """The index as plain files: joins shuffle it, and may split what is skewed on the other side."""
        return self.spark.read.schema("digest string, keep_id bigint, batch string").parquet(self.folder)

    def missing(self, digests: DataFrame) -> DataFrame:
        """Of a table with one row per digest, the rows whose digest the index lacks.

        Spark deals the rows out like the buckets, so each task meets one bucket of the index and
        writes one file to it.
        """
        known = self.by_bucket().select("digest").hint("merge")
        return digests.join(known, "digest", "left_anti")

    def append(self, digests: DataFrame, batch: str) -> None:
        """Add the missing ones of ``digest``, ``keep_id``; one file for each bucket and batch."""
        (
            self.missing(digests)
            .select("digest", "keep_id", F.lit(batch).alias("batch"))
            .write.mode("append")
            .format("parquet")
            .option("path", self.folder)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )


def add_batch(index: DigestIndex, digests: DataFrame, batch: str) -> None:
    """Deduplicate rows of ``key``, ``digest`` against the index and append what is new.

    Copies inside the batch are combined before any shuffle; the smallest key represents them.
    """
    index.append(digests.groupBy("digest").agg(F.min("key").alias("keep_id")), batch)


def decisions(
    docs: DataFrame, index: DigestIndex | None = None, key: str = "doc_id", text: str = "text", batches: int = 2
) -> DataFrame:
    """For every document, which document with an equal text stays.

    Returns one row per row of ``docs``: the key, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``. The documents reach the index in ``batches`` ranges of rising keys, so of
    equal texts the smallest key stays. With an index that already holds a text, the document
    kept earlier stays and no new one is.

    Null texts are empty texts. A null key comes after all others: such a row is kept only if
    its text has no key at all. Of rows that repeat key and text one is kept. Repeated rows
    count for ``group_size``. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, shared_folder(spark, "digest-index"))
    rows = stored(
        docs.select(F.col(key).cast("bigint").alias("key"), digest(F.col(text)).alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "digests",
    )
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    step = -(-((high or 0) - (low or 0) + 1) // batches)
    number = F.least(F.floor((F.col("key") - F.lit(low or 0)) / step), F.lit(batches - 1))
    for b in range(batches):
        # Rows without a key come last.
        own = (number == b) | (F.col("key").isNull() if b == batches - 1 else F.lit(False))
        add_batch(index, rows.filter(own).select("key", "digest"), f"{b:04d}")

    groups = rows.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "row"))["row"].alias("first_row"),
    )
    # One row per digest on the right; a text with very many copies is split on the left.
    kept = groups.join(index.rows().select("digest", "keep_id"), "digest", "left")
    return rows.join(kept, "digest").select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        ((F.col("row") == F.col("first_row")) & F.col("key").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Texts are shuffled once, by key. Nulls, ties and repeated rows as in ``decisions``.
    """
    same, plain, no_key = fresh(docs, "same", "plain_key", "no_key")

    def keyed(rows: DataFrame, found: Column) -> DataFrame:
        # A null key is a key of its own in the join.
        return rows.withColumns({same: found, plain: F.coalesce(key, F.lit(0)), no_key: F.col(key).isNull()})

    on = [plain, no_key, same]
    decided = decisions(docs, index, key, text).filter("kept")
    stay = keyed(decided, F.col("text_sha256")).select(*on)
    joined = keyed(docs, digest(F.col(text))).join(stay, on, "left_semi")
    # Rows that repeat a key and its text are in one partition already.
    return joined.dropDuplicates(on).select(*docs.columns)
