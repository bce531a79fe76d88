"""Shards whose types drift, chunk files by name, the whole job, and chunks as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from hierfeat.catalog import tables as t
from hierfeat.catalog.registry import query, rounded
from hierfeat.catalog.samples import CHUNK_ROWS, CHUNKED, order_rows
from hierfeat.catalog.scoring import ENCODE_1, ENCODE_1_BIAS, ENCODE_2, ENCODE_2_BIAS, SCORE, dense_sql, encoder, rule
from hierfeat.operators import network
from hierfeat.operators.scale import ScalerModel
from hierfeat.operators.score import ScoringModel
from hierfeat.plans.whole_job import WholeJob
from hierfeat.session import new_folder
from hierfeat.sources.export import export_chunk_files, read_chunks
from hierfeat.sources.shards import scan_table
from hierfeat.sources.state import save_features
from hierfeat.spec import BuildConfig, HierarchySpec, TableSpec
from hierfeat.streaming.chunks import chunk_stream, fold_moments, folded_scaler

SHARD_ROWS = 4_000


def drifting(spark, sf_dir):
    """Orders as three parts whose columns have other types."""
    orders = t.read(spark, sf_dir, "orders")
    half = F.col("o_orderkey") / F.lit(2)
    price = F.col("o_totalprice")
    kinds = [
        ("smallint", F.col("o_custkey") % 100, "decimal(12,2)", F.lit(1)),
        ("int", F.col("o_custkey") % 1000, "decimal(14,3)", F.lit(2)),
        ("double", half, "decimal(13,2)", F.lit(3)),
    ]
    return [
        orders.filter(F.col("o_orderkey") % 3 == i).select(
            F.col("o_orderkey").alias("case_id"),
            amount.cast(kind).alias("amount_1A"),
            price.cast(money).alias("money_2A"),
            part.cast(["int", "bigint", "bigint"][i]).alias("part_3P"),
            F.col("o_orderstatus").alias("status_4M"),
        )
        for i, (kind, amount, money, part) in enumerate(kinds)
    ]


DRIFTED = """SELECT o_orderkey AS case_id,
  CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey % 100 AS DOUBLE) WHEN 1 THEN CAST(o_custkey % 1000 AS DOUBLE)
       ELSE o_orderkey / 2.0::DOUBLE END AS amount_1A,
  CAST(o_totalprice AS DECIMAL(14,3)) AS money_2A, CAST(o_orderkey % 3 + 1 AS BIGINT) AS part_3P"""


@query("widened_shards", f"{DRIFTED}, o_orderstatus AS status_4M FROM orders")
def widened_shards(spark, sf_dir):
    """Shards of many files whose numbers only need widening: one scan."""
    folder = new_folder(spark, "widened")
    for i, part in enumerate(drifting(spark, sf_dir)):
        export_chunk_files(part, f"{folder}/part{i}", SHARD_ROWS, prefix=f"orders_{i}")
    return scan_table(spark, "orders", folder)


def write_untyped(rows, folder: str, table: str) -> None:
    """One file per task, with a column that is stored as null."""
    kind = rows.drop("status_4M").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        found = pa.Table.from_batches(batches, None) if (batches := list(batches)) else None
        if found is not None:
            system, inner = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
            system.create_dir(inner)
            name = f"{inner}/{table}_{TaskContext.get().partitionId()}.parquet"
            pq.write_table(found.append_column("status_4M", pa.nulls(len(found))), name, filesystem=system)
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    if not rows.drop("status_4M").mapInArrow(run, "name string").count():
        raise ValueError(f"no rows of {kind.simpleString()}")


@query(
    "drifted_shards",
    f"{DRIFTED}, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderstatus END AS status_4M FROM orders",
)
def drifted_shards(spark, sf_dir):
    """The same, and in some files a column of texts is stored as null: cast for each set of types."""
    folder = new_folder(spark, "drifted")
    parts = drifting(spark, sf_dir)
    for i, part in enumerate(parts[:2]):
        export_chunk_files(part, f"{folder}/part{i}", SHARD_ROWS, prefix=f"orders_{i}")
    write_untyped(parts[2], f"{folder}/part2", "orders_2")
    return scan_table(spark, "orders", folder)


@query(
    "named_chunks",
    f"WITH {t.SCORED}, {CHUNKED} SELECT printf('train_chunk_%03d.parquet', chunk) AS name, chunk, count(*) AS n, "
    "min(case_id) AS first_id, max(case_id) AS last_id, sum(target) AS positives FROM chunked GROUP BY chunk",
)
def named_chunks(spark, sf_dir):
    """Chunk files under the names they are to have, read back by name."""
    folder = new_folder(spark, "chunk-files")
    export_chunk_files(order_rows(spark, sf_dir), folder, CHUNK_ROWS)
    rows = read_chunks(spark, folder).withColumn("name", F.col("_metadata.file_name"))
    return rows.groupBy("name", F.col("chunk").cast("bigint").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("case_id").alias("first_id"),
        F.max("case_id").alias("last_id"),
        F.sum("target").alias("positives"),
    )


JOB = HierarchySpec((TableSpec("train_orders_1", 1, order=("num_group1",)), TableSpec("train_static_0", 0)))
FEATURES = ["debt_5A", "price_1A_max", "price_1A_mean", "orders_1_joined_flag"]
MEANS, VARIANCES = [4000.0, 2e7, 1.5e7, 0.5], [9e6, 1e14, 1e14, 0.25]
JOB_HEAD, JOB_BIAS = rule(2, 3, 17), [0.2, -0.2]


def fixed_model(chunks, artifact_dir: str) -> None:
    """Stores a model of fixed weights for features that the chunks must have."""
    spark = chunks.sparkSession
    chunks.select(*FEATURES)
    save_features(spark, FEATURES, artifact_dir)
    head = network.Network([network.linear(JOB_HEAD, JOB_BIAS)])
    ScoringModel(ScalerModel(FEATURES, MEANS, VARIANCES), encoder(), head).save(spark, f"{artifact_dir}/model")


def job_sql() -> str:
    scaled = ", ".join(
        f"greatest(-10.0, least(10.0, (CAST(CAST(f{i} AS FLOAT) AS DOUBLE) - {m}::DOUBLE) / sqrt({v}::DOUBLE))) AS x{i}"
        for i, (m, v) in enumerate(zip(MEANS, VARIANCES))
    )
    logits = dense_sql("z", "z", "l", JOB_HEAD, JOB_BIAS, "case_id")
    return f"""WITH {t.CUSTOMERS}, {t.ORDERS},
rolled AS (SELECT case_id, max(price) AS top, avg(price) AS mean FROM hist GROUP BY case_id),
matrix AS (SELECT c.case_id, balance AS f0, top AS f1, mean AS f2, CASE WHEN r.case_id IS NULL THEN 0 ELSE 1 END AS f3
           FROM customers c LEFT JOIN rolled r ON c.case_id = r.case_id),
known AS (SELECT median(f1) AS m1, median(f2) AS m2 FROM matrix WHERE case_id % 3 <> 0),
filled AS (SELECT case_id, f0, coalesce(f1, m1) AS f1, coalesce(f2, m2) AS f2, f3 FROM matrix, known WHERE case_id % 3 = 0),
scaled AS (SELECT case_id, {scaled} FROM filled),
h AS ({dense_sql('scaled', 'x', 'h', ENCODE_1, ENCODE_1_BIAS, 'case_id', True)}),
o AS ({dense_sql('h', 'h', 'o', ENCODE_2, ENCODE_2_BIAS, 'case_id')}),
m AS (SELECT *, (o0 + o1 + o2) / 3 AS mu FROM o),
s AS (SELECT *, sqrt(((o0 - mu) ** 2 + (o1 - mu) ** 2 + (o2 - mu) ** 2) / 3 + 1e-5::DOUBLE) AS sd FROM m),
z AS (SELECT case_id, (o0 - mu) / sd AS z0, (o1 - mu) / sd AS z1, (o2 - mu) / sd AS z2 FROM s),
logits AS ({logits})
SELECT case_id, round({SCORE}, 4) AS score FROM logits"""


def write_job_tables(spark, sf_dir, folder: str, mode: str) -> None:
    """Base, history (in two sets of types) and static table of one side, as shards."""
    own = F.col("case_id") % 3 == 0 if mode == "test" else F.col("case_id") % 3 != 0
    customers = t.customers(spark, sf_dir).filter(own)
    base = customers.select("case_id", (F.col("case_id") % 50).alias("WEEK_NUM"), F.lit(202001).alias("MONTH"), "target")
    base = base.drop("target") if mode == "test" else base
    export_chunk_files(base, folder, SHARD_ROWS, prefix=f"{mode}_base")
    static = customers.select("case_id", F.col("balance").alias("debt_5A"))
    export_chunk_files(static, folder, SHARD_ROWS, prefix=f"{mode}_static_0")
    orders = t.orders(spark, sf_dir).filter(own)
    for i, kind in enumerate(("int", "bigint")):
        history = orders.filter(F.col("num_group1") % 2 == i).select(
            "case_id",
            "num_group1",
            F.col("price").alias("price_1A"),
            F.col("week").cast(kind).alias("week_2P"),
            F.col("status").alias("status_3M"),
        )
        export_chunk_files(history, folder, SHARD_ROWS, prefix=f"{mode}_orders_1_{i}", order="num_group1")


def whole_job_of(spark, sf_dir, folder: str, fit=fixed_model) -> WholeJob:
    write_job_tables(spark, sf_dir, f"{folder}/data", "train")
    write_job_tables(spark, sf_dir, f"{folder}/data", "test")
    common = {"data_dir": f"{folder}/data", "artifact_dir": f"{folder}/artifacts", "output_dir": f"{folder}/out", "chunk_size": SHARD_ROWS}
    return WholeJob(JOB, BuildConfig(**common), BuildConfig(**common, is_inference=True), folder, fit)


@query("whole_job", job_sql())
def whole_job(spark, sf_dir):
    """Shards written, scanned, rolled up, imputed, exported; replayed on the test side, scored, read from the CSV."""
    job = whole_job_of(spark, sf_dir, new_folder(spark, "whole-job"))
    return rounded(job.run(spark), ["score"], 4)


STREAMED = ["score", "energy"]


@query(
    "stream_moments",
    f"WITH {t.SCORED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS col, round(avg({c}), 6) AS mean, round(var_samp({c}), 6) AS var FROM scored" for c in STREAMED
    ),
)
def stream_moments(spark, sf_dir):
    """Chunk files arrive as a stream; the state folded from its batches is that of the whole table."""
    folder = new_folder(spark, "stream")
    rows = t.scored_orders(spark, sf_dir).select("case_id", *STREAMED)
    export_chunk_files(rows, f"{folder}/chunks", CHUNK_ROWS)
    stream = chunk_stream(spark, f"{folder}/chunks", rows.schema, files_per_trigger=8)
    fold_moments(stream, STREAMED, f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    scaler = folded_scaler(spark, f"{folder}/state")
    found = spark.createDataFrame(list(zip(scaler.columns, scaler.mean, scaler.var)), "col string, mean double, var double")
    return rounded(found, ["mean", "var"])
