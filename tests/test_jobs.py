import datetime
import os
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import records
from pyspark.sql import functions as F

from hierfeat.catalog import jobs
from hierfeat.plans.manifest import RunManifest, files_digest
from hierfeat.plans.whole_job import WholeJob
from hierfeat.sources import shards
from hierfeat.sources.export import chunk_numbers, export_chunk_files, read_chunks
from hierfeat.sources.files import Folder, file_table
from hierfeat.spec import BuildConfig

SF = "/root/testdata/sf0.001"
VALUES = {
    "null": pa.nulls(2),
    "tinyint": pa.array([1, None], pa.int8()),
    "int": pa.array([1, None], pa.int32()),
    "bigint": pa.array([1, None], pa.int64()),
    "boolean": pa.array([True, None]),
    "float": pa.array([1.5, None], pa.float32()),
    "double": pa.array([1.5, None]),
    "decimal(10,2)": pa.array([Decimal("1.25"), None], pa.decimal128(10, 2)),
    "date": pa.array([datetime.date(2020, 1, 1), None]),
    "string": pa.array(["a", None]),
}


def write(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation")


@pytest.mark.parametrize("kind", VALUES)
def test_what_is_called_readable_is_read(spark, tmp_path, kind):
    """Types that the reader is trusted to widen come out like a cast."""
    write(tmp_path / "x.parquet", x=VALUES[kind])
    plain = spark.read.parquet(str(tmp_path))
    for target in ("tinyint", "int", "bigint", "double", "decimal(20,0)", "decimal(21,4)", "date", "timestamp_ntz", "string", "boolean"):
        if shards.readable(kind, target):
            value = F.lit(None) if kind == shards.NULL else F.col("x")
            got = spark.read.schema(f"x {target}").parquet(str(tmp_path))
            assert got.collect() == plain.select(value.cast(target).alias("x")).collect(), target


def test_widening_is_one_scan_without_paths(spark, tmp_path, monkeypatch):
    kinds = [pa.int32(), pa.float64(), pa.int16()]
    for i in range(9):
        write(
            tmp_path / f"d{i % 4}" / f"t_{i}.parquet",
            case_id=pa.array([i], pa.int32() if i % 2 else pa.int64()),
            amount_1A=pa.array([i], kinds[i % 3]),
            money=pa.array([Decimal(i)], pa.decimal128(10, i % 3)),
            empty_2A=pa.nulls(1),
            when=pa.array([datetime.date(2020, 1, 1 + i)]) if i % 2 else pa.array([datetime.datetime(2020, 1, 1 + i)], pa.timestamp("us")),
        )
    monkeypatch.setattr(shards, "list_shards", None)
    monkeypatch.setattr(shards, "union_tables", None)
    df = shards.scan_table(spark, "t", str(tmp_path))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {"case_id": "bigint", "amount_1A": "double", "money": "decimal(12,2)", "empty_2A": "double", "when": "timestamp_ntz"}
    assert scans(df) == 1
    for i, r in enumerate(df.orderBy("case_id").collect()):
        assert tuple(r) == (i, float(i), Decimal(i), None, datetime.datetime(2020, 1, 1 + i))


def test_footers_through_spark_where_no_client_opens_the_store(spark, tmp_path, monkeypatch):
    """A scheme that only Spark knows: footers come from the files' bytes."""
    write(tmp_path / "t_0.parquet", a=pa.array([1], pa.int32()), b_1M=pa.nulls(1))
    write(tmp_path / "t_1.parquet", a=pa.array([2.5]), b_1M=pa.array(["x"]))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.only.link./data", f"file://{tmp_path}")
    spark.conf.set("fs.viewfs.mounttable.only.link./data", f"file://{tmp_path}")
    df = shards.scan_table(spark, "t", "viewfs://only/data")
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1.0, None), (2.5, "x")]
    assert file_table(spark, "viewfs://only/data", "t*.parquet").count() == 2


def test_drifted_shards_by_hand(spark):
    assert scans(jobs.widened_shards(spark, SF)) == 1
    assert 1 < scans(jobs.drifted_shards(spark, SF)) < 6


def chunk_table(spark, n):
    return spark.range(n).selectExpr("id * 3 AS case_id", "id AS a", "cast(id as string) AS b").repartition(5)


def test_chunk_files_have_the_names(spark, tmp_path):
    path = str(tmp_path / "chunks")
    paths = export_chunk_files(chunk_table(spark, 500), path, 200)
    assert [os.path.basename(p) for p in paths] == [f"train_chunk_00{i}.parquet" for i in (1, 2, 3)]
    assert Folder(spark, path).names() == [os.path.basename(p) for p in paths]
    found = [pq.read_table(p).to_pydict() for p in paths]
    assert [len(x["a"]) for x in found] == [200, 200, 100] and list(found[0]) == ["case_id", "a", "b"]
    assert [v for x in found for v in x["case_id"]] == [3 * i for i in range(500)]
    assert chunk_numbers(spark, path) == [1, 2, 3]
    assert read_chunks(spark, path).filter("chunk = 3").count() == 100

    # Another prefix beside it, and a shorter export over it.
    export_chunk_files(chunk_table(spark, 10), path, 200, prefix="test_chunk")
    export_chunk_files(chunk_table(spark, 300), path, 200)
    assert Folder(spark, path).names() == ["test_chunk_001.parquet", "train_chunk_001.parquet", "train_chunk_002.parquet"]
    assert read_chunks(spark, path).count() == 300 and read_chunks(spark, path, "test_chunk").count() == 10
    assert export_chunk_files(chunk_table(spark, 5).limit(0), str(tmp_path / "none"), 200) == []


def test_chunk_bounds_of_large_numbers(spark, tmp_path):
    """Ids beyond what a double holds exactly."""
    start = 2**60
    rows = spark.range(start, start + 70).withColumnRenamed("id", "case_id")
    paths = export_chunk_files(rows, str(tmp_path), 7)
    assert [pq.read_table(p).column("case_id").to_pylist() for p in paths] == [
        list(range(start + 7 * i, start + 7 * i + 7)) for i in range(10)
    ]


def test_an_export_that_dies_leaves_the_earlier_one(spark, tmp_path):
    export_chunk_files(chunk_table(spark, 300), str(tmp_path), 200)
    dying = chunk_table(spark, 900).withColumn("a", F.when(F.col("a") == 700, F.raise_error(F.lit("lost"))).otherwise(F.col("a")))
    with pytest.raises(Exception, match="lost"):
        export_chunk_files(dying, str(tmp_path), 200)
    assert read_chunks(spark, str(tmp_path)).count() == 300


def test_manifest_records_what_is_done(spark, tmp_path):
    done = []
    manifest = RunManifest(spark, str(tmp_path / "m"))
    first = manifest.step("one", ["x"], lambda: done.append("one"))
    assert manifest.step("one", ["x"], lambda: done.append("again")) == first
    assert manifest.step("one", ["y"], lambda: done.append("changed")) != first
    with pytest.raises(ZeroDivisionError):
        manifest.step("two", [first], lambda: 1 / 0)
    assert manifest.recorded("two") is None and done == ["one", "changed"]
    write(tmp_path / "d" / "a.parquet", a=pa.array([1]))
    before = files_digest(spark, str(tmp_path / "d"))
    assert files_digest(spark, str(tmp_path / "d")) == before
    write(tmp_path / "d" / "b.parquet", a=pa.array([1]))
    assert files_digest(spark, str(tmp_path / "d")) != before


def test_a_killed_job_goes_on_after_its_last_step(spark, tmp_path, monkeypatch):
    calls = []

    def fit(chunks, folder):
        calls.append("fit")
        if calls.count("fit") == 1:
            raise RuntimeError("killed")
        jobs.fixed_model(chunks, folder)

    job = jobs.whole_job_of(spark, SF, str(tmp_path), fit)
    build, score = WholeJob._build, WholeJob._score
    monkeypatch.setattr(WholeJob, "_build", lambda self, spark: (calls.append("build"), build(self, spark)))
    monkeypatch.setattr(WholeJob, "_score", lambda self, spark: (calls.append("score"), score(self, spark)))
    with pytest.raises(RuntimeError, match="killed"):
        job.run(spark)
    found = records(job.run(spark))
    assert calls == ["build", "fit", "fit", "score"]
    assert len(found) == spark.read.parquet(f"{SF}/customer.parquet").filter("c_custkey % 3 = 0").count()
    assert records(job.run(spark)) == found and calls == ["build", "fit", "fit", "score"]


def test_both_sides_share_their_state():
    train, test = BuildConfig("d"), BuildConfig("d", is_inference=True)
    with pytest.raises(ValueError, match="replays"):
        WholeJob(jobs.JOB, train, train, "f")
    with pytest.raises(ValueError, match="artifact"):
        WholeJob(jobs.JOB, train, BuildConfig("d", is_inference=True, artifact_dir="other"), "f")
    assert WholeJob(jobs.JOB, train, test, "f").scores == "f/scores"
