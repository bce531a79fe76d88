import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import records
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from hierfeat.sources.export import (
    chunk_numbers,
    export_chunks,
    export_latents,
    export_profile,
    export_scores,
    export_table,
    read_chunks,
    read_latents,
)
from hierfeat.sources.shards import common_type, relevant_files, scan_table
from hierfeat.sources.state import load_features, save_features


def write(path, **columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), path)


def test_shards_in_nested_folders_share_types(spark, tmp_path):
    write(
        tmp_path / "a" / "train_x_0.parquet",
        case_id=pa.array([1, 2], pa.int64()),
        amount_1A=pa.array([1, 2], pa.int32()),
        when_2D=pa.nulls(2),
        kind_3M=pa.nulls(2),
        flag_4L=pa.nulls(2),
    )
    write(
        tmp_path / "b" / "c" / "train_x_1.parquet",
        case_id=pa.array([3], pa.int64()),
        amount_1A=pa.array([2.5], pa.float64()),
        when_2D=pa.array(["2020-01-01"]),
        kind_3M=pa.nulls(1),
        flag_4L=pa.array([True]),
    )
    write(tmp_path / "train_other.parquet", case_id=pa.array([9], pa.int64()))
    df = scan_table(spark, "train_x", str(tmp_path))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert kinds == {
        "case_id": "bigint",
        "amount_1A": "double",
        "when_2D": "string",
        "kind_3M": "string",
        "flag_4L": "boolean",
    }
    rows = {r["case_id"]: r for r in records(df)}
    assert rows[1]["amount_1A"] == 1.0 and rows[3]["amount_1A"] == 2.5
    assert rows[1]["when_2D"] is None and rows[3]["flag_4L"] is True


def test_shards_with_equal_types_are_one_scan(spark, tmp_path):
    for i in range(5):
        write(tmp_path / f"t_{i}.parquet", case_id=pa.array([i], pa.int64()))
    df = scan_table(spark, "t", str(tmp_path))
    assert df.count() == 5
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_missing_columns_only_on_request(spark, tmp_path):
    write(tmp_path / "t_0.parquet", a=pa.array([1]), b=pa.array([1]))
    write(tmp_path / "t_1.parquet", a=pa.array([2]))
    with pytest.raises(ValueError, match="differ in columns"):
        scan_table(spark, "t", str(tmp_path))
    rows = records(scan_table(spark, "t", str(tmp_path), allow_missing=True))
    assert rows == [{"a": 1, "b": 1}, {"a": 2, "b": None}]


def test_nested_binary_and_decimal_columns(spark, tmp_path):
    """Also where another column has drifted, so that the shards are cast."""
    from decimal import Decimal

    for i, kind in enumerate([pa.int32(), pa.float64()]):
        write(
            tmp_path / f"t_{i}.parquet",
            case_id=pa.array([i], pa.int64()),
            drift=pa.array([i], kind),
            items=pa.array([[1, 2]], pa.list_(pa.int64())),
            pair=pa.array([{"a": 1, "b": "x"}], pa.struct([("a", pa.int32()), ("b", pa.string())])),
            tags=pa.array([[("k", 1)]], pa.map_(pa.string(), pa.int32())),
            raw=pa.array([b"z"], pa.binary(1)),
            money=pa.array([Decimal("12345678901234567.89")], pa.decimal128(19 + i, 2)),
        )
    rows = scan_table(spark, "t", str(tmp_path)).orderBy("case_id").collect()
    for i, r in enumerate(rows):
        assert (r["case_id"], r["drift"], r["items"], r["pair"]["b"]) == (i, float(i), [1, 2], "x")
        assert r["tags"] == {"k": 1} and bytes(r["raw"]) == b"z" and r["money"] == Decimal("12345678901234567.89")


def test_absent_table_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        scan_table(spark, "nothing", str(tmp_path))


@pytest.mark.parametrize(
    ("column", "kinds", "expected"),
    [
        ("x_D", ["null"], "string"),
        ("x_A", ["null"], "double"),
        ("x_P", ["null"], "double"),
        ("x_L", ["null"], "double"),
        ("x_T", ["null"], "string"),
        ("x", ["null"], None),
        ("x_D", ["null", "date"], "date"),
        ("x", ["int", "bigint"], "bigint"),
        ("x", ["int", "double"], "double"),
        ("x", ["bigint", "string"], "string"),
        ("x", ["boolean", "int"], "int"),
        ("x", ["date", "timestamp_ntz"], "timestamp_ntz"),
        ("x", ["decimal(19,2)", "decimal(10,4)"], "decimal(21,4)"),
        ("x", ["decimal(4,2)", "bigint"], "decimal(21,2)"),
        ("x", ["decimal(38,0)", "decimal(38,9)"], "double"),
        ("x", ["decimal(4,2)", "double"], "double"),
        ("x", ["array<bigint>", "null"], "array<bigint>"),
    ],
)
def test_common_type(column, kinds, expected):
    assert common_type(column, kinds) == expected


def test_no_common_type():
    with pytest.raises(ValueError, match="no common type"):
        common_type("x", ["binary", "int"])


def test_only_train_and_test_files_are_relevant(spark, tmp_path):
    for name in ("train_a", "x_test_b", "other"):
        write(tmp_path / f"{name}.parquet", a=pa.array([1]))
    names = [p.rsplit("/", 1)[1] for p in relevant_files(spark, str(tmp_path))]
    assert sorted(names) == ["train_a.parquet", "x_test_b.parquet"]


def test_feature_list_keeps_its_order(spark, tmp_path):
    save_features(spark, ["b", "a", "c"], str(tmp_path))
    assert load_features(spark, str(tmp_path)) == ["b", "a", "c"]
    with pytest.raises(FileNotFoundError):
        load_features(spark, str(tmp_path / "nowhere"))


def test_chunks_of_200_200_100(spark, tmp_path):
    df = spark.range(500).selectExpr("id AS case_id", "id * 2 AS a", "202401 AS month").repartition(3)
    paths = export_chunks(df, str(tmp_path / "chunks"), 200)
    assert [p.rsplit("=", 1)[1] for p in paths] == ["1", "2", "3"]
    sizes, ids = [], []
    for path in paths:
        rows = pq.read_table(path).to_pydict()
        sizes.append(len(rows["case_id"]))
        ids += rows["case_id"]
    assert sizes == [200, 200, 100]
    assert ids == list(range(500))
    back = read_chunks(spark, str(tmp_path / "chunks"))
    assert back.count() == 500 and "chunk" in back.columns
    assert chunk_numbers(spark, str(tmp_path / "chunks")) == [1, 2, 3]
    assert chunk_numbers(spark, str(tmp_path / "none")) == []


def test_tables_scores_profiles_and_latents(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.25, -1.0), (2, 0.5, 2.0)], "case_id bigint, score double, energy double")
    export_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    export_scores(df, str(tmp_path / "s"))
    assert records(spark.read.csv(str(tmp_path / "s"), header=True)) == [
        {"case_id": "1", "score": "0.25"},
        {"case_id": "2", "score": "0.5"},
    ]
    export_profile(df, str(tmp_path / "p"))
    assert [r["col"] for r in spark.read.csv(str(tmp_path / "p"), header=True).collect()] == df.columns
    z = spark.createDataFrame([(1, 1, [0.5, 1.0]), (2, 2, [1.0, 2.0])], "case_id bigint, chunk int, z array<double>")
    export_latents(z, str(tmp_path / "z"))
    back = read_latents(spark, str(tmp_path / "z"))
    assert back.count() == 2 and isinstance(back.schema["z"].dataType, T.ArrayType)
