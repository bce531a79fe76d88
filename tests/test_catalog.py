import glob
import os
import subprocess
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check_queries import compare, rows_of  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from hierfeat.catalog import QUERIES, SQL  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def test_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql()) <= set(queries())


def test_history_is_joined_once(spark):
    """The matrix reads the joined history from storage, once for numbers and once for categories."""
    plan = QUERIES["feature_matrix"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and plan.count("Generate posexplode") == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    plan = df._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert slow not in plan
    if name in SQL:
        result = db.sql(SQL[name])
        assert sorted(df.columns) == sorted(result.columns)
        assert compare(rows_of(rows, df.columns), rows_of(result.fetchall(), result.columns)) is None


def test_scans_read_only_what_is_used(spark):
    def scanned(name):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        return [part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:]]

    assert all(c.count(":") <= 3 for c in scanned("key_distinct"))
    assert scanned("bernoulli_sample") == ["c_custkey:bigint,c_acctbal:double"]
    assert scanned("energy_summary") == ["o_totalprice:double"]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Driver started elsewhere, the package only on the driver's own path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {root!r})
from __spark_entry__ import queries
for name in ("score_energy", "latent_encode", "pca_project", "scan_table"):
    assert queries()[name](spark, {SF!r}).count() > 0
from hierfeat.sources.shards import read_footers
assert read_footers(spark, ["file://" + {SF!r} + "/orders.parquet"])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]


def test_entry(spark):
    assert entry(spark).count() == 150


def test_entry_without_the_corpus_operators():
    """Neither a missing module nor a folder that is left over empty keeps the other queries from loading."""
    code = f"""
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("hierfeat.llm.") or name == "public_tokenizers":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
import __spark_entry__ as e
assert len(e.queries()) > 70 and "pipeline" not in e.queries() and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
