import hashlib
import os
import shutil
import subprocess
import sys
from collections import Counter

import corpus_pipeline
from hierfeat.llm.queries import QUERIES, SQL
from hierfeat.llm.shared import stored

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= set(before)
        sizes.append(docs.count())
    texts = docs.collect()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    want = Counter((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in texts)
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in last) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, last))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0


def test_stages_take_awkward_tables(spark, awkward, empty):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, awkward, SF).collect()
        assert stage(spark, empty, SF).count() == 0


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_the_rest_works_without_these_folders(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "hierfeat"), tmp_path / "hierfeat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), any(x.startswith('op1_') for x in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.split()[-1] == "False", done.stderr
