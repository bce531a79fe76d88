import hashlib
import re
from collections import Counter, defaultdict

from hierfeat.llm import exact
from hierfeat.llm.shared import shared_folder


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[normal(t)].append(d)
    out = Counter()
    for text, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = min(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for d in sorted(ids, key=lambda d: (d is None, d or 0)):
            out[d, keep, len(ids), first, digest] += 1
            first = False
    return out


def test_equals_brute_force(awkward, rows):
    found = exact.decisions(awkward)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, found.collect())) == expected(rows)


def test_any_number_of_batches_gives_the_same(awkward, rows):
    assert Counter(map(tuple, exact.decisions(awkward, batches=5).collect())) == expected(rows)


def test_index_outlives_a_run(spark):
    folder = shared_folder(spark, "test-index")
    first = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id bigint, text string")
    later = spark.createDataFrame([(1, "a  b"), (2, "d"), (3, "d")], "doc_id bigint, text string")
    exact.decisions(first, exact.DigestIndex(spark, folder)).collect()
    spark.sql(f"DROP TABLE {exact.DigestIndex(spark, folder).table}")  # the files stay
    found = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact.decisions(later, exact.DigestIndex(spark, folder)).collect()}
    assert found == {1: (5, False), 2: (2, True), 3: (2, False)}
    again = exact.DigestIndex(spark, folder)
    assert sorted(r["keep_id"] for r in again.rows().collect()) == [2, 5, 6]
    exact.decisions(later, again).collect()
    assert again.rows().count() == 3


def test_index_side_is_read_by_bucket(spark):
    index = exact.DigestIndex(spark, shared_folder(spark, "test-index"))
    some = spark.createDataFrame([("x", 1)], "digest string, keep_id bigint")
    index.append(some, "0")
    plan = index.missing(some)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_documents_that_stay(awkward, rows):
    found = exact.without_copies(awkward)
    assert found.columns == awkward.columns
    texts = Counter(normal(r["text"]) for r in found.collect())
    assert texts == Counter({normal(t) for _, t, *_ in rows})
    kept = {(d, normal(t)) for d, t, *_ in rows}
    least = {}
    for d, t in kept:
        least[t] = min([x for x in (least.get(t), d) if x is not None], default=None)
    assert {(r["doc_id"], normal(r["text"])) for r in found.collect()} == {(d, t) for t, d in least.items()}


def test_empty(empty):
    assert exact.decisions(empty).count() == 0
    assert exact.without_copies(empty).count() == 0
