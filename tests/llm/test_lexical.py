import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hierfeat.llm import lexical

from .conftest import prose

LOW = str.maketrans(lexical.UPPER, lexical.LOWER)


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(LOW))


def brute(docs, items, k=10):
    of_doc = [(d, Counter(terms(t))) for d, t in docs]
    documents, total = sum(1 for _, c in of_doc if c), sum(sum(c.values()) for _, c in of_doc)
    df = Counter(t for _, c in of_doc for t in c)
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in wanted.items():
        scores = []
        for d, c in of_doc:
            m = 100 - 90 + (90 * sum(c.values()) * documents // total if total else 0)
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, prose(i, 12) + (" één 😀 x" if i % 3 == 0 else "")) for i in range(30)]
    rows += [(3, "Extra WORDS stone"), (None, "river ending"), (50, None), (51, " ,.!"), (52, "the the of"), (53, "absentword")]
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id bigint, text string, score int"), rows


@pytest.mark.parametrize("block_terms", [lexical.BLOCK_TERMS, 60])
def test_same_as_brute_force(awkward, rows, items, block_terms):
    found = lexical.ranked(awkward, items[0], block_terms=block_terms).collect()
    assert sorted(map(tuple, found), key=repr) == brute([r[:2] for r in rows], items[1])


def test_ties_over_many_tasks(spark):
    rows = [(i, "same words here" if i % 7 else f"same words here {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    asked = [(1, "words"), (2, "here 14 700")]
    found = lexical.ranked(docs, spark.createDataFrame(asked, "item_id bigint, text string"), k=13).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, asked, 13)


def test_empty_tables(spark, empty, awkward, items):
    assert lexical.ranked(empty, items[0]).count() == 0
    assert lexical.ranked(awkward, items[0].limit(0)).count() == 0


def test_products_stay_exact_beyond_53_bits(monkeypatch):
    """Weights so large that one sum over all columns would round: slices keep each product exact."""
    n = 2_000
    draw = np.random.default_rng(1)
    items = lexical.Items([b"%d" % i for i in range(n)], [np.arange(n)], np.full(n, 2**50 // lexical.LARGEST_IMPACT) - draw.integers(0, 9, n), 10, 10**6)
    times = draw.integers(1, 50, n)
    got = items.scores(np.array([n]), np.zeros(n, np.int64), np.arange(n), times)
    impact = [1_000_000_000 * int(t) // (1000 * int(t) + 8 * (10 + 90 * n * 10 // 10**6)) for t in times]
    assert int(got[0, 0]) == sum(int(w) * x for w, x in zip(items.weights, impact))
    assert len(items.tiles()[0][1]) > 200


def test_terms_by_bytes_and_natively(spark, rows):
    texts = [t for _, t, *_ in rows if t and len(t) < 10_000]
    native = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", lexical.terms_of("t").alias("x"))
    assert {r["i"]: r["x"] for r in native.collect()} == {i: list(dict.fromkeys(terms(t))) for i, t in enumerate(texts)}
    known = sorted({x.encode() for t in texts for x in terms(t)})
    n, owner, ids, times = lexical.entries(pa.array(texts, pa.large_string()), pa.array(known, pa.large_binary()))
    assert n.tolist() == [len(terms(t)) for t in texts]
    assert {(o, known[i].decode(), c) for o, i, c in zip(owner.tolist(), ids, times)} == {
        (o, x, c) for o, t in enumerate(texts) for x, c in Counter(terms(t)).items()
    }
