import zlib

import numpy as np
import pyarrow as pa

from hierfeat.llm import byte_network as network
from hierfeat.llm.words import bytes_of

from .conftest import prose


def plain_score(net, text):
    """One text, one place at a time."""
    data = (text or "").encode()
    places = max(len(data) - network.WIDTH + 1, 1)
    padded = data + bytes(network.WIDTH)
    found = []
    for at in range(0, places, network.CHUNK):
        answers = [
            sum(net.embedding[padded[i + k]] @ net.filters[k] for k in range(network.WIDTH)) + net.bias
            for i in range(at, min(at + network.CHUNK, places))
        ]
        found.append(np.maximum(np.max(answers, axis=0), 0))
    logit = np.max(found, axis=0) @ net.unit[0] + np.mean(found, axis=0) @ net.unit[1] + net.offset[0]
    return 1 / (1 + np.exp(-logit))


TEXTS = ["", "a", "abcdef", "x" * 300, prose(1, 200), "naïve 😀 " * 90, "a" * (network.CHUNK + network.WIDTH - 1), "b" * (network.CHUNK + network.WIDTH)]


def test_scores_are_those_of_the_plain_formula():
    net = network.Network.fresh(5)
    got = network.Scorer(net.flat()).scores(pa.array(TEXTS, pa.large_string()))
    assert np.allclose(got, [plain_score(net, t) for t in TEXTS], atol=1e-5)


def test_gradients_are_slopes_of_the_loss():
    net, label, weight = network.Network.fresh(3), np.array([1.0, 0, 1, 0, 1, 0, 0, 1]), np.linspace(0.5, 1.5, 8)
    texts = pa.array(TEXTS, pa.large_string())
    slope, flat = network.gradients(net, network.chunks_of(*bytes_of(texts)), label, weight).flat(), net.flat()

    def loss(flat):
        s = network.Scorer(flat).scores(texts)
        return -np.mean(weight * (label * np.log(s) + (1 - label) * np.log(1 - s)))

    for i in np.argsort(-abs(slope))[:120:8]:
        step = np.zeros_like(flat)
        step[i] = 1e-3
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-3 - slope[i]) < 1e-3 * max(1, abs(slope[i]))


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in network.scored(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    told = [(found[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in found]
    held = [(r["predicted"], r["score"], q) for r, q in told if r["held_out"]]
    assert np.mean([p == q for p, _, q in held]) > 0.9
    assert np.mean([p for p, _, q in held if q == 1]) > 0.95
    good, bad = ([s for _, s, q in held if q == x] for x in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_fit_does_not_see_what_is_held_out(spark):
    """Labels of held-out rows, and their texts, change nothing; neither does the order of rows."""
    rows = [(i, prose(i, 30) if i % 2 else "### " * 20 + str(i), i % 2) for i in range(120)]
    other = [(d, "zz", 1 - q) if zlib.crc32(str(d).encode()) % 5 == 0 else (d, t, q) for d, t, q in reversed(rows)]
    nets = []
    for some in (rows, other):
        docs = spark.createDataFrame([(d, t) for d, t, _ in some], "doc_id bigint, text string").repartition(3)
        nets.append(network.fit(docs, spark.createDataFrame([(d, q) for d, _, q in some], "doc_id bigint, quality int")).flat())
    assert np.array_equal(*nets)


def test_awkward_tables(spark, awkward, rows, labels, empty):
    found = network.scored(awkward, labels).collect()
    assert len(found) == len(rows) and found[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    assert network.scored(empty, labels, network=network.Network.fresh()).count() == 0
    none = network.scored(awkward, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
