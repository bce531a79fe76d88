import zlib
from collections import Counter

import numpy as np
import pytest

from hierfeat.llm import language


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()


def test_held_out_accuracy(found):
    held = [r for r in found if r["held_out"]]
    assert len(held) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_awkward_table(awkward, rows, empty):
    out = language.identified(awkward).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(d for d, *_ in rows)
    text = {d: t for d, t, *_ in rows}
    for r in out:
        wordless = not any(c.isalpha() for c in text[r["doc_id"]] or "")
        if r["doc_id"] is not None and r["doc_id"] not in (5, 7):
            assert (r["lang_pred"] == "und" and r["score"] == 0) == wordless
        if r["doc_id"] is None:
            assert r["held_out"] is False
    assert language.identified(empty).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark, awkward):
    from pyspark.sql import functions as F

    wrong = awkward.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert Counter(map(tuple, language.identified(wrong).collect())) == Counter(map(tuple, language.identified(awkward).collect()))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_differ_and_part_the_classes(n):
    code = language.codewords(n)
    assert set(np.unique(code)) <= {-1.0, 1.0}
    assert (np.abs(code.sum(axis=0)) < n).all()
    apart = (code.shape[1] - code @ code.T) / 2
    assert apart[~np.eye(n, dtype=bool)].min() >= max(1, code.shape[1] // 4)


def test_few_languages(spark):
    def predict(rows):
        return [tuple(r)[1:4] for r in language.identified(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()]

    assert predict([(1, "abc", None)]) == [(False, "und", 0.0)]
    assert predict([(1, "abc", "xx"), (3, "1", "xx")]) == [(False, "xx", 1.0), (False, "und", 0.0)]
    two = predict([(1, "aaa aab", "xx"), (3, "zzy zzz", "yy"), (5, "aab", None), (8, "zzy", None)])
    assert [x[1] for x in two] == ["xx", "yy", "xx", "yy"]


def plain_buckets(text):
    """Buckets of the n-grams of a text, one by one."""
    found, low = [], text.lower()
    for n in language.LENGTHS:
        for i in range(len(low) - n + 1):
            part = low[i : i + n]
            if any(c.isalpha() for c in part):
                code = n
                for c in part:
                    code = (code * (0x10FFFF + 2) + (ord(c) if c.isalpha() else 0)) % 2**64
                found.append(int(language.mixed(np.array([code], np.uint64))[0]) % language.BUCKETS)
    return found


def plain_model(taught):
    """Classifiers and trust of rows of text and language, without matrices."""
    names = sorted({x for _, x in taught})
    code, counts = language.codewords(len(names)), {x: Counter() for x in names}
    for text, x in taught:
        counts[x].update(plain_buckets(text))
    size = {x: sum(counts[x].values()) + language.SMOOTHING * language.BUCKETS for x in names}
    share = {x: {b: (counts[x][b] + language.SMOOTHING) / size[x] for b in range(language.BUCKETS)} for x in names}
    weights = []
    for bit in range(code.shape[1]):
        sides = [[x for i, x in enumerate(names) if code[i, bit] == side] for side in (1, -1)]
        w = [np.log(np.mean([share[x][b] for x in sides[0]]) / np.mean([share[x][b] for x in sides[1]])) for b in range(language.BUCKETS)]
        own = [sum(share[x][b] * w[b] for b in range(language.BUCKETS)) * code[i, bit] for i, x in enumerate(names)]
        scale = max(np.mean([max(v, 0) for v in own]), 1e-9)
        weights.append([v / scale for v in w])

    def margins(text):
        found = plain_buckets(text)
        return [sum(w[b] for b in found) / max(len(found), 1) for w in weights]

    trust = np.full(code.shape, 1e-6)
    for text, x in taught:
        if any(c.isalpha() for c in text):
            i = names.index(x)
            trust[i] += [m * code[i, bit] > 0 for bit, m in enumerate(margins(text))]
    return names, code, trust / trust.sum(axis=1, keepdims=True), margins


def test_predictions_equal_a_plain_version(spark):
    texts = {
        "en": ["the river and the stone", "a quiet garden of light", "paper and window"],
        "de": ["der Fluss und der Stein", "ein stiller Garten", "Papier und Fenster über"],
        "fr": ["la rivière et la pierre", "un jardin tranquille", "le papier, la fenêtre"],
    }
    rows = [(i, t, x) for i, (t, x) in enumerate((t, x) for x, own in texts.items() for t in own * 3)]
    rows += [(100, "12 !", "en"), (101, "der garden und the", None), (102, "", "fr"), (103, "É", None)]
    found = {r["doc_id"]: r for r in language.identified(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    taught = [(t, x) for i, t, x in rows if x and zlib.crc32(str(i).encode()) % 4 != 2]
    names, code, trust, margins = plain_model(taught)
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
            continue
        m = margins(text)
        loss = [sum(trust[k, bit] * np.log1p(np.exp(-4 * m[bit] * code[k, bit])) for bit in range(len(m))) for k in range(len(names))]
        share = np.exp(-2 * (np.array(loss) - min(loss)))
        share /= share.sum()
        assert found[i]["lang_pred"] == names[int(share.argmax())]
        assert found[i]["score"] == pytest.approx(share.max(), rel=1e-6)
