import re
from collections import Counter

import numpy as np
import pytest

from hierfeat.llm import quality
from hierfeat.llm.words import bytes_of, pieces, word_hashes, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def brute_scores(rows, trusted):
    """The ratio by its definition, on n-grams hashed by the module's own hash."""
    import pyarrow as pa

    buckets = quality.BUCKETS
    found = []
    for d, t, *_ in rows:
        (piece,) = pieces(pa.array([t], pa.string()))
        w = words_of(*bytes_of(piece))
        found.append((d, quality.grams(word_hashes(w), w.doc, buckets)[0]))
    raw = np.bincount(np.concatenate([g for _, g in found]), minlength=buckets).astype(float)
    good = np.bincount(np.concatenate([g for d, g in found if d in trusted]), minlength=buckets).astype(float)
    out = []
    for d, g in found:
        total = 0.0
        own = Counter(g.tolist())
        for b, n in own.items():
            seen = good[b] - (n if d in trusted else 0)
            expected = good.sum() / raw.sum() * (raw[b] - n)
            total += n * np.log((seen + quality.SMOOTHING) / (expected + quality.SMOOTHING))
        out.append(total / max(len(g), 1))
    return out


def test_equals_brute_force(awkward, rows, labels):
    found = quality.judged(awkward, labels)
    assert found.columns == [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    ]
    trusted = set(range(0, 40, 2))
    want = Counter()
    for (d, t, *_), score in zip(rows, brute_scores(rows, trusted)):
        base = brute_measures(t)
        want[(d, *base, not base[-1] and score >= quality.THRESHOLD, round(score, 9))] += 1
    assert Counter((*tuple(r)[:-1], round(r["score"], 9)) for r in found.collect()) == want


def test_documents_that_stay(awkward, labels):
    kept = Counter(r["doc_id"] for r in quality.judged(awkward, labels).collect() if r["kept"])
    stay = quality.good_documents(awkward, labels)
    assert stay.columns == awkward.columns
    assert Counter(r["doc_id"] for r in stay.collect()) == kept


def test_without_labels_only_the_base_rules_speak(awkward, labels):
    found = quality.judged(awkward, labels.limit(0)).collect()
    assert all(r["score"] == 0 and r["kept"] == (not r["base_failed"]) for r in found)


def test_empty(empty, labels):
    assert quality.judged(empty, labels).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_junk_goes_and_clean_text_stays(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.judged(docs, marks).join(marks.select("doc_id", "quality"), "doc_id").collect()
    good = [r["kept"] for r in found if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in found if r["quality"] == 0]
    assert all(good)
    assert np.mean(bad) < 0.25
