import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hierfeat.llm import substrings
from hierfeat.llm.suffix_sort import equal_groups


def brute(rows, length):
    """Rows in order: what each leaves, by a set of all strings seen so far."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            part = data[p : p + length]
            if part in seen:
                covered[p : p + length] = True
            else:
                seen.add(part)
        runs = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
        left = bytes(b for b, c in zip(data, covered) if not c)
        out.append((key, len(data), int(covered.sum()), runs, hashlib.sha256(left).hexdigest(), left))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_awkward_table_equals_brute_force(awkward, rows, empty):
    found = substrings.without_repeats(awkward)
    # Equal keys of different texts keep the order of the table, which the writer has chosen.
    table = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert Counter(map(tuple, found.collect())) == Counter(r[:5] for r in brute(ordered(table), 100))
    assert substrings.without_repeats(empty).count() == 0


def corpus(seed, n, letters):
    draw = random.Random(seed)
    passages = ["".join(draw.choice(letters) for _ in range(draw.randint(5, 120))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [draw.choice(passages) if draw.random() < 0.5 else "".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(draw.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "ab" * 100), (n + 3, "a" * 300), (n + 4, "é" * 90)]
    return rows


@pytest.mark.parametrize(("length", "gram", "letters"), [(20, 8, "abcdefgh "), (30, 10, "ab"), (16, 4, "aé"), (100, 24, "abcdefgh ")])
@pytest.mark.parametrize("crowded", [1, 2, 10**9])
def test_equals_brute_force(spark, monkeypatch, length, gram, letters, crowded):
    """Also with grams grouped by whole strings, in small blocks, chunks and segments."""
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "NAMED", min(crowded, 2))
    if crowded == 2:
        monkeypatch.setattr(substrings, "BLOCK_ROWS", 50)
        monkeypatch.setattr(substrings, "CHUNK_ROWS", 16)
        monkeypatch.setattr(substrings, "SEGMENT", 128)
    rows = corpus(length + crowded % 7, 120, letters)
    mixed = rows[:]
    random.Random(0).shuffle(mixed)
    df = spark.createDataFrame(mixed, "doc_id bigint, text string").repartition(3)
    found = substrings.without_repeats(df, length=length, gram=gram, with_bytes=True)
    assert sorted((*tuple(r)[:5], bytes(r["kept"])) for r in found.collect()) == sorted(brute(rows, length))


def test_texts_are_shuffled_once(awkward):
    df = substrings.without_repeats(awkward)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_deep_shallow_sorting():
    draw = np.random.default_rng(1)
    for trial in range(200):
        depth = int(draw.choice([3, 8, 20, 33, 40, 100]))
        data = draw.integers(0, draw.choice([1, 2, 3, 200]) + 1, size=600).astype(np.uint8)
        if trial % 2:
            data = np.tile(data[:150], 4)
            data[draw.integers(0, 600, 3)] = 7
        starts = draw.permutation(600 - depth)[: draw.integers(1, 400)]
        groups = draw.integers(0, 3, size=len(starts))
        want, got = {}, {}
        for i, (s, g) in enumerate(zip(starts, groups)):
            want.setdefault((g, data[s : s + depth].tobytes()), set()).add(i)
        for i, run in zip(*equal_groups(data, starts, groups, depth)):
            got.setdefault(run, set()).add(int(i))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("crowded", [None, "all"])
def test_strings_that_one_hash_confuses_are_told_apart_by_the_other(monkeypatch, crowded):
    """With one value for all bytes the first hash sees lengths only; as whole strings, and around grams."""
    monkeypatch.setattr(substrings, "BYTE_VALUE", np.full(256, 3, np.uint64))
    draw = random.Random(5)
    texts = ["".join(draw.choice("abc ") for _ in range(100)) for _ in range(60)]
    texts += texts[:20]
    batch = pa.RecordBatch.from_pydict({"doc": range(80), "row": range(80), "text": texts})
    grams = None
    if crowded:
        (block,) = substrings.blocks_of_anchors(iter([batch]), 100, 24, None)
        grams = np.unique(block["gram"])
        assert len(grams) == 1
    (block,) = substrings.blocks_of_anchors(iter([batch]), 100, 24, grams)
    assert len(np.unique(block["gram"])) == 1
    around = dict(zip(block["doc"].tolist(), block["around"].tolist(), strict=True))
    assert len(around) == 80 and len(set(around.values())) == 60
    assert all(around[i] == around[i + 60] for i in range(20))
