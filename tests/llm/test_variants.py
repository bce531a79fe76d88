import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hierfeat.llm import variants

LOW = str.maketrans(variants.UPPER, variants.LOWER)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len, reverse=True)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows):
    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOW)):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def spoiled(draw, word):
    i, letter = draw.integers(len(word)), chr(draw.choice([*range(97, 123), 0xE9, 0xFC]))
    return [word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :]][draw.integers(3)]


def texts(seed, n):
    draw = np.random.default_rng(seed)
    words = ["".join(draw.choice(list("abcdeé"), draw.integers(6, 11))) for _ in range(40)] + ["Überall", "aaaaaaaa", "aaaaaaa"]
    rows = []
    for i in range(n):
        chosen = [words[min(int(draw.exponential(6)), len(words) - 1)] for _ in range(25)]
        for _ in range(4):
            chosen.append(spoiled(draw, chosen[draw.integers(25)]))
        twice = spoiled(draw, spoiled(draw, words[0]))
        rows.append((i, " ".join([*chosen, twice, "x1y", "über-all " * 2]) + ("\n" + words[1].upper()) * 3))
    return rows


def test_same_as_brute_force(spark):
    rows = texts(3, 300)
    want = brute(rows)
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 5 for w in want)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(map(tuple, variants.variants(docs).collect())) == want


def test_awkward_tables(awkward, rows, empty):
    assert sorted(map(tuple, variants.variants(awkward).collect())) == brute([r[:2] for r in rows])
    assert variants.variants(empty).collect() == []


def test_whole_table_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, variants.variants(docs).collect())) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("symbols", [1, 4, 7])
def test_neighbourhoods_are_whole(symbols):
    draw = np.random.default_rng(symbols)
    words = list(dict.fromkeys("".join(draw.choice(list("abcdefg"), draw.integers(1, 9))) for _ in range(60)))
    table = np.ones(variants.POINTS, np.uint64)
    for i, letter in enumerate("abcdefg"):
        table[ord(letter)] = i % symbols + 1

    def low(word):
        return "".join(chr(96 + int(table[ord(c)])) for c in word)

    def number(word):
        return int(variants.Reduced(np.array([ord(c) - 96 for c in word], np.uint64), np.array([len(word)]), symbols).values[0])

    owner, value = variants.Reduced(*variants.digits_of(words, table), symbols).neighbours()
    for i, word in enumerate(words):
        r, letters = low(word), [chr(97 + s) for s in range(symbols)]
        made = {r[:j] + r[j + 1 :] for j in range(len(r))} | {r[:j] + c + r[j + 1 :] for j in range(len(r)) for c in letters if c != r[j]}
        own = value[owner == i]
        assert len(own) == len(made) and set(own.tolist()) == {number(x) if x else 0 for x in made}


def test_crowded_reduced_words(spark, monkeypatch):
    """With one symbol all words of a length share a reduced word; pairs stay whole."""
    rows = texts(8, 60)
    monkeypatch.setattr(variants, "alphabet", lambda words: np.ones(variants.POINTS, np.uint64))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, variants.variants(docs).collect())) == brute(rows)
