import os
import random
from collections import Counter, defaultdict

import corpus_pipeline
from hierfeat.llm import near_texts

from .conftest import prose


def shingles(text, k=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1)))


def brute_stay(rows):
    """Keys that stay, by comparing every pair that shares a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders, root = defaultdict(list), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in (s or {""}) for j in holders[x])
        for j, both in common.items():
            union = len(s | sets[j]) or 1
            if 5 * (both if s else 1) >= 4 * union:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for x in s or {""}:
            holders[x].append(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values())


def changed(words, n, draw):
    out = list(words)
    for i in draw.sample(range(len(out)), n):
        out[i] = f"new{draw.randrange(10**9)}"
    return out


def test_groups_are_those_of_brute_force(spark):
    draw, rows = random.Random(5), []
    for i in range(60):
        words = prose(i, 80 + i).split()
        rows.append(" ".join(words))
        for _ in range(6):
            words = changed(words if i % 2 else rows[-1].split(), draw.randrange(0, 4), draw)
            rows.append(" ".join(words))
    base = prose(999, 200).split()
    rows += [" ".join(changed(base, 2, draw)) for _ in range(150)]
    draw.shuffle(rows)
    rows = list(enumerate(dict.fromkeys(rows)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(r["doc_id"] for r in near_texts.one_of_each(docs).collect()) == brute_stay(rows)


def test_stage_of_the_pipeline_removes_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = corpus_pipeline.near_dedup(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(r["doc_id"] for r in found.collect()) == brute_stay(rows)


def test_null_keys_and_texts(spark):
    text = prose(1, 100)
    rows = [(None, text), (4, text + " end"), (None, prose(2, 50)), (None, prose(2, 50)), (2, None), (3, " \n"), (6, "one"), (6, "two")]
    found = near_texts.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(4, text + " end"), (None, prose(2, 50)), (2, None), (6, "one"), (6, "two")]
    assert Counter(map(tuple, found)) == Counter(want)


def family(n, words, edits, seed):
    """Texts that each differ from one base in a few words: most pairs lie just below the similarity."""
    draw = random.Random(seed)
    base = prose(seed, words).split()
    return [(i, " ".join(changed(base, edits, draw))) for i in range(n)]


def test_candidates_grow_with_copies_not_with_their_square(spark, monkeypatch):
    seen, plain = [], near_texts.similar

    def counted(pairs, sets):
        seen[-1] += pairs.count()
        return plain(pairs, sets)

    monkeypatch.setattr(near_texts, "similar", counted)
    for n in (100, 400):
        seen.append(0)
        rows = family(n, 200, 3, 7)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        assert sorted(r["doc_id"] for r in near_texts.one_of_each(docs).collect()) == brute_stay(rows)
    assert 0 < seen[1] < 8 * seen[0]


def test_crowded_buckets_of_texts_that_are_not_similar(spark):
    """A long shared passage puts texts into the same buckets; only a few of them are similar."""
    draw, passage = random.Random(4), prose(1, 60)
    rows = [(i, prose(1000 + i, 40) + " " + passage) for i in range(200)]
    rows += [(300 + i, " ".join(changed(t.split(), 1, draw))) for i, t in rows[::9]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(r["doc_id"] for r in near_texts.one_of_each(docs).collect()) == brute_stay(rows)


def test_tiles_find_what_all_pairs_would(spark, monkeypatch):
    """Several tiles on both sides, sets of many sizes, more shingles than one product takes."""
    monkeypatch.setattr(near_texts, "COLUMNS", 64)
    draw = random.Random(9)
    sets, rows = [], []
    for node in range(90):
        base = set(range(1000 * (node % 3), 1000 * (node % 3) + 40 + node % 3))
        mine = {x for x in base if draw.random() > 0.06} | {10**6 + draw.randrange(10**6) for _ in range(draw.randrange(5))}
        sets.append((node, sorted(mine)))
        # Sets of components 0 and 7 are linked already; in bucket 1 all are apart.
        rows.append((0, node, len(mine), 7 if node % 2 else node))
        if node < 30:
            rows.append((1, node, len(mine), node))
    found = near_texts.tile_links(
        spark.createDataFrame(rows, "bucket bigint, node bigint, n bigint, c bigint"),
        spark.createDataFrame(sets, "node bigint, items array<bigint>"),
        tile=8,
    ).collect()

    def groups(pairs):
        root = list(range(90))
        for i in range(90):
            root[i] = 7 if i % 2 else i

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for u, v in pairs:
            a, b = sorted((find(u), find(v)))
            root[b] = a
        return [find(i) for i in range(90)]

    items = {k: set(v) for k, v in sets}
    want = [(u, v) for u in items for v in items if u > v and 5 * len(items[u] & items[v]) >= 4 * len(items[u] | items[v])]
    assert groups(found) == groups(want) != groups([])


def test_tables_in_between_are_deleted(spark):
    docs = spark.createDataFrame(family(50, 100, 2, 3), "doc_id bigint, text string")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    near_texts.one_of_each(docs).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"sketches", "sets", "links", "similar", "prints"}
