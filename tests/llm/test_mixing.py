import random
import re
from collections import Counter, defaultdict

import pytest

from hierfeat.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=mixing.WEIGHTS, share=mixing.SHARE):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = share * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / open_ > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        full |= over


def test_sizes_targets_and_amounts(awkward, rows):
    found = mixing.mixed(awkward).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = Counter((d, s, len(WORD.findall(t or "")), sizes[s]) for d, t, _, s in rows)
    assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"]) for r in found) == want
    target, taken = brute_targets(sizes), defaultdict(int)
    for r in found:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["first"] + r["second"] and r["second"] <= r["first"] <= r["size"]
        taken[r["source"]] += r["taken"]
    for s, size in sizes.items():
        block = max(1, min(mixing.BLOCK, -(-size // mixing.LEAST_BLOCKS)))
        assert abs(taken[s] - target[s]) <= 4 * block


def test_any_partitioning_gives_the_same(spark, awkward):
    def once(df):
        return Counter(map(tuple, mixing.mixed(df).collect()))

    first = once(awkward)
    assert once(awkward.repartition(7)) == first
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert once(awkward) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_main_path_is_without_python(awkward):
    plan = mixing.mixed(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_schedule_mixes_evenly(spark):
    sized = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate([("a", 6400), ("b", 640), ("c", 3200)])], "key int, source string, size bigint")
    sources = mixing.targets(sized, (1.0,), 1.0, 2)
    slots = mixing.schedule(sources).orderBy("slot").collect()
    draws = {r["number"]: r["high"] - r["low"] for r in sources.collect()}
    for upto in (50, 100, len(slots)):
        part = Counter(r["number"] for r in slots[:upto])
        for number, n in draws.items():
            assert abs(part[number] - n * upto / sum(draws.values())) < 4
    ranks = defaultdict(list)
    for r in slots:
        ranks[r["number"]].append(r["rank"])
    assert all(x == list(range(len(x))) for x in ranks.values())


def test_documents_of_the_mix(awkward, rows):
    amounts = Counter()
    for r in mixing.mixed(awkward).collect():
        for n in (r["first"], r["second"]):
            amounts[r["doc_id"], r["source"], n] += n > 0
    found = mixing.mixture(awkward)
    assert found.columns == awkward.columns
    texts = defaultdict(set)
    for d, t, _, s in rows:
        texts[d, s].add(t)
    got = Counter()
    for r in found.collect():
        words = WORD.findall(r["text"])
        got[r["doc_id"], r["source"], len(words)] += 1
        own = texts[r["doc_id"], r["source"]]
        assert r["text"] in own or any(t and t.startswith(r["text"]) for t in own)
        assert r["n_chars"] == len(r["text"])
    assert got == +amounts


def test_empty_and_wordless(spark, empty):
    assert mixing.mixed(empty).count() == 0 and mixing.mixture(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id bigint, text string, source string")
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mixed(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def brute_mix(docs, seed=0, weights=mixing.WEIGHTS, share=mixing.SHARE):
    """Times of documents in the mix, slot by slot in plain Python; ``docs`` are rows of key, source, size and place in the stream."""
    sizes = defaultdict(int)
    for _, s, n, _ in docs:
        sizes[s] += n
    target = brute_targets(sizes, weights, share)
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    block = {s: max(1, min(mixing.BLOCK, -(-sizes[s] // mixing.LEAST_BLOCKS))) for s in names}
    blocks = {s: -(-sizes[s] // block[s]) for s in names}
    draws = {s: round(target[s] * blocks[s] / sizes[s] * mixing.FRACTION) if sizes[s] else 0 for s in names}
    total = sum(draws.values())
    slots = defaultdict(list)
    for k in range(round(total / mixing.FRACTION)):
        point, below = (k % mixing.CELLS * mixing.GOLDEN % mixing.CELLS + 0.5) / mixing.CELLS, 0
        for s in names:
            if below / total <= point < (below + draws[s]) / total:
                slots[s].append(k)
            below += draws[s]
    found = {}
    for key, s, n, start in docs:
        for time in range(mixing.MOST_TIMES):
            own = slots[s][time * blocks[s] : (time + 1) * blocks[s]]
            found[key, time] = (max(0, min(n, len(own) * block[s] - start)), set(own))
    return found


def many_sources(spark, n):
    draw = random.Random(5)
    rows = [(i, f"s{draw.randrange(n):03}" if i % 3 else "hot", " ".join(["w"] * draw.choice([0, 1, 7, 40, 300]))) for i in range(6 * n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def test_amounts_and_slots_follow_the_schedule(spark):
    found = mixing.mixed(many_sources(spark, 60)).collect()
    want = brute_mix([(r["doc_id"], r["source"], r["size"], r["start"]) for r in found])
    begins = defaultdict(set)
    for r in found:
        assert r["taken"] == r["first"] + r["second"]
        for time, name in enumerate(mixing.TIMES):
            words, own = want[r["doc_id"], time]
            assert r[name] == words
            assert (r[f"{name}_slot"] in own) if words else r[f"{name}_slot"] is None
            if words:
                begins[r["source"], time, r[f"{name}_slot"]].add(r["start"])
    # Documents of one slot begin in one block; the blocks of a source do not come in the order of its stream.
    hot = [(slot, min(s)) for (source, time, slot), s in begins.items() if source == "hot" and time == 0]
    assert all(max(s) - min(s) < mixing.BLOCK for s in begins.values()) and len(hot) > 25
    order = [start for _, start in sorted(hot)]
    assert 0.3 < sum(a < b for a, b in zip(order, order[1:])) / (len(order) - 1) < 0.7


def test_targets_of_many_sources(spark):
    docs = many_sources(spark, 700)
    sizes = defaultdict(int)
    found = mixing.mixed(docs).collect()
    for r in found:
        sizes[r["source"]] += r["size"]
    target = brute_targets(sizes)
    assert len(sizes) > 600 and all(r["target"] == pytest.approx(target[r["source"]]) for r in found)


def test_the_mix_comes_in_the_order_of_its_slots(spark):
    rows = [(i, "abc"[i % 3], " ".join(["w"] * 50)) for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = mixing.mixture(docs, slot="at").collect()
    slots = [r["at"] for r in found]
    assert slots == sorted(slots) and mixing.mixture(docs).columns == docs.columns
    whole = Counter(r["source"] for r in found)
    for upto in (300, 900, 1500):
        part = Counter(r["source"] for r in found[:upto])
        for s, n in whole.items():
            assert abs(part[s] - n * upto / len(found)) < 40


def test_texts_of_the_mix_are_shuffled_twice(spark):
    """Once to meet their amounts, once into the order of the slots; repeated and null keys meet one amount each."""
    rows = [(i % 40 or None, "ab"[i % 2] if i % 5 else None, " ".join([f"w{i}"] * (i % 3 + 1))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = mixing.mixture(docs)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
    words = Counter()
    for r in mixing.mixed(docs).collect():
        words[r["doc_id"], r["source"], r["size"]] += r["taken"]
    cut = Counter((r["doc_id"], r["source"]) for r in found.collect() for _ in WORD.findall(r["text"]))
    want = Counter()
    for (d, s, _), n in words.items():
        want[d, s] += n
    assert cut == +want
