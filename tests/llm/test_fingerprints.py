import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from hierfeat.llm import fingerprints
from hierfeat.llm.components import components


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_equals_brute_force(awkward, rows):
    prints = [(d, brute_print(t)) for d, t, *_ in rows]
    group = brute_groups({f for d, f in prints if d is not None}, 3)
    least = {}
    for d, f in prints:
        if d is not None:
            least[group[f]] = min(least.get(group[f], d), d)
    want = Counter((d, f"{f:016x}", least.get(group.get(f))) for d, f in prints)
    assert Counter(map(tuple, fingerprints.near_groups(awkward).collect())) == want


def clustered(seed, n):
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(6)]
    found = set()
    while len(found) < n:
        value = draw.choice(centres)
        for _ in range(draw.randint(0, 9)):
            value ^= 1 << draw.randrange(64)
        found.add(value)
    return sorted(found)


@pytest.mark.parametrize(("tile", "radius"), [(5, 3), (40, 3), (2048, 3), (7, 1), (2048, 0)])
def test_all_links_are_found_whatever_the_tiles(spark, tile, radius):
    values = clustered(tile, 300)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(i, b) for i, b in enumerate(signed)], "node bigint, bits bigint")
    found = dict(map(tuple, components(fingerprints.near_links(prints, radius, tile=tile)).collect()))
    group = brute_groups(set(values), radius)
    least = {}
    for i, v in enumerate(values):
        least[group[v]] = min(least.get(group[v], i), i)
    assert [found.get(i, i) for i in range(len(values))] == [least[group[v]] for v in values]


def test_components_of_paths_stars_and_rings(spark):
    links = [(i + 1, i) for i in range(100, 160)] + [(500, k) for k in range(200, 240)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "u bigint, v bigint")).collect()))
    assert {found[k] for k in range(100, 161)} == {100}
    assert {found[k] for k in [500, *range(200, 240)]} == {200}
    assert {found[k] for k in range(300, 309)} == {300}


def test_documents_that_stay(awkward):
    groups = fingerprints.near_groups(awkward).collect()
    stay = fingerprints.one_of_each(awkward)
    assert stay.columns == awkward.columns
    want = Counter({(r["doc_id"], r["fingerprint"]) for r in groups if r["doc_id"] == r["component_id"]})
    found = Counter((r["doc_id"], f"{brute_print(r['text']):016x}") for r in stay.collect())
    assert found == want


def test_empty(empty):
    assert fingerprints.near_groups(empty).count() == 0
    assert fingerprints.one_of_each(empty).count() == 0
