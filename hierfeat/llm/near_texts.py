"""Texts whose sets of word shingles are similar, and one text of each group that they form.

Candidates come from SimHash fingerprints of the shingles, compared in tiles, and from bands of minimum hashes for pairs
beyond the radius of fingerprints. Each is settled by the exact Jaccard similarity of the two sets. Texts
with equal sets are one node, so copies add no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierfeat.llm.components import components
from hierfeat.llm.fingerprints import RADIUS, majority_bits, near_links, shingle_hashes
from hierfeat.llm.shared import fresh, removed, stored
from hierfeat.llm.words import mixed, pieces

SHINGLE = 5
#: Least similarity of linked texts, as a fraction of integers.
SIMILAR = (4, 5)
#: Minimum hashes per band, and bands: a pair of similarity s shares a band with probability 1 - (1 - s**5)**30.
ROWS, BANDS = 5, 30
#: Rounds in which one text of each bucket is compared with the others, before all that is still apart is.
ROUNDS = 2
#: Sets and shingles of a tile, about; columns of one product.
TILE, TILE_SHINGLES, COLUMNS = 1_024, 1 << 19, 2_048

FACTORS = mixed(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)
SKETCH = "set binary, n bigint, bits bigint, bands array<bigint>"


def distinct_shingles(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text in ascending order, and how many each has."""
    hashes, counts = shingle_hashes(texts, shingle)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(counts))


def band_values(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text with shingles, a row with the value of each band."""
    counts = counts[counts > 0]
    if not len(counts):
        return np.zeros((0, BANDS), np.uint64)
    heads = np.cumsum(counts) - counts
    out = np.empty((len(counts), BANDS), np.uint64)
    for band in range(BANDS):
        value = np.full(len(counts), band, np.uint64)
        for factor in FACTORS[band * ROWS : (band + 1) * ROWS]:
            value = mixed(value + FACTORS[0]) ^ np.minimum.reduceat(hashes * factor, heads)
        out[:, band] = mixed(value)
    return out


def sketch(text: Column, shingle: int) -> Column:
    """A digest of the set of shingles, its size, its fingerprint, and the bands; no bands without words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        for batch in batches:
            digests, sizes, bands, bits = [], [], [], [np.zeros(0, np.uint64)]
            for piece in pieces(batch):
                hashes, counts = distinct_shingles(piece, shingle)
                digests += [xxhash.xxh3_128_digest(part) for part in np.split(hashes, np.cumsum(counts)[:-1])]
                sizes.append(counts.astype(np.int64))
                bits.append(majority_bits(hashes, counts))
                bands.append(band_values(hashes, counts))
            n = np.concatenate([np.zeros(0, np.int64), *sizes])
            values = np.concatenate([np.zeros((0, BANDS), np.uint64), *bands]).view(np.int64).ravel()
            bounds = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))
            prints = pa.array(np.concatenate(bits).view(np.int64))
            columns = [pa.array(digests, pa.binary()), pa.array(n), prints, lists]
            yield pa.StructArray.from_arrays(columns, ["set", "n", "bits", "bands"])

    return F.arrow_udf(run, SKETCH)(text)


def shingle_set(text: Column, shingle: int) -> Column:
    """The different shingle hashes of a text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [distinct_shingles(piece, shingle) for piece in pieces(batch)]
            values = np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in found]]).view(np.int64)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[c for _, c in found]]))])
            yield pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), pa.array(values)).cast(pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(text)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``u``, ``v`` whose sets are similar enough."""
    least, of = SIMILAR
    one, two = sets.select(F.col("node").alias("u"), F.col("items").alias("a")), sets.select(F.col("node").alias("v"), F.col("items").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    shared = pairs.join(one, "u").join(two, "v").select("u", "v", both.alias("both"), (F.size("a") + F.size("b")).alias("all"))
    return shared.filter(F.col("both") * of >= (F.col("all") - F.col("both")) * least).select("u", "v")


def similar_links(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Links (``u`` > ``v``) that join all similar candidates, directly or by way of others.

    ``nodes`` has ``node``, ``n``, ``bits`` and ``bands`` of each different set, ``texts`` has ``node`` and ``text``.
    First come pairs that the fingerprints name. In each of ``ROUNDS`` rounds the first text of every bucket is then compared
    with the others and leaves it, so a large group of near copies costs a few comparisons a copy and bucket. What a bucket
    still holds apart goes through ``tile_links``: its sets are compared in tiles, and no table of pairs is made.
    """
    least, of = SIMILAR
    keyed = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("bucket")
    buckets = stored(keyed.join(shared, "bucket"), "buckets")
    named = stored(fingerprint_pairs(nodes), "fingerprint-pairs")
    used = buckets.select("node").union(named.select("u")).union(named.select("v")).distinct()
    sets = stored(texts.join(used, "node", "left_semi").select("node", shingle_set(F.col("text"), shingle).alias("items")), "shingle-sets")
    links = stored(similar(named, sets), "similar")
    removed(named)
    close = (F.least("n", "m") * of >= F.greatest("n", "m") * least) & (F.col("c") != F.col("d"))
    for _ in range(ROUNDS):
        reached, left = open_buckets(buckets, links)
        first = left.withColumns({"other": F.col("first.node"), "m": F.col("first.n"), "d": F.col("first.c")})
        found = first.filter((F.col("node") > F.col("other")) & close)
        pairs = stored(found.select(F.col("node").alias("u"), F.col("other").alias("v")).distinct(), "candidates")
        links, before = stored(links.union(similar(pairs, sets)), "similar"), (pairs, links, buckets, reached)
        buckets = stored(left.filter("node <> first.node").select("bucket", "node", "n"), "buckets")
        for table in before:
            removed(table)
    reached, left = open_buckets(buckets, links)
    rest = stored(left.select("bucket", "node", "n", "c"), "apart")
    links = stored(links.union(tile_links(rest, sets)), "similar")
    for table in (rest, sets, buckets, reached):
        removed(table)
    return links


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs that join all sets whose fingerprints are within the radius; sets without words stay alone."""
    worded = nodes.filter("n > 0").select("node", "bits")
    prints = stored(worded.groupBy("bits").agg(F.min("node").alias("least")), "prints")
    equal = worded.join(prints, "bits").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return equal.union(near_links(prints.select(F.col("least").alias("node"), "bits"), RADIUS)).distinct()


def open_buckets(buckets: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the links, and rows of the buckets with two or more of them: component ``c``, ``first`` of the bucket."""
    reached = components(links)
    placed = buckets.join(reached, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    first = F.min(F.struct("node", "n", "c")).alias("first")
    many = placed.groupBy("bucket").agg(first, F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi")
    return reached, placed.join(many.select("bucket", "first"), "bucket")


def tile_links(rows: DataFrame, sets: DataFrame, tile: int = TILE) -> DataFrame:
    """Links that join all similar sets of different components ``c`` that share a bucket.

    In each bucket the largest component stands against all others, which stand against each other; its own sets
    are never compared. Both sides are cut into tiles of bounded size, a unit of work is a pair of them.
    """
    by_component = rows.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("weight"))
    largest = by_component.groupBy("bucket").agg(
        F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("size"), F.sum("weight").alias("weight")
    )
    # Shingles of the bucket are an upper bound for either side.
    heavy = F.ceil(F.col("weight") / TILE_SHINGLES)

    def parts(n: Column) -> Column:
        return F.least(F.greatest(F.ceil(n / tile), F.least(heavy, n)), n).cast("int")

    sizes = largest.select(
        "bucket", F.col("top.c").alias("main"), parts(F.col("top.k")).alias("mains"), parts(F.col("size") - F.col("top.k")).alias("others")
    )
    placed = rows.join(sizes, "bucket").withColumn("is_main", F.col("c") == F.col("main"))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    # Tiles of the others are numbered from 0, those of the largest component from -1 downward.
    all_others = F.sequence(F.lit(0), F.col("others") - 1)
    from_main = F.transform(all_others, lambda t: F.struct(t.alias("s"), (-1 - F.col("at")).alias("t")))
    to_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda t: F.struct(F.col("at").alias("s"), (-1 - t).alias("t")))
    to_others = F.transform(all_others, lambda t: F.struct(F.least(F.col("at"), t).alias("s"), F.greatest(F.col("at"), t).alias("t")))
    units = F.when(F.col("is_main"), from_main).otherwise(F.concat(to_others, to_main))
    dealt = placed.withColumn("at", at).select(
        "bucket", "node", "c", F.when(F.col("is_main"), -1 - F.col("at")).otherwise(F.col("at")).alias("own"), F.explode(units).alias("unit")
    )
    unit = ["bucket", "s", "t"]
    together = dealt.select("bucket", "unit.*", "own", "node", "c").join(sets, "node").repartition(*unit).sortWithinPartitions(*unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            keys = [now.column(c).to_numpy() for c in unit]
            # The last unit may go on in the next batch.
            cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1).tolist()]
            for start, stop in zip(cuts[:-1], cuts[1:]):
                yield links_of_unit(now.slice(start, stop - start))
            rest = now.slice(cuts[-1])
        if rest is not None and len(rest):
            yield links_of_unit(rest)

    return together.select(*unit, "own", "node", "c", "items").mapInArrow(run, "u bigint, v bigint")


def links_of_unit(rows: pa.Table) -> pa.RecordBatch:
    """Links between the sets of two tiles, or within one, that join what is similar and in different components."""
    s, own, node, c = (rows.column(x).to_numpy() for x in ("s", "own", "node", "c"))
    items = rows.column("items").combine_chunks()
    items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
    n = np.diff(items.offsets.to_numpy())
    owner = np.repeat(np.arange(len(n)), n)
    _, column, holders = np.unique(items.flatten().to_numpy(), return_inverse=True, return_counts=True)
    # Shingles of one set only are in no intersection.
    number = np.cumsum(holders > 1) - 1
    common = holders[column] > 1
    owner, column = owner[common], number[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    mine, theirs = np.flatnonzero(own == s), np.flatnonzero(own == rows.column("t").to_numpy())
    place_m, place_t = np.full(len(n), -1), np.full(len(n), -1)
    place_m[mine], place_t[theirs] = np.arange(len(mine)), np.arange(len(theirs))
    whole = np.zeros((len(mine), len(theirs)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        some = slice(*np.searchsorted(column, [start, start + COLUMNS]))
        left, right = (np.zeros((len(x), COLUMNS), np.float32) for x in (mine, theirs))
        for table, place in ((left, place_m), (right, place_t)):
            inside = place[owner[some]]
            table[inside[inside >= 0], column[some][inside >= 0] - start] = 1
        whole += (left @ right.T).astype(np.int64)
    least, of = SIMILAR
    alike = whole * of >= (n[mine][:, None] + n[theirs][None, :] - whole) * least
    i, j = np.nonzero(alike & (c[mine][:, None] != c[theirs][None, :]))
    i, j = mine[i], theirs[j]
    root = np.arange(len(n))
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(n)))
    u, v = node[child], node[root[child]]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of similar texts.

    Texts are linked if the Jaccard similarity of their sets of word shingles is at least 0.8; a group is
    what links lead to. The document with the smallest key stays, as one row where rows repeat; one with
    a null key only if the group has no other. Null, empty and wordless texts are one group.
    """
    row, made, of_set, plain, no_key = fresh(docs, "row_no", "made", "set_of", "plain_key", "no_key")
    marked = stored(
        docs.withColumn(made, sketch(F.col(text), shingle)).withColumn(row, F.monotonically_increasing_id()), "sketches"
    )
    rows = marked.select(F.col(row).alias("node"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(f"{made}.set").alias("set"))
    best = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"))).alias("best")
    nodes = stored(rows.groupBy("set").agg(F.min("node").alias("node"), best), "sets")
    told = marked.select(F.col(row).alias("node"), F.col(f"{made}.n").alias("n"), *[F.col(f"{made}.{c}").alias(c) for c in ("bits", "bands")])
    links = similar_links(told.join(nodes.select("node"), "node", "left_semi"), rows.select("node", "text"), shingle)
    groups = nodes.join(components(links), "node", "left").withColumn("group", F.coalesce("component", "node"))
    stay = groups.groupBy("group").agg(F.min(F.struct("best", "set")).alias("s")).select(
        F.col("s.best.key").alias("key"), F.col("s.set").alias(of_set)
    )

    def keyed(df: DataFrame, name: str) -> DataFrame:
        # A null key is a key of its own in the join.
        return df.withColumns({plain: F.coalesce(name, F.lit(0)), no_key: F.col(name).isNull()})

    on = [plain, no_key, of_set]
    whole = marked.withColumn(of_set, F.col(f"{made}.set")).drop(made, row)
    return keyed(whole, key).join(keyed(stay, "key").select(*on), on, "left_semi").dropDuplicates(on).select(*docs.columns)
