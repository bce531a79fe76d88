"""SimHash fingerprints of documents and the groups that near-equal ones form.

Fingerprints that differ in few bits agree on whole blocks of bits, so only those that
share a choice of blocks are compared. What shares a choice is cut into tiles, and tiles
are compared exactly, bit by bit, unless their population counts already lie further
apart than the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierfeat.llm.components import components
from hierfeat.llm.shared import fresh, stored
from hierfeat.llm.words import bytes_of, pieces, words_of

SEED = 42
BITS = 64
RADIUS = 3
SHINGLE = 3
#: More blocks mean longer, more selective keys and more of them; see ``keys_of``.
BLOCKS = 5
#: Fingerprints in a tile.
TILE = 2_048


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def lanes() -> np.ndarray:
    """For each byte, its eight bits as the eight bytes of one 64-bit number."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a piece, and how many each text has.

    A text with words, but fewer than a shingle takes, has one: all its words.
    """
    import xxhash

    data, bounds = bytes_of(texts)
    w = words_of(lower_ascii()[data], bounds)
    # Words with one space after each: a shingle is then a run of bytes.
    lengths = w.ends - w.starts
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if len(lengths) else lengths
    ends = starts + lengths
    joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
    if len(lengths):
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        joined[inside + np.repeat(starts, lengths)] = w.data[inside + np.repeat(w.starts, lengths)]
    counts = np.where(w.counts >= shingle, w.counts - shingle + 1, np.minimum(w.counts, 1))
    span = np.minimum(w.counts, shingle)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(w.firsts, counts)
    last = first + span[owner] - 1
    view, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(view[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())]
    return np.array(hashes, np.uint64), counts


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the bits that are set in over half of its hashes."""
    out = np.zeros(len(counts), np.uint64)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    # Eight counters share a number, one per byte of it, so at most 255 hashes are added at once.
    heads = np.cumsum(counts[own]) - counts[own]
    parts = (counts[own] + 254) // 255
    step = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.repeat(heads, parts) + 255 * step
    table, octets = lanes(), hashes.view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(table[octets[:, k]], at) for k in range(8)], axis=1)
    per_part = sums.view(np.uint8).reshape(-1, BITS).astype(np.int64)
    set_bits = np.add.reduceat(per_part, np.cumsum(parts) - parts, axis=0)
    high = 2 * set_bits > counts[own][:, None]
    out[own] = np.packbits(high, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text as a bigint; 0 without words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [majority_bits(*shingle_hashes(p, shingle)) for p in pieces(batch)]
            yield pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64), pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def keys_of(bits: Column, radius: int, blocks: int) -> Column:
    """All choices of ``blocks - radius`` blocks of bits, as an array of (choice, value).

    Of ``blocks`` blocks at most ``radius`` hold a differing bit, so two fingerprints within
    the radius agree on one choice at least.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    found = []
    for number, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        found.append(F.struct(F.lit(number).alias("choice"), bits.bitwiseAND(F.lit(signed).cast("bigint")).alias("value")))
    return F.array(*found)


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links (``u`` > ``v``) that join all fingerprints within the radius, directly or by way of others.

    ``prints`` has one row per distinct fingerprint: ``bits`` and ``node``, a number of its own.
    """
    keyed = prints.select("node", "bits", F.explode(keys_of(F.col("bits"), radius, blocks)).alias("k")).select(
        "node", "bits", "k.choice", "k.value", F.bit_count("bits").alias("pop")
    )
    # Tiles hold fingerprints of one population count; a choice of few is one tile.
    sizes = keyed.groupBy("choice", "value", "pop").agg(F.count(F.lit(1)).alias("n"))
    shares = (
        sizes.groupBy("choice", "value")
        .agg(
            F.sum("n").alias("size"),
            F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("parts")))).alias(
                "parts"
            ),
        )
        .filter("size > 1")
    )
    rows = keyed.join(shares, ["choice", "value"])
    whole = F.array(F.struct(*[F.lit(0).alias(c) for c in ("p", "s", "q", "t")]))
    part = F.pmod(F.xxhash64("bits"), F.element_at("parts", F.col("pop"))).cast("int")

    def tile_pair(pop: Column, other: Column) -> Column:
        ordered = (F.col("pop") < pop) | ((F.col("pop") == pop) & (part <= other))
        mine, theirs = [F.col("pop").alias("p"), part.alias("s")], [pop.alias("q"), other.alias("t")]
        back = [pop.alias("p"), other.alias("s"), F.col("pop").alias("q"), part.alias("t")]
        return F.when(ordered, F.struct(*mine, *theirs)).otherwise(F.struct(*back))

    near = F.filter(F.map_keys("parts"), lambda q: F.abs(q - F.col("pop")) <= radius)
    pairs = F.flatten(
        F.transform(
            near,
            lambda q: F.transform(F.sequence(F.lit(0), F.element_at("parts", q) - 1), lambda t: tile_pair(q, t)),
        )
    )
    units = rows.select(
        "choice",
        "value",
        "node",
        "bits",
        F.explode(F.when(F.col("size") <= tile, whole).otherwise(pairs)).alias("unit"),
    ).select("choice", "value", "unit.*", "node", "bits")
    unit = ["choice", "value", "p", "s", "q", "t"]
    together = units.repartition(*unit).sortWithinPartitions(*unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*unit, "node", "bits")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            # The last unit may go on in the next batch.
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in now[:6]], axis=0)) + 1
            done = int(change[-1]) if len(change) else 0
            if done:
                yield linked(change[:-1], [x[:done] for x in now[6:]], radius)
            rest = [x[done:] for x in now]
        if rest is not None and len(rest[0]):
            yield linked(np.zeros(0, np.int64), rest[6:], radius)

    return together.mapInArrow(run, "u bigint, v bigint")


def linked(cuts: np.ndarray, columns: list[np.ndarray], radius: int) -> pa.RecordBatch:
    """Links inside each unit; the rows of a unit lie together, ``cuts`` is where units begin."""
    node, bits = columns[0].astype(np.int64), columns[1].astype(np.int64).view(np.uint64)
    bounds = np.concatenate([[0], cuts, [len(node)]])
    sizes = np.diff(bounds)
    found: list[np.ndarray] = []
    small = sizes <= 8
    # Units of few rows: compare all rows with those 1, 2, … further on at once.
    unit = np.repeat(np.arange(len(sizes)), sizes)
    for step in range(1, int(sizes[small].max(initial=1))):
        same = (unit[step:] == unit[:-step]) & small[unit[step:]]
        i = np.flatnonzero(same)
        near = i[np.bitwise_count(bits[i] ^ bits[i + step]) <= radius]
        found.append(np.stack([near, near + step], axis=1))
    for k in np.flatnonzero(~small):
        found.append(bounds[k] + spanning(bits[bounds[k] : bounds[k + 1]], radius))
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    u, v = node[pairs[:, 0]], node[pairs[:, 1]]
    keep = u != v
    links = np.unique(np.stack([np.maximum(u, v)[keep], np.minimum(u, v)[keep]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["u", "v"])


def spanning(bits: np.ndarray, radius: int, rows: int = 256) -> np.ndarray:
    """For each fingerprint but the roots, a pair with the root of those it is linked with."""
    pops = np.bitwise_count(bits).astype(np.int64)
    order = np.argsort(pops, kind="stable")
    bits, pops = bits[order], pops[order]
    root = np.arange(len(bits))
    for at in range(0, len(bits), rows):
        block = bits[at : at + rows]
        # Only later rows whose population count is within the radius can be near.
        stop = int(np.searchsorted(pops, pops[min(at + rows, len(bits)) - 1] + radius, "right"))
        i, j = np.nonzero(np.bitwise_count(block[:, None] ^ bits[None, at:stop]) <= radius)
        i, j = i + at, j + at
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    child = np.flatnonzero(root != np.arange(len(bits)))
    return np.stack([order[child], order[root[child]]], axis=1)


def near_groups(
    docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """Fingerprint and group of every document.

    One row per row of ``docs``: the key, ``fingerprint`` (16 hex digits) and ``component_id``,
    the smallest key that links of at most ``radius`` differing bits lead to. Null, empty and
    wordless texts have fingerprint 0 and are linked like any other. Equal fingerprints are
    one node, so any number of copies adds no links. Rows with a null key link nothing: they get
    the group of documents with an equal fingerprint, or null. Repeated rows come out as often
    as they go in; other columns are not read.
    """
    marked = stored(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle).alias("bits")), "fingerprints")
    return grouped(marked, radius).select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def grouped(marked: DataFrame, radius: int) -> DataFrame:
    """Add ``component_id`` to rows of ``key``, ``bits``."""
    prints = stored(marked.groupBy("bits").agg(F.min("key").alias("least")), "prints")
    known = prints.filter("least IS NOT NULL").select(F.col("least").alias("node"), "bits")
    reached = components(near_links(known, radius))
    labels = known.join(reached, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))
    return marked.join(labels, "bits", "left")


def one_of_each(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of near-equal texts.

    The document with the smallest key stays, as one row where rows repeat. Rows with a null key
    stay only if no document has the same fingerprint, as one row per fingerprint. Documents are
    written once with their fingerprint and shuffled once.
    """
    bits, plain, no_key = fresh(docs, "bits", "plain_key", "no_key")
    marked = stored(docs.withColumn(bits, fingerprint(F.col(text))), "fingerprints")
    groups = grouped(marked.select(F.col(key).alias("key"), F.col(bits).alias("bits")), radius)

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        # A null key is a key of its own in the join.
        return rows.withColumns({plain: F.coalesce(name, F.lit(0)), no_key: F.col(name).isNull()})

    on = [plain, no_key, bits]
    stay = keyed(groups.filter(F.col("key").eqNullSafe(F.col("component_id"))).withColumnRenamed("bits", bits), "key")
    return keyed(marked, key).join(stay.select(*on), on, "left_semi").dropDuplicates(on).select(*docs.columns)
