"""Removal of byte strings that the corpus holds earlier, by sorting suffixes at anchors.

Two equal strings of ``LENGTH`` bytes hold the same byte grams, so the gram of the smallest hash lies
at the same place in both: it is their anchor. Each start of such a string belongs to one anchor,
and equal strings meet where anchors are grouped by their gram. Of anchors with equal surroundings
the first in the corpus stands for all; the surroundings of the others are suffixes that
deep-shallow sorting orders up to ``LENGTH`` bytes. Strings that agree that far are equal, and all
but the first are removed. Only anchors, not all suffixes of the corpus, are ever shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierfeat.llm.shared import stored
from hierfeat.llm.suffix_sort import equal_groups, split_runs
from hierfeat.llm.words import BYTE_VALUE, STEP, bytes_of, mixed, pieces, powers

LENGTH = 100
#: Bytes of an anchor's gram. Longer grams mean fewer chance meetings, but more anchors.
GRAM = 24
SEGMENT = 1 << 20
#: Grams with so many different surroundings are grouped by whole strings instead, so that no group is
#: large. Blocks of anchors name those of which they have ``NAMED`` or more.
CROWDED = 20_000
NAMED = 8
MOST_CROWDED = 200_000
SPREAD = 1 << 14
BLOCK_ROWS = 1 << 19
#: Anchors whose strings are sorted together.
CHUNK_ROWS = 1 << 14
LAST = 2**63 - 1


def inverse(x: int) -> np.uint64:
    """The number that gives 1 with ``x`` modulo 2**64."""
    return np.uint64(pow(x, -1, 1 << 64))


#: Base and byte values of the second hash, which share nothing with those of the first.
OTHER_STEP = np.uint64(0xD1342543DE82EF95)
OTHER_VALUE = mixed(BYTE_VALUE ^ OTHER_STEP)


class Hasher:
    """Hashes of any stretch of a segment from one pass of running sums."""

    def __init__(self, data: np.ndarray, values: np.ndarray, step: np.uint64):
        n = len(data)
        self.back = powers(n + 1, inverse(int(step)))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * powers(n, step), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def grams(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * self.back[: len(self.back) - size])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors of a segment: its gram's hash, the hash of its surroundings, text, place, and its strings.

    ``low`` and ``high`` are the first and the last start of the strings that belong to the anchor. Grams and
    surroundings are hashed by different sums: strings that one takes for equal are told apart by the other.
    """
    n, window = len(data), length - gram + 1
    empty = {c: np.zeros(0, np.int64) for c in ("text", "place", "low", "high")}
    if n < length:
        return empty | {c: np.zeros(0, np.uint64) for c in ("gram", "around")} | {"hashers": None}
    hasher, other = Hasher(data, BYTE_VALUE, STEP), Hasher(data, OTHER_VALUE, OTHER_STEP)
    hashes = hasher.grams(gram)
    bits = max(int(len(hashes)).bit_length(), 1)
    mask = np.uint64((1 << bits) - 1)
    # Equal hashes go by place, so the choice depends on the string alone.
    key = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    least, width = key, 1
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = window - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    chosen = (least & mask).astype(np.int64)
    text = np.searchsorted(bounds[1:], np.arange(len(chosen)), "right")
    inside = np.arange(len(chosen)) + length <= bounds[1:][text]
    start = np.flatnonzero(inside)
    if not len(start):
        return empty | {c: np.zeros(0, np.uint64) for c in ("gram", "around")} | {"hashers": None}
    own, place = text[start], chosen[start]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1])]))
    low, high = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
    place, own = place[new], own[new]
    # Surroundings are equal only if the strings lie alike around the anchor.
    shape = ((place - low) * 256 + (place - high)).astype(np.uint64)
    around = mixed(other.of(low, high + length) + mixed(shape + np.uint64(1)))
    return {
        "gram": hashes[place],
        "around": around,
        "text": own,
        "place": place,
        "low": low,
        "high": high,
        "hashers": (hasher, other),
    }


def segments(texts: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Bytes of runs of texts, or of overlapping stretches of a long one: first text, offset, bytes, bounds."""
    at = 0
    for piece in pieces(texts, SEGMENT):
        data, bounds = bytes_of(piece)
        if len(data) <= 2 * SEGMENT:
            yield at, 0, data, bounds
        else:
            # One long text (and empty ones): each string starts in one stretch.
            text = int(np.argmax(np.diff(bounds)))
            for offset in range(0, len(data), SEGMENT):
                part = data[offset : offset + SEGMENT + length - 1]
                yield at + text, offset, part, np.array([0, len(part)])
        at += len(piece)


#: ``where`` holds the first start, the number of starts less one, and how far the gram lies behind the last.
FIELDS = ("gram", "around", "doc", "row", "where")
PACK = 10
SCHEMA = ", ".join(f"{f} bigint" for f in FIELDS) + ", spare boolean"


def as_batch(columns: dict[str, np.ndarray], spare: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(columns[f].view(np.int64) if columns[f].dtype == np.uint64 else columns[f]) for f in FIELDS]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(spare)], [*FIELDS, "spare"])


def packed(low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (low << 2 * PACK) | ((high - low) << PACK) | (place - high)


def unpacked(where: np.ndarray) -> dict[str, np.ndarray]:
    mask = (1 << PACK) - 1
    low = where >> 2 * PACK
    high = low + ((where >> PACK) & mask)
    return {"low": low, "high": high, "place": high + (where & mask)}


def blocks_of_anchors(
    batches: Iterator[pa.RecordBatch], length: int, gram: int, crowded: np.ndarray | None
) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of a task, about ``BLOCK_ROWS`` at a time. Anchors of a crowded gram become their strings."""
    parts: list[dict[str, np.ndarray]] = []
    size = 0
    for batch in batches:
        doc = batch.column("doc").to_numpy(zero_copy_only=False)
        row = batch.column("row").to_numpy(zero_copy_only=False)
        for at, offset, data, bounds in segments(batch.column("text"), length):
            a = anchors(data, bounds, length, gram)
            if not len(a["text"]):
                continue
            (hasher, other), text = a.pop("hashers"), a.pop("text")
            begin = bounds[text] - offset
            if crowded is not None and len(crowded):
                hit = np.isin(a["gram"], crowded)
                if hit.any():
                    n = (a["high"] - a["low"] + 1)[hit]
                    which = np.repeat(np.flatnonzero(hit), n)
                    start = a["low"][which] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    single = {
                        "gram": mixed(hasher.of(start, start + length) + np.uint64(1)),
                        "around": other.of(start, start + length),
                        "place": a["place"][which],
                        "low": start,
                        "high": start,
                    }
                    a = {k: np.concatenate([a[k][~hit], single[k]]) for k in single}
                    text, begin = (np.concatenate([x[~hit], x[which]]) for x in (text, begin))
            where = packed(a["low"] - begin, a["high"] - begin, a["place"] - begin)
            whose = {"doc": doc[at + text], "row": row[at + text], "where": where}
            parts.append({"gram": a["gram"], "around": a["around"]} | whose)
            size += len(text)
            if size >= BLOCK_ROWS:
                yield {k: np.concatenate([p[k] for p in parts]) for k in FIELDS}
                parts, size = [], 0
    if parts:
        yield {k: np.concatenate([p[k] for p in parts]) for k in FIELDS}


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts with a row number and a place in the order of documents; files give the same numbers each time."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("doc"),
        F.col(text).alias("text"),
    )


def crowded_grams(rows: DataFrame, length: int, gram: int) -> np.ndarray:
    """Grams with many different surroundings, the most crowded ones if they are many.

    The list only decides how anchors are grouped, not what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of_anchors(batches, length, gram, None):
            _, number = split_runs(block["gram"], block["around"])
            order = np.lexsort((block["around"], block["gram"]))
            first = np.concatenate([[True], number[1:] != number[:-1]])
            grams, n = np.unique(block["gram"][order][first], return_counts=True)
            some = n >= NAMED
            yield pa.RecordBatch.from_arrays([pa.array(grams[some].view(np.int64)), pa.array(n[some])], ["gram", "n"])

    named = rows.select("doc", "row", "text").mapInArrow(run, "gram bigint, n bigint")
    sums = named.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= CROWDED)
    most = sums.orderBy(F.desc("n"), "gram").limit(MOST_CROWDED)
    return np.array([r["gram"] for r in most.select("gram").collect()], np.int64).view(np.uint64)


def leading_anchors(rows: DataFrame, length: int, gram: int, crowded: np.ndarray) -> DataFrame:
    """All anchors; of those of one block with equal surroundings all but the first are marked ``spare``.

    What is spare is known to be removed, so it needs no company: its gram is replaced by one of a few
    numbers that spread such rows evenly.
    """
    shipped = rows.sparkSession.sparkContext.broadcast((crowded,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of_anchors(batches, length, gram, shipped.value[0]):
            order = np.lexsort((block["where"], block["row"], block["doc"], block["around"], block["gram"]))
            block = {k: v[order] for k, v in block.items()}
            spare = np.zeros(len(order), bool)
            spare[1:] = (block["gram"][1:] == block["gram"][:-1]) & (block["around"][1:] == block["around"][:-1])
            spread = mixed(block["row"].astype(np.uint64) * STEP + block["where"].astype(np.uint64))
            block["gram"] = np.where(spare, spread % np.uint64(SPREAD), block["gram"])
            block["around"] = np.where(spare, np.uint64(0), block["around"])
            yield as_batch(block, spare)

    return rows.select("doc", "row", "text").mapInArrow(run, SCHEMA)


def judged_anchors(leading: DataFrame) -> DataFrame:
    """Of the anchors with one gram: those removed, and those whose surroundings must be compared.

    Rows come sorted, so a task holds one batch and one anchor more. Anchors with equal surroundings
    but the first are removed; the first ones are compared if their gram has several. What stands
    alone is left out.
    """
    together = leading.repartition("gram").sortWithinPartitions("gram", "around", "doc", "row", "where")
    out = ["row", "where", "gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead_before: dict[str, np.ndarray] | None = None  # the last anchor that is first of its kind
        told = False  # whether it has been given out already
        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*FIELDS, "spare")}
            carried = int(lead_before is not None)
            if carried:
                now = {c: np.concatenate([lead_before[c], now[c]]) for c in now}
            size = len(now["gram"])
            if not size:
                continue
            same = now["gram"][1:] == now["gram"][:-1]
            removed = now["spare"].astype(bool)
            removed[1:] |= same & (now["around"][1:] == now["around"][:-1])
            index = np.flatnonzero(~removed)
            company = now["gram"][index[1:]] == now["gram"][index[:-1]]
            several = np.zeros(len(index), bool)
            several[1:] |= company
            several[:-1] |= company
            give = removed.copy()
            give[index] = several
            if carried and told:
                give[0] = False
            if len(index):
                last = int(index[-1])
                told = bool(several[-1]) or (told and carried and last == 0)
                lead_before = {c: v[last : last + 1] for c, v in now.items()}
            # What is removed needs its gram no more.
            now["gram"] = np.where(removed, 0, now["gram"])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(now[c][give]) for c in out], pa.array(removed[give])], [*out, "removed"]
            )

    return together.mapInArrow(run, ", ".join(f"{c} bigint" for c in out) + ", removed boolean")


def surroundings(asked: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the strings of each anchor, fetched from its text."""
    fields = ["gram", "where"]
    by_row = asked.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    doc = F.coalesce(F.col("key").cast("bigint"), F.lit(LAST)).alias("doc")
    joined = texts.join(by_row, "row").select("row", doc, "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("asked")
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            columns = {f: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(fields)}
            at = 0
            for text, row, own, n in zip(batch.column("text"), batch.column("row"), batch.column("doc"), counts):
                data = text.as_py().encode()
                part = {f: columns[f][at : at + n] for f in fields}
                span = unpacked(part["where"])
                bytes_ = [data[a : b + length] for a, b in zip(span["low"].tolist(), span["high"].tolist())]
                at += n
                same = [pa.array(np.full(n, own.as_py())), pa.array(np.full(n, row.as_py()))]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(part[f]) for f in fields], *same, pa.array(bytes_, pa.binary())],
                    [*fields, "doc", "row", "bytes"],
                )

    return joined.mapInArrow(run, ", ".join(f"{f} bigint" for f in [*fields, "doc", "row"]) + ", bytes binary")


def compared(around: DataFrame, length: int) -> DataFrame:
    """Spans of the strings that another anchor of the same gram holds earlier."""
    together = around.repartition("gram").sortWithinPartitions("gram")
    numbers = ["gram", "where", "doc", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                some, batch = batch.slice(0, CHUNK_ROWS), batch.slice(CHUNK_ROWS)
                held.append(some)
                size += some.num_rows
                if size < CHUNK_ROWS:
                    continue
                whole = pa.Table.from_batches(held).combine_chunks()
                gram = whole.column("gram").to_numpy()
                # The last gram may go on.
                done = int(np.searchsorted(gram, gram[-1], "left"))
                if done:
                    yield repeats(whole.slice(0, done), numbers, length)
                held = whole.slice(done).to_batches()
                size = whole.num_rows - done
        if held:
            yield repeats(pa.Table.from_batches(held).combine_chunks(), numbers, length)

    return together.mapInArrow(run, "row bigint, start bigint, end bigint")


def repeats(members: pa.Table, numbers: list[str], length: int) -> pa.RecordBatch:
    """Sort all strings of some anchors and give the spans of those that are not the first of their kind."""
    m = {c: members.column(c).to_numpy() for c in numbers}
    m |= unpacked(m["where"])
    texts = members.column("bytes").combine_chunks()
    data, bounds = bytes_of(texts.cast(pa.large_binary()) if not isinstance(texts, pa.ChunkedArray) else texts.chunk(0).cast(pa.large_binary()))
    n = m["high"] - m["low"] + 1
    which = np.repeat(np.arange(len(n)), n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    gram = np.cumsum(np.concatenate([[0], m["gram"][1:] != m["gram"][:-1]]))
    # Only strings that lie alike around their anchor can be equal.
    lie = m["place"][which] - m["low"][which] - step
    group = gram[which] * 1024 + lie
    at, run = equal_groups(data, bounds[:-1][which] + step, group, length)
    start = m["low"][which[at]] + step[at]
    order = np.lexsort((start, m["row"][which[at]], m["doc"][which[at]], run))
    later = np.zeros(len(order), bool)
    later[1:] = run[order][1:] == run[order][:-1]
    hit = np.sort(at[order[later]])
    # Neighbouring starts of one anchor make one span.
    own, begin = which[hit], m["low"][which[hit]] + step[hit]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (begin[1:] != begin[:-1] + 1)])) if len(hit) else hit
    ends = np.concatenate([new[1:], [len(hit)]]) - 1 if len(hit) else hit
    return pa.RecordBatch.from_arrays(
        [pa.array(m["row"][own[new]]), pa.array(begin[new]), pa.array(begin[ends] + length)], ["row", "start", "end"]
    )


def spans_and_texts(docs: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    """Texts with the spans to remove: ``row``, ``key``, ``text``, ``spans`` (array of start and end)."""
    rows = numbered(docs, key, text)
    judged = stored(judged_anchors(leading_anchors(rows, length, gram, crowded_grams(rows, length, gram))), "anchors")
    # Used twice, shuffled once: both joins read the same exchange.
    texts = rows.select("row", "key", "text").repartition("row")
    near = compared(surroundings(judged.filter("NOT removed"), texts, length), length)
    low = F.shiftright("where", 2 * PACK)
    high = low + F.shiftright("where", PACK).bitwiseAND((1 << PACK) - 1)
    spans = judged.filter("removed").select("row", low.alias("start"), (high + length).alias("end")).unionByName(near)
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return texts.join(by_row, "row", "left")


def runs_of(spans: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that spans cover, as starts and ends."""
    start, end = (spans.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[new], reach[np.concatenate([new[1:], [len(start)]]) - 1]


def without_spans(data: bytes, spans: pa.Array | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of runs removed."""
    if spans is None or not len(spans):
        return data, 0
    starts, ends = runs_of(spans, len(data))
    keep = zip([0, *ends.tolist()], [*starts.tolist(), len(data)])
    return b"".join(data[a:b] for a, b in keep), len(starts)


KEPT = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def kept_column(text: Column, spans: Column, with_bytes: bool) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            found = []
            for t, s in zip(texts, lists):
                data = (t.as_py() or "").encode()
                left, n = without_spans(data, s.values)
                digest = hashlib.sha256(left).hexdigest()
                found.append((len(data), len(data) - len(left), n, digest, left if with_bytes else None))
            columns = list(zip(*found)) if found else [[]] * 5
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KEPT)], fields=list(KEPT))

    kind = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string, kept: binary>"
    return F.arrow_udf(run, kind)(text, spans)


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, with_bytes: bool = False
) -> DataFrame:
    """What is left of every whole text without the byte strings that start earlier in the corpus.

    One row per row of ``docs``: the key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and with
    ``with_bytes`` also ``kept`` (the bytes left, which may break characters). A byte is removed if
    a string of ``length`` bytes over it also starts in a document of smaller key, or earlier in the
    same one. Null is an empty text; texts shorter than ``length`` stay whole. Rows without a key come
    after all others; rows that repeat a key are in the order of the table, so of equal rows the
    first stays. An empty table gives an empty result; other columns are not read. The table must
    read the same twice, as files do.
    """
    if not 0 < gram <= length < 1 << PACK:
        raise ValueError(f"a gram must fit its string, and the string {1 << PACK} bytes: {gram}, {length}")
    found = spans_and_texts(docs, key, text, length, gram)
    kept = kept_column(F.col("text"), F.col("spans"), with_bytes)
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else [])]
    return found.select(F.col("key").alias(key), kept.alias("k")).select(key, *[f"k.{c}" for c in columns])
