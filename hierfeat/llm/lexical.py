"""Ranked lexical search: for each item of a query set, the documents of highest score.

Scoring is a matrix product. The terms of a tile of items are its columns; documents are rows
of impacts, a tile at a time, and items are columns of term weights. Both are whole numbers, and a
product takes so few columns at once that all its sums stay below 2**53, so float64 holds
them exactly; sums of several products are added as integers. Every task keeps the best rows of each
item with all ties settled by key, and these are merged in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hierfeat.llm.fingerprints import lower_ascii
from hierfeat.llm.shared import made_once, stored
from hierfeat.llm.words import bytes_of, pieces, words_of

#: What a term consists of, as an expression and as bytes: ASCII letters, digits, all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BEST = 10
#: Pairs of item and term that one scan of the documents serves, and that are sent to every executor.
BLOCK_TERMS = 200_000
#: Items and documents of a tile, and columns of one product.
ITEMS, DOCS, COLUMNS = 64, 512, 4_096
#: No impact is larger: 1000000000 * tf div (1000 * tf + 8 * m) with m of 10 or more.
LARGEST_IMPACT = 1_000_000
EXACT = 2**53


def terms_of(text: Column) -> Column:
    """The different terms of a text, natively."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


@dataclass
class Items:
    """A block of items: their terms by number, and for each item the numbers of its terms."""

    terms: list[bytes]
    of_item: list[np.ndarray]
    weights: np.ndarray | None = None
    documents: int = 0
    length: int = 0

    def tiles(self) -> list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
        """For each tile its first item and its slices: the column of every term (-1: none), and term weights by item.

        A slice has so few columns that no sum of weights times impacts reaches 2**53.
        """
        if not hasattr(self, "_tiles"):
            heaviest = int(self.weights.max(initial=0))
            width = min(COLUMNS, (EXACT - 1) // (max(heaviest, 1) * LARGEST_IMPACT))
            self._tiles = []
            for first in range(0, len(self.of_item), ITEMS):
                of_item = self.of_item[first : first + ITEMS]
                used, slices = np.unique(np.concatenate(of_item)), []
                for at in range(0, len(used), width):
                    column = np.full(len(self.terms), -1)
                    column[used[at : at + width]] = np.arange(len(used[at : at + width]))
                    table = np.zeros((len(used[at : at + width]), len(of_item)))
                    for i, own in enumerate(of_item):
                        inside = own[column[own] >= 0]
                        table[column[inside], i] = self.weights[inside]
                    slices.append((column, table))
                self._tiles.append((first, slices))
        return self._tiles

    def impacts(self, lengths: np.ndarray, owner: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Impact of each entry (a term ``times`` times in document ``owner``)."""
        # A product of two counts of the corpus may not fit 64 bits, so it is taken in Python.
        m = np.array([10 + 90 * n * self.documents // self.length for n in lengths.tolist()], np.int64)
        return (1_000_000_000 * times) // (1_000 * times + 8 * m[owner])

    def scores(self, lengths: np.ndarray, owner: np.ndarray, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of a tile of documents, a row for each, a column for each item."""
        out = np.zeros((len(lengths), len(self.of_item)), np.int64)
        impact = self.impacts(lengths, owner, times)
        for first, slices in self.tiles():
            for column, table in slices:
                at = column[ids]
                here = at >= 0
                if here.any():
                    left = np.zeros((len(lengths), len(table)))
                    left[owner[here], at[here]] = impact[here]
                    out[:, first : first + table.shape[1]] += (left @ table).astype(np.int64)
        return out


class Best:
    """The best rows of each item so far: highest score, then smallest key, null keys last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, no key, key

    def add(self, scores: np.ndarray, no_key: np.ndarray, keys: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)  # ties with the last row stay in
        new = item, scores[doc, item], no_key[doc], keys[doc]
        item, score, none, key = (np.concatenate(x) for x in zip(self.rows, new))
        order = np.lexsort((key, none, -score, item))
        heads = np.searchsorted(item[order], np.arange(len(self.least)))
        place = np.arange(len(order)) - heads[item[order]]
        self.rows = [x[order][place < self.k] for x in (item, score, none, key)]
        item, score = self.rows[:2]
        last = np.flatnonzero(np.bincount(item, minlength=len(self.least)) == self.k)
        self.least[last] = score[np.searchsorted(item, last, "right") - 1]


def entries(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each text with repeats, and text, number and times of every known term in it."""
    data, bounds = bytes_of(texts)
    data = lower_ascii()[data]
    w = words_of(data, bounds, NO_TERM)
    ends = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    runs = pa.Array.from_buffers(
        pa.large_binary(), len(w.starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[~NO_TERM[data]])]
    )
    number = pc.fill_null(pc.index_in(runs, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = number >= 0
    pair, times = np.unique(w.doc[known] * max(len(terms), 1) + number[known], return_counts=True)
    return w.counts, pair // max(len(terms), 1), pair % max(len(terms), 1), times


def forward_index(docs: DataFrame, terms: list[bytes], key: str, text: str) -> DataFrame:
    """Key, number of terms, and numbers and counts of the known terms of every document, stored."""
    shipped = docs.sparkSession.sparkContext.broadcast((terms,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made_once(shipped, lambda terms: pa.array(terms, pa.large_binary()))
        for batch in batches:
            at = 0
            for piece in pieces(batch.column("text")):
                n, owner, ids, times = entries(piece, known)
                cuts = pa.array(np.searchsorted(owner, np.arange(len(piece) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, kind)) for x, kind in ((ids, pa.int32()), (times, pa.int64()))]
                keys = batch.column("key").slice(at, len(piece))
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), *lists], ["key", "n", "ids", "times"])
                at += len(piece)

    read = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return stored(read.mapInArrow(run, "key bigint, n bigint, ids array<int>, times array<bigint>"), "forward-index")


def best_of_tasks(index: DataFrame, items: Items, k: int) -> DataFrame:
    """For each task the best rows of every item: ``item`` (its number), ``score``, ``key``."""
    shipped = index.sparkSession.sparkContext.broadcast((items.terms, items.of_item, items.weights, items.documents, items.length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = made_once(shipped, Items)
        best = Best(len(own.of_item), k)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                some = batch.slice(at, DOCS)
                ids = some.column("ids")
                cuts = ids.offsets.to_numpy()
                owner = np.repeat(np.arange(len(ids)), np.diff(cuts))
                keys, n = some.column("key"), some.column("n").to_numpy(zero_copy_only=False)
                numbers, times = ids.flatten().to_numpy(), some.column("times").flatten().to_numpy()
                no_key = keys.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                best.add(own.scores(n, owner, numbers, times), no_key, pc.fill_null(keys, 0).to_numpy(zero_copy_only=False))
        item, score, none, key = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(key, pa.int64(), mask=none > 0)], ["item", "score", "key"]
        )

    # Documents without a known term have no score.
    return index.filter("size(ids) > 0").mapInArrow(run, "item bigint, score bigint, key bigint")


def weights_of(documents: int, holders: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holders.tolist()], np.int64)


def ranked_block(docs: DataFrame, wanted: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """Best rows of the tasks for one block of items: ``item``, ``score``, ``key``."""
    spark = docs.sparkSession
    of_item: dict[int | None, list[bytes]] = {}
    for item, term in wanted.collect():
        of_item.setdefault(item, []).append(term.encode())
    names = sorted(of_item, key=lambda x: (x is None, x))
    terms = sorted({t for own in of_item.values() for t in own})
    number = {t: i for i, t in enumerate(terms)}
    index = forward_index(docs, terms, key, text)
    documents, length = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    holders = np.zeros(len(terms), np.int64)
    for i, df in index.select(F.explode("ids").alias("i")).groupBy("i").count().collect():
        holders[i] = df
    numbers = [np.array(sorted(number[t] for t in of_item[x]), np.int64) for x in names]
    items = Items(terms, numbers, weights_of(documents, holders), documents, length or 0)
    told = spark.createDataFrame(list(enumerate(names)), "item bigint, name bigint")
    return best_of_tasks(index, items, k).join(F.broadcast(told), "item").select(F.col("name").alias("item"), "score", "key")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """The ``k`` documents of highest score for each item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Terms are runs of ASCII letters and digits and of all that is not ASCII, A-Z lower-cased. A term
    that occurs ``tf`` times in a document of ``n`` terms adds its weight ``floor(1000 * ln((2 * N + 2) /
    (2 * df + 1)))`` times ``(1000000000 * tf) div (1000 * tf + 8 * m)``, ``m`` being ``10 + (90 * n * N) div L``;
    only scores above 0 count. Equal scores are ranked by key, null keys last.

    Null and empty texts have no term: such documents and items give no rows. Rows of one item id (null is
    an id) are one item with the terms of all. Each row of ``docs`` counts and is ranked, repeated ones too.
    Keys are bigint. Empty tables give no rows; other columns are not read.

    Items are dealt into blocks by hash of their id, about ``block_terms`` terms each: the terms of a block
    reach the driver and every executor, and each block reads the documents once.
    """
    wanted = stored(
        items.select(F.col(item).cast("bigint").alias("item"), F.explode(terms_of(F.col(text))).alias("term")).distinct(),
        "item-terms",
    )
    blocks = max(1, -(-wanted.count() // block_terms))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    found = [ranked_block(docs, wanted.filter(block == b), k, key, text) for b in range(blocks)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)

    def place(*by: str | Column) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("key")))

    # The rows of many tasks for one item meet in several groups before they meet in one.
    part = F.pmod(F.xxhash64("key", "score"), F.lit(64))
    some = rows.withColumn("part", part).withColumn("rank", place("item", "part")).filter(F.col("rank") <= k)
    best = some.withColumn("rank", place("item")).filter(F.col("rank") <= k)
    return best.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").alias(key), "score")
