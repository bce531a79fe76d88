"""Quality rules: a likelihood ratio of trusted and raw text on hashed n-grams, and base rules.

Words and pairs of words are hashed into buckets. Two multinomials over the buckets are
counted, one on documents that labels call good, one on the whole corpus. The score of a
document is the mean over its n-grams of log p(trusted) - log p(raw); it stays if the score
reaches a fixed threshold. The threshold lies below what clean text gets at any size of the
corpus and above text whose words are mostly unlike the trusted ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hierfeat.llm.shared import fresh, made_once
from hierfeat.llm.words import SPACE, Words, bytes_of, mixed, pieces, powers, word_hashes, words_of

BUCKETS = 1 << 16
#: Documents that the trusted multinomial is counted on: good ones by label, at most so many.
TRUSTED = 20_000
SMOOTHING = 5.0
THRESHOLD = -0.2
WINDOW = 8
NO_KEY = -(2**63)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
LEAST_WORDS, MOST_REPEATED = 20, 30  # words; percent of the words
PAIR, WINDOW_STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)


def grams(hashes: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word and of every pair of neighbouring words."""
    pairs = mixed(hashes[:-1] * PAIR + hashes[1:])
    inside = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    both = np.concatenate([hashes, pairs[inside]])
    return (both % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[:-1][inside]])


@dataclass
class Ratio:
    """Counts of both multinomials, and the keys of the documents that the trusted one is counted on."""

    trusted: np.ndarray
    raw: np.ndarray
    keys: np.ndarray

    def scores(self, hashes: np.ndarray, doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Mean log likelihood ratio over the n-grams of each text.

        What a text itself adds to the counts is taken off first, so that a rare word does not
        speak against the only text that has it. Both multinomials are smoothed on the scale of
        the trusted counts: a bucket of which these say little counts for little.
        """
        buckets = len(self.raw)
        bucket, owner = grams(hashes, doc, buckets)
        pair, own = np.unique(owner * buckets + bucket, return_counts=True)
        bucket, owner = pair % buckets, pair // buckets
        scale = self.trusted.sum() / max(self.raw.sum(), 1)
        seen = self.trusted[bucket] - own * np.isin(keys, self.keys)[owner]
        expected = scale * (self.raw[bucket] - own)
        ratio = np.log((np.maximum(seen, 0) + SMOOTHING) / (np.maximum(expected, 0) + SMOOTHING))
        total = np.bincount(owner, own * ratio, len(keys))
        return total / np.maximum(np.bincount(owner, own, len(keys)), 1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> Ratio:
    """Count both multinomials in one scan: the raw one on all documents, the trusted one on those
    labelled good, at most ``TRUSTED`` of them by hash of the key.

    A key with labels of both kinds is not trusted. Without any trusted document every score
    is 0. The trusted keys and ``buckets`` numbers of each kind reach the driver.
    """
    good = (
        labels.groupBy(F.col("doc_id").alias("_good"))
        .agg(F.min("quality").alias("quality"))
        .filter("quality = 1 AND _good IS NOT NULL")
        .orderBy(F.xxhash64("_good"), "_good")
        .limit(TRUSTED)
    )
    keys = np.array([r["_good"] for r in good.select("_good").collect()], np.int64)
    shipped = docs.sparkSession.sparkContext.broadcast((keys,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            trusted = np.isin(keys_of(batch.column("key")), shipped.value[0])
            at = 0
            for piece in pieces(batch.column("text")):
                w = words_of(*bytes_of(piece))
                bucket, owner = grams(word_hashes(w), w.doc, buckets)
                counts[0] += np.bincount(bucket[trusted[at + owner]], minlength=buckets)
                counts[1] += np.bincount(bucket, minlength=buckets)
                at += len(piece)
        used = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])], ["bucket", "trusted", "raw"]
        )

    found = (
        docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
        .mapInArrow(run, "bucket bigint, trusted bigint, raw bigint")
        .groupBy("bucket")
        .agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw"))
        .collect()
    )
    trusted, raw = np.zeros(buckets), np.zeros(buckets)
    for bucket, t, r in found:
        trusted[bucket], raw[bucket] = t, r
    return Ratio(trusted, raw, keys)


def keys_of(column: pa.Array) -> np.ndarray:
    """Keys as numbers; null is one that no label has."""
    return pc.fill_null(column, NO_KEY).to_numpy(zero_copy_only=False)


def repeated_words(w: Words, hashes: np.ndarray, texts: int) -> np.ndarray:
    """Words of each text that lie in a window which the text holds twice or more."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(texts, np.int64)
    factor = powers(WINDOW, WINDOW_STEP)
    window = sum(hashes[i : n + i] * factor[i] for i in range(WINDOW))
    start = np.flatnonzero(w.doc[:n] == w.doc[WINDOW - 1 :])
    # The text goes into the value, so equal values mean equal windows of one text.
    value = mixed(window[start] + mixed(w.doc[start].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = start[order[again]]
    cover = np.bincount(hit, minlength=len(hashes) + 1) - np.bincount(hit + WINDOW, minlength=len(hashes) + 1)
    return np.bincount(w.doc[np.cumsum(cover)[:-1] > 0], minlength=texts)


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(key: Column, text: Column, ratio: Ratio, spark: SparkSession) -> Column:
    """The base measures and the score of a text, as a struct."""
    shipped = spark.sparkContext.broadcast((ratio.trusted, ratio.raw, ratio.keys))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = made_once(shipped, Ratio)
        for keys, texts in batches:
            found, at, keys = [[] for _ in range(6)], 0, keys_of(keys)
            for piece in pieces(texts):
                data, bounds = bytes_of(piece)
                w = words_of(data, bounds)
                hashes = word_hashes(w)

                def per_text(flag: np.ndarray) -> np.ndarray:
                    total = np.concatenate([[0], np.cumsum(flag)])
                    return total[bounds[1:]] - total[bounds[:-1]]

                found[0].append(w.counts)
                found[1].append(per_text(((data & 0xC0) != 0x80) & ~SPACE[data]))
                found[2].append(per_text(SYMBOLS[data]))
                found[3].append(np.array([repeated_lines(t) for t in piece.to_pylist()], np.int64))
                found[4].append(repeated_words(w, hashes, len(piece)))
                found[5].append(own.scores(hashes, w.doc, keys[at : at + len(piece)]))
                at += len(piece)
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in found[:5]]
            columns.append(pa.array(np.concatenate([np.zeros(0), *found[5]]), pa.float64()))
            yield pa.StructArray.from_arrays(columns, [*MEASURES, "score"])

    kind = ", ".join(f"{m}: bigint" for m in MEASURES)
    return F.arrow_udf(run, f"struct<{kind}, score: double>")(key.cast("bigint"), text)


def failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def judged(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Measures and verdict of every document.

    One row per row of ``docs``: the key, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``, ``score``. Null texts have no words; a text without
    words has score 0 and fails the base rules. Repeated rows are judged alike, and each counts
    in the raw multinomial. An empty table gives an empty result. Other columns are not read.
    """
    ratio = fit(docs, labels, key, text)
    m = F.col("m")
    return docs.select(F.col(key), measured(F.col(key), F.col(text), ratio, docs.sparkSession).alias("m")).select(
        key,
        *[m[c].alias(c) for c in MEASURES],
        failed(m).alias("base_failed"),
        (~failed(m) & (m["score"] >= threshold)).alias("kept"),
        m["score"].alias("score"),
    )


def good_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; no shuffle of texts."""
    (m,) = fresh(docs, "measures")
    ratio = fit(docs, labels, key, text)
    found = docs.withColumn(m, measured(F.col(key), F.col(text), ratio, docs.sparkSession))
    return found.filter(~failed(F.col(m)) & (F.col(m)["score"] >= threshold)).select(*docs.columns)
