"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier on hashed character n-grams
tells the languages whose bit is 1 from the others; its margin is scaled so that an average
text of a language scores about one. Decoding sums, for each language, the losses of the
margins against its codeword, weighted by how often each classifier is right on that language,
and takes the smallest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierfeat.llm.shared import made_once
from hierfeat.llm.words import mixed, pieces

BUCKETS = 1 << 14
LENGTHS = (1, 2, 3)
SMOOTHING = 0.5
#: Texts counted at once; bounds the table of texts by buckets.
ROWS = 64
#: Characters of a text counted at once.
STRETCH = 1 << 20
#: A best language whose share of the decoding is below this is ambiguous.
CLEAR = 0.6
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(letter_table())
    return _letters[0]


def ngrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every character n-gram with a letter, and the number of letters per text.

    Case is folded; whatever is not a letter counts as a space. N-grams do not cross texts.
    """
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = letters()[points]
    value = np.where(letter, points, 0).astype(np.uint64)
    found, owners = [], []
    for n in LENGTHS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        inside = owner[:m] == owner[n - 1 :]
        some = np.logical_or.reduce([letter[i : m + i] for i in range(n)])
        code = np.full(m, n, np.uint64)
        for i in range(n):
            code = code * np.uint64(0x10FFFF + 2) + value[i : m + i]
        keep = inside & some
        found.append((mixed(code[keep]) % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[:m][keep])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    return np.concatenate(found), np.concatenate(owners), np.bincount(owner, letter, len(texts)).astype(np.int64)


def counted(texts: list[str], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """N-gram counts of ``ROWS`` texts at a time: first row, table, letters.

    Long texts are counted a stretch at a time; n-grams do not cross stretches.
    """
    for at in range(0, len(texts), ROWS):
        some = texts[at : at + ROWS]
        total, letters_ = np.zeros(len(some) * buckets), np.zeros(len(some), np.int64)
        for start in range(0, max(1, max(map(len, some))), STRETCH):
            bucket, owner, n = ngrams([t[start : start + STRETCH] for t in some], buckets)
            total += np.bincount(owner * buckets + bucket, minlength=len(total))
            letters_ += n
        yield at, total.reshape(len(some), buckets), letters_


def codewords(classes: int) -> np.ndarray:
    """A row of ±1 for each class.

    Up to five classes take all ways to part them in two. For more, random codes of about
    15 log2(classes) bits are drawn with a fixed seed and the one with the largest least
    distance is taken.
    """
    if classes <= 1:
        return np.ones((classes, 0))
    if classes <= 5:
        width = 2 ** (classes - 1) - 1
        # The first class has only ones; the others run through all numbers but "all ones".
        return np.array([[1] * width] + [[1 if j >> k & 1 else -1 for j in range(width)] for k in range(classes - 1)], float)
    draw, width, best, least = np.random.default_rng(0), math.ceil(15 * math.log2(classes)), None, -1
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], (classes, width))
        if (np.abs(code.sum(axis=0)) == classes).any():
            continue
        apart = (width - code @ code.T) / 2
        distance = apart[~np.eye(classes, dtype=bool)].min()
        if distance > least:
            best, least = code, distance
    return best


@dataclass
class Model:
    """Languages, their codewords, weights of the classifiers, weight of each bit for each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    @staticmethod
    def of(counts: dict[str, np.ndarray]) -> Model:
        languages = sorted(counts)
        code = codewords(len(languages))
        if not code.shape[1]:
            return Model(languages, code, np.zeros((BUCKETS, 0)), np.zeros(code.shape))
        share = np.array([counts[x] + SMOOTHING for x in languages])
        share /= share.sum(axis=1, keepdims=True)
        one, zero = (code > 0).astype(float), (code < 0).astype(float)
        weights = np.log((one.T @ share) / one.sum(axis=0)[:, None]) - np.log((zero.T @ share) / zero.sum(axis=0)[:, None])
        # Mean margin of a language's own n-grams, on the side where it should be.
        own = (share @ weights.T) * code
        scale = np.maximum(own, 0).mean(axis=0)
        weights = weights / np.maximum(scale, 1e-9)[:, None]
        return Model(languages, code, weights.T, np.full(code.shape, 1 / code.shape[1]))

    def margins(self, table: np.ndarray) -> np.ndarray:
        return table @ self.weights / np.maximum(table.sum(axis=1, keepdims=True), 1)

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """Share of each language: losses turned into weights that add up to one."""
        if not self.code.shape[1]:
            return np.ones((len(margins), len(self.languages)))
        losses = np.logaddexp(0, -4 * margins[:, None, :] * self.code[None])
        total = (losses * self.trust[None]).sum(axis=2)
        best = total.min(axis=1, keepdims=True)
        share = np.exp(-2 * (total - best))
        return share / share.sum(axis=1, keepdims=True)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", buckets: int = BUCKETS) -> Model:
    """Learn from the rows with a label and a key that are not held out.

    One scan counts the n-grams of every language, a second one tells how often each classifier
    is right on each language. Languages times ``buckets`` counts reach the driver.
    """
    taught = docs.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(
        F.col(label).cast("string").alias("label"), F.col(text).alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, at = batch.column("label").to_pylist(), 0
            for piece in pieces(batch.column("text")):
                for first, table, _ in counted(piece.to_pylist(), buckets):
                    own = np.array(names[at + first : at + first + len(table)])
                    for name in set(own.tolist()):
                        sums[name] = sums.get(name, 0) + table[own == name].sum(axis=0)
                at += len(piece)
        for name, total in sums.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(total[used])], ["label", "bucket", "n"]
            )

    counts: dict[str, np.ndarray] = {}
    found = taught.mapInArrow(count, "label string, bucket bigint, n double").groupBy("label", "bucket").agg(F.sum("n"))
    for name, bucket, n in found.collect():
        counts.setdefault(name, np.zeros(buckets))[bucket] = n
    model = Model.of(counts)
    if model.code.shape[1]:
        model.trust = trust_of(taught, model, buckets)
    return model


def trust_of(taught: DataFrame, model: Model, buckets: int) -> np.ndarray:
    """For each language, how often each classifier is right on it; rows add up to one."""
    shipped = docs_broadcast(taught, model)
    place = {x: i for i, x in enumerate(model.languages)}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, right = made_once(shipped, Model), np.zeros(model_shape)
        for batch in batches:
            row, at = np.array([place.get(x, 0) for x in batch.column("label").to_pylist()]), 0
            for piece in pieces(batch.column("text")):
                for first, table, n in counted(piece.to_pylist(), buckets):
                    side = row[at + first : at + first + len(table)]
                    hit = (own.margins(table) * own.code[side] > 0) & (n > 0)[:, None]
                    np.add.at(right, side, hit)
                at += len(piece)
        for i, values in enumerate(right):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(values)), pa.array(range(len(values))), pa.array(values)], ["row", "bit", "n"]
            )

    model_shape = model.code.shape
    trust = np.full(model_shape, 1e-6)
    for row, bit, n in taught.mapInArrow(judge, "row bigint, bit bigint, n double").groupBy("row", "bit").agg(F.sum("n")).collect():
        trust[row, bit] += n
    return trust / trust.sum(axis=1, keepdims=True)


def docs_broadcast(df: DataFrame, model: Model):
    return df.sparkSession.sparkContext.broadcast((model.languages, model.code, model.weights, model.trust))


def identified(
    docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", label: str = "lang"
) -> DataFrame:
    """The language of every whole text.

    One row per row of ``docs``: the key, ``held_out``, ``lang_pred``, ``score`` (0 to 1, the share of
    the best language in the decoding), ``ambiguous``. Without a letter, or a null text, the
    language is ``und`` with score 0; so it is where nothing could be learned. Ties go to the
    language first by name. Predictions look at the text alone. Rows without a key are not held
    out and not learned from. Repeated rows come out as often as they go in, an empty table gives
    an empty one; other columns are not read.
    """
    shipped = docs_broadcast(docs, model or fit(docs, key, text, label))
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = made_once(shipped, Model)
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            for piece in pieces(batch):
                for _, table, n in counted(piece.to_pylist(), BUCKETS):
                    if not own.languages:
                        names += [UNKNOWN] * len(table)
                        scores += [0.0] * len(table)
                        continue
                    share = own.decode(own.margins(table))
                    best = share.argmax(axis=1)
                    names += [own.languages[b] if k else UNKNOWN for b, k in zip(best, n)]
                    scores += np.where(n > 0, share.max(axis=1), 0.0).tolist()
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    found = F.arrow_udf(run, "struct<lang_pred: string, score: double>")
    return docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), found(F.col(text)).alias("f")).select(
        key,
        "held_out",
        "f.lang_pred",
        "f.score",
        ((F.col("f.score") < CLEAR) & (F.col("f.lang_pred") != UNKNOWN)).alias("ambiguous"),
    )
