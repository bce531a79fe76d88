"""Quality of a text from its bytes: a small convolutional network in numpy.

A text is cut into chunks that overlap by one byte less than a filter is wide, so every run of bytes that a filter can
see lies in exactly one chunk and the chunks cover the whole text. Bytes are embedded, filters slide over each chunk, and
each filter's largest answer stays. Over the chunks of a text the largest answer and the mean answer of each filter go
into one logistic unit.

Embedding, filters and unit are learned by gradient descent on a bounded sample of labelled texts. The sample is dealt into
shards; in each round every shard goes on from the same weights over its own texts, in a task of its own, and the weights
that come back are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierfeat.llm.shared import made_once, stored
from hierfeat.llm.words import bytes_of, pieces

#: Numbers per byte, bytes a filter sees, filters, places in a chunk.
EMBEDDING, WIDTH, FILTERS, CHUNK = 8, 6, 24, 256
#: Labelled texts of each class that the network is trained on, at most; the smallest by hash of their key.
PER_CLASS = 1_500
#: Texts of a shard, at least, and shards, at most; rounds; texts of a step, steps of a round at least; step size.
SHARD_TEXTS, SHARDS, ROUNDS, BATCH, STEPS, RATE = 250, 8, 8, 16, 24, 0.01
THRESHOLD = 0.3
#: Chunks whose answers are held at once.
CHUNKS = 256


@dataclass
class Network:
    """Weights: bytes by numbers, places by numbers by filters, bias of filters, unit on both poolings, its bias."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    unit: np.ndarray
    offset: np.ndarray

    @staticmethod
    def fresh(seed: int = 1) -> Network:
        draw = np.random.default_rng(seed)
        return Network(
            draw.normal(0, 0.5, (256, EMBEDDING)),
            draw.normal(0, 1 / np.sqrt(WIDTH * EMBEDDING), (WIDTH, EMBEDDING, FILTERS)),
            np.zeros(FILTERS),
            draw.normal(0, 0.1, (2, FILTERS)),
            np.zeros(1),
        )

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        shapes, at, found = [x.shape for x in Network.fresh().parts()], 0, []
        for shape in shapes:
            n = int(np.prod(shape))
            found.append(np.array(flat[at : at + n], float).reshape(shape))
            at += n
        return Network(*found)

    def tables(self) -> list[np.ndarray]:
        """For each place of a filter, what every byte there adds to the answers."""
        return [(self.embedding @ f).astype(np.float32) for f in self.filters]

    def logits(self, most: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return most @ self.unit[0] + mean @ self.unit[1] + self.offset[0]


@dataclass
class Chunks:
    """Chunks of texts: ``CHUNK`` places and the bytes that follow, text of each, and how many places it has."""

    data: np.ndarray
    doc: np.ndarray
    places: np.ndarray
    texts: int


def chunks_of(data: np.ndarray, bounds: np.ndarray) -> Chunks:
    """A text of n bytes has n - ``WIDTH`` + 1 places, a shorter one has one; missing bytes are 0."""
    places = np.maximum(np.diff(bounds) - WIDTH + 1, 1)
    counts = -(-places // CHUNK)
    doc = np.repeat(np.arange(len(places)), counts)
    number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (bounds[:-1][doc] + number * CHUNK)[:, None] + np.arange(CHUNK + WIDTH - 1)
    inside = at < bounds[1:][doc][:, None]
    padded = np.append(data, np.uint8(0))
    return Chunks(padded[np.where(inside, at, len(data))], doc, np.minimum(places[doc] - number * CHUNK, CHUNK), len(places))


def answers(data: np.ndarray, places: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Answers of all filters at all places of some chunks; minus infinity behind the last place."""
    total = tables[0][data[:, :CHUNK]]
    for k in range(1, WIDTH):
        total += tables[k][data[:, k : k + CHUNK]]
    total += bias.astype(np.float32)
    short = places < CHUNK
    if short.any():
        total[np.nonzero(short)[0][:, None, None], np.arange(CHUNK)[None, :, None], np.arange(FILTERS)] += np.where(
            np.arange(CHUNK) < places[short][:, None], 0, -np.inf
        )[:, :, None].astype(np.float32)
    return total


def pooled(peaks: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest and mean answers of each text over its chunks, and the number of chunks. Chunks of a text lie together."""
    counts = np.bincount(doc, minlength=texts)
    heads = np.cumsum(counts) - counts
    return np.maximum.reduceat(peaks, heads), np.add.reduceat(peaks, heads) / counts[:, None], counts


class Scorer:
    """A network ready to score; kept by a Python worker."""

    def __init__(self, flat: np.ndarray):
        self.network = Network.of(flat)
        self.tables = self.network.tables()

    def scores(self, texts: pa.Array) -> np.ndarray:
        c = chunks_of(*bytes_of(texts))
        peaks = np.concatenate(
            [
                np.maximum(answers(c.data[i : i + CHUNKS], c.places[i : i + CHUNKS], self.tables, self.network.bias).max(axis=1), 0)
                for i in range(0, len(c.doc), CHUNKS)
            ]
        ).astype(float)
        most, mean, _ = pooled(peaks, c.doc, c.texts)
        return 1 / (1 + np.exp(-np.clip(self.network.logits(most, mean), -500, 500)))


def gradients(network: Network, c: Chunks, label: np.ndarray, weight: np.ndarray) -> Network:
    """Gradient of the mean weighted log loss over some texts."""
    tables, peaks, where = network.tables(), [], []
    for i in range(0, len(c.doc), CHUNKS):
        total = answers(c.data[i : i + CHUNKS], c.places[i : i + CHUNKS], tables, network.bias)
        best = total.argmax(axis=1)
        where.append(best)
        peaks.append(np.take_along_axis(total, best[:, None, :], 1)[:, 0])
    where, raw = np.concatenate(where), np.concatenate(peaks).astype(float)
    peaks = np.maximum(raw, 0)
    most, mean, counts = pooled(peaks, c.doc, c.texts)
    slope = (1 / (1 + np.exp(-np.clip(network.logits(most, mean), -500, 500))) - label) * weight / len(label)
    unit = np.stack([slope @ most, slope @ mean])
    # The largest answer sends its slope back to its first chunk, the mean to all of them.
    top = peaks == most[c.doc]
    before = np.cumsum(top, axis=0) - top
    heads = np.cumsum(counts) - counts
    first = top & (before == before[heads][c.doc])
    back = slope[c.doc][:, None] * (first * network.unit[0] + network.unit[1] / counts[c.doc][:, None])
    back = np.where(raw > 0, back, 0)
    embedding, filters = np.zeros_like(network.embedding), np.zeros_like(network.filters)
    rows = np.arange(len(c.doc))[:, None]
    for k in range(WIDTH):
        seen = c.data[rows, where + k]
        by_byte = np.zeros((256, FILTERS))
        np.add.at(by_byte, (seen, np.arange(FILTERS)[None, :]), back)
        filters[k] = network.embedding.T @ by_byte
        embedding += by_byte @ network.filters[k].T
    return Network(embedding, filters, back.sum(axis=0), unit, np.array([slope.sum()]))


def trained(flat: np.ndarray, texts: pa.Array, label: np.ndarray, weight: np.ndarray, turn: int) -> np.ndarray:
    """Passes over the texts of a shard in small batches (Adam: two running means of the gradient)."""
    flat, one, two, step = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0
    draw, rate = np.random.default_rng(turn), RATE / (1 + turn / 2)
    while step < STEPS:
        order = draw.permutation(len(label))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            c = chunks_of(*bytes_of(texts.take(pa.array(some))))
            slope, step = gradients(Network.of(flat), c, label[some], weight[some]).flat(), step + 1
            one, two = 0.9 * one + 0.1 * slope, 0.99 * two + 0.01 * slope**2
            flat -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
    return flat


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int) -> DataFrame:
    """``_key``, ``text``, ``label`` of the sample: at most ``per_class`` texts of each class that are not held out.

    Only keys are ranked; they are bounded, so they are sent to the documents.
    """
    own = F.col("_key")
    taught = (
        labels.select(F.col("doc_id").alias("_key"), F.col(label).cast("int").alias("label"))
        .filter(own.isNotNull() & F.col("label").isin(0, 1) & ~held_out(own))
        .groupBy("_key")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .filter("label = most")
    )
    of_class = [taught.filter(F.col("label") == x).orderBy(F.xxhash64("_key"), "_key").limit(per_class) for x in (0, 1)]
    chosen = of_class[0].union(of_class[1]).select("_key", "label")
    rows = docs.select(F.col(key).alias("_of"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("_of") == own)
    # A key that repeats is one text, so the bound holds.
    return rows.groupBy("_key").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS
) -> Network | None:
    """Train on a sample of the labelled texts that are not held out; None without a text of each class.

    Both classes weigh the same. Every task holds one shard of the sample; only weights, some 2,000 numbers a shard, reach
    the driver.
    """
    spark = docs.sparkSession
    sample = stored(training_texts(docs, labels, key, text, label, per_class), "training-texts")
    sizes = dict(sample.groupBy("label").count().collect())
    if len(sizes) < 2:
        return None
    total = sum(sizes.values())
    weight = F.lit(total / 2) / F.when(F.col("label") == 1, sizes[1]).otherwise(sizes[0])
    shards = max(1, min(SHARDS, total // SHARD_TEXTS))
    dealt = sample.select("_key", "text", F.col("label").cast("double"), weight.alias("weight"), F.pmod(F.hash("_key"), F.lit(shards)).alias("shard"))
    flat = Network.fresh().flat()
    for turn in range(ROUNDS):
        shipped = spark.sparkContext.broadcast((flat, turn))

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("_key").combine_chunks()
            start, now = shipped.value
            texts = next(pieces(table.column("text").chunk(0), 1 << 62))
            found = trained(start, texts, table.column("label").to_numpy(), table.column("weight").to_numpy(), now)
            return pa.table({"shard": table.column("shard").slice(0, 1), "weights": [found.tolist()], "rows": [len(table)]})

        back = dealt.groupBy("shard").applyInArrow(run, "shard int, weights array<double>, rows bigint").collect()
        back.sort(key=lambda r: r["shard"])  # the sum does not depend on which task ends first
        flat = sum(r["rows"] * np.array(r["weights"]) for r in back) / total
    return Network.of(flat)


def score(text: Column, network: Network, docs: DataFrame) -> Column:
    """Probability that a text is of the better class; null is empty."""
    shipped = docs.sparkSession.sparkContext.broadcast((network.flat(),))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = made_once(shipped, Scorer)
        for batch in batches:
            found = [own.scores(piece) for piece in pieces(batch)]
            yield pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())

    return F.arrow_udf(run, "double")(text)


def scored(
    docs: DataFrame,
    labels: DataFrame,
    network: Network | None = None,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` of every document.

    One row per row of ``docs``. The score (0 to 1) looks at the whole text alone; null and empty texts are one chunk of missing
    bytes. Where no text of each class can be learned from, every score is 0.5. Rows with a null key are not
    held out and not learned from; a key labelled both ways is not learned from. Repeated rows come out as often as they
    go in, an empty table gives an empty one; other columns are not read.
    """
    network = network or fit(docs, labels, key, text)
    found = score(F.col(text), network, docs) if network else F.lit(0.5)
    return docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), found.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
