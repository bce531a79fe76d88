"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are dealt to a few symbols. Words one edit apart have reduced words that are equal or
one edit apart, so the one-edit neighbourhoods of the reduced words, joined to the reduced words that
exist, give every candidate; the original strings decide. The neighbourhood over few symbols is
small, and the number of symbols follows the size of the vocabulary, so that few words share a reduced word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierfeat.llm.lexical import LOWER, UPPER
from hierfeat.llm.shared import stored
from hierfeat.llm.words import mixed, powers

RUN = r"[A-Za-zÀ-ÿ]+"
#: One run in so many loses a letter.
DAMAGED = 31
LEAST_CHARS, LEAST_TIMES = 7, 2
#: A form is at least so many times as frequent.
RATIO = 10
#: Code points of words lie below this; the table of symbols has an entry for each.
POINTS = 0x100
LEAST_SYMBOLS, MOST_SYMBOLS = 4, 90
#: Words handled at once in a batch.
ROWS = 4_096


def runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row ``word`` for every run of letters: A-Z lower-cased, and damaged where its hash says so."""
    low = F.translate(F.col(text), UPPER, LOWER)
    found = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run")
    ).withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % DAMAGED == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of every word that is long and frequent enough; combined before the shuffle."""
    long = runs(docs, key, text).filter(F.length("word") >= LEAST_CHARS)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TIMES)


def alphabet(words: DataFrame) -> np.ndarray:
    """The symbol (1, 2, …) of each code point.

    So many symbols that, were all reduced words of a length equally frequent, no length would have more words than
    reduced words. Letters go, the most frequent first, to the symbol that has least. Only the number of words of each
    length and the number of words with each letter reach the driver.
    """
    lengths = words.groupBy(F.length("word").alias("length")).count().collect()
    symbols = max([LEAST_SYMBOLS, *(int(np.ceil(n ** (1 / length))) for length, n in lengths)])
    symbols = min(symbols, MOST_SYMBOLS)
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    table, load = np.ones(POINTS, np.uint64), np.zeros(symbols, np.int64)
    for letter, n in sorted(((x, n) for x, n in letters if x), key=lambda x: (-x[1], x[0])):
        least = int(load.argmin())
        table[ord(letter)] = least + 1
        load[least] += n
    return table


def digits_of(words: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words in a row, and the length of each word."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return table[points], np.array([len(w) for w in words], np.int64)


class Reduced:
    """Reduced words as numbers: digits in the smallest odd base above all of them, modulo 2**64.

    No digit is 0, so as long as numbers fit 64 bits (24 places for 5 symbols) different reduced words have different
    numbers. Longer ones could agree by chance.
    """

    def __init__(self, digits: np.ndarray, lengths: np.ndarray, symbols: int):
        base = symbols + 1 | 1
        heads = np.cumsum(lengths) - lengths
        self.digits, self.symbols, self.owner = digits, symbols, np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(digits)) - heads[self.owner]
        self.power = powers(int(lengths.max(initial=0)) + 1, np.uint64(base))[place] if len(place) else np.zeros(0, np.uint64)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digits * self.power, dtype=np.uint64)])
        self.heads, self.unit = heads, np.uint64(pow(base, -1, 1 << 64))
        self.values = self.total[heads + lengths] - self.total[heads]

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Word and number of what one deleted or replaced symbol makes.

        What an inserted symbol makes is left out: there the longer word has the shorter one among its deletions.
        """
        own, digits = self.values[self.owner], self.digits
        before = self.total[:-1] - self.total[self.heads][self.owner]
        # What stands behind a deleted place moves up by one.
        deleted = before + (own - before - digits * self.power) * self.unit
        # Within a run of equal symbols each deletion gives the same word.
        first = np.ones(len(digits), bool)
        first[1:] = (digits[1:] != digits[:-1]) | (self.owner[1:] != self.owner[:-1])
        owners, found = [self.owner[first]], [deleted[first]]
        for symbol in range(1, self.symbols + 1):
            other = digits != symbol
            owners.append(self.owner[other])
            found.append((own + (np.uint64(symbol) - digits) * self.power)[other])
        return np.concatenate(owners), np.concatenate(found)


def reduced(word: Column, table: np.ndarray) -> Column:
    """A 64-bit key of the reduced word."""
    symbols = int(table.max())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(mixed(Reduced(*digits_of(batch.to_pylist(), table), symbols).values).view(np.int64))

    return F.arrow_udf(run, "bigint")(word)


def neighbourhood(word: Column, table: np.ndarray) -> Column:
    """Keys of the reduced words one edit from a word's, by deletion or replacement."""
    symbols = int(table.max())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for at in range(0, len(batch), ROWS):
                some = batch.slice(at, ROWS).to_pylist()
                owner, value = Reduced(*digits_of(some, table), symbols).neighbours()
                keys.append(value[np.argsort(owner, kind="stable")])
                counts.append(np.bincount(owner, minlength=len(some)))
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(mixed(np.concatenate(keys)).view(np.int64)))

    return F.array_distinct(F.arrow_udf(run, "array<bigint>")(word))


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs ``a``, ``b`` of words that differ by exactly one edit, each pair once, with their counts ``n``, ``m``.

    Neighbourhoods are made once for each reduced word and joined to the reduced words that exist; these pairs of reduced
    words, and each with itself, are joined to the words. Joins shuffle both sides, so adaptive execution splits a
    crowded reduced word.
    """
    table = alphabet(words)
    keyed = stored(words.withColumn("key", reduced(F.col("word"), table)), "reduced-words")
    existing = keyed.groupBy("key").agg(F.min("word").alias("word"), F.count(F.lit(1)).alias("size"))
    length = F.length("word").cast("int")
    made = existing.select(F.col("key").alias("p"), length.alias("lp"), F.explode(neighbourhood(F.col("word"), table)).alias("q"))
    reached = made.join(existing.select(F.col("key").alias("q"), length.alias("lq")), "q")
    # Two reduced words of one length reach each other, so one order is enough; of two lengths the longer reaches the shorter.
    pairs = reached.filter("lp = lq AND p < q OR lp = lq + 1").select("p", "q")
    alone = existing.filter("size > 1").select(F.col("key").alias("p"), F.col("key").alias("q"))
    left = keyed.select(F.col("key").alias("p"), F.col("word").alias("a"), "n")
    right = keyed.select(F.col("key").alias("q"), F.col("word").alias("b"), F.col("n").alias("m"))
    candidates = pairs.union(alone).join(left, "p").join(right, "q").filter("p <> q OR a < b")
    return candidates.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n", "m")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all texts with their spelling variants: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are the runs of Latin letters, A-Z lower-cased, of 7 code points or more that occur twice or more; a run
    whose hash ``crc32("<doc_id>:<run>")`` 31 divides loses a letter first. ``form`` is the most frequent word one edit
    away (of equals the smallest) if it is at least ten times as frequent, else null; ``root`` is where forms lead to.
    Each row counts, repeated ones too; null and empty texts have no words; a null key is written as nothing.
    Other columns are not read; an empty table gives no rows.
    """
    words = stored(vocabulary(docs, key, text), "vocabulary")
    pairs = stored(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("m").alias("near_n")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n").alias("near_n"))
    )
    # The smallest of (-n, word) is the most frequent, and of equals the first by code point: UTF-8 sorts alike.
    most = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("most")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), most)
    enough = -F.col("most.less") >= RATIO * F.col("n")
    told = stored(
        words.join(near, "word", "left").select(
            "word",
            F.when(enough, F.col("most.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(enough, -F.col("most.less")).alias("form_n"),
        ),
        "forms",
    )
    return told.join(roots(told), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def roots(told: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words that have a form.

    Counts grow tenfold with each form, so a chain has at most one link for each decimal of the largest count.
    Each turn doubles how far a link reaches; a few turns are enough at any size.
    """
    links = told.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = told.agg(F.max("n")).first()[0] or 1
    steps = 1
    while steps < len(str(most)):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        steps *= 2
    return links
