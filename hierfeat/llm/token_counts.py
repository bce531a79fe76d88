"""Token counts of documents without token ids.

The tokenizer cuts a text into pre-tokens and encodes each on its own, so the count of a
text is a sum over its pre-tokens. Pre-tokens repeat a lot: each distinct one is encoded
once, and its count is joined to the frequencies in every document.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierfeat.llm.shared import made_once, stored
from hierfeat.llm.words import pieces

#: Rows read to choose the frequent pre-tokens, and how many of these are sent to every
#: executor (some MB). Both only choose the way a count travels, not its value.
SAMPLE_ROWS = 8_000
FREQUENT = 300_000
FREQUENT_CHARS = 32
#: Long texts are cut into parts of about so many characters before they are taken apart.
PART_CHARS = 1 << 16
SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
LATIN_END = 0x250
LATIN = re.compile(f"[\0-{chr(LATIN_END - 1)}]*")
COUNTED = pa.struct(
    [
        ("n_bytes", pa.int64()),
        ("known", pa.int64()),
        ("rare", pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())]))),
    ]
)


def latin_pattern(pre_tokenizer) -> re.Pattern:
    """The byte-level pattern for Latin characters, their classes asked of the library.

    A character that the library leaves in one piece with a letter is a letter, and so on.
    """
    classes = []
    for known in "a1!":
        joined = [c for c in map(chr, range(LATIN_END)) if len(pre_tokenizer.pre_tokenize_str(known + c)) == 1]
        classes.append("".join(map(re.escape, joined)))
    letter, number, other = classes
    space = "".join(re.escape(c) for c in map(chr, range(LATIN_END)) if not any(re.escape(c) in x for x in classes))
    return re.compile(
        f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[{other}]+|[{space}]+(?![{letter}{number}{other}])|[{space}]+"
    )


class Pieces:
    """A tokenizer file, opened once in a Python worker."""

    def __init__(self, definition: str, frequent: dict[str, int] | None = None):
        self.definition = definition
        self.frequent = frequent or {}

    @property
    def tokenizer(self):
        if not hasattr(self, "_tokenizer"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_str(self.definition)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
        return self._tokenizer

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """How often each pre-token occurs, and how many added tokens the text holds.

        Added tokens (such as special strings) are taken out first, leftmost and longest
        first as the library does; what lies between them is cut into pre-tokens.
        """
        if not hasattr(self, "_added"):
            added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
            self._added = re.compile("|".join(map(re.escape, added))) if added else None
        between = self._added.split(text) if self._added else [text]
        counts: Counter = Counter()
        for span in between:
            for part in self.parts(span):
                counts.update(self.cut(part))
        return counts, len(between) - 1

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text.

        The library's own cutting is slow. Where it goes by the byte-level pattern and all characters
        are Latin, an expression with the library's classes of these characters gives the same.
        """
        if not hasattr(self, "_latin"):
            kind = json.loads(self.tokenizer.pre_tokenizer.__getstate__())
            plain = kind == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            self._latin = latin_pattern(self.tokenizer.pre_tokenizer) if plain else None
        if self._latin and LATIN.fullmatch(text):
            return self._latin.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[str]:
        """Cut a long text before spaces between ASCII letters, if pre-tokens always start there."""
        start, letters = 0, self.tokenizer.pre_tokenizer.pre_tokenize_str("a b")
        starts_at_space = [span for _, span in letters] == [(0, 1), (1, 3)]
        while starts_at_space and len(text) - start > PART_CHARS:
            found = SAFE_CUT.search(text, start + PART_CHARS)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        if start < len(text):
            yield text[start:]

    def counts(self, pre_tokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pre_tokens, add_special_tokens=False)]


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 1024,
    key: str = "doc_id",
    text: str = "text",
    frequent: int = FREQUENT,
) -> DataFrame:
    """Count the tokens of every whole text.

    ``tokenizer`` is the JSON of a tokenizer without normalizer or post-processing whose
    pre-tokens are encoded apart; anything else is an error.

    One row per row of ``docs``: the key, ``n_bytes``, ``n_tokens``, ``over_limit``. A null or
    empty text has no bytes and no tokens. Repeated rows, also with equal keys, come out as
    often as they go in. Other columns are not read, so their names do not matter.
    """
    spark = docs.sparkSession
    own = Pieces(tokenizer)
    check_supported(own)
    if frequent:
        own = Pieces(tokenizer, frequent_counts(docs, own, key, text, frequent))
    shipped = spark.sparkContext.broadcast((own.definition, own.frequent))

    # A first entry without a piece carries the values of the document itself.
    no_piece = F.struct(F.lit(None).cast("string").alias("piece"), F.lit(0).cast("bigint").alias("times"))
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), cut_column(shipped, text).alias("f")
    )
    # Numbers are given before the rows are multiplied.
    cut = numbered.select(
        "row", "key", "f.n_bytes", "f.known", F.explode(F.concat(F.array(no_piece), F.col("f.rare"))).alias("r")
    )
    rows = stored(
        cut.select(
            "row",
            *[F.when(F.col("r.piece").isNull(), F.col(c)).alias(c) for c in ("key", "n_bytes", "known")],
            "r.piece",
            "r.times",
        ),
        "token-counts",
    )
    documents = rows.filter("piece IS NULL").select("row", "key", "n_bytes", F.col("known").alias("n"))
    rare = rows.filter("piece IS NOT NULL").select("row", "piece", "times")
    counts = rare.select("piece").distinct().withColumn("count", count_column(shipped, "piece"))
    summed = rare.join(counts, "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("count")).alias("rest"))
    return documents.join(summed, "row", "left").select(
        F.col("key").alias(key),
        "n_bytes",
        (F.col("n") + F.coalesce("rest", F.lit(0))).alias("n_tokens"),
        (F.col("n") + F.coalesce("rest", F.lit(0)) > limit).alias("over_limit"),
    )


def cut_column(shipped: Broadcast[tuple], text: str) -> Column:
    """Bytes of a text, tokens of its frequent pre-tokens, and how often each other one occurs."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = made_once(shipped, Pieces)
        for batch in batches:
            found = []
            for part in pieces(batch):
                for t in part.to_pylist():
                    times, known = own.frequencies(t)
                    rare = []
                    for piece, n in times.items():
                        count = own.frequent.get(piece)
                        if count is None:
                            rare.append((piece, n))
                        else:
                            known += count * n
                    found.append((len(t.encode()), known, rare))
            yield pa.array(found, COUNTED)

    return F.arrow_udf(run, "struct<n_bytes: bigint, known: bigint, rare: array<struct<piece: string, times: bigint>>>")(
        F.col(text)
    )


def count_column(shipped: Broadcast[tuple], piece: str) -> Column:
    """Tokens of one pre-token."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = made_once(shipped, Pieces)
        for batch in batches:
            yield pa.array(own.counts(batch.to_pylist()), pa.int64())

    return F.arrow_udf(run, "bigint")(F.col(piece))


def check_supported(own: Pieces) -> None:
    t = own.tokenizer
    if t.normalizer is not None or t.post_processor is not None or t.pre_tokenizer is None:
        raise ValueError("the tokenizer must cut texts into pre-tokens and change nothing else")
    if any(a.lstrip or a.rstrip or a.single_word or a.normalized for a in t.get_added_tokens_decoder().values()):
        raise ValueError("added tokens must stand for their exact strings")


def frequent_counts(docs: DataFrame, own: Pieces, key: str, text: str, most: int) -> dict[str, int]:
    """Token counts of short pre-tokens that are frequent in the documents of ``SAMPLE_ROWS`` keys.

    Texts stay where they are: only the keys, the smallest by hash, travel. At most ``most`` strings
    of ``FREQUENT_CHARS`` characters reach the driver.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((own.definition, own.frequent))
    keys = docs.select(F.col(key).alias("_key")).filter("_key IS NOT NULL").distinct()
    chosen = keys.orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE_ROWS)
    some = docs.select(F.col(key).alias("_of"), text).join(F.broadcast(chosen), F.col("_of") == F.col("_key"), "left_semi")
    seen = some.select(F.explode(cut_column(shipped, text)["rare"]).alias("r")).select("r.*")
    often = (
        seen.filter(F.length("piece") <= FREQUENT_CHARS)
        .groupBy("piece")
        .agg(F.sum("times").alias("times"))
        .orderBy(F.desc("times"), "piece")
        .limit(most)
        .withColumn("count", count_column(shipped, "piece"))
    )
    return {r["piece"]: r["count"] for r in often.select("piece", "count").collect()}
