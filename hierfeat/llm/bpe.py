"""Byte-level BPE: encoding with offsets and decoding, by the tokenizers library.

The library works on characters, so every byte is mapped to a printable character of its
own. A token that ends inside a character has no text of its own; decoding therefore goes
back to bytes for a whole sequence before it is read as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hierfeat.llm.shared import made_once
from hierfeat.llm.words import pieces

#: Texts are encoded in parts of about this many characters, so that the library's
#: records of one part stay small.
PART_CHARS = 1 << 16
#: Characters of the encoded matches in one of the two generations that a worker keeps; some 40 MB with their ids.
KEPT_CHARS = 1_500_000
LATIN = re.compile("[\0-\u024f]*")
# A space between two ASCII letters always starts a match of the usual patterns; parts end before one.
SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def byte_characters() -> list[str]:
    """The character that stands for each byte.

    Printable Latin-1 bytes stand for themselves, the others take the code points from
    256 on in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Ranks:
    """A vocabulary of byte strings by rank, and the pattern whose matches are encoded apart.

    With ``whole_matches`` a match that is itself a token becomes that token without merging.
    """

    tokens: tuple[bytes, ...]
    ids: tuple[int, ...]
    pattern: str
    whole_matches: bool = True

    def shipped(self, spark: SparkSession) -> Broadcast[tuple]:
        return spark.sparkContext.broadcast((self.tokens, self.ids, self.pattern, self.whole_matches))

    @staticmethod
    def read(path: str, pattern: str) -> Ranks:
        """Read a rank file (base64 token and rank in each line). Vocabularies are small files on the driver."""
        with open(path, "rb") as lines:
            found = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
        return Ranks(tuple(t for _, t in found), tuple(r for r, _ in found), pattern)


class Codec:
    """Encoder and decoder of one task.

    ``encode`` gives ids and the byte span of every token; ``decode`` gives bytes.
    """

    def __init__(self, tokens: tuple[bytes, ...], ids: tuple[int, ...], pattern: str, whole_matches: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        letters, rank = byte_characters(), dict(zip(tokens, ids))
        shown = {t: "".join(letters[b] for b in t) for t in tokens}
        # A pair may merge wherever its bytes are a token; the rank of the result is the order.
        merges = [
            (shown[t[:i]], shown[t[i:]])
            for t in tokens
            for i in range(1, len(t))
            if t[:i] in rank and t[i:] in rank
        ]
        model = models.BPE(
            vocab={shown[t]: r for t, r in rank.items()}, merges=merges, ignore_merges=whole_matches
        )
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        own = regex.compile(pattern)
        self.pattern = None if own.groups else own
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept_chars = 0
        byte_of = {c: b for b, c in enumerate(letters)}
        self.table = {r: bytes(byte_of[c] for c in shown[t]) for t, r in rank.items()}
        width = max(ids) + 1 if ids else 1
        self.lengths = np.zeros(width, np.int64)
        self.lengths[list(ids)] = [len(t) for t in tokens]

    def parts(self, text: str) -> Iterator[str]:
        """Cut a long text where a match must start anyway; without such a place it stays whole."""
        start = 0
        while len(text) - start > PART_CHARS:
            found = SAFE_CUT.search(text, start + PART_CHARS)
            if not found:
                break
            yield text[start : found.start()]
            start = found.start()
        yield text[start:]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text. Matches repeat a lot, so each new one is encoded once and kept.

        Classes of characters may differ between the libraries for rare scripts: texts with other
        than Latin characters are cut by the tokenizers library itself.
        """
        found: list[list[bytes]] = [[] for _ in texts]
        parts = ((i, part) for i, text in enumerate(texts) for part in self.parts(text))
        # Some parts at a time, so a long text is never taken apart as a whole.
        while some := self.next_parts(parts):
            cut = [self.matches(part) for _, part in some]
            self.keep([x for x in cut if x])
            for (i, part), own in zip(some, cut):
                if own is None:
                    found[i].append(self.raw(self.tokenizer.encode(part, add_special_tokens=False)))
                else:
                    found[i].append(b"".join(map(self.kept.__getitem__, own)))
        return [np.frombuffer(b"".join(x), "<u4") for x in found]

    @staticmethod
    def next_parts(parts: Iterator[tuple[int, str]]) -> list[tuple[int, str]]:
        some, size = [], 0
        for part in parts:
            some.append(part)
            size += len(part[1])
            if size >= 16 * PART_CHARS:
                break
        return some

    def keep(self, cut: list[list[str]]) -> None:
        """Have the ids of these matches at hand, and those of the matches before as far as there is room.

        Two generations are kept: when one is full the older one goes, and what is still in use
        moves on without being encoded again.
        """
        if self.kept_chars > KEPT_CHARS:
            self.older, self.kept, self.kept_chars = self.kept, {}, 0
        new = {m for part in cut for m in part if m not in self.kept}
        self.kept_chars += sum(map(len, new))
        unseen = [m for m in new if m not in self.older]
        self.kept.update((m, self.older[m]) for m in new if m in self.older)
        self.kept.update(zip(unseen, map(self.raw, self.tokenizer.encode_batch(unseen, add_special_tokens=False))))

    @staticmethod
    def raw(encoding) -> bytes:
        return np.array(encoding.ids, "<u4").tobytes()

    def matches(self, part: str) -> list[str] | None:
        """The matches that make up a part, or None if the library must find them."""
        if self.pattern is None or not LATIN.fullmatch(part):
            return None
        found = self.pattern.findall(part)
        return found if sum(map(len, found)) == len(part) else None

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Bounds of the tokens in the bytes of the text: token ``k`` covers ``[k]`` to ``[k + 1]``."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


def character_offsets(text: str, bounds: np.ndarray) -> np.ndarray:
    """First character touched and character after the last touched, for each token.

    A token that holds a part of a character counts as touching the whole of it, so such
    neighbours overlap.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    # Character of each byte: a continuation byte belongs to the character begun before it.
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    first, last = bounds[:-1], bounds[1:] - 1
    return np.stack([character[first], character[last] + 1], axis=1) if len(first) else np.zeros((0, 2), np.int64)


def encoded(docs: DataFrame, ranks: Ranks, text: str = "text", offsets: bool = False) -> DataFrame:
    """Ids of every text, as columns next to those given.

    Adds ``ids`` (array of int) and with ``offsets`` also ``char_spans`` (array of two-element
    arrays, the characters that each token touches). A null or empty text has no ids; rows
    that repeat are encoded each.
    """
    shipped = ranks.shipped(docs.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = made_once(shipped, Codec)
        for batch in batches:
            found = []
            for piece in pieces(batch):
                texts = piece.to_pylist()
                for t, ids in zip(texts, own.encode_all(texts)):
                    spans = character_offsets(t, own.offsets(ids)).tolist() if offsets else None
                    found.append({"ids": ids.astype(np.int32).tolist(), "char_spans": spans})
            yield pa.array(found, pa.struct([("ids", pa.list_(pa.int32())), ("char_spans", pa.list_(pa.list_(pa.int64())))]))

    coded = F.arrow_udf(run, "struct<ids: array<int>, char_spans: array<array<bigint>>>")
    out = docs.withColumn("ids", coded(F.col(text)))
    return out.select(
        *[c for c in docs.columns if c not in ("ids", "char_spans")],
        F.col("ids.ids").alias("ids"),
        *([F.col("ids.char_spans").alias("char_spans")] if offsets else []),
    )


def decoded(coded: DataFrame, ranks: Ranks, ids: str = "ids") -> DataFrame:
    """Bytes of every id sequence as ``bytes``, and as ``decoded`` where they are UTF-8 (else null)."""
    shipped = ranks.shipped(coded.sparkSession)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = made_once(shipped, Codec)
        for batch in batches:
            yield pa.array([own.decode(np.array(x or [], np.int64)) for x in batch.to_pylist()], pa.binary())

    raw = F.arrow_udf(run, "binary")
    return coded.withColumn("bytes", raw(F.col(ids))).withColumn("decoded", F.expr("try_validate_utf8(cast(bytes as string))"))


def round_trips(docs: DataFrame, ranks: Ranks, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the ids and of the decoded bytes of every text.

    One row per row of ``docs``: the key, ``n_tokens``, ``ids_sha256`` (ids as little-endian
    unsigned 32-bit integers), ``decoded_sha256``, ``n_split`` (tokens that end inside a
    character). Null and empty texts have no tokens and the digests of no bytes; repeated
    rows come out as often as they go in; an empty table gives an empty one. Other columns
    are not read, so their names do not matter.
    """
    shipped = ranks.shipped(docs.sparkSession)
    kind = pa.struct(
        [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_split", pa.int64())]
    )

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = made_once(shipped, Codec)
        for batch in batches:
            found = []
            for piece in pieces(batch):
                for ids in own.encode_all(piece.to_pylist()):
                    back = own.decode(ids)
                    ends = own.offsets(ids)[1:-1]
                    split = int(((np.frombuffer(back, np.uint8)[ends] & 0xC0) == 0x80).sum())
                    found.append(
                        (
                            len(ids),
                            hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                            hashlib.sha256(back).hexdigest(),
                            split,
                        )
                    )
            names = [f.name for f in kind]
            yield pa.array([dict(zip(names, x)) for x in found], kind)

    digest = F.arrow_udf(run, "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string, n_split: bigint>")
    return docs.select(F.col(key), digest(F.col(text)).alias("found")).select(key, "found.*")
