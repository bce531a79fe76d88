import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from hierfeat.llm import bpe, token_counts
from hierfeat.llm.queries import byte_ranks


@pytest.fixture(scope="module")
def encoding():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_digests_equal_the_other_library(awkward, rows, encoding):
    found = bpe.round_trips(awkward, byte_ranks())
    want = Counter()
    for d, t, *_ in rows:
        ids = encoding.encode_ordinary(t or "")
        data = np.array(ids, "<u4").tobytes()
        want[d, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in found.collect()) == want


def test_round_trip_with_offsets(awkward, rows):
    coded = bpe.encoded(awkward, byte_ranks(), offsets=True)
    back = bpe.decoded(coded, byte_ranks()).select("doc_id", "text", "ids", "char_spans", "bytes", "decoded").collect()
    assert len(back) == len(rows)
    for r in back:
        text = r["text"] or ""
        assert bytes(r["bytes"]) == text.encode() and r["decoded"] == text
        assert len(r["ids"]) == len(r["char_spans"])
        assert not text or (r["char_spans"][0][0] == 0 and r["char_spans"][-1][1] == len(text))


def test_a_token_inside_a_character():
    text = "😀"
    own = bpe.Codec(*(lambda r: (r.tokens, r.ids, r.pattern))(byte_ranks()))
    ids = own.encode_all([text])[0]
    assert len(ids) > 1 and own.decode(ids) == text.encode()
    assert bpe.character_offsets(text, own.offsets(ids)).tolist() == [[0, 1]] * len(ids)


def test_bytes_that_are_no_text(spark):
    ranks = byte_ranks()
    half = next(i for t, i in zip(ranks.tokens, ranks.ids) if t == b"\xf0")
    odd = spark.createDataFrame([([half],), (None,)], "ids array<int>")
    assert [(bytes(r["bytes"]), r["decoded"]) for r in bpe.decoded(odd, ranks).collect()] == [(b"\xf0", None), (b"", "")]


def test_long_texts_are_cut_where_nothing_changes(encoding, monkeypatch):
    text = "one two's three  four, 5 six\n seven été x" * 400
    monkeypatch.setattr(bpe, "PART_CHARS", 50)
    own = bpe.Codec(*(lambda r: (r.tokens, r.ids, r.pattern))(byte_ranks()))
    assert len(list(own.parts(text))) > 50
    assert own.encode_all([text])[0].tolist() == encoding.encode_ordinary(text)


@pytest.mark.parametrize("frequent", [0, 50, 100_000])
def test_counts_equal_the_library(awkward, rows, frequent):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    own = Tokenizer.from_str(definition)
    found = token_counts.token_counts(awkward, definition, frequent=frequent)
    want = Counter()
    for d, t, *_ in rows:
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        want[d, len((t or "").encode()), n, n > 1024] += 1
    assert Counter(map(tuple, found.collect())) == want


def test_pre_tokens_of_parts(monkeypatch):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        own = token_counts.Pieces(file.read())
    text = "one two's three  four, 5 six\n seven été x <|endoftext|> a b" * 300
    whole = own.frequencies(text)
    monkeypatch.setattr(token_counts, "PART_CHARS", 40)
    assert own.frequencies(text) == whole


def test_other_tokenizers_are_refused(awkward):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        token_counts.token_counts(awkward, file.read())


def test_empty(empty):
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        assert token_counts.token_counts(empty, file.read()).count() == 0
    assert bpe.round_trips(empty, byte_ranks()).count() == 0
