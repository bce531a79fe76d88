"""Tables with nulls, empty and long texts, copies, repeated rows, and column names the operators use themselves."""

import random

import pytest

WORDS = "the of and river stone light under garden morning paper window silver reason quiet forest letter number".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", ",", "."]) for _ in range(n))


def awkward_rows() -> list[tuple]:
    rows = [(i, prose(i, 20 + 7 * i), "en", f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, prose(i, 20 + 7 * i), "en", "s0") for i in range(0, 40, 3)]  # copies
    rows += [(150 + i, "  " + prose(i, 20 + 7 * i).replace(" ", "\t\n", 2), "en", None) for i in range(0, 40, 5)]
    rows += [(200 + i, prose(i, 20 + 7 * i) + " ending " + "x" * i, "de", "s1") for i in range(0, 40, 4)]
    rows += [(300, None, None, None), (301, "", "en", "s2"), (302, " \n\t ", None, "s2"), (303, "one", "en", "s3"), (304, "two words", "fr", "é")]
    rows += [(305, "naïve 😀 çá été x", "fr", "😀"), (306, "a" * 5000, "en", "s0"), (307, "ab " * 3000, "en", "s0")]
    rows += [(308, prose(77, 9000), "en", "s2"), (309, "12 34 !! ##", None, "s2"), (310, "<|endoftext|>x<|endoftext|>", "en", "s0")]
    rows += [(5, prose(5, 55), "en", "s1"), (7, prose(500, 30), "en", "s3")]  # a repeated row, an id with two texts
    rows += [(None, prose(3, 41), "en", "s3"), (None, prose(901, 60), None, "s3"), (None, None, "en", None)]
    return rows


SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, row string, bits int, size double,"
    " KEY string, piece int, Digest array<int>, number string, spans int, label string"
)


def table_of(spark, rows):
    whole = [(d, t, x, s, len(t or ""), None, "r", 1, 0.5, "k", 2, [1], "n", 3, "l") for d, t, x, s in rows]
    return spark.createDataFrame(whole, SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def awkward(spark, rows, tmp_path_factory):
    """As files, in a few parts."""
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    table_of(spark, rows).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return table_of(spark, []).limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    found = [(i, 1, 0) for i in range(0, 40, 2)] + [(303, 0, 0), (306, 0, 0), (1, 1, 0), (1, 0, 1), (None, 1, 0), (3, None, None)]
    return spark.createDataFrame(found, "doc_id bigint, quality int, toxic int")
