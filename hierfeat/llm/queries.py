"""The operators as queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hierfeat.llm import (
    bpe,
    byte_network,
    exact,
    fingerprints,
    html_content,
    language,
    lexical,
    mixing,
    pii,
    quality,
    substrings,
    token_counts,
    variants,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decisions(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


@query("op3_private_data")
def private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(table(spark, sf_dir, "documents"))


def byte_ranks() -> bpe.Ranks:
    return bpe.Ranks.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op4_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), byte_ranks())


@query("op5_language")
def language_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


@query("op6_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.main_texts(table(spark, sf_dir, "pages"))


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.near_groups(table(spark, sf_dir, "documents"))


@query("op9_mixing")
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("source")


@query("op10_token_counts")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return token_counts.token_counts(table(spark, sf_dir, "documents"), file.read())


@query(
    "op11_lexical_search",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ), sizes AS (
        SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0
    ), tf AS (
        SELECT doc_id, term, count(*) AS tf, any_value(n) AS n
        FROM (SELECT doc_id, unnest(terms) AS term, len(terms) AS n FROM d) GROUP BY doc_id, term
    ), wanted AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ), weights AS (
        SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, sizes GROUP BY term, docs
    ), scores AS (
        SELECT item_id, doc_id,
               sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
        FROM wanted JOIN tf USING (term) JOIN weights USING (term), sizes GROUP BY item_id, doc_id
    ), ranks AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scores WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10
    """,
)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_quality_network")
def quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_network.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))
