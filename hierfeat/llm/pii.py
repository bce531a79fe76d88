"""Personal data, and the words that give it away.

Base kinds are found by patterns. The corpus then says how strongly a word near a protected
value reveals it: if the pointwise mutual information of word and value comes near the
information content of the value, the word predicts it almost alone, and is generalised or
removed wherever it stands, like the value itself. All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hierfeat.llm.shared import stored

#: Characters of text on each side of a value in which words count as near it, and those that tell passages apart.
CONTEXT_CHARS, PASSAGE_CHARS = 160, 80
#: Different passages in which a word must stand near a value.
SUPPORT = 3
#: Share of a value's information that a word may carry before it is generalised, and removed.
GENERALISE, REMOVE = 0.85, 0.95
#: Revealing words that are sent to every task; more are joined by a shuffle.
SENT_TERMS = 100_000

# A word: letters, marks and digits, a letter among them, with single hyphens and apostrophes inside; three of them, or
# two that begin like a name. It stands between white space and punctuation, but not beside the signs that join the parts
# of addresses.
CHAR = r"[\p{L}\p{M}\p{N}]"
TERM = (
    rf"(?<![^\s\p{{P}}]|[@._%+\-/'’])(?=[\p{{N}}\-'’]*\p{{L}})(?=[\p{{Lu}}\p{{Lo}}]{CHAR}|{CHAR}(?:[-'’]?{CHAR}){{2}}){CHAR}++(?:[-'’]{CHAR}++)*+"
    r"(?=\s|$|[\p{P}&&[^@_%+\-/.]]|\.(?:\s|$|[\p{P}&&[^@._%+\-/]]))"
)
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Kind:
    """A base kind: a cheap test that a text may hold one, the pattern, and what a match must pass.

    Patterns give the same matches as the plain ones of the contract. They start only where a run of
    their characters starts (or the last match ended) and never give back characters, so they are
    linear in the length of the text and need no stack for long matches.
    """

    name: str
    hint: str
    pattern: str


KINDS = (
    Kind(
        "email",
        "@",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    ),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9])++"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TERM_KIND = len(KINDS)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    back = F.reverse(digits)

    def share(place: Column) -> Column:
        digit = F.substring(back, place, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return F.when(place % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, place: total + share(place)) % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    long = F.length(digits)
    return (
        F.when(kind == 1, value.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        .when(kind == 2, F.when(long.between(16, 19), luhn(digits)).otherwise(False))
        .when(kind == 3, long.between(8, 15))
        .otherwise(True)
    )


def cut_out(texts: DataFrame, text: str) -> DataFrame:
    """Replace ``text`` by ``found``: the matches of all kinds, each with the text on both its sides."""
    whole = texts.withColumn(text, F.coalesce(text, F.lit("")))
    for i, kind in enumerate(KINDS):
        may = F.col(text).rlike(kind.hint)
        none = F.lit(None).cast("array<string>")
        whole = whole.withColumns(
            {
                f"_value{i}": F.when(may, F.regexp_extract_all(F.col(text), F.lit(kind.pattern), F.lit(0))).otherwise(none),
                f"_gap{i}": F.when(may, F.split(F.col(text), kind.pattern, -1)).otherwise(none),
            }
        )
    # The array of gaps is used three times, so it stays a column of its own and is made once.
    found = F.concat(*[matches_of(i) for i in range(len(KINDS))])
    made = [f"_{x}{i}" for i in range(len(KINDS)) for x in ("value", "gap")]
    return whole.withColumn("found", found).drop(text, *made)


def matches_of(number: int) -> Column:
    """The matches of one kind, from the columns of values and gaps."""
    gaps = F.col(f"_gap{number}")
    zipped = F.arrays_zip(
        F.col(f"_value{number}").alias("value"), gaps.alias("before"), F.slice(gaps, 2, F.size(gaps)).alias("after")
    )

    def match(x: Column, place: Column) -> Column:
        left, right = F.right(x["before"], F.lit(CONTEXT_CHARS)), F.left(x["after"], F.lit(CONTEXT_CHARS))
        # A word that the context cuts in two is no word of it.
        left = F.when(F.length(x["before"]) > CONTEXT_CHARS, F.regexp_replace(left, r"^\S*", "")).otherwise(left)
        right = F.when(F.length(x["after"]) > CONTEXT_CHARS, F.regexp_replace(right, r"\S*$", "")).otherwise(right)
        return F.struct(
            F.lit(number).alias("kind"),
            place.alias("place"),
            x["value"].alias("value"),
            F.length(x["before"]).cast("bigint").alias("lead"),
            left.alias("left"),
            right.alias("right"),
        )

    # There is one gap more than values.
    real = F.filter(F.transform(zipped, match), lambda m: m["value"].isNotNull())
    return F.coalesce(real, F.array())


def base_spans(found: DataFrame) -> DataFrame:
    """Matches that pass, with their place in code points (end exclusive)."""
    matches = found.select("row", F.explode("found").alias("m")).select("row", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("place")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.col("lead") + F.length("value")).over(upto)
    return (
        matches.withColumn("end", ends)
        .withColumn("start", F.col("end") - F.length("value"))
        .filter(passes(F.col("kind"), F.col("value")))
        .select("row", "kind", F.lower("value").alias("value"), "start", "end", "left", "right")
    )


def terms_of(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def words_near(spans: DataFrame) -> DataFrame:
    """Every different word near a value, with a hash of the passage; of values seen in enough passages."""
    passage = F.xxhash64(F.right("left", F.lit(PASSAGE_CHARS)), F.left("right", F.lit(PASSAGE_CHARS)))
    placed = spans.withColumn("passage", passage)
    enough = placed.groupBy("kind", "value").agg(F.countDistinct("passage").alias("passages")).filter(F.col("passages") >= SUPPORT)
    words = F.array_distinct(F.concat(terms_of(F.col("left")), terms_of(F.col("right"))))
    seen = placed.join(enough.select("kind", "value"), ["kind", "value"])
    return seen.select("row", "kind", "value", "passage", F.explode(words).alias("term"))


def disclosing(spans: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs of a value and a word that reveals it, with ``share``: the part of the value's information.

    Of N texts with words, n hold the value, which has log2(N / n) bits. A word that m texts hold, k of them near the
    value, carries log2(k N / (n m)) bits of it. ``words`` has one row for each text and different word in it. All counts
    are over all documents; different passages are asked for, so that copies of one text reveal nothing.
    """
    corpus = stored(words.groupBy("term").agg(F.count(F.lit(1)).alias("m")), "terms")
    texts = words.agg(F.countDistinct("row")).first()[0] or 0
    near = words_near(spans)
    pairs = (
        near.groupBy("kind", "value", "term")
        .agg(F.countDistinct("row").alias("k"), F.countDistinct("passage").alias("support"))
        .filter(F.col("support") >= SUPPORT)
    )
    values = spans.select("kind", "value", "row").distinct().groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    every = F.lit(float(max(texts, 2)))
    own = F.log2(every / F.col("n"))
    told = F.log2(F.least("k", "m") * every / (F.col("n") * F.col("m")))
    return (
        pairs.join(corpus, "term")
        .join(values, ["kind", "value"])
        .withColumn("share", told / own)
        .filter((own > 0) & (F.col("share") >= GENERALISE))
        .select("kind", "value", "term", "share")
    )


def occurrences(texts: DataFrame, words: DataFrame, told: DataFrame) -> DataFrame:
    """Places of all revealing words: ``row``, ``start``, ``end``, ``share``, the largest that the word has.

    First the texts that hold such a word are found, each with its words, then only these are gone through, once and word by
    word, and no row is made for any other word.
    """
    terms = stored(told.groupBy("term").agg(F.max("share").alias("share")), "revealing")
    terms = F.broadcast(terms) if terms.count() <= SENT_TERMS else terms
    own = words.join(terms, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))
    # The text ends with a gap that no word follows.
    parts = F.arrays_zip(
        F.split("whole", TERM, -1).alias("gap"), F.regexp_extract_all(F.col("whole"), F.lit(TERM), F.lit(0)).alias("word")
    )
    holders = texts.select("row", "whole").join(own, "row").select("row", "told", parts.alias("parts"))
    none = F.array().cast("array<struct<start: bigint, end: bigint, share: double>>")

    def step(done: Column, p: Column) -> Column:
        start = done["at"] + F.length(p["gap"])
        end, share = start + F.coalesce(F.length(p["word"]), F.lit(0)), F.try_element_at(F.col("told"), F.lower(p["word"]))
        more = F.concat(done["found"], F.array(F.struct(start.alias("start"), end.alias("end"), share.alias("share"))))
        return F.struct(end.alias("at"), F.when(share.isNotNull(), more).otherwise(done["found"]).alias("found"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found"))
    return holders.select("row", F.inline(F.aggregate("parts", begin, step, lambda done: done["found"])))


def all_spans(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The documents, each with a ``row`` number and its ``whole`` text, and all spans: row, kind, start, end, share."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(text).alias("whole"))
    rows = stored(cut_out(narrow, "text").withColumn("row", F.monotonically_increasing_id()), "matches")
    spans = base_spans(rows)
    words = rows.select("row", F.explode(terms_of(F.coalesce("whole", F.lit("")))).alias("term"))
    added = occurrences(rows, words, disclosing(spans, words)).select("row", F.lit(TERM_KIND).alias("kind"), "start", "end", "share")
    base = spans.select("row", "kind", "start", "end", F.lit(None).cast("double").alias("share"))
    return rows.drop("found"), base.unionByName(added)


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS], F.lit("term"))

    def one(s: Column) -> Column:
        return F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(spans, one), ",")


def private_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data in every whole text, and words that reveal it.

    One row per row of ``docs``: the key, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``,
    ``spans`` (all spans by kind, then start; revealing words have the kind ``term``, wherever they stand), ``n_term``. Places
    count code points. Matches of a kind do not overlap, those of different kinds may. Null and
    empty texts have no spans. Repeated rows come out as often as they go in and count as often in
    the statistics; an empty table gives an empty one; other columns are not read.
    """
    rows, spans = all_spans(docs, key, text)
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    none = F.array().cast(by_row.schema["spans"].dataType)
    listed = rows.join(by_row, "row", "left").withColumn("spans", F.coalesce("spans", none))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return listed.select(
        F.col("key").alias(key),
        *[count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)],
        F.sha2(spelled(F.filter("spans", lambda s: s["kind"] < TERM_KIND)), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
        count(TERM_KIND).alias("n_term"),
    )


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text with personal data taken out: the key and ``text``.

    A base match becomes the name of its kind in brackets. A word that carries ``REMOVE`` or more of a
    value is removed, one that carries less is generalised to ``[WORD]``. Of overlapping spans the
    first takes effect, of those with one start the longest. Null stays null; rows as in
    ``private_spans``.
    """
    rows, spans = all_spans(docs, key, text)
    names = F.array(*[F.lit(f"[{k.name.upper()}]") for k in KINDS])
    put = (
        F.when(F.col("kind") < TERM_KIND, F.get(names, F.col("kind")))
        .when(F.col("share") >= REMOVE, F.lit(""))
        .otherwise(F.lit("[WORD]"))
    )
    edits = spans.select("row", "start", (-F.col("end")).alias("back"), put.alias("put"))
    by_row = edits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "back", "put"))).alias("edits"))

    def part(begin: Column, length: Column) -> Column:
        return F.substring(F.col("whole"), (begin + 1).cast("int"), length.cast("int"))

    def apply(done: Column, e: Column) -> Column:
        after = F.struct(
            F.concat(done["out"], part(done["at"], e["start"] - done["at"]), e["put"]).alias("out"), (-e["back"]).alias("at")
        )
        return F.when(e["start"] >= done["at"], after).otherwise(done)

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    rest = F.aggregate("edits", start, apply, lambda done: F.concat(done["out"], part(done["at"], F.length("whole"))))
    return rows.join(by_row, "row", "left").select(
        F.col("key").alias(key), F.when(F.col("edits").isNull(), F.col("whole")).otherwise(rest).alias(text)
    )
