"""Mixing sources to target weights along a low-discrepancy schedule.

Every source is a stream of words, its documents in a pseudo-random order, cut into blocks of
equal word count. Slot ``k`` of the mix takes the point ``frac(k * golden ratio)``; cumulative
weights map it to a source, and the rank of the slot among those of its source says which
block it takes: so many blocks from the start of the stream as the source has slots, in
shuffled order. A document stands in the mix where the block it begins in stands. All of it is
DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hierfeat.llm.shared import fresh, stored
from hierfeat.operators.slices import SLICE, by_sketch, row_index, running_totals
from hierfeat.session import shuffle_width

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_TIMES = 2
TIMES = ("first", "second")
#: Words of a block; a source is cut into ``LEAST_BLOCKS`` at least, as far as it has words.
BLOCK = 64
LEAST_BLOCKS = 64
# 2**31 divided by the golden ratio, made odd: multiples of it modulo 2**31 visit every cell
# once, each new one in the largest gap left.
GOLDEN, CELLS = 1_327_217_885, 2**31
#: The unit interval is cut into so many steps for each source, and ``LEAST_STEPS`` at least, for the join of points and sources.
STEPS, LEAST_STEPS = 4, 2**14
#: Draws are added up as whole numbers of this fraction of a block, so their sums are the same in any order.
FRACTION = 2**16


def sizes(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words.alias("size"))


def named_sources(sized: DataFrame) -> DataFrame:
    """Every source with its size and its number: by code point, null last.

    Partitions that follow the names are the slices; writing them fixes where they were cut.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("unnamed", F.col("source").isNull())
    cut = by_source.repartitionByRange(shuffle_width(sized.sparkSession), "unnamed", "source").withColumn(SLICE, F.spark_partition_id())
    return row_index(stored(cut, "source-names"), ["unnamed", "source"], name="number").drop("unnamed")


def targets(sized: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """One row per source: its number, size, target, block size, blocks and span of the unit interval.

    Sources go by code point, null last, and take the weights in turn. A source that would get
    more than ``most`` times its size gets that; the others share the rest by weight. With the
    sources in order of size by weight this is a running total: a source is full if the targets
    already exceed the sum when all of larger ratio get as much by weight as it can take.
    Running totals go over slices, so there may be as many sources as documents.
    """
    width = shuffle_width(sized.sparkSession)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stored(
        named_sources(sized)
        .withColumn("weight", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int")))
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight")),
        "source-weights",
    )
    total = weighed.agg(F.sum("weight")).scalar()
    wanted = share * weighed.agg(F.sum("source_size")).scalar()
    by_ratio = running_totals(
        by_sketch(weighed, "ratio"), {"full_before": F.col("cap"), "weight_before": F.col("weight")}, ["ratio", "number"]
    )
    above = total - F.col("weight_before") - F.col("weight")
    full = F.col("full_before") + F.col("cap") + F.col("ratio") * above < wanted
    judged = stored(by_ratio.withColumn("full", full), "source-full")
    left = wanted - judged.agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0))).scalar()
    open_ = judged.agg(F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight")))).scalar()
    target = F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("weight") / open_)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.ceil(F.col("source_size") / LEAST_BLOCKS))).cast("bigint")
    # Blocks to take: the last block of a source may be short, so by mean size.
    draws = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    drawing = stored(
        judged.withColumn("target", F.least(target, "cap"))
        .withColumn("block", block)
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("bigint"))
        .select("number", "source", "source_size", "target", "block", "blocks", F.round(draws * FRACTION).cast("bigint").alias("draws")),
        "source-draws",
    )
    sources = drawing.agg(F.count(F.lit(1))).scalar()
    sliced = drawing.withColumn(SLICE, F.floor(F.col("number") * width / sources).cast("int"))
    summed = running_totals(sliced, {"low": F.col("draws")}, ["number"])
    return summed.select(
        "number",
        "source",
        "source_size",
        "target",
        "block",
        "blocks",
        (F.col("low") / FRACTION).alias("low"),
        ((F.col("low") + F.col("draws")) / FRACTION).alias("high"),
        (drawing.agg(F.sum("draws")).scalar() / FRACTION).alias("all_draws"),
    )


def schedule(sources: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: ``slot``, ``number`` of the source, ``rank`` in it, ``block_no``, ``time`` (0 the first).

    The slots of a source at one time take the first blocks of its stream, as many as there are slots, in
    the order of a seeded hash. A slot past ``MOST_TIMES`` rounds through its source stays empty and is left out.
    """
    spark = sources.sparkSession
    most, named = sources.agg(F.max("all_draws"), F.count(F.lit(1))).first()
    slots, steps = round(most or 0.0), max(LEAST_STEPS, STEPS * named)
    width = shuffle_width(spark)
    point = (F.col("slot") % CELLS * GOLDEN % CELLS + 0.5) / CELLS
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("step", F.floor(F.col("point") * steps))
    # Neighbours share an end to the last bit, and the last span ends at 1.
    spans = (
        sources.filter("high > low")
        .select("number", "blocks", (F.col("low") / F.col("all_draws")).alias("low"), (F.col("high") / F.col("all_draws")).alias("high"))
        .withColumn("step", F.explode(F.sequence(F.floor(F.col("low") * steps), F.least(F.floor(F.col("high") * steps), F.lit(steps - 1).cast("bigint")))))
    )
    mapped = points.join(spans, "step").filter("low <= point AND point < high").select("slot", "number", "blocks")
    sliced = mapped.withColumn(SLICE, F.floor(F.col("slot") * width / max(slots, 1)).cast("int"))
    time, turn = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    ranked = stored(
        row_index(sliced, ["slot"], ["number"], "rank")
        .select("slot", "number", "rank", time.alias("time"), turn.alias("turn"))
        .filter(F.col("time") < MOST_TIMES),
        "slots",
    )
    # The same numbers as blocks of the stream, ranked by hash.
    blocks = ranked.select("number", "time", F.col("turn").alias("block_no"))
    hashed = blocks.withColumn("order", F.xxhash64(F.lit(seed), "number", "time", "block_no"))
    shuffled = row_index(hash_sliced(hashed), ["order", "block_no"], ["number", "time"], "turn").drop("order")
    return ranked.join(shuffled, ["number", "time", "turn"]).select("slot", "number", "rank", "block_no", "time")


def hash_sliced(df: DataFrame) -> DataFrame:
    """Add slices along ``order``, a 64-bit hash."""
    bits = max(1, math.ceil(math.log2(shuffle_width(df.sparkSession)))) + 2
    return df.withColumn(SLICE, F.shiftright("order", 64 - bits).cast("int"))


def streams(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Where each document starts in the stream of its source."""
    numbered = sized.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    hashed = numbered.withColumn("order", F.xxhash64(F.lit(seed), "key", "size"))
    return running_totals(hash_sliced(hashed), {"start": F.col("size")}, ["order", "key", "size"], ["number"])


def mixed(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    seed: int = 0,
) -> DataFrame:
    """How many words of each document the mix takes.

    One row per row of ``docs``: the key, the source, ``size`` (words of the text), ``source_size``,
    ``target`` (words the source is to give), ``taken`` (words the mix takes, repeats counted),
    ``first`` and ``second`` (how many of them at the first and second time; always the first
    words of the text), ``first_slot`` and ``second_slot`` (where the document stands in the mix at that
    time; null if it is not taken), ``start`` (its place in the stream of the source, which orders
    documents of one slot). ``taken`` is at most ``MOST_TIMES`` times the size. The sum over a source
    comes within a few blocks of its target. The same table gives the same result in any
    partitioning.

    A null text has size 0; documents without words are never taken. Null is a source of its own,
    after all others. Documents of equal key and size are told apart by nothing and may trade
    places, also when rows repeat. An empty table gives an empty result.
    """
    sized = stored(sizes(docs, key, source, text), "sizes")
    sources = stored(targets(sized, weights, share, MOST_TIMES), "sources")
    drawn = stored(schedule(sources, seed), "schedule")

    def at(time: int, value: Column) -> Column:
        return F.when(F.col("time") == time, value)

    rounds = drawn.groupBy("number").agg(*[F.count(at(i, F.lit(1))).alias(f"drawn_{n}") for i, n in enumerate(TIMES)])
    streamed = sources.join(rounds, "number", "left").select(
        "number", "source", "source_size", "target", "block", *[F.coalesce(f"drawn_{n}", F.lit(0)).alias(f"drawn_{n}") for n in TIMES]
    )
    placed = streams(sized, stored(streamed, "drawn"), seed)
    # The blocks drawn at one time are the start of the stream, so they hold the first words of a document.
    amounts = {n: F.greatest(F.lit(0), F.least("size", F.col(f"drawn_{n}") * F.col("block") - F.col("start"))).cast("bigint") for n in TIMES}
    placed = stored(placed.withColumns(amounts).withColumn("block_no", F.floor(F.col("start") / F.col("block"))), "streams")
    slots = drawn.groupBy("number", "block_no").agg(*[F.max(at(i, F.col("slot"))).alias(f"{n}_slot") for i, n in enumerate(TIMES)])
    taken = placed.filter("first > 0").join(slots, ["number", "block_no"])
    never = placed.filter("first = 0").withColumns({f"{n}_slot": F.lit(None).cast("bigint") for n in TIMES})
    return taken.unionByName(never).select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        (F.col("first") + F.col("second")).alias("taken"),
        *TIMES,
        "first_slot",
        F.when(F.col("second") > 0, F.col("second_slot")).alias("second_slot"),
        "start",
    )


def first_words(text: Column, count: Column) -> Column:
    """The first words of a text with the white space between them."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    return F.regexp_replace(F.array_join(F.slice(pieces, 1, (count + blank).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")


def mixture(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", chars: str = "n_chars", slot: str | None = None
) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each time a document is taken.

    Rows come in the order of the schedule: partitions hold successive stretches of slots and are sorted
    by slot. ``slot`` names a further column for it. A document of which the mix takes only the first words is
    cut there (and ``chars``, if there is such a column, counted again). Nulls, ties and repeated rows as in
    ``mixed``; repeated rows are matched one to one. Texts are shuffled twice: to meet their amounts, and into the order
    of the slots.
    """
    size, place, take, given, stretch = fresh(docs, "size", "place", "take", "given", "stretch")
    same = [key, source, size]
    found = mixed(docs, key, source, text).withColumnRenamed("size", size).filter("taken > 0")
    times = [F.struct(F.col(n).alias("words"), F.col(f"{n}_slot").alias("slot"), "start") for n in TIMES]
    amounts = stored(found.select(*same, F.array(*times).alias(take)), "amounts")
    last = amounts.agg(F.max(F.array_max(F.transform(take, lambda t: t["slot"])))).first()[0]
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    # Rows and amounts of the same key, source and size lie together, nulls too; each are numbered, and equal numbers meet.
    both = docs.withColumn(size, words).unionByName(amounts, allowMissingColumns=True).repartition(*same)
    first = F.col(take)[0]
    order = Window.partitionBy(*same, F.col(take).isNull()).orderBy(text, first["words"], first["start"])
    numbered = both.withColumn(place, F.row_number().over(order))
    matched = numbered.withColumn(given, F.max(take).over(Window.partitionBy(*same, place)))
    taken = matched.filter(F.col(take).isNull()).withColumn(take, F.explode(given)).filter(F.col(take)["words"] > 0)
    cut = F.col(take)["words"] < F.col(size)
    change = {text: F.when(cut, first_words(F.col(text), F.col(take)["words"])).otherwise(F.col(text))}
    if chars in docs.columns:
        change[chars] = F.when(cut, F.length(change[text]).cast(docs.schema[chars].dataType)).otherwise(F.col(chars))
    width = shuffle_width(docs.sparkSession)
    taken = taken.withColumns(change).withColumn(stretch, F.floor(F.col(take)["slot"] * width / ((last or 0) + 1)).cast("int"))
    ordered = taken.select(*docs.columns, take, stretch).repartitionById(width, F.col(stretch))
    ordered = ordered.sortWithinPartitions(F.col(take)["slot"], F.col(take)["start"])
    return ordered.select(*docs.columns, *([F.col(take)["slot"].alias(slot)] if slot else []))
