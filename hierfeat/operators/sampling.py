"""Deterministic samples. All draws come from hashes of ids, never from rand()."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hierfeat.functions.hashing import below_share, hash_hex, hex_word
from hierfeat.operators import slices
from hierfeat.operators.prepare import class_counts, few_or_joined
from hierfeat.spec import CASE, TARGET

logger = logging.getLogger(__name__)

# Hash digits that name a slice of a class: 16**4 slices, so the histogram is bounded.
SLICE_DIGITS = 4


def stratified_sample(
    base: DataFrame,
    sample_ratio: float,
    target_col: str = TARGET,
    random_state: int = 42,
    exact: bool = True,
    key: str = CASE,
) -> DataFrame:
    """Ids of the same share of either class (0 and 1), without replacement.

    ``exact`` takes ``floor(n * ratio)`` of each class, in hash order. One job makes a
    histogram over hash slices and finds the slice of each class in which the cut falls;
    only that slice gets sorted. Otherwise each id is kept by its own hash, with no
    shuffle at all.
    """
    if sample_ratio >= 1.0 or sample_ratio <= 0.0:
        logger.info("sample ratio %s: every id is kept", sample_ratio)
        return base.select(key)
    keyed = base.filter(F.col(target_col).isin(0, 1)).select(
        F.col(key), F.col(target_col).alias("_class"), hash_hex(random_state, F.col(key)).alias("_hash")
    )
    if not exact:
        return keyed.filter(below_share(F.col("_hash"), sample_ratio)).select(key)

    prefix = F.substring("_hash", 1, SLICE_DIGITS)
    per_class = Window.partitionBy("_class")
    earlier = per_class.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.floor(F.sum("_n").over(per_class) * F.lit(float(sample_ratio)))
    cuts = (
        keyed.groupBy("_class", prefix.alias("_slice"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_take", wanted - F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter((F.col("_take") >= 0) & (F.col("_take") < F.col("_n")))
        .collect()
    )
    # One cut per class: the slices below it are taken whole, by a plain filter.
    whole, partly, take = F.lit(False), F.lit(False), F.lit(0)
    for cut in cuts:
        mine = F.col("_class") == cut["_class"]
        whole = whole | (mine & (prefix < cut["_slice"]))
        partly = partly | (mine & (prefix == cut["_slice"]))
        take = F.when(mine, F.lit(cut["_take"])).otherwise(take)
    rank = F.row_number().over(per_class.orderBy("_hash", key))
    ranked = keyed.filter(partly).withColumn("_rank", rank)
    return keyed.filter(whole).select(key).union(ranked.filter(F.col("_rank") <= take).select(key))


def balanced_resample(
    df: DataFrame, key: str, target_col: str = TARGET, seed: int = 42, draws: int | None = None
) -> DataFrame:
    """Draws with replacement, each class as likely as any other: ``draw, key, target``.

    Every draw picks a class, then a row of it, so a row has weight 1 / class count. The
    rows are numbered inside their class in hash order; one join finds the drawn ones.
    """
    spark = df.sparkSession
    counts = class_counts(df, target_col)
    classes, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not classes:
        raise ValueError("no rows to draw from")
    draws = total if draws is None else draws
    rows = df.filter(F.col(target_col).isNotNull()).select(
        F.col(key), F.col(target_col), hash_hex(seed, F.col(key)).alias("_hash")
    )
    rows = slices.row_index(
        slices.by_hash(rows, "_hash"), ["_hash", key], [target_col], "_idx"
    ).select(key, target_col, "_idx")

    digits = hash_hex(f"{seed}|draw", F.col("id"))
    which = hex_word(digits) % classes
    picked = spark.range(draws).select(F.col("id").alias("draw"), which.alias("_w"), hex_word(digits, 9, 12).alias("_u"))
    # One row per class: numbering them in one place is small next to the draws.
    numbered = counts.withColumn("_w", (F.row_number().over(Window.orderBy("label")) - 1).cast("bigint"))
    picked = picked.join(few_or_joined(numbered), "_w").select(
        "draw", F.col("label").alias(target_col), (F.col("_u") % F.col("n")).alias("_idx")
    )
    return picked.join(rows, [target_col, "_idx"]).select("draw", key, target_col)


def random_subset(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows without replacement, the smallest in hash order."""
    digits = hash_hex(seed, F.col(key))
    return df.withColumn("_hash", digits).orderBy("_hash", key).limit(k).drop("_hash")
