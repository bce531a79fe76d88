"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hierfeat.llm.shared import removed, stored


def components(links: DataFrame) -> DataFrame:
    """The smallest node that links lead to, for every node with a link.

    ``links`` has two bigint columns (read in order). Returns ``node``, ``component``.

    Links are rewired until each node hangs on the smallest one of its component: in turn,
    larger neighbours move to the smallest neighbour, and smaller ones do. A node sends each
    of its links at most once per turn, and minima are combined before the shuffle, so a hub
    costs no more than its links; the number of turns grows with the logarithm of the longest
    path. Every turn is written to the shared folder, and the one before it is then deleted.
    """
    u, v = links.columns
    now = stored(
        links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "links"
    )
    state = _state(now)
    while state[0]:
        earlier, now = now, stored(_small_star(_large_star(now)), "links")
        removed(earlier)
        before, state = state, _state(now)
        if state == before:
            break
    child = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = child.union(child.select("component", "component").distinct())
    found._stored_at = now._stored_at
    return found


def _state(links: DataFrame) -> tuple:
    """Number and digest of the links; equal only if a turn has changed nothing."""
    return tuple(links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("u") % 1_000_003), F.sum("v")).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
