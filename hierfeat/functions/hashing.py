"""Deterministic pseudo-random columns: same value on every retry and in every branch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 2**32


def hash_hex(seed: int | str, *parts: Column) -> Column:
    """md5 hex digits of ``seed|part|part…``; uniform, and the same in any SQL engine."""
    pieces = [F.lit(str(seed))]
    for part in parts:
        pieces += [F.lit("|"), part.cast("string")]
    return F.md5(F.concat(*pieces))


def hex_word(digits: Column, start: int = 1, length: int = 8) -> Column:
    """Whole number held by ``length`` hex digits (at most 15 fit a bigint)."""
    return F.conv(F.substring(digits, start, length), 16, 10).cast("bigint")


def hex_uniform(digits: Column, start: int = 1) -> Column:
    """Uniform number in [0, 1) from eight hex digits."""
    return hex_word(digits, start) / F.lit(float(WORD))


def below_share(digits: Column, share: float) -> Column:
    """True for a ``share`` of all hashes. Hex digits compare like the numbers they are."""
    cut = int(share * WORD)
    return F.lit(True) if cut >= WORD else F.substring(digits, 1, 8) < F.lit(f"{cut:08x}")
