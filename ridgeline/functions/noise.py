"""Repeatable random numbers: a hash of a key, not of a partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(1 << 52)


def uniform(seed: int, *key: Column | str) -> Column:
    """Uniform in [0, 1) that depends only on the seed and the key.

    The first 13 hex digits of the md5 of their texts, joined by bars, over
    2**52: a rule that any SQL engine can repeat.
    """
    parts = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]]
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / TWO_52


def normal(seed: int, *key: Column | str) -> Column:
    """Standard normal by the Box-Muller transform of two hashed uniforms."""
    u1 = F.lit(1.0) - uniform(seed, F.lit("a"), *key)
    u2 = uniform(seed, F.lit("b"), *key)
    return F.sqrt(F.log(u1) * -2.0) * F.cos(u2 * 6.283185307179586)


def below(u: Column, n: Column | int) -> Column:
    """Integer in [0, n) from a uniform."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.floor(u * n), n - 1).cast("bigint")
