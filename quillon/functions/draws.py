"""Reproducible draws: a hash of (seed, key), the same in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT


def bits(key: Column, what: str, seed: str = DEFAULT.seed) -> Column:
    """32 bits as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def between(key: Column, what: str, low: Column | int, high: Column | int) -> Column:
    lo, hi = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (low, high))
    return lo + F.pmod(bits(key, what), hi - lo + 1)


def unit(key: Column, what: str) -> Column:
    return bits(key, what) / float(1 << 32)


def skewed(key: Column, what: str, low: int, high: int) -> Column:
    """Uniform up to a uniform maximum: small values are likelier."""
    return between(key, f"{what}/v", low, between(key, f"{what}/m", low, high))


def weighted(u: Column, weights: dict[str, float]) -> Column:
    """One of the names by cumulative weight."""
    total, sum_, out = sum(weights.values()), 0.0, None
    for name, w in list(weights.items())[:-1]:
        sum_ += w
        out = F.when(u < sum_ / total, name) if out is None else out.when(u < sum_ / total, name)
    last = list(weights)[-1]
    return F.lit(last) if out is None else out.otherwise(last)
