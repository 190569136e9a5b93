"""Numbers as digits in a base, with the base's symbol, and expressions moved from base to base."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DIGITS, INF, NAN, NEG_INF


def digits(n: Column, base: Column | int, alphabet: str = DIGITS) -> Column:
    """Digits of an integer, a minus sign in front; a negative target base keeps the sign."""
    b = F.lit(base) if isinstance(base, int) else base
    # conv() takes its bases as constants in the DataFrame API, not in SQL expressions.
    out = F.call_function("conv", n.cast("string"), F.lit(10), -b)
    return out if alphabet == DIGITS else F.translate(out, DIGITS, alphabet)


def literal(n: Column, base: Column | int, symbol: Column) -> Column:
    """A number in a base behind that base's symbol; plain decimal where there is none."""
    return F.when(symbol.isNull(), n.cast("string")).otherwise(F.concat(symbol, digits(n, base)))


def value_text(x: Column) -> Column:
    """A double that holds an integer or a special value, as text; null beyond 10**38, which a double doesn't hold exactly."""
    return F.when(F.isnan(x), NAN).when(x == float("inf"), INF).when(x == float("-inf"), NEG_INF).otherwise(x.try_cast("decimal(38,0)").cast("string"))


def trace_text(x: Column) -> Column:
    """The same in the spelling of traces."""
    return F.lower(value_text(x))


def rebase(text: Column, base: int) -> Column:
    """Every $digits$ of an expression in the target base, without the marks; text with an unpaired $ stays as it is."""
    parts = F.split(text, r"\$")
    moved = F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & x.rlike(r"^-?\d+$"), digits(x, base)).otherwise(x)), "")
    return F.when(F.size(parts) % 2 == 1, moved).otherwise(text)
