"""Settings of the generators and evaluators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the format: digits by value, names of the special results, the clamp of loops, limits by order.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAN, INF, NEG_INF = "NaN", "Inf", "-Inf"
CLAMP = 2**31 - 1
LOOP_LIMITS = {3: 1_000_000, 4: 1_000, 5: 100}
BASIC_SYMBOLS = ("+", "-", "*", "/", "%")
SYMBOL_RANGES = ((0x2200, 0x22FF), (0x2A00, 0x2AFF), (0x2190, 0x21FF))
COMPARISONS = ("==", ">", "<", ">=", "<=", "!=")


@dataclass(frozen=True)
class Settings:
    max_base: int = 16
    symbol_lengths: tuple[int, int] = (1, 3)
    condition_range: tuple[int, int] = (0, 1000)
    condition_weights: tuple[float, ...] = (0.7, 0.2, 0.1)
    max_branches: int = 2
    value_range: tuple[int, int] = (0, 1000)
    max_depth: int = 3
    node_weights: dict = field(default_factory=lambda: {"binary": 0.7, "prefix": 0.2, "postfix": 0.1, "atom": 0.0})
    variable_share: float = 0.3
    base: int | None = 10
    result_base: int = 10
    longer_result_base: int | None = 10
    seed: str = "quillon"


DEFAULT = Settings()
