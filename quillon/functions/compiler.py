"""Definitions compiled to Spark columns: value and cost in one pass.

Values are doubles: integers up to 2**53 are exact there, and NaN and the infinities are the
format's own. For operands that could lead past that (see within), and for loops, values are the exact interpreter's
(language.evaluate): operators.evaluation.apply_operator chooses by the operands. Python's comparisons, which are false for NaN, are guarded, as
Spark takes NaN for equal to itself and the largest number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .language import Branches, Call, Cmp, Logic, Loop, Num, Undefined, Var

NAN = float("nan")
#: Doubles hold all integers up to here.
EXACT = 2.0**53


def once(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def primitive(name: str, x: Column, y: Column) -> Column:
    if name in "+-*":
        return x + y if name == "+" else x - y if name == "-" else x * y
    usable = ~F.isnan(x) & ~F.isnan(y) & (y != 0)
    quotient = F.floor(F.try_divide(x, y)).cast("double")
    if name == "%":
        return F.when(usable & _finite(x) & _finite(y), x - y * quotient).otherwise(NAN)
    unlike = F.when((x == 0) | ((x > 0) == (y > 0)), F.lit(0.0)).otherwise(F.lit(-1.0))
    return F.when(usable & _finite(x) & _finite(y), quotient).when(usable & _finite(x), unlike).when(usable & _finite(y), F.when(y > 0, x).otherwise(-x)).otherwise(NAN)


def compare(op: str, x: Column, y: Column) -> Column:
    known = ~F.isnan(x) & ~F.isnan(y)
    return {"==": known & (x == y), "!=": ~known | (x != y), ">": known & (x > y), "<": known & (x < y), ">=": known & (x >= y), "<=": known & (x <= y)}[op]


def _state(v: Column, c: Column) -> Column:
    return F.struct(v.alias("v"), c.alias("c"))


def peak(func_id: str, bodies: dict, *bounds: int) -> int:
    """A bound on every magnitude that a call of a compiled operator meets, its operands being within bounds."""
    most = max(bounds)

    def of(x, env) -> int:
        nonlocal most
        match x:
            case Num(v):
                out = abs(v)
            case Var(n):
                out = env[n]
            case Call(f, xs):
                out = call(f, *(of(y, env) for y in xs))
            case Undefined():
                out = 0
        most = max(most, out)
        return out

    def conditions(c, env):
        match c:
            case Cmp(_, l, r):
                of(l, env), of(r, env)
            case Logic(_, xs):
                for y in xs:
                    conditions(y, env)

    def call(f, *args) -> int:
        nonlocal most
        entry = bodies[f]
        if isinstance(entry, str):
            x, y = args
            out = {"+": x + y, "-": x + y, "*": x * y, "/": x + 1, "%": y}[entry]
            most = max(most, out, x + y * (x + 1) if entry == "%" else 0)  # the remainder is taken by a product
            return out
        env = dict(zip(entry[0], args))
        if isinstance(entry[1], Branches):
            for _, c in entry[1].arms:
                conditions(c, env)
            return max(of(e, env) for e, _ in entry[1].arms)
        return of(entry[1], env)

    call(func_id, *bounds)
    return most


def within(func_id: str, bodies: dict) -> int:
    """The largest power of two such that no operand up to it leads past what doubles hold exactly; -1 if there is none."""
    arity = 2 if isinstance(bodies[func_id], str) else len(bodies[func_id][0])
    return max((1 << k for k in range(54) if peak(func_id, bodies, *[1 << k] * arity) <= EXACT), default=-1)


class Compiler:
    """bodies maps a func_id to a primitive's sign or to (parameters, body). Loops aren't compiled."""

    def __init__(self, bodies: dict):
        self.bodies = bodies

    def both(self, func_id: str, *args: Column) -> Column:
        """(v, c) of a call."""
        own = lambda *xs: self._of(self.bodies[func_id], *xs)
        if len(args) == 2:
            return once(F.struct(args[0].alias("a"), args[1].alias("b")), lambda s: own(s["a"], s["b"]))
        return once(args[0], lambda a: own(a))

    def value(self, func_id: str, *args: Column) -> Column:
        return self.both(func_id, *args)["v"]

    def cost(self, func_id: str, *args: Column) -> Column:
        return self.both(func_id, *args)["c"]

    def _of(self, entry, *args: Column) -> Column:
        one = F.lit(1).cast("long")
        if isinstance(entry, str):
            return _state(primitive(entry, *args), one)
        env = dict(zip(entry[0], args))
        match entry[1]:
            case Branches(arms):
                return self._arms(arms, env)
            case Loop():
                raise TypeError("a loop is not compiled")
        return once(self._expr(entry[1], env), lambda s: _state(s["v"], F.greatest(one, s["c"])))

    def _arms(self, arms, env) -> Column:
        """The first arm whose condition holds, with the cost of that condition alone."""
        (e, c), rest = arms[0], arms[1:]
        one, plain = F.lit(1).cast("long"), isinstance(e, (Var, Num, Undefined))
        if c is None:
            return once(self._expr(e, env), lambda s: _state(s["v"], one if plain else s["c"]))
        taken = lambda h: once(self._expr(e, env), lambda s: _state(s["v"], one if plain else s["c"] + h["c"]))
        return once(self._condition(c, env), lambda h: F.when(h["v"], taken(h)).otherwise(self._arms(rest, env)))

    def _expr(self, x, env) -> Column:
        zero = F.lit(0).cast("long")
        match x:
            case Num(v):
                return _state(F.lit(float(v)), zero)
            case Var(n):
                return _state(env[n], zero)
            case Undefined():
                return _state(F.lit(NAN), zero)
            case Call(f, xs):
                inner = F.struct(*[self._expr(y, env).alias(f"x{k}") for k, y in enumerate(xs)])

                def call(s):
                    parts = [s[f"x{k}"] for k in range(len(xs))]
                    return once(self.both(f, *[p["v"] for p in parts]), lambda r: _state(r["v"], sum((p["c"] for p in parts), r["c"])))

                return once(inner, call)
        raise TypeError(x)

    def _condition(self, c, env) -> Column:
        """(v, c) of a condition, v being boolean; all of its parts are costed."""
        zero = F.lit(0).cast("long")
        match c:
            case Cmp(op, l, r):
                both = F.struct(self._expr(l, env).alias("l"), self._expr(r, env).alias("r"))
                return once(both, lambda s: _state(compare(op, s["l"]["v"], s["r"]["v"]), s["l"]["c"] + s["r"]["c"]))
            case Logic("not", (x,)):
                return once(self._condition(x, env), lambda s: _state(~s["v"], s["c"]))
            case Logic(op, xs):
                parts = F.struct(*[self._condition(y, env).alias(f"x{k}") for k, y in enumerate(xs)])

                def joined(s):
                    all_of = [s[f"x{k}"] for k in range(len(xs))]
                    v = all_of[0]["v"]
                    for y in all_of[1:]:
                        v = v & y["v"] if op == "and" else v | y["v"]
                    return _state(v, sum((y["c"] for y in all_of), zero))

                return once(parts, joined)
        raise TypeError(c)
