"""Trees evaluated, measured, rendered and traced by folds over their nodes, as columns.

A tree's nodes in post-order are a program of a stack machine: a number is pushed, an operator
takes its operands off the stack and pushes its result. One fold runs it with values, and leaves
every node with its operands, value and cost (``ev``); measures and traces are array functions of that, and the texts are
a second fold whose stack holds texts. Values are doubles, which hold integers up to 2**53
exactly: a step whose operands could lead past that marks the tree as far, and such trees are the exact interpreter's.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.bases import digits, value_text
from ..functions.compiler import EXACT, Compiler, once, peak, primitive, within
from ..functions.language import loops

#: Operators that are compiled into one fold; beyond that a plan is no place for them.
COMPILED = 64
# How the verbose trace spells its steps.
INFO_NUMBER = "number node, value={value}"
INFO_UNARY = "compute unary expreesion, input={left}, op_id = {op}, unary_op_definition = '{definition}', output={value}"
INFO_BINARY = "compute binary expreesion, left_input={left}, right_input={right}, op_id = {op} binary_op_definition= '{definition}', output={value}"
EV = "struct<depth:int,func_id:string,v:double,l:double,r:double,c:bigint,far:boolean>"


def compiles(operators: dict, bodies: dict) -> bool:
    """Whether all operators of trees can be columns: few, and without loops."""
    used = [f for f in operators if f in bodies]
    return 0 < len(used) <= COMPILED and not any(loops(f, bodies) for f in used)


def always_near(operators: dict, bodies: dict, largest: int, depth: int) -> bool:
    """Whether no tree of this depth over numbers up to largest can leave what doubles hold exactly."""
    for _ in range(depth):
        largest = max(peak(f, bodies, *[largest] * r["n_ary"]) for f, r in operators.items() if f in bodies)
        if largest > EXACT:
            return False
    return True


def _text_format(template: str, **values: Column) -> Column:
    """template with {names} as columns; null where one is."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


class Folds:
    """Columns of trees. operators: catalog rows as dicts by func_id; bodies: their compiled forms; signs: symbols of bases."""

    def __init__(self, operators: dict, bodies: dict, signs: dict):
        self.used = {f: r for f, r in operators.items() if f in bodies}
        self.bodies, self.signs = bodies, signs

    def of(self, func_id: Column, field: str, kind: str = "string", make=None) -> Column:
        """A field of the catalog by func_id, from a constant map; null where it is null."""
        known = {f: make(r) if make else r[field] for f, r in self.used.items()}
        known = {f: v for f, v in known.items() if v is not None}
        if not known:
            return F.lit(None).cast(kind)
        value = lambda v: F.array(*map(F.lit, v)).cast(kind) if isinstance(v, list) else F.lit(v).cast(kind)
        return F.try_element_at(F.create_map(*[x for f, v in known.items() for x in (F.lit(f), value(v))]), func_id)

    def spelled(self, n: Column, base: int) -> Column:
        """A whole number in a base behind its symbol; plain decimal where the catalog has none."""
        n = n.cast("long")
        return F.concat(F.lit(self.signs[base]), digits(n, base)) if base in self.signs else n.cast("string")

    def value(self, v: Column, base: int, lower: bool = False) -> Column:
        special = F.isnan(v) | (F.abs(v) == float("inf"))
        text = value_text(v)
        return F.when(special, F.lower(text) if lower else text).otherwise(self.spelled(v, base))

    def apply(self, func_id: Column, a: Column, b: Column, near: bool = False) -> Column:
        """(v, c, far) of a call; far if the operands could lead past what doubles hold exactly, which near rules out."""
        compiler, out = Compiler(self.bodies), None
        for f, r in self.used.items():
            args, bound, entry = (a, b)[: r["n_ary"]], float(within(f, self.bodies)), self.bodies[f]
            far = F.lit(False) if near else F.greatest(*[F.when(F.isnan(x), 0.0).otherwise(F.abs(x)) for x in args], F.lit(0.0)) > bound
            state = lambda v, c: F.struct(v.alias("v"), c.alias("c"), far.alias("far"))
            # A primitive's operands are at hand; withField would make a call once for each of its fields.
            one = state(primitive(entry, *args), F.lit(1).cast("long")) if isinstance(entry, str) else once(compiler.both(f, *args), lambda s: state(s["v"], s["c"]))
            out = F.when(func_id == f, one) if out is None else out.when(func_id == f, one)
        return out

    def evaluated(self, nodes: Column, near: bool = False) -> Column:
        """ev: nodes in post-order as (depth, func_id, v, l, r, c, far); near where no node can be far."""
        far = lambda n: F.lit(False) if near else (n["value"] > int(EXACT)) | (n["value"] < -int(EXACT))
        order = F.sort_array(F.transform(nodes, lambda n: F.struct(F.concat(n["path"], F.lit("z")).alias("key"), n["depth"].alias("depth"), n["kind"].alias("kind"), n["func_id"].alias("func_id"), n["value"].cast("double").alias("value"), far(n).alias("far"))))
        start = F.struct(F.array().cast("array<double>").alias("stack"), F.array().cast(f"array<{EV}>").alias("out"))

        def step(s, n):
            number, two = n["kind"] == "num", n["kind"] == "binary"
            top, below = F.get(s["stack"], F.lit(0)), F.get(s["stack"], F.lit(1))
            leaf = F.struct(n["value"].alias("v"), F.lit(0).cast("long").alias("c"), n["far"].alias("far"))
            args = F.struct(F.when(two, below).otherwise(top).alias("l"), top.alias("r"))

            def done(p):
                a, x = p["args"], p["x"]
                node = F.struct(n["depth"].alias("depth"), n["func_id"].alias("func_id"), x["v"].alias("v"), F.when(~number, a["l"]).alias("l"), F.when(two, a["r"]).alias("r"), x["c"].alias("c"), x["far"].alias("far"))
                taken = F.when(number, 0).when(two, 2).otherwise(1)
                return F.struct(F.concat(F.array(x["v"]), F.slice(s["stack"], taken + 1, F.size(s["stack"]))).alias("stack"), F.concat(s["out"], F.array(node)).alias("out"))

            result = lambda a: F.struct(a.alias("args"), F.when(number, leaf).otherwise(self.apply(n["func_id"], a["l"], a["r"], near)).alias("x"))
            return once(once(args, result), done)

        return F.aggregate(order, start, step)["out"].cast(f"array<{EV}>")

    def text(self, ev: Column, number, bracketed: bool = False) -> Column:
        """The infix text, with no more brackets than are needed or with all; number(v) spells a number."""
        start = F.array().cast("array<struct<text:string,two:boolean,prio:int>>")

        def step(stack, n):
            op = n["func_id"]
            info = F.struct(self.of(op, "symbol").alias("sign"), self.of(op, "priority", "int").alias("prio"), self.of(op, "associativity_direction").alias("side"), (self.of(op, "unary_position") == "postfix").alias("after"), (self.of(op, "n_ary", "int") == 2).alias("two"))
            top, below = F.get(stack, F.lit(0)), F.get(stack, F.lit(1))

            def written(i):
                def child(x, side):
                    away = F.coalesce(i["side"] == {"left": "right", "right": "left"}[side], F.lit(False)) if side else F.lit(False)
                    needed = x["two"] & i["prio"].isNotNull() & ((x["prio"] < i["prio"]) | ((x["prio"] == i["prio"]) & away))
                    return x["text"] if bracketed else F.when(F.coalesce(needed, F.lit(False)), F.concat(F.lit("("), x["text"], F.lit(")"))).otherwise(x["text"])

                both = F.concat(child(below, "left"), i["sign"], child(top, "right"))
                both = F.concat(F.lit("("), both, F.lit(")")) if bracketed else both
                alone = child(top, None)
                one = F.concat(F.lit("("), F.when(F.coalesce(i["after"], F.lit(False)), F.concat(alone, i["sign"])).otherwise(F.concat(i["sign"], alone)), F.lit(")"))
                new = F.struct(F.when(op.isNull(), number(n["v"])).when(i["two"], both).otherwise(one).alias("text"), F.coalesce(i["two"], F.lit(False)).alias("two"), i["prio"].alias("prio"))
                taken = F.when(op.isNull(), 0).when(i["two"], 2).otherwise(1)
                return F.concat(F.array(new), F.slice(stack, taken + 1, F.size(stack)))

            return once(info, written)

        return F.get(F.aggregate(ev, start, step), F.lit(0))["text"]

    def json(self, ev: Column) -> Column:
        def step(stack, n):
            op = n["func_id"]
            two, name = F.coalesce(self.of(op, "n_ary", "int") == 2, F.lit(False)), self.of(op, "func_id", make=lambda r: json.dumps(r["func_id"]))
            top, below = F.get(stack, F.lit(0)), F.get(stack, F.lit(1))
            number = F.concat(F.lit('{"type":"numeric_atoms","value":'), n["v"].cast("long").cast("string"), F.lit("}"))
            both = F.concat(F.lit('{"type":"binary","op":'), name, F.lit(',"l":'), below, F.lit(',"r":'), top, F.lit("}"))
            one = F.concat(F.lit('{"type":"unary","op":'), name, F.lit(',"l":'), top, F.lit("}"))
            return F.concat(F.array(F.when(op.isNull(), number).when(two, both).otherwise(one)), F.slice(stack, F.when(op.isNull(), 1).when(two, 3).otherwise(2), F.size(stack)))

        return F.get(F.aggregate(ev, F.array().cast("array<string>"), step), F.lit(0))

    def cot(self, ev: Column, base: int) -> Column:
        """A step for each operator."""
        show = lambda v: self.value(v, base, True)

        def step(n):
            op, sign = n["func_id"], self.of(n["func_id"], "symbol")
            after = F.coalesce(self.of(op, "unary_position") == "postfix", F.lit(False))
            left = F.when(n["r"].isNotNull(), F.concat(show(n["l"]), sign, show(n["r"]))).when(after, F.concat(show(n["l"]), sign)).otherwise(F.concat(sign, show(n["l"])))
            return F.struct(F.concat(left, F.lit("="), show(n["v"])).alias("info"), n["depth"].alias("layer"))

        return F.transform(F.filter(ev, lambda n: n["func_id"].isNotNull()), step)

    def info(self, ev: Column) -> Column:
        """A step for each node."""
        plain = lambda v: F.lower(value_text(v))

        def step(n):
            op = n["func_id"]
            named = {"op": op, "definition": F.coalesce(self.of(op, "definition"), F.lit("None")), "left": plain(n["l"]), "right": plain(n["r"]), "value": plain(n["v"])}
            text = F.when(op.isNull(), _text_format(INFO_NUMBER, **named)).when(n["r"].isNotNull(), _text_format(INFO_BINARY, **named)).otherwise(_text_format(INFO_UNARY, **named))
            return F.struct(text.alias("info"), n["depth"].alias("layer"))

        return F.transform(ev, step)

    def longer(self, ev: Column, base: int) -> Column:
        """Whether a result has more digits than each operand somewhere; special values never do."""
        size = lambda v: F.length(digits(v.cast("long"), base))
        finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))

        def more(n):
            right = n["r"].isNull() | (finite(n["r"]) & (size(n["v"]) > size(n["r"])))
            return F.coalesce(n["func_id"].isNotNull() & finite(n["v"]) & finite(n["l"]) & (size(n["v"]) > size(n["l"])) & right, F.lit(False))

        return F.exists(ev, more)

    def record(self, nodes: Column, ev: Column, base: int, result_base: int, longer_base: int, brackets: bool) -> dict:
        """The fields of a record by name, each a function that makes its column; far is whether it has to be the interpreter's."""
        ops = lambda: F.filter(ev, lambda n: n["func_id"].isNotNull())
        count = lambda: F.size(ops())
        degree = lambda: F.aggregate(ev, F.lit(0).cast("long"), lambda s, n: s + n["c"])
        text = lambda: self.text(ev, lambda v: self.spelled(v, base), brackets)
        result = lambda: self.value(F.element_at(ev, -1)["v"], result_base)

        def used():
            before = F.transform(F.filter(nodes, lambda n: n["func_id"].isNotNull()), lambda n: F.struct(n["path"], n["func_id"]))
            return F.array_distinct(F.transform(F.array_sort(before), lambda n: n["func_id"]))

        def dependent():
            return F.flatten(F.transform(used(), lambda f: F.coalesce(self.of(f, "dependencies", "array<string>", lambda r: list(r["dependencies"] or []) or None), F.array().cast("array<string>"))))

        def priorities():
            # A null priority is a priority as others are.
            return F.size(F.array_distinct(F.transform(ops(), lambda n: F.coalesce(self.of(n["func_id"], "priority", "int"), F.lit(-(1 << 31))))))

        return {
            "expression_no_base_symbol": lambda: self.text(ev, lambda v: F.concat(F.lit("$"), v.cast("long").cast("string"), F.lit("$")), brackets), "expression": text,
            "highest_n_order": lambda: F.coalesce(F.array_max(F.transform(ops(), lambda n: self.of(n["func_id"], "n_order", "int"))), F.lit(0)), "priority_hierarchical_complexity": priorities,
            "normalized_expansion_degree": lambda: degree().cast("string"), "operation_count": count, "complexity_ratio": lambda: F.when(count() > 0, F.round(degree() / count(), 6)).otherwise(0.0), "tree": lambda: self.json(ev),
            "used_operators": used, "dependent_operators": dependent, "result": result, "longer_result_info": lambda: F.struct(F.lit(longer_base).cast("int").alias("target_base"), self.longer(ev, longer_base).alias("flag")),
            "cot_info": lambda: self.info(ev), "base": lambda: F.lit(base), "result_base": lambda: F.lit(result_base), "text": lambda: F.concat(text(), F.lit("="), result()), "cot": lambda: self.cot(ev, longer_base),
            "far": lambda: F.exists(ev, lambda n: F.coalesce(n["far"], F.lit(False))),
        }
