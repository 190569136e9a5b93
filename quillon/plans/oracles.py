"""The same queries in SQL for another engine, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from ..config import DEFAULT
from . import fixtures as X
from .queries import BAD_LINES, EXTRA, POSTFIX

CAT, CAT_X = X.catalog_sql(), X.catalog_sql(EXTRA)
WIDE, WIDE_X = X.catalog_sql(parts=True), X.catalog_sql(EXTRA, True)
FIELDS = "id, func_id, symbol, n_ary, unary_position, n_order, is_base, definition, definition_type, priority, associativity_direction, op_compute_func, op_count_func, dependencies"
LINE = "SELECT l_orderkey, l_linenumber, l_partkey AS a, (l_linenumber - 3)::BIGINT AS b FROM lineitem"


def bits(key: str, what: str) -> str:
    return f"('0x' || substr(md5('{DEFAULT.seed}:{what}:' || ({key})::VARCHAR), 1, 8))::BIGINT"


def between(key: str, what: str, lo, hi) -> str:
    return f"({lo} + {bits(key, what)} % ({hi} - {lo} + 1))"


def unit(key: str, what: str) -> str:
    return f"({bits(key, what)} / 4294967296.0::DOUBLE)"


def skewed(key: str, what: str, lo: int, hi: int) -> str:
    return between(key, f"{what}/v", lo, between(key, f"{what}/m", lo, hi))


def pick(names, index: str) -> str:
    return "[" + ", ".join(X.sql_value(n) for n in names) + f"][({index})::INT + 1]"


def base_digits(n: str, base: int) -> str:
    return f"CASE WHEN {n} < 0 THEN '-' || to_base(-({n}), {base}) ELSE to_base({n}, {base}) END"


def shape(key: str) -> str:
    return f"CASE WHEN {bits(key, 'arity')} % 2 = 0 THEN 'binary' WHEN {bits(key, 'position')} % 2 = 0 THEN 'prefix' ELSE 'postfix' END"


SIGNS = ("+", "-", "*", "/", "%", "⊕")


def variable(key: str, what: str, sh: str) -> str:
    return f"CASE WHEN {sh} = 'binary' AND {bits(key, what)} % 2 = 1 THEN 'b' ELSE 'a' END"


def operand(key: str, tag: str, var: str) -> str:
    binary = f"'(' || ({var}) || ' ' || {pick(SIGNS, bits(key, tag + '/op') + ' % 6')} || ' ' || {between(key, tag + '/constant', 0, 1000)}::VARCHAR || ')'"
    return f"CASE {bits(key, tag + '/operand')} % 4 WHEN 1 THEN '(∇' || ({var}) || ')' WHEN 2 THEN '(' || ({var}) || '‰)' WHEN 3 THEN {binary} ELSE {var} END"


def condition(key: str, tag: str, sh: str) -> str:
    op = pick(("==", ">", "<", ">=", "<=", "!="), f"{bits(key, tag + '/cmp')} % 6")
    return f"(({operand(key, tag, variable(key, tag + '/var', sh))}) || ' ' || {op} || ' ' || {skewed(key, tag + '/k', 0, 1000)}::VARCHAR)"


def condition_count(key: str, tag: str = "") -> str:
    u = unit(key, tag + "conditions")
    return f"(CASE WHEN {u} < 0.7 / {0.7 + 0.2 + 0.1!r}::DOUBLE THEN 1 WHEN {u} < {(0.7 + 0.2)!r}::DOUBLE / {0.7 + 0.2 + 0.1!r}::DOUBLE THEN 2 ELSE 3 END)::INT"


def condition_expression(key: str, sh: str, tag: str = "") -> str:
    c = [condition(key, f"{tag}c{i}", sh) for i in range(3)]
    word = lambda i: f"CASE WHEN {bits(key, f'{tag}join{i}')} % 2 = 0 THEN 'and' ELSE 'or' END"
    pair = lambda x, i, y: f"CASE WHEN {bits(key, tag + 'bracket')} % 2 = 1 THEN '(' || {x} || ' ' || {word(i)} || ' ' || {y} || ')' ELSE {x} || ' ' || {word(i)} || ' ' || {y} END"
    return f"CASE {condition_count(key, tag)} WHEN 1 THEN {c[0]} WHEN 2 THEN {pair(c[0], 0, c[1])} ELSE {c[0]} || ' ' || {word(0)} || ' ' || ({pair(c[1], 1, c[2])}) END"


def body(key: str, tag: str, sh: str) -> str:
    def term(side: str) -> str:
        at = f"{tag}/{side}"
        var = variable(key, at + "/var", sh)
        return f"CASE WHEN {bits(key, at + '/deep')} % 2 = 1 THEN {operand(key, at, var)} WHEN {bits(key, at + '/number')} % 2 = 1 THEN {skewed(key, at + '/n', 1, 9)}::VARCHAR ELSE {var} END"

    return f"('(' || ({term('l')}) || {pick(SIGNS, bits(key, tag + '/op') + ' % 6')} || ({term('r')}) || ')')"


def branches(key: str, sh: str) -> str:
    """One or two conditioned arms and the last."""
    arm = lambda i: f"{body(key, f'b{i}', sh)} || ' , if ' || ({condition_expression(key, sh, f'i{i}/')}) || ' ; '"
    return f"{arm(0)} || CASE WHEN {between(key, 'branches', 1, 2)} > 1 THEN {arm(1)} ELSE '' END || {body(key, 'else', sh)} || ' , else'"


def recursive_operators(key: str) -> str:
    """Loops of order 2 and 3, from the draws, over the fixture's operators of the order below."""
    again = lambda step: (
        f"CASE WHEN arity = 2 THEN '(' || CASE x WHEN 'r' THEN {{e}} ELSE x END || ')' || sign || '(' || CASE y WHEN 'r' THEN {{e}} ELSE y END || ')' WHEN pos = 'prefix' THEN sign || '(' || {{e}} || ')' ELSE '(' || {{e}} || ')' || sign END"
    ).replace("{e}", f"(CASE v WHEN 'a' THEN '(a{step}1)⊛b' ELSE 'a⊛(b{step}1)' END)")
    near, beyond = "CASE WHEN k = 3 THEN ' and abs(' || v || ') <= 1000000' ELSE '' END", "CASE WHEN k = 3 THEN ' or abs(' || v || ') > 1000000' ELSE '' END"
    nl, args = "chr(10)", "CASE WHEN arity = 2 THEN x || ', ' || y ELSE 'r' END"
    guard = lambda value: f"'    if ' || v || ' != ' || v || ' or abs(' || v || ') == float(''inf'')' || {beyond} || ':' || {nl} || '        return {value}' || {nl} || '    r = ' || st || {nl}"
    loop, step = f"'    for _ in range(abs(' || v || ')):' || {nl}", f"'        t = op_' || callee || '(' || {args} || ')' || {nl}"
    keep = f"'        if abs(t) > 2147483647:' || {nl} || '            t = float(''inf'')' || {nl} || '        r = t if ' || v || ' > 0 else -t' || {nl}"
    pattern = f"{bits(key, 'pattern')} % 5"
    return (
        f"WITH d AS (SELECT {key} AS key, CASE WHEN {bits(key, 'order')} % 2 = 0 THEN 2 ELSE 3 END AS k, CASE WHEN {bits(key, 'loop')} % 2 = 0 THEN 'a' ELSE 'b' END AS v, "
        f"CASE {bits(key, 'start')} % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE {between(key, 'start/n', -100, 100)}::VARCHAR END AS st, {pick(('r', 'r', 'r', 'a', 'b'), pattern)} AS x, {pick(('r', 'a', 'b', 'r', 'r'), pattern)} AS y, "
        f"CASE WHEN {bits(key, 'order')} % 2 = 0 THEN {pick(('b1', 'd1', 'm1', 'p1', 'q1', 'r1', 's1', 't1'), bits(key, 'callee') + ' % 8')} ELSE {pick(('l1', 'l2'), bits(key, 'callee') + ' % 2')} END AS callee FROM orders), "
        f"{X.catalog_sql([POSTFIX])}, e AS (SELECT d.*, symbol AS sign, n_ary AS arity, unary_position AS pos FROM d JOIN cat ON func_id = callee) "
        f"SELECT key, 'g' || key AS func_id, '⊛' AS symbol, k::INT AS n_order, callee, 'a⊛b = {{ ' || st || ' , if ' || v || ' == 0 ; ' || {again('-')} || ' , if ' || v || ' > 0' || {near} || ' ; -(' || {again('+')} || CASE WHEN k = 3 THEN ') , if ' || v || ' < 0' || {near} || ' ; NaN , else }}' ELSE ') , else }}' END AS definition, "
        f"'recursive_definition' AS definition_type, 'def op_g' || key || '(a, b):' || {nl} || {guard('float(' + chr(39) * 2 + 'nan' + chr(39) * 2 + ')')} || {loop} || {step} || {keep} || '    return r' AS op_compute_func, "
        f"'def op_count_g' || key || '(a, b):' || {nl} || {guard('1')} || '    n = 0' || {nl} || {loop} || {step} || '        n += op_count_' || callee || '(' || {args} || ')' || {nl} || {keep} || '    return max(n, 1)' AS op_count_func, [callee] AS dependencies FROM e"
    )


def _source_operand(key: str, tag: str, var: str) -> str:
    binary = f"'op_' || {pick(NAMES, bits(key, tag + '/op') + ' % 6')} || '(' || ({var}) || ', ' || {between(key, tag + '/constant', 0, 1000)}::VARCHAR || ')'"
    return f"CASE {bits(key, tag + '/operand')} % 4 WHEN 1 THEN 'op_b1(' || ({var}) || ')' WHEN 2 THEN 'op_q1(' || ({var}) || ')' WHEN 3 THEN {binary} ELSE {var} END"


def _source_body(key: str, sh: str) -> str:
    def term(at: str) -> str:
        var = variable(key, at + "/var", sh)
        return f"CASE WHEN {bits(key, at + '/deep')} % 2 = 1 THEN {_source_operand(key, at, var)} WHEN {bits(key, at + '/number')} % 2 = 1 THEN {skewed(key, at + '/n', 1, 9)}::VARCHAR ELSE {var} END"

    return f"'op_' || {pick(NAMES, bits(key, 'b0/op') + ' % 6')} || '(' || ({term('b0/l')}) || ', ' || ({term('b0/r')}) || ')'"


NAMES = ("p1", "m1", "t1", "d1", "r1", "s1")


def generation_run(layers: int = 5) -> str:
    """Layer by layer: more attempts than a layer needs, those that pass, the first of each body, and of these as many as are missing."""
    nl, total, ratio = "chr(10)", "(2 * (SELECT count(*) FROM part))", 0.6
    first = f"({total}::DOUBLE / {sum(ratio**k for k in range(layers))!r}::DOUBLE)"
    size = lambda k: f"floor({first} * power({ratio}::DOUBLE, {k - 1}))::BIGINT"
    sizes = {k: size(k) for k in range(1, layers)} | {layers: f"({total} - " + " - ".join(size(k) for k in range(1, layers)) + ")"}
    out = [X.catalog_sql([POSTFIX], True)]
    for k in range(1, layers + 1):
        out.append(f"s{k} AS (SELECT greatest({sizes[k]} - (SELECT count(*) FROM cat WHERE n_order = {k}), 0) AS n), i{k} AS (SELECT unnest(range(0, (SELECT 60 * n + 4000 FROM s{k}))) * 10 + {k} AS key)")
        if k == 1:
            out.append(f"t1 AS (SELECT key, 'g' || key AS func_id, CASE sh WHEN 'binary' THEN 2 ELSE 1 END AS n_ary, 'def op_g' || key || CASE sh WHEN 'binary' THEN '(a, b)' ELSE '(a)' END || ':' || {nl} || '    return ' || {_source_body('key', 'sh')} AS op_compute_func FROM (SELECT key, {shape('key')} AS sh FROM i1))")
        else:
            limit = {3: 1_000_000, 4: 1_000, 5: 100}.get(k)
            beyond, pattern = f"' or abs(' || v || ') > {limit}'" if limit else "''", f"{bits('key', 'pattern')} % 5"
            out.append(f"p{k} AS (SELECT *, row_number() OVER (ORDER BY func_id) - 1 AS place FROM (SELECT func_id AS callee, func_id, n_ary AS arity FROM cat WHERE is_base IS NULL AND n_order = {k - 1} UNION ALL SELECT func_id, func_id, n_ary FROM g{k - 1}))")
            out.append(
                f"d{k} AS (SELECT key, CASE WHEN {bits('key', 'loop')} % 2 = 0 THEN 'a' ELSE 'b' END AS v, CASE {bits('key', 'start')} % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE {between('key', 'start/n', -100, 100)}::VARCHAR END AS st, "
                f"{pick(('r', 'r', 'r', 'a', 'b'), pattern)} AS x, {pick(('r', 'a', 'b', 'r', 'r'), pattern)} AS y, {bits('key', 'callee')} % (SELECT count(*) FROM p{k}) AS place FROM i{k})"
            )
            out.append(
                f"t{k} AS (SELECT key, 'g' || key AS func_id, 2 AS n_ary, 'def op_g' || key || '(a, b):' || {nl} || '    if ' || v || ' != ' || v || ' or abs(' || v || ') == float(''inf'')' || {beyond} || ':' || {nl} || '        return float(''nan'')' || {nl} || '    r = ' || st || {nl} "
                f"|| '    for _ in range(abs(' || v || ')):' || {nl} || '        t = op_' || callee || '(' || CASE WHEN arity = 2 THEN x || ', ' || y ELSE 'r' END || ')' || {nl} || '        if abs(t) > 2147483647:' || {nl} || '            t = float(''inf'')' || {nl} || '        r = t if ' || v || ' > 0 else -t' || {nl} || '    return r' AS op_compute_func FROM d{k} JOIN p{k} USING (place))"
            )
        out.append(
            f"g{k} AS MATERIALIZED (SELECT func_id, n_ary, op_compute_func FROM (SELECT *, row_number() OVER (ORDER BY key) AS nth FROM (SELECT min(key) AS key, arg_min(func_id, key) AS func_id, arg_min(n_ary, key) AS n_ary, arg_min(op_compute_func, key) AS op_compute_func FROM t{k} "
            f"WHERE ({_uses}) AND NOT ({_wrapper}) AND {_bodies} NOT IN (SELECT {_bodies} FROM cat WHERE op_compute_func IS NOT NULL) GROUP BY {_bodies})) WHERE nth <= (SELECT n FROM s{k}))"
        )
    rows = " UNION ALL ".join(f"SELECT func_id, n_ary::INT AS n_ary, {k}::INT AS n_order, op_compute_func, list_sort(list_distinct(regexp_extract_all({_bodies}, 'op_(\\w+)\\(', 1))) AS dependencies FROM g{k}" for k in range(1, layers + 1))
    return f"WITH {', '.join(out)} {rows}"


# Trees: two levels under a root, numbered as in a heap.
POOL = ("p1", "m1", "t1", "d1", "r1", "s1")


def _level(select: str, last: bool, root: bool, attempt: int = 0) -> str:
    key = "(expr_id::VARCHAR || '/' || node_id::VARCHAR" + f" || '/{attempt}'" * bool(attempt) + ")"
    w = {"binary": 0.7, "prefix": 0.2, "postfix": 0.1} | ({} if root else {"num": 0.3})
    total, acc, arms = sum(w.values()), 0.0, []
    for k, v in list(w.items())[:-1]:
        acc += v
        arms.append(f"WHEN {unit(key, 'kind')} < {acc / total!r}::DOUBLE THEN '{k}'")
    kind = "'num'" if last else f"CASE {' '.join(arms)} ELSE '{list(w)[-1]}' END"
    return f"SELECT *, CASE kind WHEN 'binary' THEN {pick(POOL, bits(key, 'func') + ' % 6')} WHEN 'prefix' THEN 'b1' WHEN 'postfix' THEN 'q1' END AS func_id, CASE WHEN kind = 'num' THEN {skewed(key, 'value', 0, 1000)} END AS value FROM (SELECT *, {kind} AS kind FROM ({select}))"


def _kids(parent: str, depth: int) -> str:
    return f"SELECT expr_id, (node_id * 2)::INT AS node_id, node_id AS parent_id, CASE WHEN kind = 'binary' THEN 'left' ELSE 'unary' END AS side, {depth}::INT AS depth FROM {parent} WHERE kind <> 'num' UNION ALL SELECT expr_id, (node_id * 2 + 1)::INT, node_id, 'right', {depth}::INT FROM {parent} WHERE kind = 'binary'"


def _tree(attempt: int = 0, mark: str = "") -> str:
    return (
        f"d0{mark} AS ({_level('SELECT o_orderkey AS expr_id, 1::INT AS node_id, NULL::INT AS parent_id, NULL::VARCHAR AS side, 0::INT AS depth FROM orders', False, True, attempt)}), "
        f"d1{mark} AS ({_level(_kids(f'd0{mark}', 1), False, False, attempt)}), d2{mark} AS ({_level(_kids(f'd1{mark}', 2), True, False, attempt)}), nodes{mark} AS (SELECT * FROM d0{mark} UNION ALL SELECT * FROM d1{mark} UNION ALL SELECT * FROM d2{mark})"
    )


TREE = _tree()
FORCED = (
    "WITH " + ", ".join(_tree(t, f"_{t}") for t in range(2)) + ", every AS (" + " UNION ALL ".join(f"SELECT {t} AS t, * FROM nodes_{t}" for t in range(2)) + "), has AS (SELECT expr_id, min(t) AS t FROM every WHERE kind = 'binary' GROUP BY 1), "
    "picked AS (SELECT every.* FROM every JOIN has USING (expr_id, t)), s AS (SELECT expr_id, arg_min(func_id, node_id) AS old FROM picked WHERE kind = 'binary' GROUP BY 1) "
    "SELECT expr_id, node_id, CASE WHEN func_id = old THEN 'l1' ELSE func_id END AS func_id FROM picked JOIN s USING (expr_id) "
    "UNION ALL SELECT o_orderkey, unnest([1, 2, 3])::INT, unnest(['l1', NULL, NULL]) FROM orders WHERE o_orderkey NOT IN (SELECT expr_id FROM has)"
)
SYMBOL = "CASE {f} WHEN 'p1' THEN '+' WHEN 'm1' THEN '-' WHEN 't1' THEN '*' WHEN 'd1' THEN '/' WHEN 'r1' THEN '%' WHEN 's1' THEN '⊕' WHEN 'b1' THEN '∇' WHEN 'q1' THEN '‰' END"
PRIORITY = "CASE {f} WHEN 'p1' THEN 1 WHEN 'm1' THEN 1 WHEN 't1' THEN 2 WHEN 'd1' THEN 2 WHEN 'r1' THEN 2 WHEN 's1' THEN 3 WHEN 'b1' THEN 4 WHEN 'q1' THEN 4 END"
DEFINITION = "CASE p.func_id WHEN 's1' THEN 'a⊕b = { ((a+b)*2) }' WHEN 'b1' THEN '∇a = { (a*a) , if a > 10 and (a % 2) == 0 ; (a+1) , else }' WHEN 'q1' THEN 'a‰ = { (a*a) }' ELSE 'None' END"
_QUOTIENT = "floor(l.v / nullif(r.v, 0))"
_SQUARED = "NOT isnan(l.v) AND l.v > 10 AND l.v % 2 = 0"
VALUE = (
    "CASE p.func_id WHEN 'p1' THEN l.v + r.v WHEN 'm1' THEN l.v - r.v WHEN 't1' THEN l.v * r.v WHEN 's1' THEN (l.v + r.v) * 2 WHEN 'q1' THEN l.v * l.v "
    f"WHEN 'd1' THEN CASE WHEN isnan(l.v) OR isnan(r.v) OR r.v = 0 THEN 'nan'::DOUBLE ELSE {_QUOTIENT} END WHEN 'r1' THEN CASE WHEN isnan(l.v) OR isnan(r.v) OR r.v = 0 THEN 'nan'::DOUBLE ELSE l.v - r.v * {_QUOTIENT} END "
    f"WHEN 'b1' THEN CASE WHEN {_SQUARED} THEN l.v * l.v ELSE l.v + 1 END END"
)
COST = f"CASE p.func_id WHEN 's1' THEN 2 WHEN 'b1' THEN CASE WHEN {_SQUARED} THEN 2 ELSE 1 END ELSE 1 END"


def spelled(v: str, nan: str = "NaN") -> str:
    return f"CASE WHEN isnan({v}) THEN '{nan}' ELSE ({v})::BIGINT::VARCHAR END"


def _show(name: str, brackets: bool) -> str:
    sym, o, c = SYMBOL.format(f="p.func_id"), "'(' || " if brackets else "", " || ')'" if brackets else ""

    def child(x: str, wrong: str) -> str:
        own = PRIORITY.format(f="p.func_id")
        need = "false" if brackets else f"{x}.kind = 'binary' AND ({x}.pr < {own} OR {x}.pr = {own} AND {wrong})"
        return f"CASE WHEN {need} THEN '(' || {x}.{name} || ')' ELSE {x}.{name} END"

    left, right = child("l", "p.func_id = 's1'"), child("r", "p.func_id <> 's1'")
    return f"CASE WHEN p.kind = 'binary' THEN {o}{left} || {sym} || {right}{c} WHEN p.kind = 'postfix' THEN '(' || {child('l', 'false')} || {sym} || ')' ELSE '(' || {sym} || {child('l', 'false')} || ')' END"


def _up(d: int, below: str, brackets: bool) -> str:
    digits = lambda v: f"length(({v})::BIGINT::VARCHAR)"
    longer = f"CASE WHEN isnan({VALUE}) OR isnan(l.v) OR (p.kind = 'binary' AND isnan(r.v)) THEN false ELSE {digits(VALUE)} > {digits('l.v')} AND (p.kind <> 'binary' OR {digits(VALUE)} > {digits('r.v')}) END"
    sym, shown = SYMBOL.format(f="p.func_id"), lambda v: spelled(v, "nan")
    step = f"CASE WHEN p.kind = 'binary' THEN {shown('l.v')} || {sym} || {shown('r.v')} WHEN p.kind = 'postfix' THEN {shown('l.v')} || {sym} ELSE {sym} || {shown('l.v')} END || '=' || {shown(VALUE)}"
    info = (
        f"CASE WHEN p.kind = 'num' THEN 'number node, value=' || p.value WHEN p.kind = 'binary' THEN 'compute binary expreesion, left_input=' || {shown('l.v')} || ', right_input=' || {shown('r.v')} || ', op_id = ' || p.func_id || ' binary_op_definition= ''' || {DEFINITION} "
        f"ELSE 'compute unary expreesion, input=' || {shown('l.v')} || ', op_id = ' || p.func_id || ', unary_op_definition = ''' || {DEFINITION} END || CASE WHEN p.kind = 'num' THEN '' ELSE ''', output=' || {shown(VALUE)} END"
    )
    json = "CASE WHEN p.kind = 'binary' THEN '{\"type\":\"binary\",\"op\":\"' || p.func_id || '\",\"l\":' || l.json || ',\"r\":' || r.json || '}' ELSE '{\"type\":\"unary\",\"op\":\"' || p.func_id || '\",\"l\":' || l.json || '}' END"
    leaf = _leaf("p")
    return (
        f"SELECT p.*, CASE WHEN p.kind = 'num' THEN {leaf['v']} ELSE {VALUE} END AS v, CASE WHEN p.kind = 'num' THEN 0 ELSE {COST} + l.degree + coalesce(r.degree, 0) END AS degree, "
        f"CASE WHEN p.kind = 'num' THEN {leaf['t']} ELSE {_show('t', brackets)} END AS t, CASE WHEN p.kind = 'num' THEN {leaf['nb']} ELSE {_show('nb', brackets)} END AS nb, CASE WHEN p.kind = 'num' THEN {leaf['json']} ELSE {json} END AS json, "
        f"CASE WHEN p.kind = 'num' THEN false ELSE ({longer}) OR l.longer OR coalesce(r.longer, false) END AS longer, {PRIORITY.format(f='p.func_id')} AS pr, CASE WHEN p.kind <> 'num' THEN {step} END AS step, {info} AS info "
        f"FROM d{d} p LEFT JOIN {below} l ON l.expr_id = p.expr_id AND l.parent_id = p.node_id AND l.side <> 'right' LEFT JOIN {below} r ON r.expr_id = p.expr_id AND r.parent_id = p.node_id AND r.side = 'right'"
    )


def _leaf(p: str) -> dict:
    return {"v": f"{p}.value::DOUBLE", "t": f"{p}.value::VARCHAR", "nb": f"'$' || {p}.value::VARCHAR || '$'", "json": f"'{{\"type\":\"numeric_atoms\",\"value\":' || {p}.value::VARCHAR || '}}'"}


def fold(brackets: bool = False) -> str:
    leaf = _leaf("d2")
    base = f"u2 AS (SELECT *, {leaf['v']} AS v, 0 AS degree, {leaf['t']} AS t, {leaf['nb']} AS nb, {leaf['json']} AS json, false AS longer, NULL::INT AS pr, NULL::VARCHAR AS step, 'number node, value=' || value AS info FROM d2)"
    return f"WITH {TREE}, {base}, u1 AS ({_up(1, 'u2', brackets)}), u0 AS ({_up(0, 'u1', brackets)}), u AS (SELECT * FROM u0 UNION ALL SELECT * FROM u1 UNION ALL SELECT * FROM u2)"


# In post-order a node comes after its children: both heap children of 1 before it, and so on.
POST = "CASE node_id WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 2 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN 5 WHEN 3 THEN 6 ELSE 7 END"
PRE = "CASE node_id WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END"
USED = f"used AS (SELECT expr_id, list(func_id ORDER BY nth) AS fs FROM (SELECT expr_id, func_id, min({PRE}) AS nth FROM u WHERE kind <> 'num' GROUP BY 1, 2) GROUP BY expr_id)"
AGG = "agg AS (SELECT expr_id, count(DISTINCT pr)::INT AS prs, count(*)::INT AS ops FROM u WHERE kind <> 'num' GROUP BY expr_id)"
ROOT = fold() + f", {AGG}, rt AS (SELECT u0.expr_id AS id, u0.t, u0.nb, u0.v, u0.degree, u0.json, prs, ops FROM u0 JOIN agg USING (expr_id))"
DEPS = "CASE f WHEN 's1' THEN ['p1', 't1'] WHEN 'b1' THEN ['p1', 'r1', 't1'] WHEN 'q1' THEN ['t1'] ELSE []::VARCHAR[] END"

_clamp = "CASE WHEN abs(@) > 2147483647 THEN 'inf'::DOUBLE ELSE @ END"


def _loop(step: str, start: str) -> str:
    t = _clamp.replace("@", f"({step})")
    return f"list_reduce(range(abs(b)), lambda r, i: CASE WHEN b > 0 THEN {t} ELSE -({t}) END, ({start})::DOUBLE)".replace("range(abs(b))", "list_transform(range(abs(b)), lambda i: i::DOUBLE)")


def _text(v: str) -> str:
    return f"CASE WHEN isnan({v}) THEN 'NaN' WHEN {v} = 'inf'::DOUBLE THEN 'Inf' WHEN {v} = '-inf'::DOUBLE THEN '-Inf' ELSE ({v})::HUGEINT::VARCHAR END"


_floor_mod = lambda x, y: f"({x} - {y} * floor({x}::DOUBLE / {y})::BIGINT)"
_RULES = {
    "dependency_export": f"WITH RECURSIVE {WIDE}, e AS (SELECT unnest(dependencies) AS src, func_id AS dst FROM cat), r AS (SELECT func_id, 0 AS level FROM cat UNION SELECT dst, level + 1 FROM r JOIN e ON src = r.func_id), m AS (SELECT func_id, max(level)::INT AS level FROM r GROUP BY 1), d AS (SELECT src, list(DISTINCT dst ORDER BY dst) AS derived FROM e GROUP BY src) SELECT m.func_id AS primitive_op_id, coalesce(derived, []::VARCHAR[]) AS derived_op_id_list, level FROM m LEFT JOIN d ON d.src = m.func_id",
}
_def_key, _sh = "o_orderkey", shape("o_orderkey")
_lhs = "CASE shape WHEN 'binary' THEN 'a⊛b' WHEN 'prefix' THEN '⊛a' ELSE 'a⊛' END"
_code_text = "chr(code)"
_bodies = "regexp_replace(op_compute_func, '^[^\\n]*\\n', '')"
_uses = f"regexp_matches({_bodies}, '(^|\\W)a(\\W|$)') AND (n_ary = 1 OR regexp_matches({_bodies}, '(^|\\W)b(\\W|$)'))"
_wrapper = f"CASE WHEN n_ary = 1 THEN regexp_matches({_bodies}, '^\\s*return op_\\w+\\(a\\)\\s*$') ELSE regexp_matches({_bodies}, '^\\s*return op_\\w+\\((a, b|b, a|a, a|b, b)\\)\\s*$') END"
_returns = "regexp_extract_all(op_compute_func, 'return ([^\\n]*)', 1)"
_prop = {v: f"({between('id', f'prop{v}', 0, 2**32 - 2)} - {2**31 - 1})" for v in "ab"}

_drawn = lambda t: "substr(" + " || ".join(f"s[({bits('key', f'sign{t}/{k}')} % 629)::INT + 1]" for k in range(3)) + f", 1, ({between('key', f'length{t}', 1, 3)})::INT)"
_number = " || ".join(f"s[((key // {629**k}) % 629)::INT + 1]" for k in range(6))
SYMBOLS = (
    f"WITH {CAT}, a AS (SELECT list(chr(code::INT) ORDER BY nth) AS s FROM (SELECT unnest(list_concat(list_concat(range(8704, 8960), range(10752, 11008)), list_concat(range(8592, 8704), [43, 45, 42, 47, 37]))) AS code, unnest(range(629)) AS nth)), "
    f"tried AS (SELECT o_orderkey AS key, 0 AS t, d0 AS symbol FROM (SELECT *, {_drawn(0).replace('key', 'o_orderkey')} AS d0 FROM orders, a) UNION ALL SELECT o_orderkey, 1, {_drawn(1).replace('key', 'o_orderkey')} FROM orders, a UNION ALL SELECT o_orderkey, 2, {_drawn(2).replace('key', 'o_orderkey')} FROM orders, a), "
    "free AS (SELECT key, arg_min(symbol, t) AS symbol FROM tried WHERE symbol NOT IN (SELECT symbol FROM cat) GROUP BY key), won AS (SELECT symbol, min(key) AS key FROM free GROUP BY symbol), "
    f"named AS (SELECT o.key, coalesce(won.symbol, o.number) AS symbol FROM (SELECT key, {_number} AS number FROM (SELECT o_orderkey AS key, s FROM orders, a)) o LEFT JOIN won ON won.key = o.key)"
)

SINGLES = (*POOL, "b1", "q1")
_PER_OP = "(SELECT *, f || '/' || i AS op_key FROM (SELECT i, [" + ", ".join(f"'{f}'" for f in SINGLES) + "][(i // 1000)::INT + 1] AS f FROM range(8000) t(i)))"


def _single(id_: str, key: str, func: str, source: str) -> str:
    """(id, func_id, expression, value, cost) of one operator over drawn numbers."""
    drawn = f"SELECT {id_} AS id, {{'func_id': {func}}} AS p, {{'v': {skewed(key, 'left', 0, 1000)}::DOUBLE}} AS l, {{'v': {skewed(key, 'right', 0, 1000)}::DOUBLE}} AS r FROM {source}"
    sym, x, y = SYMBOL.format(f="p.func_id"), spelled("l.v"), spelled("r.v")
    shown = f"CASE p.func_id WHEN 'b1' THEN '(' || {sym} || {x} || ')' WHEN 'q1' THEN '(' || {x} || {sym} || ')' ELSE {x} || {sym} || {y} END"
    return f"SELECT id, p.func_id AS func_id, {shown} AS expression, {spelled(VALUE)} AS value, ({COST})::BIGINT AS cost FROM ({drawn})"


ORACLES: dict[str, str] = _RULES | {
    "catalog_load": f"WITH {WIDE} SELECT {FIELDS} FROM cat UNION ALL SELECT NULL, 'ok1', '#', 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL",
    "operator_record_parse": "SELECT i AS line, i = 5 AS ok, CASE WHEN i = 5 THEN 'ok1' END AS func_id FROM range(6) t(i)",
    "operator_to_json": f"WITH {WIDE} SELECT func_id, to_json({{{', '.join(f'{c!r}: {c}' for c in FIELDS.split(', '))}}})::VARCHAR AS json FROM cat",
    "operator_project": f"WITH {WIDE} SELECT {FIELDS} FROM cat",
    "catalog_save": f"WITH {WIDE} SELECT {FIELDS} FROM cat",
    "op_source_dump": f"WITH {WIDE} SELECT id AS place, func_id, '# Operator ID: ' || func_id || ' - op_compute_func' || chr(10) || op_compute_func || chr(10) || chr(10) || '# Operator ID: ' || func_id || ' - op_count_func' || chr(10) || op_count_func || chr(10) || chr(10) AS text FROM cat WHERE op_compute_func IS NOT NULL UNION ALL SELECT 0, NULL, 'thres = 2147483647' || chr(10) || chr(10)",
    "catalog_read_keyed": "SELECT 'f' || l_partkey AS func_id, max(l_orderkey * 8 + l_linenumber) AS line, arg_max(l_suppkey, l_orderkey * 8 + l_linenumber) AS payload FROM lineitem WHERE l_partkey % 7 <> 0 GROUP BY l_partkey",
    "nonbase_func_ids": f"WITH {WIDE} SELECT func_id FROM cat WHERE is_base IS NULL",
    "existing_count": f"SELECT {len(X.records()) + len(BAD_LINES)}::BIGINT AS there, 0::BIGINT AS absent",
    "op2expr": f"WITH {TREE} SELECT func_id AS op_id, expr_id // 4096 AS bucket, list(DISTINCT expr_id ORDER BY expr_id) AS expr_id FROM nodes WHERE func_id IS NOT NULL GROUP BY 1, 2",
    "lookup_func_id": f"WITH {CAT}, w AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'p' ELSE 'l' END || l_linenumber AS func_id FROM lineitem) SELECT w.func_id, symbol IS NOT NULL AS found, symbol FROM w LEFT JOIN cat USING (func_id)",
    "lookup_symbol": f"WITH {WIDE_X} SELECT func_id, symbol FROM cat WHERE symbol = '⊕'",
    "distinct_symbols": f"WITH {WIDE_X} SELECT DISTINCT symbol FROM cat",
    "resolve_overload": "SELECT * FROM (VALUES ('⊕', 2::INT, NULL::VARCHAR, 's1'), ('∇', 1, 'prefix', 'b1'), ('∇', 1, 'postfix', NULL), ('?', 2, NULL, NULL), ('‰', 1, 'postfix', 'q1')) t(symbol, n_ary, unary_position, func_id)",
    "lookup_base": f"WITH {WIDE} SELECT func_id, symbol, is_base FROM cat WHERE is_base = 16",
    "arity_partition": f"WITH {WIDE_X} SELECT coalesce(unary_position, 'binary') AS shape, list(func_id ORDER BY func_id) AS func_ids FROM cat GROUP BY 1",
    "sort_by_priority": f"WITH {WIDE} SELECT func_id, priority, row_number() OVER (ORDER BY priority, id) AS place FROM cat",
    "generation_pool": f"WITH {WIDE} SELECT func_id, coalesce(unary_position, 'binary') AS shape FROM cat WHERE is_base IS NULL",
    "order_pool": f"WITH {WIDE} SELECT func_id, n_order = 2 AS is_target FROM cat WHERE n_order <= 2",
    "recursive_call_pool": f"SELECT o_orderkey AS key, {pick(('l1', 'l2'), bits('o_orderkey', 'callee') + ' % 2')} AS func_id FROM orders",
    "catalog_add": f"WITH {X.catalog_sql([POSTFIX])} SELECT func_id, symbol FROM cat",
    "catalog_remove": f"WITH {WIDE} SELECT func_id FROM cat WHERE func_id <> 's1'",
    "catalog_update": f"WITH {WIDE} SELECT func_id, CASE WHEN func_id = 's1' THEN '⊎' ELSE symbol END AS symbol, CASE WHEN func_id <> 's1' THEN n_order END AS n_order FROM cat",
    "temporary_flag": f"WITH {WIDE} SELECT func_id, func_id = 'b1' AS is_temporary FROM cat",
    "cascade_closure": f"WITH RECURSIVE {WIDE}, e AS (SELECT unnest(dependencies) AS src, func_id AS dst FROM cat), r AS (SELECT 'p1' AS func_id UNION SELECT dst FROM e JOIN r ON src = r.func_id) SELECT func_id FROM r",
    "cascade_delete": f"WITH RECURSIVE {WIDE}, e AS (SELECT unnest(dependencies) AS src, func_id AS dst FROM cat), r AS (SELECT 'p1' AS func_id UNION SELECT dst FROM e JOIN r ON src = r.func_id) SELECT func_id FROM cat WHERE func_id NOT IN (SELECT func_id FROM r)",
    "renumber": f"WITH {WIDE}, n AS (SELECT func_id, row_number() OVER (ORDER BY func_id) AS new_id, dependencies FROM cat) SELECT func_id, new_id, list_transform(dependencies, lambda d: (SELECT m.new_id FROM n m WHERE m.func_id = d)) AS new_dependencies FROM n".replace("list_transform(dependencies, lambda d: (SELECT m.new_id FROM n m WHERE m.func_id = d))", "coalesce((SELECT list(m.new_id ORDER BY list_position(n.dependencies, m.func_id)) FROM n m WHERE list_contains(n.dependencies, m.func_id)), []::BIGINT[])"),
    "symbol_dedupe": f"WITH {CAT_X} SELECT func_id, CASE func_id WHEN 'z9' THEN '∀' ELSE symbol END AS symbol FROM cat",
    "extract_deps": f"WITH {WIDE} SELECT func_id, coalesce(list_filter(list_distinct_ordered, lambda x: x <> func_id), []::VARCHAR[]) AS deps FROM (SELECT func_id, (SELECT list(d ORDER BY nth) FROM (SELECT d, min(nth) AS nth FROM (SELECT unnest(ds) AS d, generate_subscripts(ds, 1) AS nth FROM (SELECT regexp_extract_all(op_compute_func, 'op_(\\w+)\\(', 1) AS ds)) GROUP BY d)) AS list_distinct_ordered FROM cat)",
    "calc_order": f"WITH {WIDE} SELECT func_id, n_order FROM cat WHERE is_base IS NULL",
    "dep_edges": f"WITH {WIDE} SELECT func_id AS dst, len(dependencies)::BIGINT AS in_degree FROM cat WHERE len(dependencies) > 0",
    "topo_sort": f"WITH RECURSIVE {WIDE}, e AS (SELECT unnest(dependencies) AS src, func_id AS dst FROM cat), r AS (SELECT func_id, 0 AS level FROM cat UNION SELECT dst, level + 1 FROM r JOIN e ON src = r.func_id), m AS (SELECT func_id, max(level)::INT AS level FROM r GROUP BY 1) SELECT func_id, level, row_number() OVER (ORDER BY level, func_id) AS place FROM m",
    "assign_priority": f"WITH RECURSIVE {WIDE}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY id, func_id) AS pos, bits // (4294967296 - bits) AS reach FROM (SELECT func_id, id, CASE unary_position WHEN 'prefix' THEN 0 WHEN 'postfix' THEN 1 ELSE 2 END AS phase, {bits('func_id', 'priority')} AS bits FROM cat)), "
    "u(phase, k, pos) AS (SELECT phase, 0::BIGINT, 0::BIGINT FROM (VALUES (0), (1)) v(phase) UNION ALL SELECT u.phase, u.k + 1, min(r.pos) FROM u JOIN r ON r.phase = u.phase AND r.pos > u.pos AND r.reach >= u.k GROUP BY 1, 2), "
    "w(phase, k, pos) AS (SELECT 2, count(*) FILTER (pos > 0), 0::BIGINT FROM u UNION ALL SELECT w.phase, w.k + 1, min(r.pos) FROM w JOIN r ON r.phase = 2 AND r.pos > w.pos AND r.reach >= w.k GROUP BY 1, 2), "
    "o AS (SELECT * FROM u UNION ALL SELECT * FROM w), p AS (SELECT r.func_id, r.phase, r.bits * (max(o.k) + 1) // 4294967296 AS c, max(o.k) AS n FROM r JOIN o ON o.phase = r.phase AND o.pos < r.pos GROUP BY r.func_id, r.phase, r.bits), "
    f"q AS (SELECT func_id, phase, c = n AS opens, c + 1 + CASE phase WHEN 1 THEN (SELECT max(k) FROM u WHERE phase = 0) ELSE 0 END AS priority FROM p), s AS (SELECT priority, CASE phase WHEN 0 THEN 'right' WHEN 1 THEN 'left' ELSE CASE {bits('func_id', 'priority/side')} % 2 WHEN 0 THEN 'left' ELSE 'right' END END AS side FROM q WHERE opens) SELECT func_id, priority, side FROM q JOIN s USING (priority)",
    "op_usage": f"WITH {TREE} SELECT expr_id, func_id, count(*) AS n FROM nodes WHERE func_id IS NOT NULL GROUP BY 1, 2",
    "base_convert": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{base_digits('((l_partkey - 1000) * l_linenumber)', b)} AS base{b}" for b in (2, 3, 16, 36)) + " FROM lineitem",
    "supported_bases": "SELECT i AS base FROM range(2, 37) t(i)",
    "base_literal": "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 2 WHEN 1 THEN 16 ELSE 10 END::INT AS base, CASE l_linenumber % 3 WHEN 0 THEN '⊞' || to_base(l_partkey, 2) WHEN 1 THEN '⊠' || to_base(l_partkey, 16) ELSE l_partkey::VARCHAR END AS literal FROM lineitem",
    "expr_rebase": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_linenumber = 7 THEN '$' || l_partkey ELSE to_base(l_partkey, {b}) || ' + ' || to_base(l_suppkey, {b}) END AS base{b}" for b in (2, 16)) + " FROM lineitem",
    "number_plain": f"SELECT l_orderkey, l_linenumber, '$' || b || '$' AS text FROM ({LINE})",
    "number_based": f"SELECT l_orderkey, l_linenumber, '⊠' || {base_digits('b', 16)} AS text FROM ({LINE})",
    "base_operators": "SELECT i::INT AS is_base, chr((8704 + i - 2)::INT) AS symbol, 1::INT AS n_ary, 'prefix' AS unary_position FROM range(2, 17) t(i)",
    "target_base_text": f"SELECT l_orderkey, l_linenumber, CASE b WHEN 0 THEN 'nan' WHEN -1 THEN 'inf' WHEN -2 THEN '-inf' ELSE '⊠' || to_base(a, 16) END AS text FROM ({LINE})",
    "skewed_value": f"SELECT o_orderkey, {skewed('o_orderkey', 'value', 0, 1000)} AS value FROM orders",
    "random_base": f"SELECT o_orderkey, {between('o_orderkey', 'base', 2, 16)} AS base FROM orders",
    "atom_gen": f"SELECT o_orderkey, CASE WHEN {unit('o_orderkey', 'atom')} < 0.3::DOUBLE THEN CASE WHEN {bits('o_orderkey', 'name')} % 2 = 0 THEN 'a' ELSE 'b' END ELSE {skewed('o_orderkey', 'value', 0, 1000)}::VARCHAR END AS atom FROM orders",
    "tree_gen": f"WITH {TREE} SELECT expr_id, node_id, parent_id, side, depth, kind, func_id, value FROM nodes",
    "order_tree_gen": FORCED,
    "single_op_expr": f"SELECT id, expression, value, cost, expression || '=' || value AS text FROM ({_single('o_orderkey', 'o_orderkey', pick(SINGLES, bits('o_orderkey', 'single') + ' % 8'), 'orders')})",
    "symbol_gen": f"{SYMBOLS} SELECT key, symbol FROM named",
    "symbol_alphabet": "SELECT code::INT AS code, chr(code::INT) AS symbol FROM (SELECT unnest(range(8704, 8960)) AS code UNION ALL SELECT unnest(range(10752, 11008)) UNION ALL SELECT unnest(range(8592, 8704)) UNION ALL SELECT unnest([43, 45, 42, 47, 37]))",
    "op_shape_gen": f"SELECT o_orderkey, {_sh} AS shape FROM orders",
    "cond_atom": f"SELECT o_orderkey, {condition('o_orderkey', 'c0', chr(39) + 'binary' + chr(39))} AS condition FROM orders",
    "cond_count": f"SELECT o_orderkey, {condition_count('o_orderkey')} AS n FROM orders",
    "cond_expr": f"SELECT o_orderkey, {condition_expression('o_orderkey', chr(39) + 'binary' + chr(39))} AS condition FROM orders",
    "cond_operand": f"SELECT o_orderkey, {operand('o_orderkey', 'c0', variable('o_orderkey', 'c0/var', chr(39) + 'binary' + chr(39)))} AS operand FROM orders",
    "recursive_operator_gen": recursive_operators("o_orderkey"),
    "eval_nested_loop": f"SELECT *, (CASE WHEN b >= 0 OR b % 2 = 0 THEN 1 ELSE -1 END * power(a, abs(b)))::BIGINT::VARCHAR AS value, greatest(abs(b) * greatest(a, 1), 1)::BIGINT AS cost FROM (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS a, (l_linenumber - 3)::BIGINT AS b FROM lineitem)",
    "lhs_gen": f"WITH {WIDE_X} SELECT func_id, CASE coalesce(unary_position, 'binary') WHEN 'binary' THEN 'a' || symbol || 'b' WHEN 'prefix' THEN symbol || 'a' ELSE 'a' || symbol END AS lhs FROM cat",
    "definition_gen": f"SELECT key, shape, definition_type, {_lhs} || ' = {{ ' || CASE WHEN definition_type = 'simple_definition' THEN {body('key', 'b0', 'shape')} ELSE {branches('key', 'shape')} END || ' }}' AS definition FROM (SELECT o_orderkey AS key, {_sh} AS shape, CASE WHEN {bits('o_orderkey', 'type')} % 2 = 0 THEN 'simple_definition' ELSE 'branch_definition' END AS definition_type FROM orders)",
    "definition_parse": "SELECT 'd' || o_orderkey AS func_id, o_orderkey % 9 <> 0 AS ok, o_orderkey % 9 <> 0 AS compiled FROM orders",
    "decompile": f"SELECT 'd' || key AS func_id, regexp_replace({body('key', 'b0', 'shape')}, ' ', '', 'g') AS definition FROM (SELECT o_orderkey AS key, {_sh} AS shape FROM orders WHERE {bits('o_orderkey', 'type')} % 2 = 0)",
    "decompile_flat": f"SELECT 'd' || key AS func_id, regexp_replace(regexp_replace(regexp_replace({branches('key', 'shape')}, '(\\([ab]) (\\S+) (\\d+\\))', '\\1\\2\\3', 'g'), '\\(((?:\\([^()]*\\)|[^()])* (?:and|or) (?:\\([^()]*\\)|[^()])*)\\)( ;| and| or)', '\\1\\2', 'g'), ' +', ' ', 'g') AS definition FROM (SELECT o_orderkey AS key, {_sh} AS shape FROM orders WHERE {bits('o_orderkey', 'type')} % 2 <> 0)",
    "definition_roundtrip": "SELECT 'd' || o_orderkey AS func_id, true AS same FROM orders",
    "compile_branches": f"SELECT 'd' || o_orderkey AS func_id, (1 + n)::INT AS returns, 1::INT AS ifs, (n - 1)::INT AS elifs FROM (SELECT o_orderkey, {between('o_orderkey', 'branches', 1, 2)} AS n FROM orders WHERE {bits('o_orderkey', 'type')} % 2 <> 0)",
    "eval_simple": f"SELECT *, ((a + b) * 2)::VARCHAR AS value, 2::BIGINT AS cost FROM ({LINE})",
    "eval_branch": f"SELECT *, CASE WHEN a > 10 AND a % 2 = 0 THEN a * a ELSE a + 1 END::VARCHAR AS value, CASE WHEN a > 10 AND a % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS cost FROM ({LINE})",
    "eval_loop": f"SELECT l_orderkey, l_linenumber, a, b, {_text('s')} AS sum_value, greatest(abs(b), 1)::BIGINT AS sum_cost, {_text('p')} AS power_value, greatest(abs(b), 1)::BIGINT AS power_cost FROM (SELECT *, {_loop('r + a', '0')} AS s, {_loop('r * a', 'a')} AS p FROM ({LINE}))",
    "call_binary": f"SELECT l_orderkey, l_linenumber, a, b, (a + b)::VARCHAR AS p1, (a - b)::VARCHAR AS m1, (a * b)::VARCHAR AS t1, CASE WHEN b = 0 THEN 'NaN' ELSE floor(a::DOUBLE / nullif(b, 0))::BIGINT::VARCHAR END AS d1, CASE WHEN b = 0 THEN 'NaN' ELSE {_floor_mod('a', 'nullif(b, 0)')}::VARCHAR END AS r1 FROM ({LINE})",
    "cmp": f"SELECT l_orderkey, l_linenumber, b <> 0 AND b <> 1 AND b = a % 5 AS eq, b <> 0 AND (b = 1 OR b > a % 5) AS gt, b <> 0 AND b <> 1 AND b < a % 5 AS lt, b <> 0 AND (b = 1 OR b >= a % 5) AS ge, b <> 0 AND b <> 1 AND b <= a % 5 AS le, b = 0 OR b = 1 OR b <> a % 5 AS ne FROM ({LINE})",
    "bool_and": f"SELECT l_orderkey, l_linenumber, a > 100 AND b < 2 AS both FROM ({LINE})",
    "bool_or": f"SELECT l_orderkey, l_linenumber, a > 100 OR b < 2 AS either FROM ({LINE})",
    "bool_not": f"SELECT l_orderkey, l_linenumber, b <= 0 AS negated FROM ({LINE})",
    "lit_nan": f"SELECT l_orderkey, l_linenumber, CASE WHEN a > 1000 THEN 'NaN' ELSE a::VARCHAR END AS value FROM ({LINE})",
    "loop_limit": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_linenumber > 4 THEN 'NaN' ELSE '0' END AS value{k}, CASE WHEN l_linenumber > 4 THEN 1 ELSE l_linenumber - 4 + {n} END::BIGINT AS cost{k}" for k, n in ((3, 1_000_000), (4, 1_000), (5, 100))) + " FROM lineitem",
    "loop_text": "SELECT * FROM (VALUES ('l1', 'a⇑b = { 0 , if b == 0 ; (a⇑(abs(b)-1))+a , if b > 0 ; -((a⇑(abs(b)-1))+a) , if b < 0 ; NaN , else }'), ('l2', 'a⤊b = { a , if b == 0 ; (a⤊(abs(b)-1))*a , if b > 0 ; -((a⤊(abs(b)-1))*a) , if b < 0 ; NaN , else }'), "
    "('l3', 'a⊗b = { 1 , if b == 0 ; (a⊗(abs(b)-1))⇑a , if b > 0 and abs(b) <= 1000000 ; -((a⊗(abs(b)-1))⇑a) , if b < 0 and abs(b) <= 1000000 ; NaN , else }')) t(func_id, definition)",
    "render_expr": f"{fold()} SELECT expr_id, t AS expression FROM u0",
    "render_brackets": f"{fold(True)} SELECT expr_id, t AS expression FROM u0",
    "render_no_base": f"{fold()} SELECT expr_id, nb AS expression FROM u0",
    "tree_json": f"{fold()} SELECT expr_id, json AS tree FROM u0",
    "eval_tree": f"{fold()} SELECT expr_id, {spelled('v')} AS result, degree::BIGINT AS degree FROM u0",
    "longer_result": f"{fold()} SELECT expr_id, longer AS flag FROM u0",
    "expansion_degree": f"{ROOT} SELECT id, degree::VARCHAR AS normalized_expansion_degree FROM rt",
    "result_text": f"{ROOT} SELECT id, {spelled('v')} AS result FROM rt",
    "highest_order": f"{ROOT} SELECT id, 1::INT AS highest_n_order FROM rt",
    "priority_complexity": f"{ROOT} SELECT id, prs AS priority_hierarchical_complexity FROM rt",
    "operation_count": f"{ROOT} SELECT id, ops AS operation_count FROM rt",
    "complexity_ratio": f"{ROOT} SELECT id, round(degree / ops::DOUBLE, 6) AS complexity_ratio FROM rt",
    "record_text": f"{ROOT} SELECT id, t || '=' || {spelled('v')} AS text FROM rt",
    "used_ops": f"{fold()}, {USED} SELECT expr_id AS id, fs AS used_operators FROM used",
    "dependent_ops": f"{fold()}, {USED} SELECT expr_id AS id, flatten(list_transform(fs, lambda f: {DEPS})) AS dependent_operators FROM used",
    "cot_trace": f"{fold()} SELECT expr_id AS id, row_number() OVER (PARTITION BY expr_id ORDER BY {POST}) - 1 AS step, step AS info, depth AS layer FROM u WHERE kind <> 'num'",
    "number_count": f"WITH {TREE} SELECT expr_id, count(*) FILTER (WHERE kind = 'num') AS n FROM nodes GROUP BY 1",
    "evaluate": f"{ROOT}, {USED}, tr AS (SELECT expr_id, to_json(list({{'info': info, 'layer': depth}} ORDER BY {POST}))::VARCHAR AS cot_info, to_json(list({{'info': step, 'layer': depth}} ORDER BY {POST}) FILTER (WHERE kind <> 'num'))::VARCHAR AS cot, bool_or(longer) AS longer FROM u GROUP BY expr_id) "
    f"SELECT id, nb AS expression_no_base_symbol, t AS expression, 1::INT AS highest_n_order, prs AS priority_hierarchical_complexity, degree::VARCHAR AS normalized_expansion_degree, ops AS operation_count, round(degree / ops::DOUBLE, 6) AS complexity_ratio, json AS tree, fs AS used_operators, "
    f"flatten(list_transform(fs, lambda f: {DEPS})) AS dependent_operators, {spelled('v')} AS result, '{{\"target_base\":10,\"flag\":' || longer || '}}' AS longer_result_info, cot_info, 10::INT AS base, 10::INT AS result_base, t || '=' || {spelled('v')} AS text, cot FROM rt JOIN used ON used.expr_id = id JOIN tr ON tr.expr_id = id",
    "uses_both_args": f"WITH {WIDE_X} SELECT func_id, {_uses} AS ok FROM cat WHERE op_compute_func IS NOT NULL AND n_ary = 2",
    "uses_arg": f"WITH {WIDE_X} SELECT func_id, {_uses} AS ok FROM cat WHERE op_compute_func IS NOT NULL AND n_ary = 1",
    "not_wrapper": f"WITH {WIDE_X} SELECT func_id, NOT ({_wrapper}) AS ok FROM cat WHERE op_compute_func IS NOT NULL",
    "distinct_returns": f"WITH {WIDE_X} SELECT func_id, len(list_distinct({_returns})) = len({_returns}) AS ok FROM cat WHERE op_compute_func IS NOT NULL",
    "body_hash": f"WITH {WIDE_X} SELECT func_id, sha256({_bodies}) AS hash FROM cat WHERE op_compute_func IS NOT NULL",
    "body_dedupe": f"WITH {WIDE_X} SELECT arg_min(func_id, id) AS func_id FROM cat WHERE op_compute_func IS NOT NULL AND {_bodies} NOT IN (SELECT {_bodies} FROM cat WHERE op_compute_func IS NOT NULL AND id <= 12 AND func_id <> 's1') GROUP BY {_bodies}",
    "order_match": "SELECT * FROM (VALUES ('l1'), ('l2')) t(func_id)",
    "accept_pipeline": f"WITH {CAT_X} SELECT min(func_id) AS func_id FROM cat WHERE op_compute_func IS NOT NULL AND len(dependencies) > 0 AND n_order = 1 AND ({_uses}) AND NOT ({_wrapper}) AND len(list_distinct({_returns})) = len({_returns}) GROUP BY {_bodies}",
    "property_check": f"WITH {CAT_X} SELECT func_id, true AS ok FROM cat WHERE op_compute_func IS NOT NULL AND len(dependencies) > 0 UNION ALL SELECT 't9', false",
    "generation_run": generation_run(),
    "layer_sizes": "SELECT * FROM (VALUES (1::INT, 43372::BIGINT), (2, 26023), (3, 15614), (4, 9368), (5, 5623)) t(layer, size)",
    "order_histogram": f"WITH {WIDE} SELECT i::INT AS n_order, count(n_order) AS n FROM range(1, 6) t(i) LEFT JOIN cat ON n_order = i GROUP BY i",
    "layer_deficit": f"WITH {WIDE}, s(layer, size) AS (VALUES (1, 43), (2, 26), (3, 15), (4, 9), (5, 7)) SELECT layer::INT AS layer, greatest(size - (SELECT count(*) FROM cat WHERE n_order = layer), 0)::BIGINT AS missing FROM s",
    "type_mix": f"SELECT o_orderkey, CASE WHEN k <= n * 0.2::DOUBLE // 1 THEN 'simple_definition' WHEN k <= 2 * (n * 0.2::DOUBLE // 1) THEN 'branch_definition' WHEN {bits('o_orderkey', 'mix')} % 2 = 0 THEN 'simple_definition' ELSE 'branch_definition' END AS definition_type FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n FROM orders)".replace("n * 0.2::DOUBLE // 1", "floor(n * 0.2::DOUBLE)"),
    "sequence_ids": f"WITH {WIDE} SELECT func_id, row_number() OVER (ORDER BY func_id) + 100 AS id FROM cat",
    "resume_topup": "SELECT i AS id, 1::BIGINT AS times FROM range(1, 101) t(i)",
    "per_op_corpus": f"SELECT id, func_id, expression || '=' || value AS text FROM ({_single('i', 'op_key', 'f', _PER_OP)})",
    "base_record": f"SELECT l_orderkey, l_linenumber, v::VARCHAR AS value, c AS cost, '⊠' || to_base(v, 16) AS literal, '(∇' || a || ')=' || v AS text FROM (SELECT *, CASE WHEN a > 10 AND a % 2 = 0 THEN a * a ELSE a + 1 END AS v, CASE WHEN a > 10 AND a % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS c FROM ({LINE}))",
    "count_branch": f"SELECT l_orderkey, l_linenumber, CASE WHEN a > 10 AND a % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS cost FROM ({LINE})",
    "count_loop": f"SELECT l_orderkey, l_linenumber, greatest(abs(b), 1)::BIGINT AS cost FROM ({LINE})",
    "call_prefix": f"SELECT l_orderkey, l_linenumber, (b + 1)::VARCHAR AS value FROM ({LINE})",
    "call_postfix": f"SELECT l_orderkey, l_linenumber, (b * b)::VARCHAR AS value FROM ({LINE})",
    "loop_args": f"SELECT l_orderkey, l_linenumber, a, b, {_text('x1')} AS rr, {_text('x2')} AS ra, {_text('x3')} AS rb, {_text('x2')} AS ar, {_text('x3')} AS br, {_text('y1')} AS rr_product, {_text('y2')} AS ra_product, {_text('y3')} AS rb_product, {_text('y2')} AS ar_product, {_text('y3')} AS br_product "
    f"FROM (SELECT *, {_loop('r + r', 'a')} AS x1, {_loop('r + a', 'a')} AS x2, {_loop('r + b', 'a')} AS x3, {_loop('r * r', 'a')} AS y1, {_loop('r * a', 'a')} AS y2, {_loop('r * b', 'a')} AS y3 FROM ({LINE}))",
    "valid_syntax": f"WITH {WIDE} SELECT func_id, true AS ok FROM cat WHERE op_compute_func IS NOT NULL UNION ALL SELECT 'bad', false",
    "expr_str": f"{fold(True)} SELECT expr_id, t AS expression, length(t)::BIGINT AS n_chars FROM u0",
    "cot_info_trace": f"{fold()} SELECT expr_id AS id, row_number() OVER (PARTITION BY expr_id ORDER BY {POST}) - 1 AS step, info, depth AS layer FROM u",
    "branch_gen": f"SELECT o_orderkey AS key, (1 + {between('o_orderkey', 'branches', 1, 2)})::INT AS branches FROM orders WHERE {bits('o_orderkey', 'type')} % 2 <> 0",
    "operator_gen": f"{SYMBOLS} SELECT key, 'g' || key AS func_id, symbol, CASE shape WHEN 'binary' THEN 2 ELSE 1 END::INT AS n_ary, CASE WHEN shape <> 'binary' THEN shape END AS unary_position, definition_type, {_lhs.replace(chr(39) + 'a⊛b' + chr(39), chr(39) + 'a' + chr(39) + ' || symbol || ' + chr(39) + 'b' + chr(39)).replace(chr(39) + '⊛a' + chr(39), 'symbol || ' + chr(39) + 'a' + chr(39)).replace(chr(39) + 'a⊛' + chr(39), chr(39) + 'a' + chr(39) + ' || symbol')} || ' = {{ ' || CASE WHEN definition_type = 'simple_definition' THEN {body('key', 'b0', 'shape')} ELSE {branches('key', 'shape')} END || ' }}' AS definition FROM (SELECT key, symbol, {shape('key')} AS shape, CASE WHEN {bits('key', 'type')} % 2 = 0 THEN 'simple_definition' ELSE 'branch_definition' END AS definition_type FROM named)",
    "combo_expr": f"{ROOT}, {USED} SELECT id, t || '=' || {spelled('v')} AS text, len(fs)::INT AS n_used FROM rt JOIN used ON used.expr_id = rt.id",
}
