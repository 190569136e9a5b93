"""Settings from a configuration file: nested keys by indentation, lists, and plain or quoted scalars."""

from __future__ import annotations

import ast
import re
from dataclasses import replace

from pyspark.sql import SparkSession

from ..config import DEFAULT, Settings


class SettingsError(ValueError):
    pass


def scalar(text: str):
    """A number, a truth value, null, a quoted or plain string, or a list in brackets."""
    text = text.strip()
    if text[:1] == "[" and text[-1:] == "]":
        return [scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", text[1:-1])]
    if text[:1] in ("'", '"'):
        try:
            return ast.literal_eval(text)
        except (SyntaxError, ValueError) as e:
            raise SettingsError(f"a quote is not closed: {text}") from e
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?\d*\.\d+([eE][-+]?\d+)?", text):
        return float(text)
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), text)


def parse(text: str) -> dict:
    """The file as nested dicts and lists. Blank lines and comments are left out; what is neither a key nor an item is an error."""
    lines = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"""((?:"[^"]*"|'[^']*'|[^"'#])*?)(?:(?<!\S)#.*)?$""", r"\1", raw, count=1).rstrip()
        if line.strip():
            lines.append((len(line) - len(line.lstrip()), line.strip(), number))
    value, rest = _block(lines, 0)
    if rest:
        raise SettingsError(f"line {rest[0][2]}: unexpected indentation")
    return value or {}


def _block(lines: list, depth: int):
    """The value that lines at this depth make up, and the lines after it."""
    out = None
    while lines and lines[0][0] >= depth:
        at, text, number = lines[0]
        if at > depth:
            if out is not None:
                raise SettingsError(f"line {number}: unexpected indentation")
            depth = at
        if text.startswith("- ") or text == "-":
            out = [] if out is None else out
            if not isinstance(out, list):
                raise SettingsError(f"line {number}: an item among keys")
            m = re.fullmatch(r"""-\s*([^"'\[\s][^:]*?)\s*:(?:\s+(.*))?""", text)
            out.append({_key(m[1]): scalar(m[2] or "")} if m else scalar(text[1:]))
            lines = lines[1:]
            continue
        m = re.fullmatch(r"""("[^"]*"|'[^']*'|[^:]+?)\s*:(?:\s+(.*))?""", text)
        if not m or out is not None and not isinstance(out, dict):
            raise SettingsError(f"line {number}: neither a key nor an item: {text}")
        out = {} if out is None else out
        lines = lines[1:]
        if m[2] is None and lines and (lines[0][0] > at or lines[0][0] == at and lines[0][1].startswith("-")):
            out[_key(m[1])], lines = _block(lines, lines[0][0])
        else:
            out[_key(m[1])] = scalar(m[2] or "")
    return out, lines


def _key(text: str):
    return scalar(text)


def settings_of(found: dict, default: Settings = DEFAULT) -> Settings:
    """Settings with what the file says; what it leaves out stays. Unknown keys are ignored."""
    between = lambda name, old: (found[name].get("min_value", old[0]), found[name].get("max_value", old[1])) if name in found else old
    kinds, atoms = found.get("expr_type_weights", {}), found.get("expr_atom_type_weights", {})
    shares = found.get("condition_probabilities")
    if shares is not None and not all(0 <= x <= 1 for x in shares.values()):
        raise SettingsError(f"probabilities are from 0 to 1: {shares}")
    names = {"binary": "binary", "prefix": "unary_prefix", "postfix": "unary_postfix", "atom": "atoms"}
    total = sum(atoms.values()) if atoms else 0
    base, result, longer = found.get("random_base", {}), found.get("result_base", {}), found.get("longer_result_compute", {})
    return replace(
        default,
        max_base=found.get("max_base", default.max_base),
        symbol_lengths=(found.get("operator_symbol_min_len", default.symbol_lengths[0]), found.get("operator_symbol_max_len", default.symbol_lengths[1])),
        condition_range=between("condition_numeric_range", default.condition_range),
        condition_weights=tuple(shares[k] for k in sorted(shares)) if shares else default.condition_weights,
        max_branches=found.get("max_if_branches", default.max_branches),
        value_range=between("expr_numeric_range", default.value_range),
        max_depth=found.get("expr_max_depth", default.max_depth),
        node_weights={k: float(kinds.get(v, default.node_weights[k])) for k, v in names.items()},
        variable_share=atoms.get("variable", 0) / total if total else default.variable_share,
        base=None if base.get("flag") else base.get("base", default.base),
        result_base=result.get("base", default.result_base),
        longer_result_base=longer.get("base", default.longer_result_base) if longer.get("flag", True) else None,
    )


def read(spark: SparkSession, path: str, default: Settings = DEFAULT) -> Settings:
    """Settings of a file in any store that Spark reads; a missing file is an error."""
    return settings_of(parse(spark.read.text(path, wholetext=True).first()[0]), default)
