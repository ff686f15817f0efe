"""Rules compiled to Column predicates, effect patterns, and code patterns with metavariables."""

from __future__ import annotations

import ast
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import wildcard_match
from ..sources.parsers import spread


def compiled(spec: dict) -> Column:
    """A predicate from a specification: ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": ...}`` or ``{"field", "op", "value"}``.

    Operators: is, in, like (stars), at_least, at_most, known.  Anything else is an error.
    """
    if len(spec) == 1:
        (kind, body), = spec.items()
        if kind in ("all", "any"):
            parts = [compiled(x) for x in body]
            return reduce(Column.__and__ if kind == "all" else Column.__or__, parts, F.lit(kind == "all")) if not parts else reduce(Column.__and__ if kind == "all" else Column.__or__, parts)
        if kind == "not":
            return ~compiled(body)
    field, op, value = F.col(spec["field"]), spec["op"], spec.get("value")
    known = {"is": lambda: field == value, "in": lambda: field.isin(*value), "like": lambda: wildcard_match(F.lit(value), field), "at_least": lambda: field >= value, "at_most": lambda: field <= value, "known": lambda: field.isNotNull()}
    if op not in known:
        raise ValueError(f"no operator is called {op}")
    return F.coalesce(known[op](), F.lit(False))


def findings(entities: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """rule_id, id: one pass over the entities for all rules."""
    hits = F.array_compact(F.array(*[F.when(compiled(spec), F.lit(name)) for name, spec in rules.items()]))
    return entities.select(F.explode(hits).alias("rule_id"), "id")


def effect_of(call: Column, patterns: list[tuple[str, str]], default: str = "UNKNOWN") -> Column:
    """The effect of the first pattern (stars) that a call's name matches; user patterns go first in the list."""
    out = F.lit(default)
    for pattern, effect in reversed(patterns):
        out = F.when(wildcard_match(F.lit(pattern), call), effect).otherwise(out)
    return out


def _meets(pattern, node, bound: dict[str, str]) -> bool:
    if isinstance(pattern, ast.Name) and pattern.id.startswith("META_"):
        text = ast.dump(node) if isinstance(node, ast.AST) else repr(node)
        return bound.setdefault(pattern.id, text) == text
    if type(pattern) is not type(node):
        return False
    if isinstance(pattern, ast.AST):
        return all(_meets(getattr(pattern, f), getattr(node, f), bound) for f in pattern._fields if f not in ("ctx", "type_comment", "kind"))
    if isinstance(pattern, list):
        return len(pattern) == len(node) and all(_meets(a, b, bound) for a, b in zip(pattern, node, strict=True))
    return pattern == node


def code_matches(files: DataFrame, pattern: str) -> DataFrame:
    """path, line, code of the expressions of Python files (path, content) that match a pattern; ``$X`` stands for any expression, the same one each time.

    A file that cannot be parsed has no matches.
    """
    wanted = ast.parse(pattern.replace("$", "META_"), mode="eval").body
    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("code", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for path, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tree = ast.parse(code or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                rows += [(path, n.lineno, ast.unparse(n)) for n in ast.walk(tree) if isinstance(n, ast.expr) and _meets(wanted, n, {})]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return spread(files).mapInArrow(run, "path string, line int, code string")


RULE = "path string, rule_id string, type string, call string, severity string, cwe string, error string"


def rules_of(files: DataFrame) -> DataFrame:
    """The rules of YAML (or, without a YAML library, JSON) files (path, content): a list, or a mapping with a list ``rules``.

    Each rule has an id and optionally type, call, severity (medium) and cwe.  A
    file that cannot be read is one row with its error.
    """
    names = [c.split()[0] for c in RULE.split(", ")]

    def run(batches):
        try:
            from yaml import YAMLError, safe_load
        except ImportError:
            from json import JSONDecodeError as YAMLError
            from json import loads as safe_load
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = safe_load(content or "") or []
                    found = found.get("rules") or [] if isinstance(found, dict) else found
                    rows += [(path, str(r["id"]), r.get("type"), r.get("call"), str(r.get("severity", "medium")).lower(), r.get("cwe"), None) for r in found]
                except (YAMLError, KeyError, TypeError, AttributeError) as e:
                    rows.append((path, None, None, None, None, None, type(e).__name__))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return spread(files).mapInArrow(run, RULE)
