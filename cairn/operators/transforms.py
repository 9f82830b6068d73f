"""Record transforms: pick, map, filter, sort, template, and a small workflow of them.

A path names a column, then fields, ``[i]`` or ``.i`` places of arrays and ``.length``. Below a
column listed in ``json`` it continues inside the JSON text. What does not resolve is null.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that no path may walk through.
BLOCKED = {"__proto__", "constructor", "prototype"}


def _steps(text: str) -> list[str | int]:
    out: list[str | int] = []
    for name, at in re.findall(r"([^.\[\]]+)|\[(\d+)\]", text):
        out.append(int(at) if at else int(name) if name.isdigit() and out else name)
    if any(x in BLOCKED for x in out):
        raise ValueError(f"path {text} is not allowed")
    return out


def _number_text(x: float) -> str:
    """A number as scripts write it: whole ones without a point, exponents only below 1e-6 and from 1e21."""
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        whole, _, rest = format(Decimal(repr(abs(x))), "f").partition(".")
        rest = rest.rstrip("0")
        return ("-" if x < 0 else "") + whole + (f".{rest}" if rest else "")
    mantissa, _, power = repr(x).partition("e")
    return f"{mantissa}e{int(power):+d}"


def _is_place(key: str) -> bool:
    return key.isascii() and key.isdigit() and str(int(key)) == key and int(key) < 2**32 - 1


def canonical_text(value) -> str:
    """A JSON value in one form: keys in order (whole numbers first), no white space, letters as they are."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: (0, int(k), b"") if _is_place(k) else (1, 0, k.encode("utf-16-be", "surrogatepass")))
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical_text(value[k]) for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_text, value)) + "]"
    if isinstance(value, float) or (isinstance(value, int) and not isinstance(value, bool)):
        return _number_text(float(value)) if math.isfinite(float(value)) else "null"
    return json.dumps(value, ensure_ascii=False)


def _hashes(texts: pd.Series) -> pd.Series:
    seen: dict[str, str | None] = {}
    for t in texts.dropna().unique():
        try:
            seen[t] = hashlib.sha256(canonical_text(json.loads(t)).encode("utf-8", "surrogatepass")).hexdigest()
        except (ValueError, OverflowError, RecursionError):
            seen[t] = None
    return texts.map(lambda t: seen.get(t))


def value_hash(c: Column | str) -> Column:
    """sha256 of the canonical form of the JSON value in each text, so that equal values have equal hashes.

    Null, and text that does not parse, give null. Arrow batches, each different text once.
    """
    return F.pandas_udf(_hashes, "string")(c)


def path(df: DataFrame, text: str, json: list[str] | None = None) -> Column:
    """The value at a path as a column; values inside JSON come as text."""
    steps = _steps(text)
    types = dict(df.dtypes)
    if not steps or steps[0] not in types:
        return F.lit(None).cast("string")
    c = F.col(f"`{steps[0]}`")
    rest = steps[1:]
    if steps[0] in (json or []) and rest:
        length = rest[-1] == "length"
        inner = "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in (rest[:-1] if length else rest))
        if not length:
            return F.get_json_object(c, inner)
        value = F.get_json_object(c, inner)
        return F.coalesce(F.json_array_length(value), F.length(value))
    field = df.schema[steps[0]].dataType
    for s in rest:
        kind = field.typeName()
        if s == "length" and kind in ("array", "string"):
            return F.size(c) if kind == "array" else F.length(c)
        if kind == "array" and isinstance(s, int):
            c, field = F.get(c, F.lit(s)), field.elementType
        elif kind == "struct" and s in field.names:
            c, field = c.getField(s), field[s].dataType
        elif kind == "map":
            c, field = F.try_element_at(c, F.lit(s)), field.valueType
        else:
            return F.lit(None).cast("string")
    return c


def data_pick(df: DataFrame, fields: dict[str, str], json: list[str] | None = None) -> DataFrame:
    """One record of named paths for each record."""
    return df.select(*(path(df, p, json).alias(name) for name, p in fields.items()))


def data_map(array: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of each element of an array; a null array stays null."""
    return F.transform(array, make)


def clause(df: DataFrame, where: str, op: str, value=None, json: list[str] | None = None) -> Column:
    """One clause, never null. Order compares numbers (text that is none is false), ``eq`` and ``ne`` are strict."""
    c = path(df, where, json)
    kind = df.select(c.alias("x")).schema["x"].dataType.typeName()
    if op == "exists":
        return c.isNotNull()
    if op in ("eq", "ne"):
        same = c.eqNullSafe(F.lit(value))
        return same if op == "eq" else ~same
    if op in ("gt", "gte", "lt", "lte"):
        a, b = c.cast("string").try_cast("double"), F.lit(value).cast("string").try_cast("double")
        test = {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]
        return F.coalesce(test & ~F.isnan(a) & ~F.isnan(b), F.lit(False))
    if op == "contains":
        return F.coalesce(F.array_contains(c, value) if kind == "array" else F.contains(c, F.lit(value)), F.lit(False))
    if op == "icontains":
        low = str(value).lower()
        return F.coalesce(F.exists(c, lambda x: F.contains(F.lower(x), F.lit(low))) if kind == "array" else F.contains(F.lower(c), F.lit(low)), F.lit(False))
    if op == "in":
        return F.coalesce(c.isin(list(value)), F.lit(False))
    raise ValueError(f"no clause operator is named {op}")


def data_filter(df: DataFrame, clauses: list[tuple], mode: str = "all", json: list[str] | None = None) -> DataFrame:
    """Records that satisfy ``all`` or ``any`` of the clauses; no clause keeps every record."""
    tests = [clause(df, *c, json=json) for c in clauses]
    if not tests:
        return df
    return df.where(reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), tests))


def data_sort(df: DataFrame, keys: list[tuple[str, str, bool]], ties: list[str], json: list[str] | None = None) -> DataFrame:
    """Records by (path, type, descending) keys, null first ascending and last descending, then ties."""
    cast = {"string": "string", "number": "double", "date": "timestamp_ntz", "boolean": "boolean"}
    order = []
    for p, kind, down in keys:
        c = path(df, p, json).cast("string").try_cast(cast[kind])
        order.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return df.orderBy(*order, *ties)


def data_template(df: DataFrame, template: str, out: str, json: list[str] | None = None) -> DataFrame:
    """``df`` with a text in which each ``{{path}}`` is the value there; nested values come as JSON, null as nothing."""
    parts, last = [], 0
    for m in re.finditer(r"\{\{\s*([^{}]+?)\s*\}\}", template):
        parts.append(F.lit(template[last : m.start()]))
        c = path(df, m[1], json)
        kind = df.select(c.alias("x")).schema["x"].dataType.typeName()
        parts.append(F.coalesce(F.to_json(c) if kind in ("struct", "array", "map") else c.cast("string"), F.lit("")))
        last = m.end()
    return df.withColumn(out, F.concat(*parts, F.lit(template[last:])))


class Workflow:
    """Named steps from DataFrame to DataFrame; a step may refer to earlier results by their names.

    ``run`` gives all results. Nothing is computed until a result is used, so a dry run is a
    look at the plans; ``most_rows`` limits what each result hands out.
    """

    def __init__(self, most_rows: int | None = None):
        self.steps: list[tuple[str, Callable[..., DataFrame], tuple[str, ...]]] = []
        self.most_rows = most_rows

    def step(self, name: str, make: Callable[..., DataFrame], *refs: str) -> Workflow:
        known = {n for n, _, _ in self.steps}
        if name in known or any(r not in known for r in refs):
            raise ValueError(f"step {name} is there already or refers to a later step")
        self.steps.append((name, make, refs))
        return self

    def run(self) -> dict[str, DataFrame]:
        done: dict[str, DataFrame] = {}
        for name, make, refs in self.steps:
            df = make(*(done[r] for r in refs))
            done[name] = df if self.most_rows is None else df.limit(self.most_rows)
        return done
