"""Filter trees to boolean columns.

Grid semantics by default: a comparison with a null cell is false, also under `not`; strings compare without
regard to case; an unknown column matches nothing; an empty `or` matches nothing, an empty `and` or `not` all.
dialect="sql" instead compares strings with case, matches all rows for an empty `or` and for notIn [], and raises
on unknown columns. Under no `not`, leaves stay bare so that they reach the source as pushed filters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Further comparison operators: name -> (column, filter node) -> Column.
CUSTOM: dict[str, Callable[[Column, dict], Column]] = {}


def register_operator(name: str, build: Callable[[Column, dict], Column]) -> None:
    CUSTOM[name] = build


def _leaf(node: dict, schema: T.StructType, sql: bool) -> Column:
    name, op = node["columnId"], node["op"]
    if name not in schema.fieldNames():
        if sql:
            raise ValueError(f"unknown column {name!r}")
        return F.lit(False)
    c, text = F.col(f"`{name}`"), isinstance(schema[name].dataType, T.StringType)
    folds = not node.get("caseSensitive", sql)
    if op in CUSTOM:
        return CUSTOM[op](c, node)
    if op == "isNull":
        return c.isNull()
    if op == "isNotNull":
        return c.isNotNull()
    values = list(node.get("values") or [])
    if op in ("in", "notIn"):
        known = [v for v in values if v is not None]
        if op == "in":
            return c.isin(known) if known else F.lit(False)
        return c.isNotNull() & ~c.isin(known) if known else (F.lit(True) if sql else c.isNotNull())
    v = node.get("value")
    if op in ("contains", "notContains", "startsWith", "endsWith"):
        c = c.cast("string")
        x, needle = (F.lower(c), str(v).lower()) if folds else (c, str(v))
        if op == "notContains":
            return c.isNotNull() & ~x.contains(needle)
        return {"contains": x.contains, "startsWith": x.startswith, "endsWith": x.endswith}[op](needle)
    if op in ("between", "notBetween"):
        lo, hi = values
        inside = c.between(F.lit(lo), F.lit(hi))
        return inside if op == "between" else c.isNotNull() & ~inside
    if v is None:
        return F.lit(False)
    if isinstance(v, str) and text and folds:
        c, v = F.lower(c), v.lower()
    elif isinstance(v, str) and not text:
        v = F.lit(v).cast(schema[name].dataType)
    compare = {"eq": "__eq__", "neq": "__ne__", "lt": "__lt__", "lte": "__le__", "gt": "__gt__", "gte": "__ge__"}
    return getattr(c, compare[op])(v)


def to_column(node: dict | None, schema: T.StructType, dialect: str = "grid", _negated: bool = False) -> Column:
    """The boolean column of a filter tree; never null where a `not` stands above."""
    sql = dialect == "sql"
    if node is None:
        return F.lit(True)
    if node["type"] == "comparison":
        leaf = _leaf(node, schema, sql)
        return F.coalesce(leaf, F.lit(False)) if _negated and not sql else leaf
    below = node["filters"]
    if node["op"] == "not":
        return ~to_column(below[0], schema, dialect, True) if below else F.lit(True)
    parts = [to_column(x, schema, dialect, _negated) for x in below]
    if node["op"] == "and":
        return reduce(Column.__and__, parts, F.lit(True)) if len(parts) != 1 else parts[0]
    return reduce(Column.__or__, parts) if parts else F.lit(sql)


def apply_filter(df: DataFrame, node: dict | None, dialect: str = "grid") -> DataFrame:
    return df if node is None else df.where(to_column(node, df.schema, dialect))


def quick_filter(df: DataFrame, needle: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which some column's text contains needle, case aside."""
    parts = [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(needle.lower()), F.lit(False)) for c in columns or df.columns]
    return df.where(reduce(Column.__or__, parts))
