"""JSON intents (sort, filter, group, formula) checked against a schema and turned into request changes."""

from __future__ import annotations

import re
from dataclasses import replace

from tessella.plans.request import BlockRequest

OPS = {"eq", "neq", "lt", "lte", "gt", "gte", "in", "notIn", "contains", "notContains", "startsWith", "endsWith", "isNull", "isNotNull", "between", "notBetween"}
SIGNS = {"=": "eq", "==": "eq", "!=": "neq", "<>": "neq", "<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}


def check(intent: dict, columns: list[str]) -> list[str]:
    """What is wrong with an intent; an empty list if nothing is."""
    kind, bad = intent.get("kind"), []
    need = lambda c: bad.append(f"unknown column {c!r}") if c not in columns else None

    def walk(node: dict) -> None:
        if node.get("type") == "logical":
            if node.get("op") not in ("and", "or", "not"):
                bad.append(f"unknown operator {node.get('op')!r}")
            for x in node.get("filters", []):
                walk(x)
        else:
            need(node.get("columnId"))
            if node.get("op") not in OPS:
                bad.append(f"unknown operator {node.get('op')!r}")

    if kind == "sort":
        for s in intent.get("sort", []):
            need(s.get("columnId"))
            if s.get("direction") not in ("asc", "desc"):
                bad.append("direction is asc or desc")
    elif kind == "filter":
        if intent.get("filter"):
            walk(intent["filter"])
    elif kind == "group":
        for c in intent.get("columns", []):
            need(c)
        for a in intent.get("aggregations", []):
            if a.get("columnId") != "*":
                need(a.get("columnId"))
    elif kind == "formula":
        if not intent.get("targetColumn") or not intent.get("expression"):
            bad.append("formula needs targetColumn and expression")
    else:
        bad.append(f"unknown kind {kind!r}")
    return bad


def apply(request: BlockRequest, intent: dict, columns: list[str]) -> BlockRequest:
    if problems := check(intent, columns):
        raise ValueError("; ".join(problems))
    if intent["kind"] == "sort":
        return replace(request, sort=list(intent["sort"]), cursor=None)
    if intent["kind"] == "filter":
        return replace(request, filter=intent.get("filter"), cursor=None)
    if intent["kind"] == "group":
        return replace(request, grouping={"columns": list(intent["columns"]), "openKeys": []}, aggregations=list(intent.get("aggregations", [])), cursor=None)
    raise ValueError("a formula adds a column; it is no change of the request")


def from_text(text: str, columns: list[str]) -> dict | None:
    """An intent for plain phrases: "sort by X desc", "X >= 5", "group by X"; None for others."""
    by_name = {c.lower(): c for c in columns}
    if m := re.fullmatch(r"\s*(?:sort|order) by (\w+)(?: (asc|desc)(?:ending)?)?\s*", text, re.I):
        if c := by_name.get(m[1].lower()):
            return {"kind": "sort", "sort": [{"columnId": c, "direction": (m[2] or "asc").lower()}]}
    if m := re.fullmatch(r"\s*group by (\w+)\s*", text, re.I):
        if c := by_name.get(m[1].lower()):
            return {"kind": "group", "columns": [c], "aggregations": []}
    if m := re.fullmatch(r"\s*(\w+)\s*(==?|!=|<>|<=|>=|<|>)\s*(.+?)\s*", text):
        if c := by_name.get(m[1].lower()):
            value: object = m[3].strip("'\"")
            if re.fullmatch(r"-?\d+(\.\d+)?", m[3]):
                value = float(m[3]) if "." in m[3] else int(m[3])
            return {"kind": "filter", "filter": {"type": "comparison", "columnId": c, "op": SIGNS[m[2]], "value": value}}
    return None
