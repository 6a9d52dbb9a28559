"""Pages by keyset or offset cursors."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.ordering import order_columns, tie_descends


@dataclass(frozen=True)
class KeysetCursor:
    """The sort values and key of a page's outermost row."""

    sort_values: tuple
    row_id: Any

    def encode(self) -> str:
        return "ks:" + base64.b64encode(json.dumps({"s": list(self.sort_values), "r": self.row_id}, default=str, separators=(",", ":")).encode()).decode()


def decode_cursor(text: str | None) -> KeysetCursor | int | None:
    """A keyset cursor, an offset or None; raises ValueError for anything else."""
    if text is None:
        return None
    if text.startswith("offset:"):
        n = text[7:]
        if not n.isdigit():
            raise ValueError("bad offset cursor")
        return int(n)
    if not text.startswith("ks:"):
        raise ValueError("unknown cursor")
    try:
        d = json.loads(base64.b64decode(text[3:], validate=True))
        return KeysetCursor(tuple(d["s"] if "s" in d else d["sortValues"]), d["r"] if "r" in d else d["rowId"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("bad keyset cursor") from e


def cursor_from_row(row, sort: list[dict], key: str) -> KeysetCursor:
    return KeysetCursor(tuple(row[s["columnId"]] for s in sort), row[key])


def _beyond(c: Column, value: Any, down: bool, nulls_first: bool) -> Column:
    """Rows that come strictly after value under one sort key."""
    if value is None:
        return c.isNotNull() if nulls_first else F.lit(False)
    after = c < F.lit(value) if down else c > F.lit(value)
    return after if nulls_first else after | c.isNull()


def keyset_predicate(cursor: KeysetCursor, sort: list[dict], key: str, before: bool = False) -> Column:
    """Rows after (or before) the cursor: an or of prefix equalities, for mixed directions and nulls too."""
    keys = [(F.col(f"`{s['columnId']}`"), v, s.get("direction", "asc") == "desc", s.get("nulls", "last") == "first") for s, v in zip(sort, cursor.sort_values, strict=True)]
    keys.append((F.col(f"`{key}`"), cursor.row_id, tie_descends(sort), False))
    parts = []
    for i, (c, v, down, first) in enumerate(keys):
        same = [x.eqNullSafe(F.lit(y)) for x, y, _, _ in keys[:i]]
        parts.append(reduce(Column.__and__, [*same, _beyond(c, v, down != before, first != before)]))
    return reduce(Column.__or__, parts)


def page(df: DataFrame, limit: int, sort: list[dict], key: str, cursor: str | None = None, direction: str = "after") -> DataFrame:
    """One page as a plan: seek, top-n by the total order, rows in page order."""
    at, before = decode_cursor(cursor), direction == "before"
    if isinstance(at, KeysetCursor):
        df = df.where(keyset_predicate(at, sort, key, before))
    ordered = df.orderBy(*order_columns(sort, key, reverse=before))
    if isinstance(at, int):
        ordered = ordered.offset(at)
    out = ordered.limit(limit)
    return out.orderBy(*order_columns(sort, key)) if before else out


def fetch_page(df: DataFrame, limit: int, sort: list[dict], key: str, cursor: str | None = None, direction: str = "after") -> dict:
    """rows (at most limit), hasMore and the cursors of both ends; one row more than limit comes to the driver."""
    at = decode_cursor(cursor)
    rows = page(df, limit + 1, sort, key, cursor, direction).collect()
    more = len(rows) > limit
    rows = (rows[1:] if direction == "before" else rows[:limit]) if more else rows
    make = (lambda r, i: f"offset:{(at or 0) + i}") if isinstance(at, int) else (lambda r, i: cursor_from_row(r, sort, key).encode())
    return {"rows": [r.asDict() for r in rows], "hasMore": more, "next": make(rows[-1], len(rows)) if rows and more else None, "previous": make(rows[0], 0) if rows and cursor else None}
