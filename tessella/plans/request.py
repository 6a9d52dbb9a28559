"""Block requests: parsed, checked and compiled to one DataFrame each."""

from __future__ import annotations

import json
from collections import OrderedDict
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import aggregate, paging, pivot, tree
from tessella.operators.predicate import apply_filter


@dataclass(frozen=True)
class BlockRequest:
    """What a grid asks for; field names are those of its JSON form, in Python's spelling."""

    limit: int = 200
    cursor: str | None = None
    direction: str = "after"
    sort: list[dict] = field(default_factory=list)
    filter: dict | None = None
    grouping: dict | None = None
    aggregations: list[dict] = field(default_factory=list)
    pivot: dict | None = None
    columns: list[str] = field(default_factory=list)
    parent_id: Any = None
    request_id: str | None = None

    @classmethod
    def from_json(cls, data: str | dict) -> BlockRequest:
        d = dict(json.loads(data) if isinstance(data, str) else data)
        for a, b in (("parentId", "parent_id"), ("requestId", "request_id")):
            if a in d:
                d[b] = d.pop(a)
        unknown = set(d) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        r = cls(**{k: v for k, v in d.items() if v is not None})
        if r.direction not in ("after", "before"):
            raise ValueError("direction is after or before")
        if r.limit < 1:
            raise ValueError("limit is at least 1")
        return r

    def fingerprint(self) -> str:
        """Equal for requests that page through the same rows: all but cursor, direction, limit and request_id."""
        d = {k: v for k, v in asdict(self).items() if k not in ("cursor", "direction", "limit", "request_id")}
        return json.dumps(d, sort_keys=True, default=str, separators=(",", ":"))


class Source:
    """A table with a key that answers block requests."""

    def __init__(self, df: DataFrame, key: str, dialect: str = "grid", parent: str | None = None, natural: bool = False, cached: int = 50):
        self.df, self.key, self.dialect, self.parent, self.natural = df, key, dialect, parent, natural
        self._plans: OrderedDict[str, DataFrame] = OrderedDict()
        self._limit = cached

    def _known(self, names: list[str]) -> None:
        bad = [n for n in names if n not in self.df.columns]
        if bad:
            raise ValueError(f"unknown columns {bad}")

    def rows(self, r: BlockRequest) -> DataFrame:
        """All rows a request pages through, before seek, order and limit; plans are kept by fingerprint."""
        key = r.fingerprint()
        if key in self._plans:
            self._plans.move_to_end(key)
            return self._plans[key]
        self._known(r.columns)
        d = self.df
        if self.parent is not None:
            d = tree.children(d, r.parent_id, self.key, self.parent)
        d = apply_filter(d, r.filter, self.dialect)
        if r.pivot:
            d = pivot.pivot(d, r.pivot["rows"], r.pivot["columns"], r.pivot["measures"], order=[self.key])
        elif r.grouping and r.grouping["columns"]:
            self._known(r.grouping["columns"])
            d = aggregate.group(d, r.grouping["columns"], r.aggregations, [self.key])
        elif r.columns:
            d = d.select(*dict.fromkeys([*r.columns, self.key, *(s["columnId"] for s in r.sort)]))
        self._plans[key] = d
        while len(self._plans) > self._limit:
            self._plans.popitem(last=False)
        return d

    def plan(self, r: BlockRequest) -> DataFrame:
        """The block as a DataFrame: groups and pivots whole, in order of their keys; rows as a page."""
        d = self.rows(r)
        keys = r.pivot["rows"] if r.pivot else r.grouping["columns"] if r.grouping else None
        if keys:
            return d.orderBy(*[F.col(f"`{k}`").asc_nulls_last() for k in keys])
        sort = [s for s in r.sort if s["columnId"] in d.columns]
        return paging.page(d, r.limit, sort, self.key, r.cursor, r.direction)

    def fetch(self, r: BlockRequest, count: bool = False) -> dict:
        """rows, hasMore, next and previous cursor, and the total on request."""
        if r.pivot or r.grouping and r.grouping["columns"]:
            out = {"rows": [x.asDict() for x in self.plan(r).collect()], "hasMore": False, "next": None, "previous": None}
        else:
            d = self.rows(r)
            out = paging.fetch_page(d, r.limit, [s for s in r.sort if s["columnId"] in d.columns], self.key, r.cursor, r.direction)
        return out | ({"totalCount": self.rows(r).count()} if count else {}) | ({"requestId": r.request_id} if r.request_id else {})

    def block(self, index: int, size: int, r: BlockRequest) -> DataFrame:
        """The index-th block of size rows in the request's total order."""
        return paging.page(self.rows(r), size, r.sort, self.key, f"offset:{index * size}")

    def refresh(self, df: DataFrame) -> None:
        """Take a new table; what was planned on the old one is dropped."""
        self.df = df
        self._plans.clear()
