"""Aggregations, grouping trees and distinct values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUILT_IN = ("sum", "avg", "count", "countDistinct", "min", "max", "first", "last")
CUSTOM: dict[str, Callable[[Column], Column]] = {}


def register_aggregator(name: str, build: Callable[[Column], Column]) -> None:
    """Add an aggregation: column -> aggregate column, which may be a grouped pandas UDF."""
    if name in BUILT_IN:
        raise ValueError(f"{name} is built in")
    CUSTOM[name] = build


def alias_of(a: dict) -> str:
    return a.get("alias") or f"{a['fn']}_{a['columnId']}"


def aggregate_column(a: dict, columns: list[str], order: list[str] | None = None) -> Column:
    """An aggregation's column: nulls are left out, an empty sum is 0; first and last go by order."""
    fn, name = a["fn"], a["columnId"]
    if fn == "count" and name == "*":
        return F.count("*")
    if fn not in BUILT_IN and fn not in CUSTOM:
        raise ValueError(f"unknown aggregation {fn!r}")
    if name not in columns:
        return F.lit(None)
    c = F.col(f"`{name}`")
    if fn in CUSTOM:
        return CUSTOM[fn](c)
    if fn in ("first", "last"):
        if not order:
            raise ValueError("first and last need an order")
        by = F.when(c.isNotNull(), F.struct(*[F.col(f"`{o}`") for o in order]))
        return (F.min_by if fn == "first" else F.max_by)(c, by)
    if fn == "sum":
        return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))
    return {"avg": F.avg, "count": F.count, "countDistinct": F.count_distinct, "min": F.min, "max": F.max}[fn](c)


def aggregate(df: DataFrame, aggs: list[dict], order: list[str] | None = None) -> DataFrame:
    return df.agg(*[aggregate_column(a, df.columns, order).alias(alias_of(a)) for a in aggs])


def group(df: DataFrame, keys: list[str], aggs: list[dict], order: list[str] | None = None) -> DataFrame:
    """One row per group, a null key being a group of its own, with the row count as __count__."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("__count__"), *[aggregate_column(a, df.columns, order).alias(alias_of(a)) for a in aggs])


def group_tree(df: DataFrame, keys: list[str], aggs: list[dict], order: list[str] | None = None) -> DataFrame:
    """All levels of the grouping tree: the keys, __level__ (0 is the grand total), __count__ and the aggregates."""
    level = F.lit(len(keys)) - sum((F.grouping(k).cast("int") for k in keys), F.lit(0))
    return df.rollup(*[F.col(f"`{k}`") for k in keys]).agg(level.cast("int").alias("__level__"), F.count("*").alias("__count__"), *[aggregate_column(a, df.columns, order).alias(alias_of(a)) for a in aggs])


def open_rows(df: DataFrame, keys: list[str], aggs: list[dict], open_keys: list[list]) -> DataFrame:
    """Headers and leaf rows that show with these paths open, in display order.

    A header shows if its parent path is open, a leaf row if its whole path is. Columns: keys, __level__ (leaves are
    one deeper than the last group), __count__, aggregates, __row__ (the leaf row, null for headers).
    """
    tree = group_tree(df, keys, aggs).where("__level__ > 0")

    def opened(depth) -> Column:
        paths = [p for p in open_keys if len(p) == depth]
        tests = [F.lit(True) if not p else _all([F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in zip(keys, p, strict=False)]) for p in paths]
        return F.lit(depth == 0) if not tests else _any(tests)

    show = F.lit(False)
    for depth in range(1, len(keys) + 1):
        up = _all([opened(d) for d in range(1, depth)]) if depth > 1 else F.lit(True)
        show = show | ((F.col("__level__") == depth) & up)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    heads = tree.where(show).withColumn("__row__", F.lit(None).cast(df.select(row.alias("r")).schema["r"].dataType))
    leaves = df.where(_all([opened(d) for d in range(1, len(keys) + 1)])).select(*[F.col(f"`{k}`") for k in keys], F.lit(len(keys) + 1).alias("__level__"), F.lit(1).cast("long").alias("__count__"), row.alias("__row__"))
    out = heads.unionByName(leaves, allowMissingColumns=True)
    ends = [F.when(F.col("__level__") > i, F.lit(1)).otherwise(0) for i in range(len(keys))]
    return out.orderBy(*[x for e, k in zip(ends, keys, strict=True) for x in (e.asc(), F.col(f"`{k}`").asc_nulls_last())], "__level__")


def _all(cs: list[Column]) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & c
    return out


def _any(cs: list[Column]) -> Column:
    out = F.lit(False)
    for c in cs:
        out = out | c
    return out


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """value and count, most frequent first, then by value with null last; limit keeps so many of them."""
    out = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.col("value").asc_nulls_last())
    return out.limit(limit) if limit is not None else out


def selection_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, sum, avg, min, max of the finite numbers in a rectangle of cells."""
    cells = df.select(F.explode(F.array(*[F.expr(f"try_cast(`{c}` as double)") for c in columns])).alias("x")).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    return cells.agg(F.count("x").alias("count"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("sum"), F.avg("x").alias("avg"), F.min("x").alias("min"), F.max("x").alias("max"))


def hash_aggregate(df: DataFrame, key: str, value: str, mask: int | None = None) -> DataFrame:
    """sum and count by key; with a mask, keys that agree under it are one bucket."""
    k = F.col(key) if mask is None else F.col(key).bitwiseAND(F.lit(mask))
    return df.groupBy(k.alias("key")).agg(F.sum(value).alias("sum"), F.count("*").alias("count"))


def mask_filter(df: DataFrame, column: str, op: str, value: float) -> DataFrame:
    """df with a 0/1 column mask, null cells being 0."""
    c = F.col(column)
    test = {"eq": c == value, "neq": c != value, "lt": c < value, "lte": c <= value, "gt": c > value, "gte": c >= value}[op]
    return df.withColumn("mask", F.coalesce(test, F.lit(False)).cast("int"))
