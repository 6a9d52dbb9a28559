"""Pivot and unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.aggregate import aggregate_column, alias_of

NULL = "∅"


def pivot(df: DataFrame, rows: list[str], columns: list[str], measures: list[dict], values: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """rows by columns by measures; a cell's column is alias__v1|v2, a null value is written ∅, an empty cell null.

    The pivoted values are looked up with one distinct query unless given as joined texts.
    """
    key = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL)) for c in columns])
    d = df.withColumn("__pivot__", key)
    if values is None:
        values = sorted((r[0] for r in d.select("__pivot__").distinct().collect()), key=lambda v: [(p == NULL, p) for p in v.split("|")])
    aggs = [(F.count(F.lit(1)) if m["fn"] == "count" and m["columnId"] == "*" else aggregate_column(m, df.columns, order)).alias(alias_of(m)) for m in measures]
    out = d.groupBy(*[F.col(f"`{r}`") for r in rows]).pivot("__pivot__", values).agg(*aggs)
    made = [(v if len(measures) == 1 else f"{v}_{alias_of(m)}", f"{alias_of(m)}__{v}") for v in values for m in measures]
    named = {a: b for a, b in made}
    return out.select(*[F.col(f"`{r}`") for r in rows], *[F.col(f"`{a}`").alias(b) for a, b in named.items()])


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "column", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)
