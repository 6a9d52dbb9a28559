"""Sort models to order expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.storage import materialize


def natural_key(c: Column, width: int = 20) -> Column:
    """A key under which item9 comes before item10: lower case, each run of digits padded to width."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, width, "0")).otherwise(x)), "")


def order_columns(sort: list[dict], tie: str | None = None, natural: bool = False, reverse: bool = False) -> list[Column]:
    """Order of a sort model: nulls last in either direction unless told; ties by the key, descending if all are.

    reverse turns all of it around, for pages before a cursor. natural orders strings by natural_key.
    """
    out = []
    for s in sort:
        c = F.col(f"`{s['columnId']}`")
        c = natural_key(c) if natural and s.get("natural", True) else c
        down, first = s.get("direction", "asc") == "desc", s.get("nulls", "last") == "first"
        if reverse:
            down, first = not down, not first
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    if tie:
        down = tie_descends(sort) != reverse
        out.append(F.col(f"`{tie}`").desc() if down else F.col(f"`{tie}`").asc())
    return out


def positions(df: DataFrame, sort: list[dict], tie: str | None = None, natural: bool = False, name: str = "pos") -> DataFrame:
    """df with each row's place, from 1, in the whole order.

    Rows are dealt out by ranges of the order and written; a row's place is that in its range and the sizes of those before.
    """
    order = order_columns(sort, tie, natural)
    dealt = materialize(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__range__", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range__").agg(F.count("*").alias("n"))
    base = sizes.select("__range__", (F.sum("n").over(W.orderBy("__range__")) - F.col("n")).alias("__base__"))
    at = F.row_number().over(W.partitionBy("__range__").orderBy(*order_columns(sort, tie, natural)))
    return dealt.join(F.broadcast(base), "__range__").withColumn(name, (F.col("__base__") + at).cast("long")).drop("__range__", "__base__")  # a row for each partition


def tie_descends(sort: list[dict]) -> bool:
    return bool(sort) and all(s.get("direction", "asc") == "desc" for s in sort)


def apply_sort(df: DataFrame, sort: list[dict], tie: str | None = None, natural: bool = False) -> DataFrame:
    known = [s for s in sort if s["columnId"] in df.columns]
    return df.orderBy(*order_columns(known, tie, natural)) if known or tie else df
