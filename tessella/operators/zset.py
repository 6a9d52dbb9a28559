"""Z-sets in batch: tables of entries (key, row, weight, seq), weight being signed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.aggregate import alias_of


def coalesce(entries: DataFrame, key: str = "key", row: str = "row", weight: str = "weight", seq: str = "seq") -> DataFrame:
    """One entry per key: weights summed, the last row, keys of weight 0 dropped."""
    return entries.groupBy(key).agg(F.max_by(row, seq).alias(row), F.sum(weight).alias(weight)).where(F.col(weight) != 0)


def integrate(entries: DataFrame, key: str = "key", row: str = "row", weight: str = "weight", seq: str = "seq") -> DataFrame:
    """The snapshot: each key's last entry where that adds the row."""
    last = entries.groupBy(key).agg(F.max_by(F.struct(F.col(row), F.col(weight)), seq).alias("x"))
    return last.where(F.col("x")[weight] > 0).select(key, F.col("x")[row].alias(row))


def map_rows(entries: DataFrame, row: Column, name: str = "row") -> DataFrame:
    return entries.withColumn(name, row)


def filter_rows(entries: DataFrame, test: Column) -> DataFrame:
    return entries.where(F.coalesce(test, F.lit(False)))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def distinct(state: DataFrame, delta: DataFrame, key: str = "key", weight: str = "weight") -> DataFrame:
    """+1 or -1 for keys whose presence (weight over 0) changes when delta joins state."""
    s = state.groupBy(key).agg(F.sum(weight).alias("__was__"))
    d = delta.groupBy(key).agg(F.sum(weight).alias("__by__"))
    both = d.join(s, key, "left").select(key, F.coalesce("__was__", F.lit(0)).alias("was"), F.col("__by__").alias("by"))
    change = (F.col("was") + F.col("by") > 0).cast("int") - (F.col("was") > 0).cast("int")
    return both.select(key, change.alias(weight)).where(F.col(weight) != 0)


def group_aggregate(entries: DataFrame, keys: list[str], aggs: list[dict], weight: str = "weight") -> DataFrame:
    """Aggregates of the rows that a Z-set holds, weights honoured: sum, count, avg; min and max over rows present.

    entries has the rows' columns flat. min and max first net the weights of equal rows, so a deleted row does not
    count; groups without rows are dropped.
    """
    w = F.col(weight)
    extremes = [a for a in aggs if a["fn"] in ("min", "max")]
    d = entries
    if extremes:
        rest = [c for c in entries.columns if c != weight]
        d = entries.groupBy(*rest).agg(F.sum(weight).alias(weight)).where(w != 0)

    def build(a: dict) -> Column:
        if a["fn"] == "count":
            return F.sum(w) if a["columnId"] == "*" else F.sum(F.when(F.col(a["columnId"]).isNotNull(), w).otherwise(0))
        x = F.col(a["columnId"])
        if a["fn"] == "sum":
            return F.coalesce(F.sum(x * w), F.lit(0))
        if a["fn"] == "avg":
            return F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0))
        if a["fn"] in ("min", "max"):
            return (F.min if a["fn"] == "min" else F.max)(F.when(w > 0, x))
        raise ValueError(f"{a['fn']} is not incremental")

    return d.groupBy(*keys).agg(F.sum(w).alias("__n__"), *[build(a).alias(alias_of(a)) for a in aggs]).where("__n__ > 0").drop("__n__")


def join_delta(a: DataFrame, da: DataFrame, b: DataFrame, db: DataFrame, on: list[str], weight: str = "weight") -> DataFrame:
    """The change of a join b: da with b, a with db and da with db, weights multiplied."""

    def times(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.withColumnRenamed(weight, "__w__")
        return x.join(y, on).withColumn(weight, F.col(weight) * F.col("__w__")).drop("__w__")

    return times(da, b).unionByName(times(a, db)).unionByName(times(da, db))


def top_k_delta(before: DataFrame, after: DataFrame, order: list[Column], k: int, key: str = "key") -> DataFrame:
    """-1 for rows that leave the first k and +1 for those that enter when before becomes after."""
    old, new = before.orderBy(*order).limit(k), after.orderBy(*order).limit(k)
    gone = old.join(new.select(key), key, "left_anti").withColumn("weight", F.lit(-1))
    return gone.unionByName(new.join(old.select(key), key, "left_anti").withColumn("weight", F.lit(1)))
