"""Time travel over a log of row diffs (kind, version, pkey, fields).

kind is insert, update or delete; fields is a map; an update changes the fields it names, an insert sets all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff_between(log: DataFrame, low: int, high: int) -> DataFrame:
    """The diffs after version low up to high."""
    return log.where((F.col("version") > low) & (F.col("version") <= high))


def _fold(log: DataFrame) -> DataFrame:
    """(pkey, fields) of the rows alive after the log: per key, what came since its last insert or delete.

    Fields are merged with aggregates over (pkey, field), so a key of many diffs is summed before it moves.
    """
    start = log.where("kind <> 'update'").groupBy(F.col("pkey").alias("s_pkey")).agg(F.max(F.struct("version", "kind")).alias("s"))
    d = log.join(start, log["pkey"] == start["s_pkey"], "left").where("s is null or version >= s.version")
    last = d.groupBy("pkey").agg(F.max_by("kind", "version").alias("kind")).where("kind <> 'delete'").select("pkey")
    cells = d.where("kind <> 'delete'").select("pkey", "version", F.explode("fields").alias("k", "v"))
    newest = cells.groupBy("pkey", "k").agg(F.max_by(F.struct("v"), "version")["v"].alias("v"))
    rows = newest.groupBy("pkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("fields"))
    empty = F.create_map().cast(log.schema["fields"].dataType)
    return last.join(rows, "pkey", "left").select("pkey", F.coalesce("fields", empty).alias("fields"))


def snapshot_at(log: DataFrame, version: int, anchor: DataFrame | None = None, anchor_version: int = -1) -> DataFrame:
    """(pkey, fields) as of a version, from the start or from an anchor snapshot at an earlier version."""
    part = diff_between(log, anchor_version, version)
    if anchor is not None:
        part = anchor.select(F.lit("insert").alias("kind"), F.lit(anchor_version).cast("long").alias("version"), "pkey", "fields").unionByName(part.select("kind", "version", "pkey", "fields"))
    return _fold(part)


def branch(log: DataFrame, version: int) -> DataFrame:
    """A log that begins with the snapshot at a version, as inserts."""
    return snapshot_at(log, version).select(F.lit("insert").alias("kind"), F.lit(version).cast("long").alias("version"), "pkey", "fields")


def invert(log: DataFrame, low: int, high: int) -> DataFrame:
    """Diffs that undo what came after low up to high, newest first by undo_of."""
    w = W.partitionBy("pkey").orderBy("version")
    before = snapshot_at(log, low).select(F.lit("snapshot").alias("kind"), F.lit(low).cast("long").alias("version"), "pkey", "fields")
    d = before.unionByName(diff_between(log, low, high).select("kind", "version", "pkey", "fields"))
    # the row before each diff: fields since the last insert, merged in order
    runs = d.withColumn("run", F.sum(F.when(F.col("kind") == "update", 0).otherwise(1)).over(w))
    seen = F.collect_list("fields").over(W.partitionBy("pkey", "run").orderBy("version").rowsBetween(W.unboundedPreceding, 0))
    kind = log.schema["fields"].dataType
    merged = F.aggregate(seen, F.create_map().cast(kind), lambda a, m: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(m, k)), m))
    state = runs.withColumn("after", F.when(F.col("kind") == "delete", F.lit(None)).otherwise(merged))
    prior = state.withColumn("prior", F.lag("after").over(w)).where("kind <> 'snapshot'")
    undo = F.when(F.col("kind") == "insert", F.when(F.col("prior").isNull(), "delete").otherwise("insert")).when(F.col("kind") == "delete", "insert").otherwise("update")
    fields = F.when(F.col("kind") == "update", F.map_filter("prior", lambda k, v: F.map_contains_key(F.col("fields"), k))).otherwise(F.col("prior"))
    return prior.select(undo.alias("kind"), "pkey", fields.alias("fields"), F.col("version").alias("undo_of")).orderBy(F.desc("undo_of"))


def gaps(log: DataFrame, base: int = -1, width: int = 1_000_000) -> DataFrame:
    """(after, before) for each hole in the versions: diffs between them are missing; base -1 takes any first version.

    Versions are compared within ranges of width; only the ranges' last versions are put in one order.
    """
    v = log.select("version").distinct().withColumn("range", F.floor(F.col("version") / width))
    tops = v.groupBy("range").agg(F.max("version").alias("top"))
    carried = tops.select("range", F.lag("top").over(W.orderBy("range")).alias("carried"))
    d = v.join(carried, "range").withColumn("after", F.coalesce(F.lag("version").over(W.partitionBy("range").orderBy("version")), F.col("carried"), F.lit(base)))
    first = F.lit(base == -1) & (F.col("after") == base)
    return d.where((F.col("version") - F.col("after") > 1) & ~first).select("after", F.col("version").alias("before"))


def retain(log: DataFrame, from_version: int) -> DataFrame:
    """The log without diffs up to a version, which its snapshot replaces."""
    return branch(log, from_version).unionByName(log.where(F.col("version") > from_version).select("kind", "version", "pkey", "fields"))


def resync(log: DataFrame, from_version: int, limit: int = 10_000) -> tuple[str, DataFrame]:
    """("replay", diffs) for a client behind by at most limit diffs, else ("snapshot", rows)."""
    behind = log.where(F.col("version") > from_version).orderBy("version")
    if behind.limit(limit + 1).count() <= limit:
        return "replay", behind
    return "snapshot", snapshot_at(log, log.agg(F.max("version")).first()[0])
