"""Row diffs from other kinds of change, and typed rows from row diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIFF = "kind string, version bigint, pkey string, fields map<string,string>"


def from_document_events(events: DataFrame, path: str = "path", value: str = "value", version: str = "version", deleted: str = "deleted") -> DataFrame:
    """Diffs from changes of nested documents: path is [row, field, inner fields ...], value a text.

    A change of an inner field is an update of its dotted name; a deleted path of one part deletes the row, of more
    parts sets the field to null. Changes of one row and version are one diff; a row's first is an insert.
    """
    e = events.select(F.col(path)[0].alias("pkey"), F.col(version).cast("bigint").alias("version"), F.array_join(F.slice(path, F.lit(2), F.size(path)), ".").alias("field"), F.col(value).cast("string").alias("value"), F.coalesce(F.col(deleted), F.lit(False)).alias("deleted"))
    gone = e.groupBy("pkey", "version").agg(F.bool_or(F.col("deleted") & (F.col("field") == "")).alias("gone"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field") != "", F.struct("field", F.when(~F.col("deleted"), F.col("value")).alias("value")))))).alias("fields"))
    first = gone.groupBy("pkey").agg(F.min("version").alias("first"))
    kind = F.when(F.col("gone"), "delete").when(F.col("version") == F.col("first"), "insert").otherwise("update")
    return gone.join(first, "pkey").select(kind.alias("kind"), "version", "pkey", F.when(F.col("gone"), F.create_map().cast("map<string,string>")).otherwise(F.col("fields")).alias("fields"))


def from_snapshots(before: DataFrame, after: DataFrame, key: str, version: int) -> DataFrame:
    """Diffs that lead from one table to another of the same columns; an update holds the fields that changed."""
    cols = [c for c in before.columns if c != key]
    b, a = before.alias("b"), after.alias("a")
    j = b.join(a, F.col(f"b.`{key}`") == F.col(f"a.`{key}`"), "full")
    here, there = F.col(f"a.`{key}`").isNotNull(), F.col(f"b.`{key}`").isNotNull()
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"a.`{c}`").cast("string").alias("v"), F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")).alias("same")) for c in cols]), lambda p: ~there | ~p["same"])
    fields = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"])))
    kind = F.when(here & there, "update").when(here, "insert").otherwise("delete")
    out = j.select(kind.alias("kind"), F.lit(version).cast("bigint").alias("version"), F.coalesce(F.col(f"a.`{key}`"), F.col(f"b.`{key}`")).cast("string").alias("pkey"), F.when(here, fields).otherwise(F.create_map().cast("map<string,string>")).alias("fields"))
    return out.where((F.col("kind") != "update") | (F.size("fields") > 0))


def typed(rows: DataFrame, schema: T.StructType, key: str = "pkey") -> DataFrame:
    """Columns of a schema from rows (pkey, fields); a field that cannot be read as its type is null."""

    def one(f: T.StructField) -> Column:
        c = F.col("pkey") if f.name == key else F.col("fields")[f.name]
        return (c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name)

    return rows.select(*[one(f) for f in schema.fields])


def to_entries(diffs: DataFrame, prior: DataFrame) -> DataFrame:
    """Z-set entries (key, row, weight, seq) of diffs: an update takes the row before back and adds the new one.

    prior has (pkey, fields) before the diffs, each key changed once; longer runs go batch by batch.
    """
    j = diffs.join(prior.select("pkey", F.col("fields").alias("was")), "pkey", "left")
    merged = F.map_concat(F.map_filter(F.coalesce("was", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.col("fields"), k)), F.col("fields"))
    new = F.when(F.col("kind") == "insert", F.col("fields")).when(F.col("kind") == "update", merged)
    both = F.array(F.struct(F.col("was").alias("row"), F.lit(-1).alias("weight")), F.struct(new.alias("row"), F.lit(1).alias("weight")))
    return j.select(F.col("pkey").alias("key"), F.col("version").alias("seq"), F.explode(F.filter(both, lambda x: x["row"].isNotNull())).alias("x")).select("key", "x.row", "x.weight", "seq")
