"""Write-back with optimistic checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mutate(table: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(new table, results) of changes (kind, <key>, values map, expected map).

    An update or delete is ok if the row is there and equals expected in the fields that names (compared as text),
    else a conflict; an insert is ok if the key is new. Keys changed twice in one call are errors and left alone.
    """
    row = F.create_map(*[x for c in table.columns if c != key for x in (F.lit(c), F.col(f"t.`{c}`").cast("string"))])
    twice = changes.groupBy(key).agg(F.count("*").alias("n"))
    c = changes.join(twice, key)
    j = c.alias("c").join(table.alias("t"), F.col(f"c.{key}") == F.col(f"t.{key}"), "left").withColumn("there", F.col(f"t.{key}").isNotNull()).withColumn("row", row)
    same = F.coalesce(F.forall(F.map_entries(F.col("c.expected")), lambda e: e["value"].eqNullSafe(F.col("row")[e["key"]])), F.lit(True))
    known = F.forall(F.map_keys(F.coalesce(F.col("c.values"), F.create_map().cast("map<string,string>"))), lambda k: k.isin([x for x in table.columns if x != key]))
    status = (
        F.when((F.col("n") > 1) | ~known | ~F.col("c.kind").isin("insert", "update", "delete"), "error")
        .when(F.col("c.kind") == "insert", F.when(F.col("there"), "conflict").otherwise("ok"))
        .when(F.col("there") & same, "ok").otherwise("conflict")
    )
    results = j.select(F.col(f"c.{key}").alias(key), F.col("c.kind").alias("kind"), status.alias("status"), F.col("c.values").alias("values"))
    good = results.where("status = 'ok'")
    kinds = dict(table.dtypes)
    put = lambda name, old: F.when(F.map_contains_key(F.col("g.values"), name), F.col("g.values")[name].cast(kinds[name])).otherwise(old)
    stay = table.alias("t").join(good.where("kind <> 'insert'").alias("g"), F.col(f"t.{key}") == F.col(f"g.{key}"), "left").where("g.kind is null or g.kind <> 'delete'")
    kept = stay.select(*[F.col(f"t.`{x}`") if x == key else F.coalesce(put(x, F.col(f"t.`{x}`")), F.when(F.col("g.kind").isNull(), F.col(f"t.`{x}`"))).alias(x) for x in table.columns])
    new = good.where("kind = 'insert'").alias("g").select(*[F.col(f"g.{key}").cast(kinds[key]).alias(x) if x == key else put(x, F.lit(None).cast(kinds[x])).alias(x) for x in table.columns])
    return kept.unionByName(new), results.select(key, "kind", "status")
