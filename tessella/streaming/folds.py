"""Operators over streams of changes that fold each batch into written tables.

Each operator starts a query whose batches are plain DataFrame plans: a hot key is aggregated by many tasks, and the
state is a set of tables in a folder, numbered by batch, so a batch that is run again gives the same tables. What an
operator emits stands in <folder>/out, a table for each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.storage import Numbered

#: After so many batches the state's tables are folded into one.
FOLD_EVERY = 32
#: Versions that one task of the gap tracker looks at side by side.
WIDTH = 1 << 16
EVENTS = "source string, event string, version long, pkey string"


def _start(entries: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return entries.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def emitted(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All that an operator has written, with its batch's number."""
    d = spark.read.schema(schema).parquet(f"{folder}/out/*")
    return d.withColumn("batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).cast("long"))


def changes(entries: DataFrame, folder: str, keys: list[str], view: Callable[[DataFrame], DataFrame], weight: str = "weight") -> StreamingQuery:
    """Emit what each batch of a stream of weighted rows changes in view(rows), as rows of weight -1 and +1.

    The view must hold its rows' keys and treat keys apart; it is computed for the batch's keys only, before and
    after. The state is the rows' net weights: each batch adds those of its own rows.
    """
    rest = [c for c in entries.columns if c != weight]
    kind = entries.select(*rest, F.col(weight).cast("long").alias(weight)).schema
    state, out = Numbered(f"{folder}/state"), Numbered(f"{folder}/out")
    net = lambda d: d.groupBy(*rest).agg(F.sum(weight).alias(weight)).where(F.col(weight) != 0)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = number - number % FOLD_EVERY
        before = state.read(spark, [n for n in range(max(0, base - (FOLD_EVERY if base == number else 0)), number)], kind)
        delta = net(batch.select(*rest, F.col(weight).cast("long").alias(weight)))
        # a folded table holds all rows so far; the others only their batch's
        now = state.write(net(before.unionByName(delta)) if number and number == base else delta, number)
        after = now if number == base else before.unionByName(now)
        touched = batch.select(*keys).distinct()
        same = lambda d: d.join(touched.select(*[F.col(k).alias(f"_{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")
        old, new = (view(net(same(d))) for d in (before, after))
        both = old.withColumn(weight, F.lit(-1).cast("long")).unionByName(new.withColumn(weight, F.lit(1).cast("long")))
        out.write(both.groupBy(*[c for c in both.columns if c != weight]).agg(F.sum(weight).alias(weight)).where(F.col(weight) != 0), number)

    return _start(entries, folder, step)


GROUPED = "key string, n long, sum double, min double, max double, weight long"


def group_aggregate(entries: DataFrame, folder: str) -> StreamingQuery:
    """(key, n, sum, min, max, weight) changes of the groups of a stream of (key, x, weight); rows of weight over 0 count."""
    d = entries.select(F.col("key").cast("string").alias("key"), F.col("x").cast("double").alias("x"), F.col("weight").cast("long").alias("weight"))

    def view(z: DataFrame) -> DataFrame:
        aggs = [F.sum("weight").alias("n"), F.sum(F.col("x") * F.col("weight")).alias("sum"), F.min("x").alias("min"), F.max("x").alias("max")]
        return z.where("weight > 0").groupBy("key").agg(*aggs)

    return changes(d, folder, ["key"], view)


RANKED = "key string, id long, score double, weight long"


def top_k(entries: DataFrame, folder: str, k: int) -> StreamingQuery:
    """(key, id, score, weight) changes of each key's k smallest (score, id) of a stream of such rows."""
    d = entries.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), F.col("weight").cast("long").alias("weight"))

    def view(z: DataFrame) -> DataFrame:  # Spark cuts each task's rows to k before the shuffle
        rank = F.row_number().over(W.partitionBy("key").orderBy("score", "id"))
        return z.where("weight > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("key", "id", "score")

    return changes(d, folder, ["key"], view)


def _frontier(waiting: DataFrame, last: DataFrame, width: int) -> DataFrame:
    """(source, frontier): the version up to which each source's waiting versions follow its last without a hole.

    Versions are counted by blocks of width behind the last one; only the first block that is not full is put in order.
    """
    placed = waiting.join(last, "source").withColumn("nth", F.col("version") - F.col("last") - 1).withColumn("block", F.floor(F.col("nth") / width))
    w = W.partitionBy("source").orderBy("block")
    blocks = placed.groupBy("source", "block").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(w) - 1)
    whole = (F.col("n") == width) & (F.col("block") == F.col("k"))
    full = blocks.groupBy("source").agg(F.coalesce(F.min(F.when(~whole, F.col("k"))), F.count("*")).alias("full"))
    part = placed.join(full, "source").where(F.col("block") == F.col("full")).withColumn("k", F.row_number().over(W.partitionBy("source").orderBy("nth")) - 1 + F.col("full") * width)
    more = part.where(F.col("nth") == F.col("k")).groupBy("source").agg(F.count("*").alias("more"))
    return last.join(full, "source", "left").join(more, "source", "left").select("source", (F.col("last") + F.coalesce("full", F.lit(0)) * width + F.coalesce("more", F.lit(0))).alias("frontier"))


def track_gaps(diffs: DataFrame, folder: str, width: int = WIDTH, refill: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Put the diffs (source, version, pkey) of each source in version order: duplicates go, later ones wait for a missing one.

    Emits ("apply", version, pkey) for diffs whose predecessors are all there and ("gap", first missing version, null)
    when new diffs leave some waiting. A source's first batch sets its base; of diffs of one version that come
    together the least pkey counts. refill(gaps: source, missing) may fetch diffs that a hole lacks; they join the
    batch as if they had come with it.
    """
    d = diffs.select(F.col("source").cast("string").alias("source"), F.col("version").cast("long").alias("version"), F.col("pkey").cast("string").alias("pkey"))
    tables = {k: Numbered(f"{folder}/{k}") for k in ("waiting", "last", "out", "pending", "frontier")}

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [number - 1] if number else []
        waiting = tables["waiting"].read(spark, before, d.schema)
        known = tables["last"].read(spark, before, "source string, last long")

        def advance(new: DataFrame) -> tuple[DataFrame, DataFrame]:
            base = new.groupBy("source").agg((F.min("version") - 1).alias("base"))
            last = known.join(base, "source", "full").select("source", F.coalesce("last", "base").alias("last"))
            fresh = new.join(last, "source").where(F.col("version") > F.col("last")).select("source", "version", "pkey", F.lit(True).alias("fresh"))
            every = waiting.withColumn("fresh", F.lit(False)).unionByName(fresh)
            held = every.groupBy("source", "version").agg(F.min(F.struct("fresh", "pkey")).alias("x")).select("source", "version", "x.*")
            held = tables["pending"].write(held, number)
            return held, tables["frontier"].write(_frontier(held, last, width), number)

        new = batch.select("source", "version", "pkey")
        held, frontier = advance(new)
        stopped = lambda: held.join(frontier, "source").groupBy("source").agg(F.max((F.col("version") > F.col("frontier"))).alias("left"), F.max("fresh").alias("fresh"), F.first("frontier").alias("frontier")).where("left and fresh")
        if refill is not None:
            lacking = stopped().select("source", (F.col("frontier") + 1).alias("missing"))
            if not lacking.isEmpty():
                more = refill(lacking).select("source", F.col("version").cast("long").alias("version"), F.col("pkey").cast("string").alias("pkey"))
                more = Numbered(f"{folder}/refill").write(more, number)
                held, frontier = advance(new.unionByName(more))
        at = held.join(frontier, "source")
        apply = at.where("version <= frontier").select("source", F.lit("apply").alias("event"), "version", "pkey")
        gap = stopped().select("source", F.lit("gap").alias("event"), (F.col("frontier") + 1).alias("version"), F.lit(None).cast("string").alias("pkey"))
        tables["out"].write(apply.unionByName(gap), number)
        tables["waiting"].write(at.where("version > frontier").select("source", "version", "pkey"), number)
        tables["last"].write(frontier.withColumnRenamed("frontier", "last"), number)

    return _start(d, folder, step)
