"""Event-time windows, joins and views over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import zset


def tumbling(df: DataFrame, ts: str, width: str, keys: list[str], aggs: list, late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(*aggs)


def sliding(df: DataFrame, ts: str, width: str, step: str, keys: list[str], aggs: list, late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, width, step), *keys).agg(*aggs)


def session(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list, late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*aggs)


def dedupe(df: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def stream_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Inner join of two streams on a key with times at most `within` apart, so old state can go."""
    l, r = left.withWatermark(left_ts, late), right.withWatermark(right_ts, late)
    near = (F.col(f"r.{right_ts}") >= F.col(f"l.{left_ts}") - F.expr(f"INTERVAL {within}")) & (F.col(f"r.{right_ts}") <= F.col(f"l.{left_ts}") + F.expr(f"INTERVAL {within}"))
    return l.alias("l").join(r.alias("r"), (F.col(f"l.{on}") == F.col(f"r.{on}")) & near)


def weighted_sums(entries: DataFrame, keys: list[str], value: str, weight: str = "weight") -> DataFrame:
    """Complete-mode sum and count of a stream of a Z-set; groups without rows are left out."""
    return entries.groupBy(*keys).agg(F.sum(F.col(value) * F.col(weight)).alias("sum"), F.sum(weight).alias("n")).where("n > 0")


def maintain(entries: DataFrame, path: str, checkpoint: str, view: Callable[[DataFrame], DataFrame], key: str = "key", weight: str = "weight", seq: str = "seq"):
    """Keep path as view(snapshot) of a stream of entries; each batch folds its changes into the state beside it.

    The state is the coalesced Z-set, written anew under the batch's number before the number is published, so a
    batch that is run twice gives the same state.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = f"{checkpoint}/zset"
        old = None
        for n in range(number - 1, -1, -1):
            try:
                old = spark.read.parquet(f"{state}/{n}")
                break
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        every = batch if old is None else old.unionByName(batch)
        rest = [c for c in batch.columns if c not in (key, weight, seq)]
        zset.coalesce(every.withColumn("row", F.struct(*rest, seq)), key, "row", weight, seq).select(key, weight, *[F.col("row")[c].alias(c) for c in (*rest, seq)]).write.mode("overwrite").parquet(f"{state}/{number}")
        view(spark.read.parquet(f"{state}/{number}")).write.mode("overwrite").parquet(path)

    return entries.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
