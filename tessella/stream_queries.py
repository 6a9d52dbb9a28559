"""Queries that run a stream to its end and return what it leaves, so they can be held against SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.catalog import query
from tessella.storage import fresh_path
from tessella.streaming import folds, processors, windows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; a stream's source is a pattern, so one letter of the name is written as one."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(os.path.join(sf_dir, "event[s].parquet"))


def finish(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all there is and read back what it wrote."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "stream")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-cp").trigger(availableNow=True).start()
    else:
        q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def fold(spark: SparkSession, start, schema: str) -> DataFrame:
    """Run start(folder) to its end and read what it emitted."""
    folder = fresh_path(spark, "fold")
    start(folder).awaitTermination()
    return folds.emitted(spark, folder, schema)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.tumbling(d, "ts", "1 day", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    flat = out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
    return finish(flat, "complete")


@query("SELECT user_id::VARCHAR AS key, 1::BIGINT AS weight FROM events GROUP BY 1 HAVING sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) > 0")
def stream_distinct(spark, sf_dir):
    d = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("weight"))
    return finish(processors.distinct(d)).groupBy("key").agg(F.sum("weight").alias("weight")).where("weight <> 0")


@query("SELECT event_type AS key, count(*) AS n, round(sum(value), 3) AS sum, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def stream_group_aggregate(spark, sf_dir):
    d = events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("value").alias("x"), F.lit(1).alias("weight"))
    net = fold(spark, lambda at: folds.group_aggregate(d, at), folds.GROUPED).groupBy("key", "n", "sum", "min", "max").agg(F.sum("weight").alias("w")).where("w > 0")
    return net.select("key", "n", F.round("sum", 3).alias("sum"), "min", "max")


@query("SELECT event_type AS key, event_id AS id, value AS score FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) <= 5")
def stream_top_k(spark, sf_dir):
    d = events(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), F.col("value").alias("score"), F.lit(1).alias("weight"))
    return fold(spark, lambda at: folds.top_k(d, at, 5), folds.RANKED).groupBy("key", "id", "score").agg(F.sum("weight").alias("w")).where("w > 0").drop("w")


@query("SELECT 'events' AS source, count(*) AS applied, max(event_id) AS last FROM events")
def stream_in_order(spark, sf_dir):
    d = events(spark, sf_dir).select(F.lit("events").alias("source"), F.col("event_id").alias("version"), F.col("user_id").alias("pkey"))
    return fold(spark, lambda at: folds.track_gaps(d, at), folds.EVENTS).where("event = 'apply'").groupBy("source").agg(F.count("*").alias("applied"), F.max("version").alias("last"))
