"""Stateful operators over streams of changes, with a store on disk (RocksDB) and timers only where needed.

A key's state is one number, on one task at a time; operators that need all rows of a key are in folds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _one(kind):
    return StructType([StructField("v", kind)])


class Distinct(StatefulProcessor):
    """+1 or -1 when a key's total weight starts or stops being over 0."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", _one(LongType()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        was = self.total.get()[0] if self.total.exists() else 0
        now = was + int(sum(p["weight"].sum() for p in rows))
        if now:
            self.total.update((now,))
        else:
            self.total.clear()
        if (now > 0) != (was > 0):
            yield pd.DataFrame({"key": [key[0]], "weight": [1 if now > 0 else -1]})

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None")


def distinct(entries: DataFrame) -> DataFrame:
    """(key, weight) changes of presence of a stream of (key string, weight)."""
    return _run(entries.select(F.col("key").cast("string").alias("key"), F.col("weight").cast("long").alias("weight")), ["key"], Distinct(), "key string, weight long")
