import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.operators import zset
from tessella.streaming import folds, processors, windows


def feed(spark, tmp_path, batches, schema):
    """A file stream of the batches, a file each, taken one by one."""
    src = tmp_path / "src"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))


def run(df, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert not q.isActive
    return df.sparkSession.table("out").collect()


def fold(spark, tmp_path, start, schema):
    folder = f"file://{tmp_path}/fold"
    q = start(folder)
    q.awaitTermination(240)
    assert not q.isActive
    return folds.emitted(spark, folder, schema).collect()


def test_distinct(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", 1), ("b", 1), ("b", 1)], [("a", -1), ("b", -1)], [("b", -1)]], "key string, weight long")
    assert [(r.key, r.weight) for r in run(processors.distinct(s), tmp_path) if r.key == "b"] == [("b", 1), ("b", -1)]


def test_group_aggregate_matches_batch(spark, tmp_path):
    batches = [[("us", 100.0, 1), ("us", 200.0, 1), ("eu", 50.0, 1)], [("us", 100.0, -1)], [("eu", 50.0, -1)]]
    out = fold(spark, tmp_path, lambda at: folds.group_aggregate(feed(spark, tmp_path, batches, "key string, x double, weight long"), at), folds.GROUPED)
    assert {(r.key, r.batch) for r in out if r.weight == -1} == {("us", 1), ("eu", 2)}
    net = {}
    for r in out:
        k = (r.key, r.n, r.sum, r.min, r.max)
        net[k] = net.get(k, 0) + r.weight
    flat = spark.createDataFrame([x for b in batches for x in b], "key string, x double, weight long")
    want = zset.group_aggregate(flat, ["key"], [{"fn": "count", "columnId": "*", "alias": "n"}, {"fn": "sum", "columnId": "x"}, {"fn": "min", "columnId": "x"}, {"fn": "max", "columnId": "x"}]).collect()
    assert {k for k, v in net.items() if v} == {(r.key, r.n, r.sum_x, r.min_x, r.max_x) for r in want} == {("us", 1, 200.0, 200.0, 200.0)}


def test_top_k(spark, tmp_path):
    batches = [[("p", 1, 5.0, 1), ("p", 2, 1.0, 1), ("p", 3, 3.0, 1), ("p", 4, 2.0, 1)], [("p", 2, 1.0, -1)]]
    net = {}
    for r in fold(spark, tmp_path, lambda at: folds.top_k(feed(spark, tmp_path, batches, "key string, id long, score double, weight long"), at, 2), folds.RANKED):
        net[r.id] = net.get(r.id, 0) + r.weight
    assert {k for k, v in net.items() if v} == {3, 4}


@pytest.mark.parametrize("width", [2, 1 << 16])
def test_gaps(spark, tmp_path, width):
    batches = [[("s", 1, "a"), ("s", 2, "b"), ("t", 7, "x")], [("s", 4, "d"), ("s", 2, "b"), ("s", 9, "z")], [("s", 3, "c"), ("t", 8, None)], [("s", k, "e") for k in (5, 6, 7, 8)] + [("t", 7, "late")]]
    out = fold(spark, tmp_path, lambda at: folds.track_gaps(feed(spark, tmp_path, batches, "source string, version long, pkey string"), at, width), folds.EVENTS)
    got = sorted((r.batch, r.event, r.source, r.version, r.pkey or "") for r in out)
    assert got == [
        (0, "apply", "s", 1, "a"), (0, "apply", "s", 2, "b"), (0, "apply", "t", 7, "x"), (1, "gap", "s", 3, ""), (2, "apply", "s", 3, "c"), (2, "apply", "s", 4, "d"), (2, "apply", "t", 8, ""), (2, "gap", "s", 5, ""),
        *[(3, "apply", "s", k, "e") for k in (5, 6, 7, 8)], (3, "apply", "s", 9, "z"),
    ]


def test_gaps_refilled(spark, tmp_path):
    log = spark.createDataFrame([("s", k, f"log{k}") for k in range(20)], "source string, version long, pkey string")
    refill = lambda gaps: log.join(gaps, "source").where("version >= missing").select("source", "version", "pkey")
    batches = [[("s", 1, "a")], [("s", 5, "f")]]
    out = fold(spark, tmp_path, lambda at: folds.track_gaps(feed(spark, tmp_path, batches, "source string, version long, pkey string"), at, refill=refill), folds.EVENTS)
    assert sorted((r.batch, r.version) for r in out if r.event == "apply") == [(0, 1)] + [(1, k) for k in range(2, 20)] and not any(r.event == "gap" for r in out)


def test_folded_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folds, "FOLD_EVERY", 2)
    batches = [[("p", k, float(9 - k), 1)] for k in range(5)] + [[("p", 4, 5.0, -1)]]
    net = {}
    for r in fold(spark, tmp_path, lambda at: folds.top_k(feed(spark, tmp_path, batches, "key string, id long, score double, weight long"), at, 2), folds.RANKED):
        net[r.id] = net.get(r.id, 0) + r.weight
    assert {k for k, v in net.items() if v} == {2, 3}


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_windows(spark, tmp_path, kind):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    s = feed(spark, tmp_path, [[("k", t(1), 1.0), ("k", t(4), 2.0), ("k", t(6), 3.0)]], "key string, ts timestamp, x double")
    aggs = [F.sum("x").alias("s")]
    df = windows.tumbling(s, "ts", "5 minutes", ["key"], aggs) if kind == "tumbling" else windows.sliding(s, "ts", "10 minutes", "5 minutes", ["key"], aggs) if kind == "sliding" else windows.session(s, "ts", "150 seconds", ["key"], aggs)
    sums = sorted(r.s for r in run(df.select("s"), tmp_path, "complete"))
    assert sums == {"tumbling": [3.0, 3.0], "sliding": [3.0, 3.0, 6.0], "session": [1.0, 5.0]}[kind]


def test_maintained_view(spark, tmp_path):
    s = feed(spark, tmp_path, [[("a", 1.0, 1, 1), ("b", 2.0, 1, 2)], [("a", 1.0, -1, 3), ("c", 5.0, 1, 4)]], "key string, x double, weight long, seq long")
    q = windows.maintain(s, str(tmp_path / "view"), str(tmp_path / "cp"), lambda z: z.agg(F.sum("x").alias("s")))
    q.awaitTermination(180)
    assert spark.read.parquet(str(tmp_path / "view")).first().s == 7.0
