from tessella.operators import diffs, temporal


def test_document_events(spark):
    e = spark.createDataFrame([(["r1", "a"], "1", 1, None), (["r1", "b", "c"], "2", 1, None), (["r1", "a"], "3", 2, None), (["r1", "b", "c"], None, 3, True), (["r1"], None, 4, True)], "path array<string>, value string, version int, deleted boolean")
    out = {r.version: (r.kind, r.fields) for r in diffs.from_document_events(e).collect()}
    assert out == {1: ("insert", {"a": "1", "b.c": "2"}), 2: ("update", {"a": "3"}), 3: ("update", {"b.c": None}), 4: ("delete", {})}


def test_snapshots_and_back(spark):
    a = spark.createDataFrame([(1, "x", 1.5), (2, "y", None)], "id int, s string, v double")
    b = spark.createDataFrame([(1, "x", 2.5), (3, "z", 0.0)], "id int, s string, v double")
    log = diffs.from_snapshots(a.where("false"), a, "id", 1).unionByName(diffs.from_snapshots(a, b, "id", 2))
    assert {(r.kind, r.pkey) for r in log.where("version = 2").collect()} == {("update", "1"), ("delete", "2"), ("insert", "3")}
    back = diffs.typed(temporal.snapshot_at(log, 2), b.schema, "id")
    assert sorted(back.collect()) == sorted(b.collect())
    entries = diffs.to_entries(log.where("version = 2"), temporal.snapshot_at(log, 1))
    assert sorted((r.key, r.weight) for r in entries.collect()) == [("1", -1), ("1", 1), ("2", -1), ("3", 1)]
