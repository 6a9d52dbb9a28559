"""Operators on the small literal tables of the behaviour they follow."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella import types
from tessella.operators import aggregate, joins, mutate, ordering, paging, pivot, predicate, temporal, tree, zset
from tessella.plans import intent
from tessella.plans.request import BlockRequest, Source


def cmp(c, op, value=None, values=None, **more):
    return {"type": "comparison", "columnId": c, "op": op, "value": value, "values": values} | more


def logic(op, *fs):
    return {"type": "logical", "op": op, "filters": list(fs)}


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(25, "alice", "a"), (30, "bob", None), (35, "CHARLIE", "b"), (40, "David", "a"), (45, "eve", None), (50, "Frank", "c")], "age int, name string, tag string").cache()


@pytest.mark.parametrize(
    ("node", "n"),
    [
        (None, 6), (cmp("age", "eq", 30), 1), (cmp("age", "gt", 35), 3), (cmp("age", "lte", 35), 3), (cmp("age", "in", values=[25, 45]), 2), (cmp("age", "between", values=[30, 40]), 3),
        (cmp("name", "contains", "a"), 4), (cmp("name", "contains", "a", caseSensitive=True), 3), (cmp("tag", "isNull"), 2), (cmp("tag", "isNotNull"), 4), (cmp("nope", "eq", 1), 0), (cmp("name", "eq", "CHARLIE".lower()), 1),
        (logic("and", cmp("age", "gt", 30), logic("or", cmp("name", "startsWith", "c"), cmp("name", "startsWith", "f"))), 2), (logic("not", cmp("tag", "eq", "a")), 4), (cmp("tag", "neq", "a"), 2), (cmp("tag", "notIn", values=["a"]), 2),
        (cmp("tag", "notIn", values=[]), 4), (logic("or"), 0), (logic("and"), 6), (logic("not"), 6), (cmp("tag", "notContains", "a"), 2), (cmp("age", "notBetween", values=[30, 40]), 3), (cmp("name", "endsWith", "E"), 3),
    ],
)
def test_filters(people, node, n):
    assert predicate.apply_filter(people, node).count() == n


def test_sql_dialect(people):
    assert predicate.apply_filter(people, logic("or"), "sql").count() == 6
    assert predicate.apply_filter(people, logic("not", cmp("tag", "eq", "a")), "sql").count() == 2
    with pytest.raises(ValueError):
        predicate.apply_filter(people, cmp("nope", "eq", 1), "sql")


def test_pushed_filters(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 3).alias("m")).write.parquet(str(tmp_path / "t"))
    d = predicate.apply_filter(spark.read.parquet(str(tmp_path / "t")), cmp("id", "gt", 50)).select("id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,50)" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_sorting(spark):
    d = spark.createDataFrame([(3, 0), (None, 1), (1, 2), (None, 3), (2, 4)], "x int, id int")
    got = lambda **k: [r.x for r in ordering.apply_sort(d, [{"columnId": "x", **k}], "id").collect()]
    assert got(direction="asc") == [1, 2, 3, None, None]
    assert got(direction="desc") == [3, 2, 1, None, None]
    assert got(direction="asc", nulls="first") == [None, None, 1, 2, 3]
    t = spark.createDataFrame([("item10", 1), ("item9", 2), ("Apple", 3), ("banana", 4)], "s string, id int")
    assert [r.s for r in ordering.apply_sort(t, [{"columnId": "s", "direction": "asc"}], "id", natural=True).collect()] == ["Apple", "banana", "item9", "item10"]


@pytest.fixture(scope="module")
def orders(spark):
    status = ["active", "pending", "churned", "pilot", "archived"]
    return spark.createDataFrame([(i, f"name_{i}", ((i * 1009) % 10000) / 100, status[i % 5] if i % 7 else None) for i in range(1, 51)], "id int, name string, revenue double, status string").cache()


@pytest.mark.parametrize("sort", [[], [{"columnId": "revenue", "direction": "desc"}], [{"columnId": "status", "direction": "asc"}, {"columnId": "revenue", "direction": "desc"}], [{"columnId": "status", "direction": "desc", "nulls": "first"}]])
def test_paging_meets_each_row_once(orders, sort):
    whole = [r.id for r in orders.orderBy(*ordering.order_columns(sort, "id")).collect()]
    seen, cursor, pages = [], None, []
    while True:
        p = paging.fetch_page(orders, 8, sort, "id", cursor)
        seen += [r["id"] for r in p["rows"]]
        pages.append(p)
        if not p["hasMore"]:
            break
        cursor = p["next"]
    assert seen == whole
    back = paging.fetch_page(orders, 8, sort, "id", pages[2]["previous"], "before")
    assert [r["id"] for r in back["rows"]] == whole[8:16]


@given(st.lists(st.one_of(st.none(), st.booleans(), st.integers(-(2**53), 2**53), st.text(max_size=20)), max_size=4), st.one_of(st.integers(), st.text(max_size=10)))
@settings(max_examples=100, suppress_health_check=[HealthCheck.too_slow])
def test_cursor_codec(values, row):
    c = paging.KeysetCursor(tuple(values), row)
    assert paging.decode_cursor(c.encode()) == c


@pytest.mark.parametrize("bad", ["ks:!!", "x", "offset:-1", "ks:e30="])
def test_bad_cursors(bad):
    with pytest.raises(ValueError):
        paging.decode_cursor(bad)


def test_aggregates(spark):
    d = spark.createDataFrame([(10, "a", 1), (20, "b", 2), (None, "a", 3), (30, "c", 4), (40, "a", 5), (None, "b", 6)], "x int, tag string, id int")
    r = aggregate.aggregate(d, [{"fn": f, "columnId": "x"} for f in ("sum", "avg", "count", "countDistinct", "min", "max", "first", "last")], ["id"]).first()
    assert tuple(r) == (100, 25, 4, 4, 10, 40, 10, 40)
    assert aggregate.aggregate(d.where("false"), [{"fn": "sum", "columnId": "x"}, {"fn": "avg", "columnId": "x"}]).first()[:] == (0, None)
    with pytest.raises(ValueError):
        aggregate.aggregate(d, [{"fn": "nope", "columnId": "x"}])
    aggregate.register_aggregator("spread", lambda c: F.max(c) - F.min(c))
    assert aggregate.aggregate(d, [{"fn": "spread", "columnId": "x"}]).first()[0] == 30
    with pytest.raises(ValueError):
        aggregate.register_aggregator("sum", F.sum)


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("EMEA", "A", "active", 100), ("AMER", "A", "active", 200), ("EMEA", "B", "churned", 150), ("APAC", "A", "active", 50), ("AMER", "B", "churned", 300), ("EMEA", "A", "active", 75)]
    return spark.createDataFrame(rows, "region string, product string, status string, revenue int").cache()


def test_group_tree(sales):
    t = {(r.region, r.product): (r.sum_revenue, r["__level__"], r["__count__"]) for r in aggregate.group_tree(sales, ["region", "product"], [{"fn": "sum", "columnId": "revenue"}]).collect()}
    assert t[("AMER", None)] == (500, 1, 2) and t[("EMEA", None)][0] == 325 and t[(None, None)] == (875, 0, 6) and t[("EMEA", "A")] == (175, 2, 2)
    shown = aggregate.open_rows(sales, ["region", "product"], [], [["EMEA"], ["EMEA", "A"]]).collect()
    assert [(r.region, r.product, r["__level__"]) for r in shown] == [("AMER", None, 1), ("APAC", None, 1), ("EMEA", None, 1), ("EMEA", "A", 2), ("EMEA", "A", 3), ("EMEA", "A", 3), ("EMEA", "B", 2)]


def test_pivot(sales):
    r = {x.region: x for x in pivot.pivot(sales, ["region"], ["status"], [{"fn": "sum", "columnId": "revenue"}]).collect()}
    assert r["EMEA"]["sum_revenue__active"] == 175 and r["AMER"]["sum_revenue__churned"] == 300 and r["APAC"]["sum_revenue__churned"] is None


def test_distinct(spark):
    d = spark.createDataFrame([(x,) for x in "abacbaa"], "status string")
    assert [tuple(r) for r in aggregate.distinct_values(d, "status").collect()] == [("a", 4), ("b", 2), ("c", 1)]


def test_tree(spark):
    d = spark.createDataFrame([("r:emea", None), ("r:apac", None), ("x:de", "r:emea"), ("x:de/berlin", "x:de")], "id string, parent_id string")
    assert [(r.id, r.depth, r.hasChildren, r.expanded) for r in tree.flatten(d, ["r:emea"]).collect()] == [("r:apac", 0, False, False), ("r:emea", 0, True, True), ("x:de", 1, True, False)]
    assert tree.tree_count(d) == 4
    assert [(r.id, r.hasChildren) for r in tree.children(d, "x:de").collect()] == [("x:de/berlin", False)]


def test_joins(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("z", 5, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("k", 2, "two"), ("k", 5, "five"), ("k", 9, "nine")], "k string, t int, v string")
    pick = lambda **k: {r.id: r.v for r in joins.asof(left, right, "t", ["k"], ["v"], **k).collect()}
    assert pick() == {1: "five", 2: None, 3: None}
    assert pick(strict=True) == {1: "two", 2: None, 3: None}
    assert pick(direction="forward") == {1: "five", 2: "two", 3: None}
    assert pick(direction="forward", strict=True) == {1: "nine", 2: "two", 3: None}
    for width in (1, 3, 100):
        assert pick(width=width) == {1: "five", 2: None, 3: None} and pick(strict=True, width=width) == {1: "two", 2: None, 3: None}
        assert pick(direction="forward", width=width) == {1: "five", 2: "two", 3: None} and pick(direction="forward", strict=True, width=width) == {1: "nine", 2: "two", 3: None}
    whole = {r.id: r.v for r in joins.asof(left.drop("k"), right.drop("k"), "t", [], ["v"], width=2).collect()}
    assert whole == {1: "five", 2: None, 3: "five"}
    out = joins.join_query(spark, {"jl": left, "jr": right}, "SELECT count(*) AS n FROM jl JOIN jr USING (k)")
    assert out.first().n == 6 and not spark.catalog.tableExists("jl")


def test_zset(spark):
    e = spark.createDataFrame([("r1", "us", 100, 1, 1), ("r2", "us", 200, 1, 2), ("r3", "eu", 50, 1, 3)], "key string, g string, x int, weight int, seq int")
    total = lambda d: {r.g: r.sum_x for r in zset.group_aggregate(d, ["g"], [{"fn": "sum", "columnId": "x"}]).collect()}
    assert total(e) == {"us": 300, "eu": 50}
    gone = spark.createDataFrame([("r1", "us", 100, -1, 4)], e.schema)
    assert total(e.union(gone)) == {"us": 200, "eu": 50}
    assert total(e.union(gone).union(spark.createDataFrame([("r3", "eu", 50, -1, 5)], e.schema))) == {"us": 200}
    assert {r.key for r in zset.integrate(e.union(gone), row="x").collect()} == {"r2", "r3"}


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([("insert", 1, "a", {"x": "1", "y": "1"}), ("update", 2, "a", {"x": "2"}), ("insert", 3, "b", {"x": "9"}), ("delete", 4, "a", {}), ("update", 5, "b", {"y": "8"}), ("insert", 6, "a", {"x": "7"})], "kind string, version long, pkey string, fields map<string,string>").cache()


def test_time_travel(log):
    at = lambda v: {r.pkey: r.fields for r in temporal.snapshot_at(log, v).collect()}
    assert at(2) == {"a": {"x": "2", "y": "1"}}
    assert at(4) == {"b": {"x": "9"}}
    assert at(6) == {"a": {"x": "7"}, "b": {"x": "9", "y": "8"}}
    anchored = temporal.snapshot_at(log, 6, temporal.snapshot_at(log, 3), 3)
    assert {r.pkey: r.fields for r in anchored.collect()} == at(6)
    undo = [(r.kind, r.pkey, r.fields) for r in temporal.invert(log, 3, 6).collect()]
    assert undo == [("delete", "a", None), ("update", "b", {}), ("insert", "a", {"x": "2", "y": "1"})]
    assert temporal.resync(log, 4)[0] == "replay" and temporal.resync(log, 0, limit=3)[0] == "snapshot"
    assert temporal.gaps(log.where("version <> 3")).collect() == [(2, 4)]
    assert sorted(temporal.gaps(log.where("version not in (1, 3, 4)"), base=0, width=2).collect()) == [(0, 2), (2, 5)]


def test_mutations(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "id int, s string, x double")
    c = spark.createDataFrame(
        [("update", 1, {"s": "A"}, {"x": "1.0"}), ("update", 2, {"s": "B"}, {"s": "zz"}), ("delete", 3, {}, {}), ("insert", 4, {"s": "d"}, None)],
        "kind string, id int, values map<string,string>, expected map<string,string>",
    )
    new, res = mutate.mutate(t, c, "id")
    assert {r.id: r.status for r in res.collect()} == {1: "ok", 2: "conflict", 3: "ok", 4: "ok"}
    assert sorted(tuple(r) for r in new.collect()) == sorted([(1, "A", 1.0), (2, "b", 2.0), (4, "d", None)])


def test_requests(orders):
    src = Source(orders, "id")
    out = src.fetch(BlockRequest.from_json({"limit": 5, "filter": cmp("status", "eq", "PILOT"), "sort": [{"columnId": "revenue", "direction": "desc"}], "requestId": "q"}), count=True)
    assert len(out["rows"]) == 5 and out["hasMore"] and out["totalCount"] == orders.where("status = 'pilot'").count() and out["requestId"] == "q"
    grouped = src.fetch(BlockRequest(grouping={"columns": ["status"], "openKeys": []}, aggregations=[{"fn": "sum", "columnId": "revenue"}]))
    assert sum(r["__count__"] for r in grouped["rows"]) == 50 and grouped["rows"][-1]["status"] is None
    assert BlockRequest(limit=5).fingerprint() == BlockRequest(limit=9, cursor="offset:3").fingerprint() != BlockRequest(columns=["id"]).fingerprint()
    with pytest.raises(ValueError):
        BlockRequest.from_json({"limit": 0})
    with pytest.raises(ValueError):
        src.rows(BlockRequest(columns=["nope"]))


def test_intents():
    cols = ["Revenue", "status"]
    assert intent.from_text("sort by revenue desc", cols)["sort"] == [{"columnId": "Revenue", "direction": "desc"}]
    assert intent.from_text("revenue >= 5", cols)["filter"]["op"] == "gte"
    assert intent.from_text("what?", cols) is None
    assert intent.check({"kind": "sort", "sort": [{"columnId": "x", "direction": "up"}]}, cols)
    assert intent.apply(BlockRequest(), intent.from_text("group by status", cols), cols).grouping["columns"] == ["status"]


def test_types():
    assert [types.from_sql_name(n) for n in ("INTEGER", "varchar(20)", "interval", "numeric(10,2)", "timestamp with time zone", "bigint unsigned", "double precision")] == ["int32", "utf8", "unknown", "decimal", "timestamp_tz", "int64", "float64"]
    for kind in types.SIMPLE:
        assert types.to_spark(kind)
    assert types.from_spark(types.to_spark("decimal", 12, 3)) == {"type": "decimal", "precision": 12, "scale": 3}


values = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text("ab%_\\'\"", max_size=4))
leaves = st.builds(lambda c, op, v, vs: cmp(c, op, v, vs), st.sampled_from(["age", "name", "tag", "a`b", "x; drop"]), st.sampled_from(["eq", "neq", "contains", "notContains", "startsWith", "endsWith", "isNull", "isNotNull", "in", "notIn"]), st.text("ab%_\\'", max_size=4), st.lists(st.text("ab", max_size=2), max_size=3))
trees = st.recursive(leaves, lambda t: st.builds(lambda op, fs: logic(op, *fs), st.sampled_from(["and", "or", "not"]), st.lists(t, max_size=3)), max_leaves=6)


@given(trees)
@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
def test_any_tree_is_two_valued(people, node):
    d = people.select(F.col("age").cast("string").alias("age"), "name", "tag")
    yes, no = predicate.apply_filter(d, node).count(), predicate.apply_filter(d, logic("not", node)).count()
    assert yes + no == 6


def test_dates_compare(spark):
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 6, 1),)], "t timestamp_ntz")
    assert predicate.apply_filter(d, cmp("t", "gte", "2024-03-01")).count() == 1


def test_tree_of_many_levels(spark):
    from tessella.operators import tree

    n = 300  # a chain, a cycle, a node without parent in the table
    rows = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(n)] + [("a", "b"), ("b", "a"), ("lost", "gone"), ("leaf", "n3")]
    d = spark.createDataFrame(rows, "id string, parent_id string")
    got = {r.id: r for r in tree.flatten(d).collect()}
    assert set(got) == {f"n{k}" for k in range(n)} | {"leaf"}
    assert all(got[f"n{k}"].depth == k and got[f"n{k}"].path == [f"n{j}" for j in range(k + 1)] for k in range(n)) and got["leaf"].depth == 4
    assert {r.id for r in tree.flatten(d, ["n0", "n2", "n3"]).collect()} == {"n0", "n1"}
    assert not spark.catalog.listTables() or not any(t.name.startswith("__tree") for t in spark.catalog.listTables())


def test_wildcards_of_columns(spark):
    from tessella.operators import joins

    words = ["a.b", "a*b", "axb", "A?b", "a~b", "a[b", "aab", "(ab)", "a\\b"]
    marks = ["a.b", "a~*b", "a?b", "a~?b", "a~~b", "a[b", "a*b", "(a*", "a\\b", "z*"]
    right = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, w string")
    left = spark.createDataFrame([(m,) for m in marks], "m string")
    got = {r.m: r.k for r in joins.lookup_wildcard(left, right, "m", "w", "k", ["k"]).collect()}
    import re

    want = {m: next((k for k, w in enumerate(words) if re.match(joins.wildcard_pattern(m), w)), None) for m in marks}
    assert got == want


def test_positions(spark):
    from tessella.operators import ordering

    d = spark.range(1000).selectExpr("id", "if(id % 7 = 0, null, id % 13) as x")
    got = {r.id: r.pos for r in ordering.positions(d, [{"columnId": "x", "direction": "desc"}], "id").collect()}
    want = sorted(range(1000), key=lambda i: (i % 7 == 0, -(i % 13) if i % 7 else 0, -i))
    assert [got[i] for i in want] == list(range(1, 1001))
