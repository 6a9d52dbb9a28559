"""Registered queries of the engine's own operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import aggregate, joins, mutate, ordering, paging, pivot, predicate, temporal, tree, zset
from tessella.plans.request import BlockRequest, Source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cmp(column: str, op: str, value=None, values=None, **more) -> dict:
    return {"type": "comparison", "columnId": column, "op": op} | ({"value": value} if value is not None else {}) | ({"values": values} if values is not None else {}) | more


def logic(op: str, *filters: dict) -> dict:
    return {"type": "logical", "op": op, "filters": list(filters)}


# ---- requests ----

_FLAGSHIP = {
    "filter": cmp("l_shipdate", "lte", "1998-09-02"),
    "grouping": {"columns": ["l_returnflag", "l_linestatus"], "openKeys": []},
    "aggregations": [{"fn": "sum", "columnId": "l_quantity"}, {"fn": "avg", "columnId": "l_discount"}, {"fn": "countDistinct", "columnId": "l_suppkey"}],
}


@query("""SELECT l_returnflag, l_linestatus, count(*) AS __count__, sum(l_quantity) AS sum_l_quantity, round(avg(l_discount), 9) AS avg_l_discount,
       count(DISTINCT l_suppkey) AS countDistinct_l_suppkey FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def request_grouped(spark, sf_dir):
    out = Source(table(spark, sf_dir, "lineitem"), "l_orderkey").plan(BlockRequest.from_json(_FLAGSHIP))
    return out.withColumn("avg_l_discount", F.round("avg_l_discount", 9))


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 100000 AND lower(o_orderpriority) LIKE '%urgent%'
       ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100""")
def request_rows(spark, sf_dir):
    f = logic("and", cmp("o_totalprice", "gt", 100000), cmp("o_orderpriority", "contains", "urgent"))
    r = BlockRequest(limit=100, filter=f, sort=[{"columnId": "o_totalprice", "direction": "desc"}], columns=["o_orderkey", "o_orderpriority", "o_totalprice"])
    return Source(table(spark, sf_dir, "orders"), "o_orderkey").plan(r)


# ---- filters ----

_FILTERS = {
    "eq": ("orders", cmp("o_orderstatus", "eq", "f"), "lower(o_orderstatus) = 'f'"),
    "neq": ("orders", cmp("o_orderstatus", "neq", "F"), "lower(o_orderstatus) <> 'f'"),
    "lt": ("orders", cmp("o_totalprice", "lt", 50000.5), "o_totalprice < 50000.5"),
    "lte": ("orders", cmp("o_custkey", "lte", 40), "o_custkey <= 40"),
    "gt": ("orders", cmp("o_totalprice", "gt", 400000), "o_totalprice > 400000"),
    "gte": ("orders", cmp("o_orderdate", "gte", "1998-01-01"), "o_orderdate >= TIMESTAMP '1998-01-01'"),
    "in": ("orders", cmp("o_orderstatus", "in", values=["F", "P", None]), "o_orderstatus IN ('F', 'P')"),
    "not_in": ("orders", cmp("o_orderstatus", "notIn", values=["F", "P"]), "o_orderstatus NOT IN ('F', 'P')"),
    "between": ("orders", cmp("o_custkey", "between", values=[10, 30]), "o_custkey BETWEEN 10 AND 30"),
    "not_between": ("orders", cmp("o_custkey", "notBetween", values=[10, 1400]), "o_custkey NOT BETWEEN 10 AND 1400"),
    "contains": ("part", cmp("p_type", "contains", "eD"), "contains(lower(p_type), 'ed')"),
    "contains_case": ("part", cmp("p_type", "contains", "ED", caseSensitive=True), "contains(p_type, 'ED')"),
    "not_contains": ("part", cmp("p_type", "notContains", "a"), "NOT contains(lower(p_type), 'a')"),
    "starts_with": ("customer", cmp("c_mktsegment", "startsWith", "auto"), "starts_with(lower(c_mktsegment), 'auto')"),
    "ends_with": ("customer", cmp("c_name", "endsWith", "7"), "ends_with(lower(c_name), '7')"),
    "is_not_null": ("orders", cmp("o_orderstatus", "isNotNull"), "o_orderstatus IS NOT NULL"),
    "and_or": ("orders", logic("and", cmp("o_custkey", "gt", 20), logic("or", cmp("o_orderstatus", "eq", "P"), cmp("o_totalprice", "lt", 10000))), "o_custkey > 20 AND (o_orderstatus = 'P' OR o_totalprice < 10000)"),
    "empty_or": ("orders", logic("or"), "false"),
    "empty_and": ("orders", logic("and"), "true"),
    "unknown_column": ("orders", cmp("nope", "eq", 1), "false"),
}


def _filter(name: str, source: str, node: dict, where: str) -> None:
    def run(spark, sf_dir):
        return predicate.apply_filter(table(spark, sf_dir, source), node)

    QUERIES[f"filter_{name}"] = run
    ORACLE_SQL[f"filter_{name}"] = f"SELECT * FROM {source} WHERE {where}"


for _name, _spec in _FILTERS.items():
    _filter(_name, *_spec)

_NULLED = "(SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status, o_totalprice FROM orders)"


def _nulled(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status"), "o_totalprice")


@query(f"SELECT * FROM {_NULLED} WHERE status IS NULL")
def filter_is_null(spark, sf_dir):
    return predicate.apply_filter(_nulled(spark, sf_dir), cmp("status", "isNull"))


@query(f"SELECT * FROM {_NULLED} WHERE NOT coalesce(status = 'F', false)")
def filter_not_two_valued(spark, sf_dir):
    return predicate.apply_filter(_nulled(spark, sf_dir), logic("not", cmp("status", "eq", "F")))


@query(f"SELECT * FROM {_NULLED} WHERE NOT (status = 'F')")
def filter_not_sql_dialect(spark, sf_dir):
    return predicate.apply_filter(_nulled(spark, sf_dir), logic("not", cmp("status", "eq", "F")), "sql")


@query("SELECT * FROM customer WHERE contains(lower(c_name), '99') OR contains(lower(c_mktsegment), '99') OR contains(CAST(c_custkey AS VARCHAR), '99') OR contains(CAST(c_nationkey AS VARCHAR), '99')")
def quick_filter(spark, sf_dir):
    return predicate.quick_filter(table(spark, sf_dir, "customer"), "99", ["c_name", "c_mktsegment", "c_custkey", "c_nationkey"])


# ---- projection, sort, pages ----


@query("SELECT c_custkey, c_name FROM customer")
def project_columns(spark, sf_dir):
    return Source(table(spark, sf_dir, "customer"), "c_custkey").rows(BlockRequest(columns=["c_custkey", "c_name"]))


@query(f"SELECT *, row_number() OVER (ORDER BY status ASC NULLS LAST, o_totalprice DESC, o_orderkey) AS pos FROM {_NULLED}")
def sort_nulls_last(spark, sf_dir):
    sort = [{"columnId": "status", "direction": "asc"}, {"columnId": "o_totalprice", "direction": "desc"}]
    return ordering.positions(_nulled(spark, sf_dir), sort, "o_orderkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY c_name DESC, o_orderkey DESC LIMIT 1000")
def sort_string_top(spark, sf_dir):
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    return ordering.apply_sort(d, [{"columnId": "c_name", "direction": "desc"}], "o_orderkey").limit(1000)


@query("SELECT p_partkey, p_brand, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS INT) DESC, p_partkey DESC) AS pos FROM part")
def sort_natural(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return ordering.positions(d, [{"columnId": "p_brand", "direction": "desc"}], "p_partkey", natural=True)


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def top_k(spark, sf_dir):
    return ordering.apply_sort(table(spark, sf_dir, "orders"), [{"columnId": "o_totalprice", "direction": "desc"}], "o_orderkey").limit(25)


_KEYSET_SORT = [{"columnId": "o_orderstatus", "direction": "desc"}, {"columnId": "o_totalprice", "direction": "asc"}]


@query("""SELECT * FROM orders WHERE o_orderstatus < 'O' OR (o_orderstatus = 'O' AND o_totalprice > 250000.0) OR (o_orderstatus = 'O' AND o_totalprice = 250000.0 AND o_orderkey > 7)
       ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 200""")
def keyset_page_mixed(spark, sf_dir):
    return paging.page(table(spark, sf_dir, "orders"), 200, _KEYSET_SORT, "o_orderkey", paging.KeysetCursor(("O", 250000.0), 7).encode())


@query("""SELECT * FROM orders WHERE o_orderstatus > 'O' OR (o_orderstatus = 'O' AND o_totalprice < 250000.0) OR (o_orderstatus = 'O' AND o_totalprice = 250000.0 AND o_orderkey < 7)
       ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey DESC LIMIT 200""")
def keyset_page_before(spark, sf_dir):
    return paging.page(table(spark, sf_dir, "orders"), 200, _KEYSET_SORT, "o_orderkey", paging.KeysetCursor(("O", 250000.0), 7).encode(), "before")


@query(f"SELECT * FROM {_NULLED} WHERE (status = 'P' AND (o_totalprice > 300000.0 OR (o_totalprice = 300000.0 AND o_orderkey > 9))) OR status > 'P' OR status IS NULL ORDER BY status NULLS LAST, o_totalprice, o_orderkey LIMIT 300")
def keyset_page_nulls(spark, sf_dir):
    sort = [{"columnId": "status", "direction": "asc"}, {"columnId": "o_totalprice", "direction": "asc"}]
    return paging.page(_nulled(spark, sf_dir), 300, sort, "o_orderkey", paging.KeysetCursor(("P", 300000.0), 9).encode())


@query("SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 150")
def offset_page(spark, sf_dir):
    return paging.page(table(spark, sf_dir, "orders"), 50, [{"columnId": "o_orderdate", "direction": "asc"}], "o_orderkey", "offset:150")


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 200 OFFSET 400")
def block_by_index(spark, sf_dir):
    return Source(table(spark, sf_dir, "customer"), "c_custkey").block(2, 200, BlockRequest())


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def total_count(spark, sf_dir):
    return predicate.apply_filter(table(spark, sf_dir, "orders"), cmp("o_orderstatus", "eq", "F", caseSensitive=True)).agg(F.count("*").alias("n"))


# ---- aggregation ----

_AGGS = [{"fn": f, "columnId": "l_quantity"} for f in ("sum", "avg", "count", "countDistinct", "min", "max")]


@query("""SELECT l_shipmode, sum(l_quantity) AS sum_l_quantity, round(avg(l_quantity), 6) AS avg_l_quantity, count(l_quantity) AS count_l_quantity, count(DISTINCT l_quantity) AS countDistinct_l_quantity,
       min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, count(*) AS __count__ FROM (SELECT l_quantity, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1""")
def group_all_aggregates(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_quantity", F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"))
    return aggregate.group(d, ["l_shipmode"], _AGGS).withColumn("avg_l_quantity", F.round("avg_l_quantity", 6))


@query("""SELECT user_id, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value, count(*) AS __count__ FROM events GROUP BY 1""")
def group_first_last(spark, sf_dir):
    return aggregate.group(table(spark, sf_dir, "events"), ["user_id"], [{"fn": "first", "columnId": "value"}, {"fn": "last", "columnId": "value"}], ["event_id"])


@query(f"SELECT status, count(*) AS __count__, round(sum(o_totalprice), 2) AS total FROM {_NULLED} GROUP BY status")
def group_null_key(spark, sf_dir):
    return aggregate.group(_nulled(spark, sf_dir), ["status"], [{"fn": "sum", "columnId": "o_totalprice", "alias": "total"}]).withColumn("total", F.round("total", 2))


@query("""SELECT r_name, n_name, (2 - grouping(r_name) - grouping(n_name))::INT AS __level__, count(*) AS __count__, round(sum(c_acctbal), 2) AS sum_c_acctbal
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def group_tree(spark, sf_dir):
    d = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return aggregate.group_tree(d, ["r_name", "n_name"], [{"fn": "sum", "columnId": "c_acctbal"}]).withColumn("sum_c_acctbal", F.round("sum_c_acctbal", 2))


@query("""WITH d AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders)
SELECT o_orderstatus, NULL AS o_orderpriority, 1 AS __level__, count(*) AS __count__, NULL::BIGINT AS leaf FROM d GROUP BY 1
UNION ALL SELECT o_orderstatus, o_orderpriority, 2, count(*), NULL FROM d WHERE o_orderstatus = 'P' GROUP BY 1, 2
UNION ALL SELECT o_orderstatus, o_orderpriority, 3, 1, o_orderkey FROM d WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'""")
def group_open_paths(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out = aggregate.open_rows(d, ["o_orderstatus", "o_orderpriority"], [], [["P"], ["P", "1-URGENT"]])
    return out.withColumn("leaf", F.col("__row__")["o_orderkey"]).drop("__row__")


@query('SELECT event_type AS "value", count(*) AS "count" FROM events GROUP BY 1')
def distinct_values(spark, sf_dir):
    return aggregate.distinct_values(table(spark, sf_dir, "events"), "event_type")


@query('SELECT count(x) AS "count", round(sum(x), 2) AS "sum", round(avg(x), 3) AS "avg", min(x) AS "min", max(x) AS "max" FROM (SELECT l_quantity AS x FROM lineitem UNION ALL SELECT l_tax FROM lineitem)')
def selection_summary(spark, sf_dir):
    return aggregate.selection_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]).withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 3)})


@query('SELECT l_suppkey & 15 AS "key", sum(l_quantity) AS "sum", count(*) AS "count" FROM lineitem GROUP BY 1')
def hash_aggregate(spark, sf_dir):
    return aggregate.hash_aggregate(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", 15)


@query("SELECT l_orderkey, l_linenumber, (l_quantity > 25)::INT AS mask FROM lineitem")
def mask_filter(spark, sf_dir):
    return aggregate.mask_filter(table(spark, sf_dir, "lineitem"), "l_quantity", "gt", 25).select("l_orderkey", "l_linenumber", "mask")


@query("SELECT sum(l_quantity) AS total FROM lineitem")
def reduce_sum(spark, sf_dir):
    return aggregate.aggregate(table(spark, sf_dir, "lineitem"), [{"fn": "sum", "columnId": "l_quantity", "alias": "total"}])


@query(
    "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS level, SUM(l_quantity) AS sum_qty, COUNT(*) AS n "
    "FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"
)
def cube_returns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.sum("l_quantity").alias("sum_qty"), F.count("*").alias("n"))


# ---- pivot and tree ----

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderstatus, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 2) AS \"total__{p}\"" for p in _PRIORITIES) + " FROM orders GROUP BY 1")
def pivot_sum(spark, sf_dir):
    out = pivot.pivot(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderpriority"], [{"fn": "sum", "columnId": "o_totalprice", "alias": "total"}], _PRIORITIES)
    return out.select("o_orderstatus", *[F.round(F.col(f"`{c}`"), 2).alias(c) for c in out.columns[1:]])


@query("SELECT l_linestatus, " + ", ".join(f"{f} FILTER (l_returnflag = '{v}') AS \"{a}__{v}\"" for v in "ANR" for f, a in (("count(*)", "n"), ("max(l_quantity)", "top"), ("count(DISTINCT l_suppkey)", "sellers"))) + " FROM lineitem GROUP BY 1")
def pivot_measures(spark, sf_dir):
    measures = [{"fn": "count", "columnId": "*", "alias": "n"}, {"fn": "max", "columnId": "l_quantity", "alias": "top"}, {"fn": "countDistinct", "columnId": "l_suppkey", "alias": "sellers"}]
    out = pivot.pivot(table(spark, sf_dir, "lineitem"), ["l_linestatus"], ["l_returnflag"], measures, ["A", "N", "R"])
    return out.na.fill(0, [c for c in out.columns if c.startswith(("n__", "sellers__"))])


@query('SELECT p_partkey, \'p_size\' AS "column", p_size::DOUBLE AS "value" FROM part UNION ALL SELECT p_partkey, \'p_retailprice\', p_retailprice FROM part')
def unpivot(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return pivot.unpivot(d, ["p_partkey"], ["p_size", "p_retailprice"])


def _places(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    none = F.lit(None).cast("string")
    return r.select(key("r", "r_regionkey").alias("id"), none.alias("parent_id")).unionByName(n.select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"))).unionByName(
        c.select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id")))


_PLACES = """p AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""


@query(f"""WITH RECURSIVE {_PLACES}, t AS (SELECT id, parent_id, 0 AS depth FROM p WHERE parent_id IS NULL UNION ALL SELECT p.id, p.parent_id, t.depth + 1 FROM p JOIN t ON p.parent_id = t.id WHERE t.id IN ('r0', 'r1', 'n5'))
SELECT id, parent_id, depth, id IN (SELECT parent_id FROM p WHERE parent_id IS NOT NULL) AS hasChildren, id IN ('r0', 'r1', 'n5') AND id IN (SELECT parent_id FROM p WHERE parent_id IS NOT NULL) AS expanded FROM t""")
def tree_flatten(spark, sf_dir):
    return tree.flatten(_places(spark, sf_dir), ["r0", "r1", "n5"]).drop("path")


@query(f"WITH {_PLACES} SELECT id, parent_id, id IN (SELECT parent_id FROM p WHERE parent_id IS NOT NULL) AS hasChildren FROM p WHERE parent_id = 'r2'")
def tree_children(spark, sf_dir):
    return tree.children(_places(spark, sf_dir), "r2")


@query(f"WITH {_PLACES} SELECT id, parent_id, id IN (SELECT parent_id FROM p WHERE parent_id IS NOT NULL) AS hasChildren FROM p WHERE parent_id IS NULL")
def tree_roots(spark, sf_dir):
    return tree.children(_places(spark, sf_dir), None)


# ---- joins and sets ----


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_sources(spark, sf_dir):
    sources = {f"src_{t}": table(spark, sf_dir, t) for t in ("orders", "customer", "nation")}
    return joins.join_query(spark, sources, "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM src_orders JOIN src_customer ON o_custkey = c_custkey JOIN src_nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def join_left(spark, sf_dir):
    o = predicate.apply_filter(table(spark, sf_dir, "orders"), cmp("o_orderstatus", "eq", "P"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def join_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 450000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def lookup_exact(spark, sf_dir):
    return joins.lookup_exact(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderkey", ["o_orderkey", "o_totalprice"])


_ASOF = """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, max(struct_pack(value := value, event_id := event_id)) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT l.event_id, l.user_id, l.ts, {pick}(r.v.value, r.ts) AS value, {pick}(r.v.event_id, r.ts) AS click FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts {sign} l.ts GROUP BY 1, 2, 3"""


def _asof(spark, sf_dir, direction, **more):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", "ts", "value", F.col("event_id").alias("click"))
    return joins.asof(left, right, "ts", ["user_id"], ["value", "click"], direction, **more)


@query(_ASOF.format(pick="arg_max", sign="<="))
def asof_backward(spark, sf_dir):
    return _asof(spark, sf_dir, "backward")


@query(_ASOF.format(pick="arg_min", sign=">="))
def asof_forward(spark, sf_dir):
    return _asof(spark, sf_dir, "forward")


@query(_ASOF.format(pick="arg_max", sign="<="))
def asof_backward_ranges(spark, sf_dir):
    return _asof(spark, sf_dir, "backward", width=86_400_000_000 * 7)


@query(_ASOF.format(pick="arg_min", sign=">="))
def asof_forward_ranges(spark, sf_dir):
    return _asof(spark, sf_dir, "forward", width=86_400_000_000 * 7)


@query("SELECT e.event_id, b.lo FROM events e JOIN (SELECT (x * 10.0)::DOUBLE AS lo, (x * 10.0 + 4.0)::DOUBLE AS hi FROM range(0, 50) t(x)) b ON e.value >= b.lo AND e.value < b.hi")
def range_join(spark, sf_dir):
    bands = spark.range(50).select((F.col("id") * F.lit(10.0)).alias("lo"), (F.col("id") * F.lit(10.0) + 4.0).alias("hi"))
    return joins.range_join(table(spark, sf_dir, "events"), bands, "value", "lo", "hi", 10.0).select("event_id", "lo")


@query("""WITH l AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '*d?um' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'p*o' ELSE 'x~*' END AS said FROM supplier),
       m AS (SELECT said, min(p_partkey) AS k FROM (SELECT DISTINCT said FROM l) JOIN part ON regexp_full_match(lower(p_type), CASE said WHEN '*d?um' THEN '.*d.um' WHEN 'SMALL' THEN 'small' WHEN 'p*o' THEN 'p.*o' ELSE 'x[*]' END) GROUP BY 1)
       SELECT s_suppkey, said, p_partkey, p_name FROM l LEFT JOIN m USING (said) LEFT JOIN part ON p_partkey = k""")
def lookup_wildcard(spark, sf_dir):
    n = F.col("s_suppkey") % 4
    said = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(n == 0, "*d?um").when(n == 1, "SMALL").when(n == 2, "p*o").otherwise("x~*").alias("said"))
    return joins.lookup_wildcard(said, table(spark, sf_dir, "part"), "said", "p_type", "p_partkey", ["p_partkey", "p_name"])


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_intersect(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_totalprice > 300000").select("o_custkey"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_except(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).subtract(o.where("o_totalprice > 300000").select("o_custkey"))


@query("SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, NULL FROM region")
def vstack(spark, sf_dir):
    return joins.vstack([table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))])


@query("SELECT * FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 480000")
def selection_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return joins.select_rows(o, "o_orderkey", o.where("o_orderstatus = 'P'"), o.where("o_totalprice > 480000"), "union")


# ---- Z-sets and time travel ----

_Z = "z AS (SELECT user_id AS key, value AS x, event_type AS g, event_id AS seq, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS weight FROM events)"


def _z(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("value").alias("x"), F.col("event_type").alias("g"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("weight"))


@query(f"WITH {_Z} SELECT key, arg_max(x, seq) AS x, sum(weight)::BIGINT AS weight FROM z GROUP BY 1 HAVING sum(weight) <> 0")
def zset_coalesce(spark, sf_dir):
    return zset.coalesce(_z(spark, sf_dir), row="x")


@query(f"WITH {_Z} SELECT key, arg_max(x, seq) AS x FROM z GROUP BY 1 HAVING arg_max(weight, seq) > 0")
def zset_integrate(spark, sf_dir):
    return zset.integrate(_z(spark, sf_dir), row="x")


@query(f"WITH {_Z} SELECT key, round(sum(x * weight), 4) AS sum_x, sum(weight)::BIGINT AS n, round(sum(x * weight) / nullif(sum(weight), 0), 6) AS avg_x FROM z GROUP BY 1 HAVING sum(weight) > 0")
def zset_group_sum(spark, sf_dir):
    aggs = [{"fn": "sum", "columnId": "x"}, {"fn": "count", "columnId": "*", "alias": "n"}, {"fn": "avg", "columnId": "x"}]
    return zset.group_aggregate(_z(spark, sf_dir), ["key"], aggs).withColumns({"sum_x": F.round("sum_x", 4), "avg_x": F.round("avg_x", 6)})


@query(f"WITH {_Z}, n AS (SELECT key, g, floor(x) AS x, sum(weight) AS weight FROM z GROUP BY 1, 2, 3 HAVING sum(weight) <> 0) SELECT key, min(x) FILTER (weight > 0) AS min_x, max(x) FILTER (weight > 0) AS max_x FROM n GROUP BY 1 HAVING sum(weight) > 0")
def zset_group_extremes(spark, sf_dir):
    d = _z(spark, sf_dir).select("key", "g", F.floor("x").cast("double").alias("x"), "weight")
    return zset.group_aggregate(d, ["key"], [{"fn": "min", "columnId": "x"}, {"fn": "max", "columnId": "x"}])


@query(f"""WITH {_Z}, s AS (SELECT key, sum(weight) AS was FROM z WHERE seq < 500 GROUP BY 1), d AS (SELECT key, sum(weight) AS plus FROM z WHERE seq >= 500 GROUP BY 1),
c AS (SELECT key, ((coalesce(was, 0) + plus > 0)::INT - (coalesce(was, 0) > 0)::INT) AS weight FROM d LEFT JOIN s USING (key)) SELECT * FROM c WHERE weight <> 0""")
def zset_distinct(spark, sf_dir):
    z = _z(spark, sf_dir)
    return zset.distinct(z.where("seq < 500"), z.where("seq >= 500"))


@query(f"""WITH {_Z}, a AS (SELECT key, sum(weight) AS weight FROM z GROUP BY 1), d AS (SELECT z.key, z.weight * c.weight AS w FROM z JOIN z c ON z.key = c.key WHERE z.g = 'signup' AND c.g = 'error' AND (z.seq >= 500 OR c.seq >= 500))
SELECT key, sum(w)::BIGINT AS weight FROM d GROUP BY 1""")
def zset_join_delta(spark, sf_dir):
    z = _z(spark, sf_dir).select("key", "g", "seq", F.col("weight").cast("long").alias("weight"))
    a, b = z.where("g = 'signup'").select("key", "seq", "weight"), z.where("g = 'error'").select("key", F.col("seq").alias("seq2"), "weight")
    out = zset.join_delta(a.where("seq < 500"), a.where("seq >= 500"), b.where("seq2 < 500"), b.where("seq2 >= 500"), ["key"])
    return out.groupBy("key").agg(F.sum("weight").alias("weight"))


@query("""WITH o AS (SELECT event_id, value FROM events WHERE event_id < 800 ORDER BY value, event_id LIMIT 20), n AS (SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 20)
SELECT event_id, value, -1 AS weight FROM o WHERE event_id NOT IN (SELECT event_id FROM n) UNION ALL SELECT event_id, value, 1 FROM n WHERE event_id NOT IN (SELECT event_id FROM o)""")
def zset_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return zset.top_k_delta(e.where("event_id < 800"), e, [F.col("value"), F.col("event_id")], 20, "event_id")


def _log(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return table(spark, sf_dir, "events").select(kind.alias("kind"), F.col("event_id").alias("version"), F.col("user_id").cast("string").alias("pkey"), F.create_map(F.col("event_type"), F.round("value").cast("long").cast("string")).alias("fields"))


_LOG = """l AS (SELECT CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS kind, event_id AS version, user_id::VARCHAR AS pkey, event_type AS k, round(value)::BIGINT::VARCHAR AS v FROM events)"""


@query(f"""WITH {_LOG}, s AS (SELECT pkey, max(version) FILTER (kind <> 'update') AS start, arg_max(kind, version) AS last FROM l WHERE version <= 700 GROUP BY 1),
c AS (SELECT l.pkey, k, arg_max(v, version) AS v FROM l JOIN s USING (pkey) WHERE version <= 700 AND version >= coalesce(start, -1) AND kind <> 'delete' AND last <> 'delete' GROUP BY 1, 2)
SELECT pkey, string_agg(k || '=' || v, ',' ORDER BY k) AS fields FROM c GROUP BY 1""")
def snapshot_at(spark, sf_dir):
    return temporal.snapshot_at(_log(spark, sf_dir), 700).select("pkey", F.array_join(F.transform(F.sort_array(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


@query(f"WITH {_LOG} SELECT kind, version, pkey, k, v FROM l WHERE version > 100 AND version <= 250")
def diff_between(spark, sf_dir):
    return temporal.diff_between(_log(spark, sf_dir), 100, 250).select("kind", "version", "pkey", F.map_keys("fields")[0].alias("k"), F.map_values("fields")[0].alias("v"))


@query('SELECT a.event_id AS "after", min(b.event_id) AS "before" FROM events a JOIN events b ON b.event_id > a.event_id WHERE a.event_id % 7 <> 3 AND b.event_id % 7 <> 3 GROUP BY 1 HAVING min(b.event_id) - a.event_id > 1')
def version_gaps(spark, sf_dir):
    return temporal.gaps(_log(spark, sf_dir).where("version % 7 <> 3"))


# ---- write-back ----


@query("""SELECT n_nationkey, CASE WHEN n_nationkey = 99 THEN 'ATLANTIS' WHEN n_nationkey = 3 THEN 'CA' ELSE n_name END AS n_name, n_regionkey FROM (SELECT * FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 99, 'ATLANTIS', 1)""")
def mutate_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    kind = "kind string, n_nationkey int, values map<string,string>, expected map<string,string>"
    rows = [("update", 3, {"n_name": "CA"}, {"n_regionkey": str(n.where("n_nationkey = 3").first().n_regionkey)}), ("update", 4, {"n_name": "no"}, {"n_name": "someone else's"}), ("delete", 5, {}, {}), ("insert", 99, {"n_name": "ATLANTIS", "n_regionkey": "1"}, None), ("insert", 1, {"n_name": "no"}, None)]
    return mutate.mutate(n, spark.createDataFrame(rows, kind), "n_nationkey")[0]


def load() -> None:
    """Register the queries of the other modules too."""
    from tessella import formula_queries, stream_queries  # noqa: F401
