"""Connected components of an edge table, by Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common


def _onto(edges: DataFrame, low: DataFrame) -> DataFrame:
    """The edges (u, v) with u's value m of a table (u, m, number of edges)."""
    low = common.materialize(low.where("n > 0"), "stars")
    most, total = low.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if most * common.HOT_SHARE <= total:  # no vertex of very many edges
        return edges.join(low.select("u", "m"), "u")
    return common.join_by_count(edges, low, ["u"], "n", total)


def _print(edges: DataFrame) -> tuple:
    """Number of edges and two sums of their hashes: alike for alike sets of edges, and found by a scan alone."""
    sums = [F.sum(F.xxhash64(F.lit(salt), "v", "u").cast("decimal(20)")) for salt in (1, 2)]
    return tuple(edges.agg(F.count("*"), *sums).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each vertex of an edge with the smallest vertex it reaches.

    Alternating large-star and small-star rounds: every vertex links its larger, then its smaller neighbours to the
    smallest of them all. Rounds grow with the logarithm of the longest path; each is one sum per vertex that is
    combined before it moves, and one join, in which a vertex of very many edges is not shuffled; rounds end when the
    edges keep their number and hash sums. Null ends and loops are left out; an empty table gives an empty one.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("v < u").distinct()
    e = common.materialize(e, "edges")
    seen = _print(e)
    while True:
        # large-star: u's neighbours larger than u go to the smallest of u's neighbours and u
        both = e.select(F.col("u"), F.col("v")).unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        large = _onto(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.materialize(large, "edges")
        # small-star: u's smaller neighbours and u go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _onto(large, low).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = common.materialize(small.select("x.v", "x.u").where("v < u").distinct(), "edges")
        now = _print(new)
        if now == seen:
            break
        e, seen = new, now
    star = new.groupBy("u").agg(F.min("v").alias("component"))
    return star.select(F.col("u").alias("id"), "component").unionByName(new.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
