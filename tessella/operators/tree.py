"""Trees of (id, parent) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.storage import materialize


def children(df: DataFrame, parent: object | None, id_column: str = "id", parent_column: str = "parent_id") -> DataFrame:
    """A node's children (the roots for None) with hasChildren."""
    mine = df.where(F.col(parent_column).isNull() if parent is None else F.col(parent_column) == F.lit(parent))
    parents = df.where(F.col(parent_column).isNotNull()).select(F.col(parent_column).alias("__p__")).distinct()
    return mine.join(parents, F.col(id_column) == F.col("__p__"), "left").withColumn("hasChildren", F.col("__p__").isNotNull()).drop("__p__")


def flatten(df: DataFrame, open_ids: list | None = None, id_column: str = "id", parent_column: str = "parent_id") -> DataFrame:
    """Rows that show with these ids open (all of them for None): depth, path, hasChildren, expanded.

    Only roots and children of open nodes can show. Each has the path to its nearest known ancestor; in every round
    paths are joined with those of their tops, so they double and a tree of depth n takes log2(n) rounds of one join.
    Nodes on or below a cycle, or below one that does not show, never reach a root and are left out.
    """
    parent = F.col(parent_column)
    is_open = lambda c: F.coalesce(F.lit(True) if open_ids is None else c.isin(list(open_ids)), F.lit(False))
    d = df.select(F.col(id_column).alias("id"), parent.alias("parent_id")).where(F.col("parent_id").isNull() | is_open(F.col("parent_id")))
    state = d.withColumn("up", F.col("parent_id")).withColumn("path", F.array(F.col("id").cast("string")))
    state = materialize(state, "tree")
    while not (pending := state.where("up is not null")).isEmpty():
        above = state.select(F.col("id").alias("top"), F.col("up").alias("next"), F.col("path").alias("head"))
        moved = pending.join(above, pending["up"] == above["top"]).select("id", "parent_id", F.col("next").alias("up"), F.concat("head", "path").alias("path"))
        moved = moved.where(F.col("up").isNull() | ~F.array_contains("path", F.col("up").cast("string")))
        state = materialize(state.where("up is null").select("id", "parent_id", "up", "path").unionByName(moved), "tree")
    parents = df.where(parent.isNotNull()).select(parent.alias("__p__")).distinct()
    out = state.join(parents, F.col("id") == F.col("__p__"), "left").withColumn("hasChildren", F.col("__p__").isNotNull())
    return out.select("id", "parent_id", (F.size("path") - 1).alias("depth"), "path", "hasChildren", (is_open(F.col("id")) & F.col("hasChildren")).alias("expanded")).orderBy("path")


def tree_count(df: DataFrame, open_ids: list | None = None, **names: str) -> int:
    return flatten(df, open_ids, **names).count()
