"""Joins of registered sources, lookups and set operations."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def register_source(spark: SparkSession, name: str, source: DataFrame | str | list) -> None:
    """A DataFrame, a SELECT or rows under a name."""
    df = source if isinstance(source, DataFrame) else spark.sql(source) if isinstance(source, str) else spark.createDataFrame(source)
    df.createOrReplaceTempView(name)


def unregister_source(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def join_query(spark: SparkSession, sources: dict[str, DataFrame | str | list], query: str, args: dict | None = None) -> DataFrame:
    """The query over the sources; their names are gone afterwards, the plan keeps what they stood for."""
    try:
        for name, source in sources.items():
            register_source(spark, name, source)
        return spark.sql(query, args=args) if args else spark.sql(query)
    finally:
        for name in sources:
            with contextlib.suppress(Exception):
                unregister_source(spark, name)


def lookup_exact(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: str, values: list[str], last: bool = False) -> DataFrame:
    """left with the values of the first (or last) row of right whose key is equal, null without one.

    One aggregate reduces right to a row per key before the join, so a key of many rows moves once.
    """
    pick = F.max_by if last else F.min_by
    one = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("__k__")).agg(pick(F.struct(*values), F.col(order)).alias("__v__"))
    return left.join(one, left[left_key] == one["__k__"], "left").select(*[left[c] for c in left.columns], *[F.col("__v__")[v].alias(v) for v in values])


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], direction: str = "backward", strict: bool = False, width: float | None = None) -> DataFrame:
    """left with the values of the nearest row of right by on: the largest at or below (backward), the smallest at or
    above (forward); equal ones count unless strict. Ties of right take its greatest values.

    Both sides are sorted together by a window over `by`; rows of right are first reduced to one per key and time.
    With a width (of a number, or of microseconds for times), a key is cut into ranges of it, each a partition of its
    own, and the last value before a range is carried in: for no `by`, or keys with very many rows.
    """
    back = direction == "backward"
    r = right.groupBy(*by, on).agg(F.max(F.struct(*values)).alias("__v__")).withColumn("__side__", F.lit(1 if strict else 0))
    l = left.withColumn("__v__", F.lit(None).cast(r.schema["__v__"].dataType)).withColumn("__side__", F.lit(0 if strict else 1)).withColumn("__left__", F.lit(True))
    both = l.unionByName(r, allowMissingColumns=True)
    parts = list(by)
    if width is not None:
        kind = dict(both.dtypes)[on]
        at = F.unix_micros(F.col(on).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(on).cast("double")
        both = both.withColumn("__range__", F.floor(at / width))
        parts.append("__range__")
        w = W.partitionBy(*by).orderBy(F.col("__range__").asc() if back else F.col("__range__").desc()).rowsBetween(W.unboundedPreceding, -1)
        ends = both.groupBy(*parts).agg((F.max_by if back else F.min_by)("__v__", F.when(F.col("__left__").isNull(), F.col(on))).alias("__end__"))
        carried = ends.select(*parts, F.last("__end__", ignorenulls=True).over(w).alias("__carried__")).withColumnsRenamed({p: f"__{p}__" for p in parts})
        same = [F.col(p).eqNullSafe(F.col(f"__{p}__")) for p in parts]
        both = both.join(carried, same)
    order = [F.col(on).asc() if back else F.col(on).desc(), F.col("__side__").asc()]
    w = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = F.last("__v__", ignorenulls=True).over(w)
    out = both.withColumn("__v__", F.coalesce(found, F.col("__carried__")) if width is not None else found).where("__left__")
    return out.select(*left.columns, *[F.col("__v__")[v].alias(v) for v in values])


def wildcard_pattern(text: str) -> str:
    """The regular expression of a lookup text with * and ?; ~ takes the next one as it is."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "~" and i + 1 < len(text) and text[i + 1] in "*?~":
            i += 1
            out += "\\" + text[i]
        else:
            out += ".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == "_" else "\\" + c
        i += 1
    return f"(?is)^{out}$"


def pattern_column(text: Column) -> Column:
    """wildcard_pattern of a column of lookup texts."""
    held = {"~~": "\x01", "~*": "\x02", "~?": "\x03"}
    for mark, stand in held.items():
        text = F.replace(text, F.lit(mark), F.lit(stand))
    text = F.regexp_replace(text, r"([\\.\[\]{}()+^$|])", r"\\$1")
    text = F.replace(F.replace(text, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    for stand, back in (("\x01", "~"), ("\x02", "\\*"), ("\x03", "\\?")):
        text = F.replace(text, F.lit(stand), F.lit(back))
    return F.concat(F.lit("(?is)^"), text, F.lit("$"))


def lookup_wildcard(left: DataFrame, right: DataFrame, text: str, key: str, order: str, values: list[str]) -> DataFrame:
    """left with the values of the first row of right, by order, whose key matches left's text with *, ? and ~; null where none does.

    Texts without marks are looked up by equality; each different one with marks is held against right's different keys.
    """
    first = right.where(F.col(key).isNotNull()).groupBy(F.lower(F.col(key).cast("string")).alias("__k__")).agg(F.min_by(F.struct(F.col(order).alias("__o__"), *values), order).alias("__v__"))
    texts = left.select(F.lower(F.col(text).cast("string")).alias("__t__")).distinct()
    marked = F.col("__t__").rlike(r"[*?~]")
    same = texts.where(~marked).join(first, F.col("__t__") == F.col("__k__")).select("__t__", "__v__")
    like = texts.where(marked).withColumn("__p__", pattern_column(F.col("__t__"))).join(first, F.expr("__k__ rlike __p__"))
    found = same.unionByName(like.groupBy("__t__").agg(F.min_by("__v__", F.col("__v__")["__o__"]).alias("__v__")))
    return left.join(found, F.lower(F.col(text).cast("string")) == F.col("__t__"), "left").select(*left.columns, *[F.col("__v__")[v].alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= value < high, joined through buckets of a width instead of by comparing all with all."""
    l = left.withColumn("__b__", F.floor(F.col(value) / width))
    r = right.withColumn("__b__", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return l.join(r, "__b__").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__b__")


def vstack(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def select_rows(df: DataFrame, key: str, first: DataFrame, second: DataFrame, op: str) -> DataFrame:
    """Rows of df whose key is in both (intersect), either (union) or not in (complement) of two selections."""
    a, b = first.select(key), second.select(key)
    keys = {"intersect": a.intersect(b), "union": a.union(b).distinct(), "difference": a.exceptAll(b).distinct()}.get(op)
    if keys is None:
        return df.join(a, key, "left_anti")
    return df.join(keys, key, "left_semi")
