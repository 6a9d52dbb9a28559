"""Delimited text in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, delimiter: str = ",", header: bool = True) -> DataFrame:
    """A CSV with a header; types are inferred by one more read of the file unless a schema is given."""
    r = spark.read.option("header", header).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def cell(c: Column, delimiter: str = ",") -> Column:
    """A cell's text: quoted if it holds a quote, the delimiter or a line end; null is empty."""
    t = c.cast("string")
    needs = t.contains('"') | t.contains(delimiter) | t.contains("\n") | t.contains("\r")
    return F.coalesce(F.when(needs, F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t), F.lit(""))


def lines(df: DataFrame, columns: list[str] | None = None, delimiter: str = ",", skip_empty: bool = False) -> DataFrame:
    """One column, value: each row as a line; rows without any text are left out on request."""
    cols = [F.col(f"`{c}`") for c in columns or df.columns]
    out = df.select(F.concat_ws(delimiter, *[cell(c, delimiter) for c in cols]).alias("value"), F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).alias("_all"))
    return (out.where("_all <> ''") if skip_empty else out).select("value")


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, crlf: bool = False, skip_empty: bool = False) -> None:
    """A folder of CSV parts, written by all tasks at once; crlf ends lines with CR LF."""
    names = df.sparkSession.createDataFrame([tuple(df.columns)], T.StructType([T.StructField(c, T.StringType()) for c in df.columns]))
    out = lines(df, delimiter=delimiter, skip_empty=skip_empty)
    end = "\r\n" if crlf else "\n"
    if header:
        first = lines(names, delimiter=delimiter).first()[0]
        out = out.mapInArrow(_with_head(first), "value string")
    out.write.option("lineSep", end).text(path)


def _with_head(first: str):
    def run(batches):
        import pyarrow as pa

        done = False
        for b in batches:
            if not done and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([first])], ["value"])
                done = True
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    return run


def to_csv_text(df: DataFrame, delimiter: str = ",", header: bool = True, crlf: bool = True, bom: bool = False, limit: int = 100_000) -> str:
    """The rows of a page or report as one text on the driver; more than limit rows are refused."""
    rows = lines(df, delimiter=delimiter).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; use write_csv")
    end = "\r\n" if crlf else "\n"
    names = df.sparkSession.createDataFrame([tuple(df.columns)], T.StructType([T.StructField(c, T.StringType()) for c in df.columns]))
    head = [lines(names, delimiter=delimiter).first()[0]] if header else []
    return ("﻿" if bom else "") + end.join([*head, *(r[0] for r in rows)])
