"""Databases over JDBC, schemas from their catalogs, and change capture by polling an outbox."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tessella import types

#: JDBC drivers and the dialect whose filter rules a database follows.
DRIVERS = {"postgresql": ("org.postgresql.Driver", "sql"), "mysql": ("com.mysql.cj.jdbc.Driver", "sql"), "sqlite": ("org.sqlite.JDBC", "sql"), "clickhouse": ("com.clickhouse.jdbc.ClickHouseDriver", "sql"), "duckdb": ("org.duckdb.DuckDBDriver", "grid")}


def options(url: str, table: str | None = None, query: str | None = None, split: tuple[str, int, int, int] | None = None, fetch: int = 10_000) -> dict[str, str]:
    """Reader options of a table or a SELECT; split (column, low, high, parts) reads it in parallel ranges.

    Filters, projections and, for a table, aggregates and limits of a request are pushed down by Spark.
    """
    kind = url.split(":")[1]
    if kind not in DRIVERS:
        raise ValueError(f"no driver for {kind}")
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    out = {"url": url, "driver": DRIVERS[kind][0], "fetchsize": str(fetch), "pushDownAggregate": "true", "pushDownLimit": "true"}
    out |= {"dbtable": table} if table else {"query": query}
    if split:
        if query:
            raise ValueError("a query is read whole; split a table")
        out |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, split), strict=True))
    return out


def read(spark: SparkSession, url: str, **more) -> DataFrame:
    return spark.read.format("jdbc").options(**options(url, **more)).load()


def dialect_of(url: str) -> str:
    return DRIVERS[url.split(":")[1]][1]


def schema_from_catalog(rows: list[dict]) -> dict[str, list[dict]]:
    """Tables of information_schema.columns rows: name -> columns in order."""
    out: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["table_name"], int(r.get("ordinal_position", 0)))):
        c = {"id": r["column_name"], "type": types.from_sql_name(r["data_type"]), "nullable": str(r.get("is_nullable", "YES")).upper() == "YES"}
        if c["type"] == "decimal":
            c |= {"precision": int(r.get("numeric_precision") or 38), "scale": int(r.get("numeric_scale") or 0)}
        out.setdefault(r["table_name"], []).append(c)
    return out


def schema_from_pragma(rows: list[dict]) -> list[dict]:
    """Columns of SQLite's table_info rows."""
    return [{"id": r["name"], "type": types.from_sql_name(r["type"]), "nullable": not r["notnull"]} for r in sorted(rows, key=lambda r: r["cid"])]


class OutboxSource(DataSource):
    """spark.readStream.format("outbox"): row diffs from a folder of JSON lines {kind, version, pkey, fields}.

    Each poll takes about `batch` (1000) diffs after the last version, in order and never part of a version; the version
    is the offset, so a restarted stream goes on where it was.
    """

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return "kind string, version bigint, pkey string, fields map<string,string>"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _OutboxReader(self.options)


class _OutboxReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.batch = options["path"], int(options.get("batch", 1000))

    def initialOffset(self) -> dict:
        return {"version": -1}

    def _after(self, low: int, high: float = float("inf")) -> list[tuple]:
        import json

        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        out = []
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if f.is_file and f.base_name.endswith(".jsonl"):
                with fs.open_input_stream(f.path) as s:
                    for line in s.read().decode().splitlines():
                        d = json.loads(line)
                        if low < d["version"] <= high:
                            out.append((d["kind"], d["version"], str(d["pkey"]), {k: None if v is None else str(v) for k, v in (d.get("fields") or {}).items()}))
        return sorted(out, key=lambda r: r[1])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._after(start["version"])
        n = self.batch
        while 0 < n < len(rows) and rows[n][1] == rows[n - 1][1]:  # a version is taken whole
            n += 1
        rows = rows[:n]
        return iter(rows), {"version": rows[-1][1] if rows else start["version"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._after(start["version"], end["version"]))

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Make the Python sources of this package known to a session."""
    from tessella.sources.workbook import XlsxSource

    spark.dataSource.register(OutboxSource)
    spark.dataSource.register(XlsxSource)


