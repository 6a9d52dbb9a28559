"""Column types of requests and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

SIMPLE = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "utf8": T.StringType(), "binary": T.BinaryType(), "bool": T.BooleanType(),
    "date32": T.DateType(), "date64": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamp_tz": T.TimestampType(),
    "time32": T.LongType(), "time64": T.LongType(), "json": T.StringType(), "unknown": T.StringType(),
}

#: SQL type names, tried in order, whole words only (so "interval" is not an integer).
SQL_NAMES = [
    (r"tinyint|int1", "int8"), (r"smallint|int2|smallserial", "int16"), (r"bigint|int8|bigserial|long", "int64"),
    (r"integer|int|int4|mediumint|serial", "int32"), (r"double( precision)?|float8|real8", "float64"), (r"real|float4|float", "float32"),
    (r"decimal|numeric|money", "decimal"), (r"bool(ean)?", "bool"), (r"timestamptz|timestamp with time zone", "timestamp_tz"),
    (r"timestamp( without time zone)?|datetime", "timestamp"), (r"date", "date32"), (r"time", "time64"),
    (r"json|jsonb", "json"), (r"bytea|blob|binary|varbinary", "binary"), (r"(var)?char|character( varying)?|text|string|uuid|enum|clob", "utf8"),
]


def to_spark(kind: str, precision: int | None = None, scale: int | None = None, children: list[dict] | None = None) -> T.DataType:
    """The Spark type of a column type; unsigned integers widen by one step."""
    if kind == "decimal":
        return T.DecimalType(precision or 38, scale if scale is not None else 10)
    if kind in ("list", "struct", "map"):
        inner = [to_spark(c["type"], c.get("precision"), c.get("scale"), c.get("children")) for c in children or []]
        if kind == "list":
            return T.ArrayType(inner[0] if inner else T.StringType())
        if kind == "map":
            return T.MapType(*(inner + [T.StringType()] * 2)[:2])
        return T.StructType([T.StructField(c["id"], t) for c, t in zip(children or [], inner, strict=True)])
    return SIMPLE[kind]


def from_spark(t: T.DataType) -> dict:
    """{type, precision?, scale?, children?} of a Spark type."""
    if isinstance(t, T.DecimalType):
        return {"type": "decimal", "precision": t.precision, "scale": t.scale}
    if isinstance(t, T.ArrayType):
        return {"type": "list", "children": [{"id": "element"} | from_spark(t.elementType)]}
    if isinstance(t, T.MapType):
        return {"type": "map", "children": [{"id": "key"} | from_spark(t.keyType), {"id": "value"} | from_spark(t.valueType)]}
    if isinstance(t, T.StructType):
        return {"type": "struct", "children": [{"id": f.name} | from_spark(f.dataType) for f in t.fields]}
    names = {"byte": "int8", "short": "int16", "integer": "int32", "long": "int64", "float": "float32", "double": "float64", "string": "utf8", "binary": "binary", "boolean": "bool", "date": "date32", "timestamp_ntz": "timestamp", "timestamp": "timestamp_tz"}
    return {"type": names.get(t.typeName(), "unknown")}


def from_sql_name(name: str) -> str:
    """The column type that a database's type name stands for, "unknown" for others."""
    base = re.sub(r"\(.*?\)", "", name.lower()).replace(" unsigned", "").strip()
    return next((kind for pattern, kind in SQL_NAMES if re.fullmatch(pattern, base)), "unknown")


def schema_of(df) -> list[dict]:
    return [{"id": f.name, "nullable": f.nullable} | from_spark(f.dataType) for f in df.schema.fields]


def struct_type(schema: list[dict]) -> T.StructType:
    return T.StructType([T.StructField(c["id"], to_spark(c["type"], c.get("precision"), c.get("scale"), c.get("children")), c.get("nullable", True)) for c in schema])
