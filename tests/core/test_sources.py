import datetime as dt
import io
import json
import zipfile

import pytest

from tessella.sources import databases, delimited, workbook


def test_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a,"b"'), (2, "line\nend"), (3, None), (4, "")], "id int, t string")
    text = delimited.to_csv_text(d.orderBy("id"), crlf=True, bom=True)
    assert text == '﻿id,t\r\n1,"a,""b"""\r\n2,"line\nend"\r\n3,\r\n4,'
    delimited.write_csv(d, str(tmp_path / "c"), delimiter=";")
    back = delimited.read_csv(spark, str(tmp_path / "c"), "id int, t string", ";")
    assert {(r.id, r.t or None) for r in back.collect()} == {(1, 'a,"b"'), (2, "line\nend"), (3, None), (4, None)}
    assert delimited.lines(spark.createDataFrame([(None, None)], "a string, b string"), skip_empty=True).count() == 0
    with pytest.raises(ValueError):
        delimited.to_csv_text(d, limit=2)


def test_workbook_round_trip(spark, tmp_path):
    cells = {(1, 1): "n", (1, 2): "when", (2, 1): 3, (2, 2): dt.datetime(2024, 2, 29, 12), (3, 1): 2.5, (3, 2): True, (4, 1): "<&>", (5, 1): 5.5}
    data = workbook.Workbook({"One": cells, "Two": {(1, 28): "far"}}, {"One": {(5, 1): "SUM(A2:A3)"}}).write()
    back = workbook.Workbook.read(data)
    assert back.sheets["One"] == cells and back.sheets["Two"] == {(1, 28): "far"} and back.formulas["One"] == {(5, 1): "SUM(A2:A3)"}
    (tmp_path / "b.xlsx").write_bytes(data)
    assert workbook.read_xlsx(spark, str(tmp_path / "b.xlsx"), "One").count() == 4
    databases.register(spark)
    rows = spark.read.format("xlsx_cells").option("path", str(tmp_path / "b.xlsx")).load().where("formula is not null").collect()
    assert [(r.sheet, r.row, r.formula) for r in rows] == [("One", 5, "SUM(A2:A3)")]
    out = workbook.Workbook.read(workbook.to_xlsx(spark.createDataFrame([(1, None, "x")], "a int, b int, c string")))
    assert out.sheets["Sheet1"] == {(1, 1): "a", (1, 2): "b", (1, 3): "c", (2, 1): 1, (2, 3): "x"}


def test_archive_bounds():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"\0" * (4 << 20))
    with pytest.raises(ValueError):
        workbook.open_archive(b.getvalue(), max_ratio=100)
    with pytest.raises(ValueError):
        workbook.open_archive(b.getvalue(), max_bytes=1 << 20)


def test_catalogs():
    rows = [{"table_name": "t", "column_name": "x", "data_type": "numeric", "is_nullable": "NO", "ordinal_position": 2, "numeric_precision": 10, "numeric_scale": 2}, {"table_name": "t", "column_name": "id", "data_type": "bigint", "ordinal_position": 1}]
    assert databases.schema_from_catalog(rows) == {"t": [{"id": "id", "type": "int64", "nullable": True}, {"id": "x", "type": "decimal", "nullable": False, "precision": 10, "scale": 2}]}
    assert databases.schema_from_pragma([{"cid": 0, "name": "a", "type": "TEXT", "notnull": 1}]) == [{"id": "a", "type": "utf8", "nullable": False}]
    o = databases.options("jdbc:postgresql://h/db", table="t", split=("id", 0, 100, 4))
    assert o["numPartitions"] == "4" and o["driver"] == "org.postgresql.Driver"
    for bad in ({"table": "t", "query": "q"}, {}, {"query": "q", "split": ("id", 0, 1, 2)}):
        with pytest.raises(ValueError):
            databases.options("jdbc:mysql://h/db", **bad)


def test_outbox_stream(spark, tmp_path):
    databases.register(spark)
    (tmp_path / "box").mkdir()
    (tmp_path / "box/1.jsonl").write_text("\n".join(json.dumps({"kind": "insert", "version": v, "pkey": f"k{v}", "fields": {"x": v}}) for v in (2, 1, 3)))
    df = spark.readStream.format("outbox").option("path", str(tmp_path / "box")).load()
    q = df.writeStream.format("memory").queryName("box").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.version, r.fields["x"]) for r in spark.table("box").orderBy("version").collect()] == [(1, "1"), (2, "2"), (3, "3")]


def test_outbox_takes_versions_whole(tmp_path):
    import json

    from tessella.sources.databases import _OutboxReader

    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"kind": "insert", "version": v, "pkey": str(k), "fields": {}}) for k, v in enumerate([1, 1, 1, 2, 3, 3])))
    reader, at, seen = _OutboxReader({"path": str(tmp_path), "batch": 2}), {"version": -1}, []
    for _ in range(4):
        rows, at = reader.read(at)
        seen += [r[2] for r in rows]
    assert seen == [str(k) for k in range(6)]
