"""XLSX workbooks: sheets of cells in and out, with bounds on what an archive may unpack to."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BYTES, MAX_RATIO = 256 << 20, 1000
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats that the file format itself defines as dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def open_archive(data: bytes, max_bytes: int = MAX_BYTES, max_ratio: int = MAX_RATIO) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    total = sum(i.file_size for i in z.infolist())
    if total > max_bytes:
        raise ValueError(f"the archive unpacks to {total} bytes")
    for i in z.infolist():
        if i.file_size > 1 << 16 and i.file_size > max_ratio * max(1, i.compress_size):
            raise ValueError(f"{i.filename} is packed too tightly")
    return z


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def from_serial(x: float) -> dt.datetime:
    return dt.datetime(1899, 12, 30) + dt.timedelta(days=x)


def to_serial(d: dt.date) -> float:
    t = d if isinstance(d, dt.datetime) else dt.datetime(d.year, d.month, d.day)
    return (t.replace(tzinfo=None) - dt.datetime(1899, 12, 30)) / dt.timedelta(days=1)


class Workbook:
    """sheets: name -> {(row, column): value}; formulas: name -> {(row, column): text}. Rows and columns count from 1."""

    def __init__(self, sheets: dict[str, dict] | None = None, formulas: dict[str, dict] | None = None):
        self.sheets, self.formulas = sheets or {}, formulas or {}

    @classmethod
    def read(cls, data: bytes) -> Workbook:
        z = open_archive(data)
        xml = lambda name: ElementTree.fromstring(z.read(name))
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dates = cls._date_styles(xml("xl/styles.xml")) if "xl/styles.xml" in names else set()
        rels = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        book = cls()
        for s in xml("xl/workbook.xml").iter(f"{MAIN}sheet"):
            target = rels[s.get(f"{REL}id")].lstrip("/")
            cells, formulas = cls._cells(xml(target if target.startswith("xl/") else f"xl/{target}"), shared, dates)
            book.sheets[s.get("name")], book.formulas[s.get("name")] = cells, formulas
        return book

    @staticmethod
    def _date_styles(styles) -> set[int]:
        own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{MAIN}numFmt")}
        is_date = lambda n: n in DATE_FORMATS or bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")), re.I))
        xfs = styles.find(f"{MAIN}cellXfs")
        return {k for k, x in enumerate(xfs if xfs is not None else []) if is_date(int(x.get("numFmtId", 0)))}

    @staticmethod
    def _cells(root, shared: list[str], dates: set[int]) -> tuple[dict, dict]:
        cells, formulas = {}, {}
        for c in root.iter(f"{MAIN}c"):
            m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r"))
            at = int(m[2]), column_number(m[1])
            f, v, kind = c.find(f"{MAIN}f"), c.find(f"{MAIN}v"), c.get("t", "n")
            if f is not None and f.text:
                formulas[at] = f.text
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
            elif v is not None and v.text is not None:
                if kind == "s":
                    cells[at] = shared[int(v.text)]
                elif kind in ("str", "e"):
                    cells[at] = v.text
                elif kind == "b":
                    cells[at] = v.text == "1"
                else:
                    x = float(v.text)
                    cells[at] = from_serial(x) if int(c.get("s", 0)) in dates else int(x) if x == int(x) and "." not in v.text else x
        return cells, formulas

    def write(self) -> bytes:
        out = io.BytesIO()
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        names = list(self.sheets)
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
            z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
            base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{base}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'{head}<workbook {ns} xmlns:r="{base}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{base}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + f'<Relationship Id="rId{len(names) + 1}" Type="{base}/styles" Target="styles.xml"/></Relationships>')
            z.writestr("xl/styles.xml", f'{head}<styleSheet {ns}><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
            for k, n in enumerate(names, 1):
                z.writestr(f"xl/worksheets/sheet{k}.xml", f"{head}<worksheet {ns}><sheetData>{self._rows(n)}</sheetData></worksheet>")
        return out.getvalue()

    def _rows(self, name: str) -> str:
        cells, formulas = self.sheets[name], self.formulas.get(name, {})
        by_row: dict[int, list[int]] = {}
        for r, c in {*cells, *formulas}:
            by_row.setdefault(r, []).append(c)
        out = []
        for r in sorted(by_row):
            row = []
            for c in sorted(by_row[r]):
                v, f, at = cells.get((r, c)), formulas.get((r, c)), f"{column_letters(c)}{r}"
                said = f"<f>{escape(f)}</f>" if f else ""
                if v is None:
                    row.append(f'<c r="{at}">{said}</c>' if f else "")
                elif isinstance(v, bool):
                    row.append(f'<c r="{at}" t="b">{said}<v>{int(v)}</v></c>')
                elif isinstance(v, (dt.date, dt.datetime)):
                    row.append(f'<c r="{at}" s="1">{said}<v>{to_serial(v):.10f}</v></c>')
                elif isinstance(v, (int, float)):
                    row.append(f'<c r="{at}">{said}<v>{v!r}</v></c>')
                else:
                    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
                    row.append(f'<c r="{at}" t="str">{said}<v>{escape(t)}</v></c>' if f else f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(t)}</t></is></c>')
            out.append(f'<row r="{r}">{"".join(row)}</row>')
        return "".join(out)

    def table(self, sheet: str, header: bool = True) -> tuple[list[str], list[tuple]]:
        cells = self.sheets[sheet]
        height, width = max((r for r, _ in cells), default=0), max((c for _, c in cells), default=0)
        names = [str(cells.get((1, c), f"_c{c}")) if header else f"_c{c}" for c in range(1, width + 1)]
        return names, [tuple(cells.get((r, c)) for c in range(1, width + 1)) for r in range(2 if header else 1, height + 1)]


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of one workbook as text columns; the file is opened on the driver, as a workbook is one archive."""
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    book = Workbook.read(bytes(data))
    names, rows = book.table(sheet or next(iter(book.sheets)))
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"`{n}` string" for n in names))


def to_xlsx(df: DataFrame, sheet: str = "Sheet1", limit: int = 1_048_575) -> bytes:
    """A workbook of the rows, at most as many as a sheet holds; more are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a sheet holds {limit} rows")
    cells = {(1, c): n for c, n in enumerate(df.columns, 1)}
    for r, row in enumerate(rows, 2):
        cells |= {(r, c): v if isinstance(v, (bool, int, float, dt.date)) else str(v) for c, v in enumerate(row, 1) if v is not None}
    return Workbook({sheet: cells}).write()


class XlsxSource(DataSource):
    """spark.read.format("xlsx_cells"): one row per cell (path, sheet, row, column, value, formula), a task per file."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return "path string, sheet string, row int, column int, value string, formula string"

    def reader(self, schema) -> DataSourceReader:
        return _XlsxReader(self.options)


class _XlsxReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["paths"].split(",") if "paths" in options else [options["path"]]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, at = pafs.FileSystem.from_uri(partition.value if "://" in partition.value else f"file://{partition.value}")
        with fs.open_input_file(at) as f:
            book = Workbook.read(f.read())
        for sheet, cells in book.sheets.items():
            formulas = book.formulas.get(sheet, {})
            for r, c in sorted({*cells, *formulas}):
                v = cells.get((r, c))
                yield partition.value, sheet, r, c, None if v is None else str(v), formulas.get((r, c))
