"""Workbook-folder ingest (S4): every .xlsx file of a folder, first sheet,
first row as header.

Files are read by the ``binaryFile`` source; a Python task per file turns the
sheet XML into rows keyed by the file's own header (stdlib zip + XML, no
spreadsheet library), then the CSV typing path types the columns.
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.session import persist_reliably
from scrubspark.sources.files import NA_TOKENS, header_names, type_text_columns

# --- fixed values: number format ids that show dates or times -----------------
BUILT_IN_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
# -----------------------------------------------------------------------------
ROWS_AT_ONCE = 2000

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet(z: zipfile.ZipFile) -> str:
    names = set(z.namelist())
    try:
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        first = wb.find("m:sheets/m:sheet", _NS)
        rid = first.get(_REL) if first is not None else None
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        for rel in rels:
            if rel.get("Id") == rid:
                target = rel.get("Target").lstrip("/")
                return target if target.startswith("xl/") else f"xl/{target}"
    except KeyError:
        pass
    sheets = sorted(n for n in names if n.startswith("xl/worksheets/sheet"))
    return sheets[0]


def _is_date_format(code: str) -> bool:
    """A number format with a day, month, year, hour or second outside quotes and brackets."""
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code)
    return bool(re.search(r"[dmyhs]", plain, re.I)) and "general" not in plain.lower()


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.findall("m:numFmts/m:numFmt", _NS)}
    styles = set()
    for i, xf in enumerate(root.findall("m:cellXfs/m:xf", _NS)):
        k = int(xf.get("numFmtId", "0"))
        if k in BUILT_IN_DATE_FORMATS if k not in own else _is_date_format(own[k]):
            styles.add(i)
    return styles


def _date_text(serial: str, first_day: datetime) -> str:
    """ISO text of a day number (a date alone if it has no time)."""
    seconds = round(float(serial) * 86400)
    when = first_day + timedelta(seconds=seconds)
    return when.strftime("%Y-%m-%d") if seconds % 86400 == 0 else when.strftime("%Y-%m-%d %H:%M:%S")


def _elements(part, name: str, parent: str) -> Iterator[ET.Element]:
    """The elements ``name`` of an XML part one by one; each is let go after its use, so that
    memory does not grow with their number."""
    holder = None
    for event, element in ET.iterparse(part, ("start", "end")):
        if event == "start":
            if element.tag == parent:
                holder = element
        elif element.tag == name:
            yield element
            if holder is not None:
                holder.clear()


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text cells (None for empty cells). A cell without a
    reference follows the one before it; day numbers in a date style become ISO text."""
    z = zipfile.ZipFile(io.BytesIO(content))
    tag = lambda name: f"{{{_NS['m']}}}{name}"
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as part:
            for si in _elements(part, tag("si"), tag("sst")):
                shared.append("".join(t.text or "" for t in si.iter(tag("t"))))
    dates, first_day = _date_styles(z), datetime(1899, 12, 30)
    if "xl/workbook.xml" in z.namelist():
        props = ET.fromstring(z.read("xl/workbook.xml")).find("m:workbookPr", _NS)
        if props is not None and props.get("date1904") in ("1", "true"):
            first_day = datetime(1904, 1, 1)
    with z.open(_first_sheet(z)) as sheet:
        for row in _elements(sheet, tag("row"), tag("sheetData")):
            cells: dict[int, str | None] = {}
            at = -1
            for c in row.findall("m:c", _NS):
                at = _col_index(c.get("r")) if c.get("r") else at + 1
                kind, v = c.get("t", "n"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(tag("t")))
                elif v is None or v.text is None:
                    cells[at] = None
                elif kind == "s":
                    cells[at] = shared[int(v.text)]
                elif kind == "b":
                    cells[at] = "True" if v.text == "1" else "False"
                elif kind == "n" and int(c.get("s", "-1")) in dates:
                    cells[at] = _date_text(v.text, first_day)
                else:
                    cells[at] = v.text
            yield [cells.get(i) for i in range(max(cells) + 1 if cells else 0)]


def _explode_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per data row its cells by the file's own header, some rows of one file at a time."""
    schema = pa.schema([("path", pa.string()), ("row_no", pa.int64()), ("names", pa.list_(pa.string())), ("cells", pa.map_(pa.string(), pa.string()))])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            names: list[str] | None = None
            out: list[tuple] = []
            for n, cells in enumerate(sheet_rows(content.as_py())):
                if names is None:
                    names = header_names([c if c is not None else "" for c in cells])
                    out.append((path, n, names, None))
                    continue
                extra = [f"Unnamed: {i}" for i in range(len(names), len(cells))]
                out.append((path, n, None, [(k, v) for k, v in zip(names + extra, cells) if v is not None]))
                if extra:
                    out.append((path, n, extra, None))
                if len(out) >= ROWS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def workbook_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(path, row_no, names, cells): data rows as name -> text maps; rows with ``names``
    declare columns, the header of each file first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder).select("path", "content")
    return files.mapInArrow(_explode_files, "path string, row_no long, names array<string>, cells map<string,string>")


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Typed table of all workbooks: columns are matched by name over the files, in order
    of first appearance (by path, then place); a file without a column has nulls there."""
    rows = persist_reliably(workbook_rows(spark, folder), spark)
    declared = rows.where("names is not null").select("path", "row_no", F.posexplode("names").alias("at", "name"))
    # one row per column name
    first = declared.groupBy("name").agg(F.min(F.struct("path", "row_no", "at")).alias("place")).orderBy("place")
    names = [r["name"] for r in first.collect()]
    if not names:
        return spark.createDataFrame([], "value string")
    cell = lambda n: F.element_at("cells", F.lit(n))
    cols = [F.when(~cell(n).isin(NA_TOKENS), cell(n)).alias(f"_c{i}") for i, n in enumerate(names)]
    return type_text_columns(rows.where("cells is not null").select(*cols)).toDF(*names)
