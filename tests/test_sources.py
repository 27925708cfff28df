"""Small file fixtures for ingest, typing and cleaning rules."""

import os
import tempfile
import zipfile

import pytest

from scrubspark.functions.text import coerce_numeric_text, normalize_headers
from scrubspark.operators.clean import clean
from scrubspark.operators.names import normalize_header_column
from scrubspark.sources.files import cleaned_path, delimiter_counts, detect_delimiter, detect_encoding, read_cleaned, read_csv, read_table, write_cleaned
from scrubspark.sources.workbook import read_workbooks


def _write(text: str, name: str, data: bytes | None = None) -> str:
    d = tempfile.mkdtemp(prefix="scrubspark-test-")
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(data if data is not None else text.encode("utf-8"))
    return p


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiter_detection(spark, sep):
    rows = ["id{0}name{0}amount".format(sep)] + [f"{i}{sep}n{i}{sep}{i * 1.5}" for i in range(20)]
    p = _write("\n".join(rows) + "\n", "delim.csv")
    assert detect_delimiter(spark, p) == sep
    df = read_csv(spark, p)
    assert df.columns == ["id", "name", "amount"]
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "amount": "double"}


def test_one_column_falls_back_to_comma(spark):
    p = _write("name\na\nb\nc\nd\ne\n", "one.csv")
    assert detect_delimiter(spark, p) == ","
    assert read_csv(spark, p).count() == 5


def test_latin1_fallback(spark):
    p = _write("", "latin1.csv", data="a;b\ncaf\xe9;1\nthé;2\n".encode("latin-1"))
    assert detect_encoding(spark, p) == "ISO-8859-1"
    rows = read_csv(spark, p).collect()
    assert rows[0]["a"] == "café"


def test_na_tokens(spark):
    vals = ["", "NA", "N/A", "null", "None", "nan", "#N/A", "-", "x"]
    p = _write("a,k\n" + "\n".join(f"{v},{i}" for i, v in enumerate(vals)) + "\n", "na.csv")
    got = [r["a"] for r in read_csv(spark, p).orderBy("k").collect()]
    assert got == [None] * 7 + ["-", "x"]


def test_header_rules(spark):
    cols = ["  Total  Sales ($)!", "a", "A", "a_2", "é", "__x--y__"]
    assert normalize_headers(spark, cols) == ["total_sales", "a", "a_2", "a_2_2", "column_5", "xy"]
    assert normalize_headers(spark, []) == []


def test_headers_of_many_tables(spark):
    tables = {"t1": ["a", "a", "b"], "t2": ["a", "A "], "t3": ["", "x"]}
    rows = [(t, i, c) for t, cs in tables.items() for i, c in enumerate(cs, start=1)]
    got = normalize_header_column(spark.createDataFrame(rows, "tab string, pos long, h string"), "h", "pos", "tab")
    by = {(r["tab"], r["position"]): r["normalized"] for r in got.collect()}
    for t, cs in tables.items():
        assert [by[t, i] for i in range(1, len(cs) + 1)] == normalize_headers(spark, cs)


@pytest.mark.parametrize(
    "cols",
    [["a", "a", "a_2", "a"], ["a_2", "a", "a", "a_2", "a_2_2"], ["", "column_1", "", "column_3"], ["x"] * 5 + ["x_3"] * 3 + ["x_3_2"]],
)
def test_header_forms_agree(spark, cols):
    want = normalize_headers(spark, cols)
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cols, start=1)], "pos long, h string").repartition(3)
    got = [r["normalized"] for r in normalize_header_column(df, "h", "pos").orderBy("position").collect()]
    assert got == want and len(set(got)) == len(cols)
    if cols == ["a", "a", "a_2", "a"]:
        assert got == ["a", "a_2", "a_2_2", "a_3"]


def test_numeric_text_guard(spark):
    vals = ["$1,200", "(300)", "12%", "(-5)", "1e3", "0x1A", "inf", "nan", "1d", "1f", "-", "+5", "5.", ".5", "1_000"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, v string")
    got = [r["x"] for r in df.select("k", coerce_numeric_text("v").alias("x")).orderBy("k").collect()]
    assert got == [1200.0, -300.0, 12.0, None, 1000.0, None, None, None, None, None, None, 5.0, 5.0, 0.5, None]


@pytest.mark.parametrize(
    "vals,expect",
    [
        (["2024-01-05", "2024-02-10", "2024-03-15", "x"], "timestamp"),
        (["01/31/2024", "02/15/2024", "12/01/2023"], "timestamp"),
        (["31/01/2024", "15/02/2024", "13/12/2023"], "timestamp"),
        (["Jan 5, 2024", "Feb 10, 2024", "Mar 3, 2024"], "timestamp"),
        (["2024-01-05 10:00:00.123", "2024-01-06 11:00:00.5", "2024-01-07 12:00:00.000001"], "timestamp"),
        (["2024-01-05T10:00:00Z", "2024-02-10T11:30:00+02:00", "2024-03-01T00:00:00.25Z"], "timestamp"),
        (["1/5/2024 10:30", "2/10/2024 9:05", "12/31/2024 23:59"], "timestamp"),
        (["5-Jan-2024", "10-FEB-2024", "3-mar-2024"], "timestamp"),
        (["Jan 5 2024", "feb 10 2024", "MAR 3 2024"], "timestamp"),
        (["2024-01-05", "2024-02-10", "hello", "world", "foo"], "string"),
        (["192.168.1.10", "marker 12", "192.168.1.11"], "string"),
    ],
)
def test_date_gates(spark, vals, expect):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, v string")
    res = clean(df)
    assert dict(res.table.dtypes)["v"] == expect


def test_whitespace_strip_and_fill(spark):
    df = spark.createDataFrame(
        [(1, "\tA\n", 1.0), (2, " A ", None), (3, None, 3.0), (4, "B", 5.0)], "k long, s string, x double"
    )
    res = clean(df)
    rows = {r["k"]: r for r in res.table.collect()}
    assert rows[1]["s"] == "A" and rows[2]["s"] == "A" and rows[3]["s"] == "Unknown"
    assert rows[2]["x"] == 3.0  # median of 1, 3, 5
    log = {r["column"]: r for r in res.plan.change_log(spark).collect()}
    assert log["s"]["transformations"][0] == "stripped whitespace from 2 values"


def test_all_null_column_filled_with_zero(spark):
    p = _write("a,b\n1,\n2,\n3,\n", "all_null.csv")
    df = read_csv(spark, p)
    res = clean(df)
    assert [r["b"] for r in res.table.collect()] == [0.0, 0.0, 0.0]


def test_dedup_after_strip(spark):
    df = spark.createDataFrame([(1, "a"), (1, " a"), (2, "b"), (2, "b")], "k long, s string")
    res = clean(df)
    assert res.plan.raw_duplicate_rows == 1
    assert res.plan.duplicates_removed == 2
    assert res.table.count() == 2


def _xlsx(path: str, rows: list[list[str]]):
    shared = sorted({c for r in rows for c in r if not c.replace(".", "").isdigit()})
    idx = {s: i for i, s in enumerate(shared)}

    def cell(ref, v):
        if v.replace(".", "").isdigit():
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="s"><v>{idx[v]}</v></c>'

    body = "".join(
        f'<row r="{i + 1}">' + "".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r)) + "</row>"
        for i, r in enumerate(rows)
    )
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        sst = "".join(f"<si><t>{s}</t></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{sst}</sst>")


def test_workbook_folder(spark):
    d = tempfile.mkdtemp(prefix="scrubspark-xlsx-")
    _xlsx(os.path.join(d, "book.xlsx"), [["name", "qty"], ["a", "1"], ["b", "2"], ["c", "3"], ["d", "4"], ["e", "5"]])
    df = read_workbooks(spark, d)
    assert df.columns == ["name", "qty"]
    assert dict(df.dtypes)["qty"] == "bigint"
    assert sorted(r["qty"] for r in df.collect()) == [1, 2, 3, 4, 5]
    assert read_table(spark, d, fmt="xlsx").count() == 5


def test_workbooks_are_matched_by_name(spark):
    d = tempfile.mkdtemp(prefix="scrubspark-xlsx-")
    _xlsx(os.path.join(d, "a.xlsx"), [["name", "qty"], ["n1", "1"]])
    _xlsx(os.path.join(d, "b.xlsx"), [["qty", "name", "city"], ["2", "n2", "Oslo"]])
    df = read_workbooks(spark, d)
    assert df.columns == ["name", "qty", "city"]
    assert sorted((r["name"], r["qty"], r["city"]) for r in df.collect()) == [("n1", 1, None), ("n2", 2, "Oslo")]


def test_workbook_cells_without_reference_and_dates(spark):
    d = tempfile.mkdtemp(prefix="scrubspark-xlsx-")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    text = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    body = (
        f"<row>{text('day')}{text('at')}{text('n')}{text('d2')}</row>"
        '<row><c s="1"><v>45296</v></c><c s="2"><v>45296.5</v></c><c><v>3</v></c><c r="D2" s="3"><v>1.5</v></c></row>'
        '<row><c s="1"><v>45297</v></c><c r="C3"><v>4</v></c></row>'
    )
    styles = (
        f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd hh:mm"/>'
        '<numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'
    )
    with zipfile.ZipFile(os.path.join(d, "x.xlsx"), "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/styles.xml", styles)
    rows = sorted(tuple(r) for r in read_workbooks(spark, d).collect())
    assert rows == [("2024-01-05", "2024-01-05 12:00:00", 3, 1.5), ("2024-01-06", None, 4, None)]


def test_long_integers_are_kept(spark):
    ids = ["1234567890123456789012345", "9" * 25, "7"]
    wide = ["1" * 45, "2", "3"]
    p = _write("id,wide,n\n" + "\n".join(f"{a},{b},{i}" for i, (a, b) in enumerate(zip(ids, wide))) + "\n", "ids.csv")
    df = read_csv(spark, p)
    assert dict(df.dtypes) == {"id": "decimal(38,0)", "wide": "string", "n": "bigint"}
    assert sorted(str(r["id"]) for r in df.collect()) == sorted(ids)
    assert sorted(str(r["id"]) for r in clean(df).table.collect()) == sorted(ids)


def test_delimiter_is_judged_on_all_lines(spark):
    lines = [f"{i};a,b" for i in range(210)] + [f"{i};ab" for i in range(500)]
    p = _write("\n".join(lines) + "\n", "late.csv")
    assert detect_delimiter(spark, p) == ";"
    got = {r["delimiter"]: r["chosen"] for r in delimiter_counts(spark.read.text(p)).collect()}
    assert got == {",": False, ";": True, "\t": False, "|": False}


def test_splitting_depends_on_quotes(spark):
    body = "".join(f"{i},text {i}\n" for i in range(60000))
    plain, quoted = _write("a,b\n" + body, "plain.csv"), _write('a,b\n1,"two\nlines"\n' + body, "quoted.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        split, whole = read_csv(spark, plain), read_csv(spark, quoted)
        assert split.rdd.getNumPartitions() > 1 and split.count() == 60000
        assert whole.count() == 60001 and whole.filter("a = 1 and b like 'two%lines'").count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sink_and_read_back(spark):
    d = tempfile.mkdtemp(prefix="scrubspark-sink-")
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "k long, s string, x double")
    for fmt in ("parquet", "csv"):
        path = write_cleaned(df, cleaned_path(d, "My File (1).csv", fmt), fmt)
        assert "/cleaned/my_file_1_" in path
        got = read_cleaned(spark, path)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect())) and got.columns == df.columns
        with pytest.raises(Exception, match="(?i)exist"):
            write_cleaned(df, path, fmt)


def test_sheet_memory_does_not_grow_with_its_rows():
    import io
    import tracemalloc
    import zipfile

    from scrubspark.sources.workbook import sheet_rows

    def book(n):
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rows = "".join(f'<row><c t="s"><v>{i % 7}</v></c><c><v>{i}</v></c><c t="inlineStr"><is><t>t{i}</t></is></c></row>' for i in range(n))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>s</t></r><r><t>{i}</t></r></si>" for i in range(7)) + "</sst>")
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")
        return out.getvalue()

    peaks = []
    for n in (2000, 20000):
        content = book(n)
        tracemalloc.start()
        for i, row in enumerate(sheet_rows(content)):
            assert row == [f"s{i % 7}", str(i), f"t{i}"]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert i == n - 1
    assert peaks[1] < peaks[0] + (1 << 19), peaks
