"""Delimited-text ingest (S1-S3), workbook folders (S4), cleaned-table sink and
read-back (S5/S6), preview (S8).

CSV files are read as text columns first; missing-value tokens become NULL
and each column is then typed from its values (all integers -> long, all
numbers -> double, all True/False without gaps -> boolean, else text), so the
later cleaning compares typed values.
"""

from __future__ import annotations

import csv
import io
import math
import re
import uuid
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.functions.jsonsafe import json_safe_columns
from scrubspark.operators.names import safe_stem
from scrubspark.operators.stats import qcol
from scrubspark.session import persist_reliably
from scrubspark.sources.records import read_records

# --- fixed values -------------------------------------------------------------
# Text read as a missing value (after nothing else: no trimming).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Candidate delimiters, in tie-break order; fallback is the first.
DELIMITERS = [",", ";", "\t", "|"]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
# -----------------------------------------------------------------------------

# Aggregates in one job: few enough for generated code.
AGGS_PER_JOB = 300
_INT_RE = r"^[+-]?\d+$"
_FLOAT_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Inf|INF|infinity|Infinity)$"


@dataclass(frozen=True)
class Layout:
    """What one scan of a delimited file tells about it."""

    file: str
    encoding: str
    delimiter: str
    quotes_span_lines: bool
    header: str  # first line that is not blank
    fields: int  # most fields of a line


def _delimiter_aggs(line: Column, prefix: str) -> list[Column]:
    aggs = []
    for i, d in enumerate(DELIMITERS):
        n = F.when(line != "", F.length(line) - F.length(F.replace(line, F.lit(d), F.lit(""))))
        aggs += [F.min(n).alias(f"{prefix}mn{i}"), F.avg(n).alias(f"{prefix}av{i}"), F.stddev_pop(n).alias(f"{prefix}sd{i}")]
    return aggs


def _pick_delimiter(r, prefix: str) -> str:
    """The candidate that is on every line, with the most even count per line (lowest
    spread relative to the mean); ties in listed order, the first candidate if none is."""
    fit = [
        ((r[f"{prefix}sd{i}"] or 0.0) / r[f"{prefix}av{i}"], i)
        for i in range(len(DELIMITERS))
        if r[f"{prefix}mn{i}"] is not None and r[f"{prefix}mn{i}"] >= 1
    ]
    return DELIMITERS[min(fit)[1]] if fit else DELIMITERS[0]


def _decoded(encoding: str) -> Column:
    """A raw line as text; the text source keeps the file's bytes."""
    return F.decode(F.col("value").cast("binary"), encoding)


def delimiter_counts(lines: DataFrame, col: str = "value") -> DataFrame:
    """S2 over a column of lines: per candidate the least, mean and spread of its count
    on the non-empty lines, and which one is chosen."""
    r = lines.agg(*_delimiter_aggs(qcol(col), "")).first()
    chosen = _pick_delimiter(r, "")
    rows = [(d, r[f"mn{i}"], r[f"av{i}"], r[f"sd{i}"], d == chosen) for i, d in enumerate(DELIMITERS)]
    return lines.sparkSession.createDataFrame(rows, "delimiter string, least int, mean double, spread double, chosen boolean")


def inspect(spark: SparkSession, path: str) -> list[Layout]:
    """S2/S3 per file, in one scan over everything: encoding (UTF-8 unless some line is not
    valid UTF-8, then ISO-8859-1), delimiter by its counts outside quotes, most fields of a
    line, and whether some line holds an odd number of quotes (quoted text may span lines)."""
    raw = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    line = _decoded("ISO-8859-1")  # letter by letter the bytes; delimiters and quotes are ASCII
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    bare = raw.withColumn("line", line).withColumns({"odd": quotes % 2 == 1, "filled": F.trim("line") != "", "bare": F.regexp_replace("line", '"[^"]*"', "")})
    most = [F.max(F.length("bare") - F.length(F.replace("bare", F.lit(d), F.lit("")))).alias(f"mx{i}") for i, d in enumerate(DELIMITERS)]
    rows = (
        bare.groupBy("file_path")
        .agg(
            F.count_if(~F.is_valid_utf8("value")).alias("bad"),
            F.count_if("odd").alias("odd"),
            F.min_by(F.col("value").cast("binary"), F.when(F.col("filled"), F.struct("file_block_start", "at"))).alias("head"),
            *_delimiter_aggs(F.col("bare"), ""),
            *most,
        )
        .orderBy("file_path")
        .collect()
    )
    out = []
    for r in rows:
        if r["head"] is None:
            continue  # nothing but blank lines
        encoding, sep = "ISO-8859-1" if r["bad"] else "UTF-8", _pick_delimiter(r, "")
        fields = (r[f"mx{DELIMITERS.index(sep)}"] or 0) + 1
        out.append(Layout(r["file_path"], encoding, sep, bool(r["odd"]), bytes(r["head"]).decode(encoding), fields))
    return out


def detect_encoding(spark: SparkSession, path: str) -> str:
    """S3, of the first file."""
    return next((f.encoding for f in inspect(spark, path)), "UTF-8")


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """S2, of the first file."""
    seen = inspect(spark, path)
    if not seen or not seen[0].quotes_span_lines:
        return seen[0].delimiter if seen else DELIMITERS[0]
    return read_records(spark, [_as_path(seen[0].file)], DELIMITERS, _pick_by_records)[1][seen[0].file]


def _pick_by_records(stats: dict[int, tuple]) -> int:
    """As ``_pick_delimiter``, from (records, least, sum, sum of squares) per candidate."""
    fit = []
    for i, (n, least, total, squares) in sorted(stats.items()):
        if n and least >= 1:
            fit.append((math.sqrt(max(0.0, squares / n - (total / n) ** 2)) / (total / n), i))
    return min(fit)[1] if fit else min(stats)


def _as_path(uri: str) -> str:
    """A file's URI as a path that a reader takes literally."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri))


def header_names(raw: list[str]) -> list[str]:
    """Header labels as a table library would present them: blanks become
    ``Unnamed: i``, a repeated label gets the first free ``.1``, ``.2`` ..."""
    out: list[str] = []
    used: set[str] = set()
    for i, name in enumerate(raw):
        name = name if name != "" else f"Unnamed: {i}"
        cand, k = name, 0
        while cand in used:
            k += 1
            cand = f"{name}.{k}"
        used.add(cand)
        out.append(cand)
    return out


def _na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def type_text_columns(df: DataFrame) -> DataFrame:
    """Type each text column from its values in one aggregate job.

    Integers become long if every value fits, else decimal(38, 0) if every value fits,
    else they stay text: no value is lost to a narrower type."""
    cols = df.columns
    aggs = []
    for i, c in enumerate(cols):
        x = qcol(c)
        whole = x.rlike(_INT_RE)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.count_if(whole).alias(f"i{i}"),
            F.count(F.when(whole, x.try_cast("long"))).alias(f"l{i}"),
            F.count(F.when(whole, x.try_cast("decimal(38,0)"))).alias(f"d{i}"),
            F.count_if(x.rlike(_FLOAT_RE)).alias(f"f{i}"),
            F.count_if(x.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b{i}"),
        ]
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    r = {}
    for at in range(0, len(aggs), AGGS_PER_JOB):
        r |= df.agg(*aggs[at : at + AGGS_PER_JOB]).first().asDict()
    sel = []
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        x = qcol(c)
        if n == 0:
            sel.append(x.try_cast("double").alias(c))  # empty column: a number column of NULLs
        elif r[f"i{i}"] == n:
            kind = "long" if r[f"l{i}"] == n else "decimal(38,0)" if r[f"d{i}"] == n else "string"
            sel.append(x.try_cast(kind).alias(c))
        elif r[f"f{i}"] == n:
            sel.append(x.try_cast("double").alias(c))
        elif r[f"b{i}"] == n and n == r["__rows"]:
            sel.append(x.isin(TRUE_TOKENS).alias(c))
        else:
            sel.append(x.alias(c))
    return df.select(*sel)


_CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _parsed(width: int) -> T.StructType:
    return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])


def _header(text: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), delimiter=sep), [])


def _plain_parts(spark: SparkSession, layouts: list[Layout]) -> list[tuple[str, list[str], DataFrame]]:
    """(first file, header, rows) per kind of file without line breaks in quotes: Spark's reader."""
    kinds: dict[tuple, list[Layout]] = {}
    for f in layouts:
        kinds.setdefault((f.encoding, f.delimiter, f.header), []).append(f)
    out = []
    for (encoding, sep, head), own in kinds.items():
        header = _header(head, sep)
        header += [""] * (max(f.fields for f in own) - len(header))
        reader = spark.read.options(header=True, sep=sep, encoding=encoding, nullValue="\u0000never\u0000", emptyValue="", **_CSV)
        out.append((own[0].file, header, reader.schema(_parsed(len(header))).csv([_as_path(f.file) for f in own])))
    return out


def _quoted_parts(spark: SparkSession, layouts: list[Layout], sep: str | None) -> list[tuple[str, list[str], DataFrame]]:
    """As ``_plain_parts`` for files with line breaks in quotes: records cut from byte ranges."""
    records, seps = read_records(spark, [_as_path(f.file) for f in layouts], [sep] if sep else DELIMITERS, _pick_by_records)
    records = persist_reliably(records, spark)
    most = {r["file"]: r["n"] + 1 for r in records.groupBy("file").agg(F.max("delimiters").alias("n")).collect()}
    heads = {r["file"]: bytes(r["record"]) for r in records.filter("header").select("file", "record").collect()}
    kinds: dict[tuple, list[Layout]] = {}
    for f in layouts:
        kinds.setdefault((f.encoding, seps[f.file], heads[f.file]), []).append(f)
    out = []
    for (encoding, mark, head), own in kinds.items():
        header = _header(head.decode(encoding), mark)
        header += [""] * (max(most[f.file] for f in own) - len(header))
        options = {"sep": mark, "nullValue": "\u0000never\u0000", "emptyValue": "", "multiLine": "true", **{k: str(v).lower() for k, v in _CSV.items()}}
        rows = records.filter(~F.col("header") & F.col("file").isin([f.file for f in own]))
        cells = F.from_csv(F.decode("record", encoding), _parsed(len(header)).simpleString()[7:-1].replace(":", " "), options)
        out.append((own[0].file, header, rows.select(cells.alias("r")).select("r.*")))
    return out


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """Delimited text with header (a file or a folder of files) -> typed DataFrame.

    Each file is read by its own encoding, delimiter and header; files are united by header
    names, in the order in which files (by name) bring them, absent columns are null. Fields
    beyond the header are kept as columns ``Unnamed: i``. Every file is split over many
    tasks, also one whose quoted fields hold line breaks (``sources.records``)."""
    seen = [replace(f, encoding=encoding or f.encoding, delimiter=sep or f.delimiter) for f in inspect(spark, path)]
    if sep:  # the most fields of a line were counted for another delimiter
        seen = [f if sep in DELIMITERS and f.delimiter == sep else replace(f, fields=0) for f in seen]
    plain, quoted = [f for f in seen if not f.quotes_span_lines], [f for f in seen if f.quotes_span_lines]
    parts = _plain_parts(spark, plain) + (_quoted_parts(spark, quoted, sep) if quoted else [])
    names: list[str] = []
    found = []
    for _, header, rows in sorted(parts, key=lambda p: p[0]):
        own = header_names(header)
        names += [n for n in own if n not in names]
        found.append(({n: f"_c{i}" for i, n in enumerate(own)}, rows))
    if not found:
        return spark.createDataFrame([], T.StructType([]))
    same = [rows.select(*[_na_to_null(F.col(at[n])).alias(f"_u{i}") if n in at else F.lit(None).cast("string").alias(f"_u{i}") for i, n in enumerate(names)]) for at, rows in found]
    return type_text_columns(reduce(DataFrame.unionAll, same)).toDF(*names)


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Any supported source by extension (or explicit ``fmt``)."""
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt in ("csv", "txt", "tsv"):
        return read_csv(spark, path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "json":
        return spark.read.json(path)
    if fmt == "xlsx":
        from scrubspark.sources.workbook import read_workbooks

        return read_workbooks(spark, path)
    raise ValueError("Unsupported file type: use csv, parquet, json or xlsx.")


def cleaned_path(base: str, original_filename: str, fmt: str = "parquet") -> str:
    """S5 naming: ``<base>/cleaned/<safe stem>_<random hex>.<fmt>``."""
    stem = original_filename.rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem else stem
    spark = SparkSession.getActiveSession()
    safe = spark.range(1).select(safe_stem(F.lit(stem)).alias("s")).collect()[0]["s"] if spark else stem
    return f"{base.rstrip('/')}/cleaned/{safe}_{uuid.uuid4().hex}.{fmt}"


def write_cleaned(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write once; an existing path is an error, never overwritten."""
    w = df.write.mode("errorifexists")
    if fmt == "csv":
        w.options(header=True, **_CSV).csv(path)
    else:
        w.parquet(path)
    return path


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """Read back a cleaned table (types kept by Parquet)."""
    if path.rstrip("/").endswith(".csv"):
        return read_csv(spark, path)
    return spark.read.parquet(path)


def preview(df: DataFrame, rows: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """First rows (by key when given), JSON-safe values."""
    src = df.orderBy(*order_by) if order_by else df
    return src.limit(rows).select(*json_safe_columns(df))
