"""Column profiles.

One wide aggregate gives rows and per-column null counts; exact distinct
counts come from one (column, value) frequency aggregate (map-side partial
counts, so a hot value costs one row per task); duplicates from one group-by
over all columns. ``exact=False`` swaps the distinct counts for HLL sketches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.operators.stats import qcol

SAMPLE_VALUES = 3
# Longest text that is compared as it is (a SHA-256 has 64 characters).
WIDE_TEXT = 63


def is_missing(df: DataFrame, name: str) -> Column:
    c = qcol(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def value_text(df: DataFrame, name: str) -> Column:
    """Comparable text of a non-missing cell (for distinct counts and samples)."""
    dt = df.schema[name].dataType
    c = qcol(name)
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), (c + F.lit(0.0)).cast("string"))  # -0.0 == 0.0
    if isinstance(dt, (T.MapType, T.StructType, T.ArrayType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def narrow_text(v: Column) -> Column:
    """Text as it is, or its SHA-256 if it is longer than ``WIDE_TEXT``: equal iff the texts are."""
    return F.when(F.length(v) <= WIDE_TEXT, v).otherwise(F.sha2(v.cast("binary"), 256))


def groupable(df: DataFrame) -> list[Column]:
    """All columns in a form usable as grouping keys (maps/variants -> JSON)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.MapType, T.VariantType)):
            out.append(F.to_json(qcol(f.name)).alias(f.name))
        else:
            out.append(qcol(f.name))
    return out


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's cells, equal iff the rows are (NULL equals NULL, -0.0 equals 0.0)."""
    cells = []
    for f, c in zip(df.schema.fields, groupable(df)):
        c = c + F.lit(0.0) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c
        cells.append(c.alias(f.name))
    return F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).cast("binary"), 256)


def duplicate_row_count(df: DataFrame) -> int:
    """Rows equal to an earlier row (NULL equals NULL): rows minus different digests,
    so that a row is shuffled as its digest."""
    n = df.select(row_digest(df).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    r = n.agg(F.sum(F.col("n") - 1).alias("d")).collect()[0]
    return int(r["d"] or 0)


def _distinct(df: DataFrame, cells: list[tuple[int, Column]]) -> DataFrame:
    sp = df.select(*[c.alias(f"s{i}") for i, c in cells])
    args = ", ".join(f"{i}, s{i}" for i, _ in cells)
    long = sp.select(F.expr(f"stack({len(cells)}, {args}) AS (pos, value)")).where(F.col("value").isNotNull())
    return long.select("pos", "value").distinct().groupBy("pos").agg(F.count(F.lit(1)).alias("unique_count"))


def distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(pos, unique_count) per column, NULL / NaN excluded, exact.

    Cells are shuffled as narrow keys: numbers, dates and times as their 64-bit hash
    (one-to-one on 64 bits), text of more than ``WIDE_TEXT`` characters as its SHA-256."""
    cols = cols if cols is not None else df.columns
    parts, numbers, texts = [], [], []
    for i, c in enumerate(cols):
        kind, x = df.schema[c].dataType, qcol(c)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            numbers.append((i, F.when(x.isNotNull() & ~F.isnan(x), F.xxhash64(x.cast("double") + F.lit(0.0)))))
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            numbers.append((i, F.when(x.isNotNull(), F.xxhash64(x))))
        else:
            texts.append((i, narrow_text(value_text(df, c))))
    if numbers:
        parts.append(_distinct(df, numbers))
    if texts:
        parts.append(_distinct(df, texts))
    if not parts:
        return df.sparkSession.createDataFrame([], "pos int, unique_count long")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@dataclass
class Profile:
    rows: int
    columns: list[str]
    dtypes: list[str]
    null_counts: list[int]
    unique_counts: list[int]
    duplicate_rows: int | None
    extra: dict | None = None

    @property
    def missing_cells(self) -> int:
        return int(sum(self.null_counts))

    def frame(self, spark) -> DataFrame:
        rows = []
        for i, c in enumerate(self.columns):
            pct = round(self.null_counts[i] / self.rows * 100, 2) if self.rows else 0.0
            rows.append((i, c, self.dtypes[i], self.null_counts[i], float(pct), self.unique_counts[i]))
        return spark.createDataFrame(
            rows,
            "position int, column string, dtype string, null_count long, null_percentage double, unique_count long",
        )

    def totals(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(self.rows, len(self.columns), self.duplicate_rows)],
            "total_rows long, total_columns long, duplicate_rows long",
        )


def profile(
    df: DataFrame, exact: bool = True, duplicates: bool = True, extra: list[Column] | None = None
) -> Profile:
    """P1-P4 and P6 for every column; ``extra`` aggregates ride along in the
    same scan (results in ``Profile.extra``)."""
    cols = df.columns
    extra = extra or []
    aggs = [F.count(F.lit(1)).alias("__rows"), *extra]
    aggs += [F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]
    if not exact:
        aggs += [F.approx_count_distinct(value_text(df, c)).alias(f"u{i}") for i, c in enumerate(cols)]
    r = df.agg(*aggs).collect()[0]
    nulls = [int(r[f"m{i}"]) for i in range(len(cols))]
    if exact:
        got = {int(x["pos"]): int(x["unique_count"]) for x in distinct_counts(df, cols).collect()}
        uniques = [got.get(i, 0) for i in range(len(cols))]
    else:
        uniques = [int(r[f"u{i}"]) for i in range(len(cols))]
    dups = duplicate_row_count(df) if duplicates else None
    return Profile(
        rows=int(r["__rows"]),
        columns=list(cols),
        dtypes=[f.dataType.simpleString() for f in df.schema.fields],
        null_counts=nulls,
        unique_counts=uniques,
        duplicate_rows=dups,
        extra=r.asDict(),
    )


def sample_values(df: DataFrame, order_by: str, k: int = SAMPLE_VALUES) -> DataFrame:
    """First ``k`` non-missing values per column by ``order_by`` (P5).

    A row_number <= k filter over (column) becomes a window group limit, so
    each task forwards at most k rows per column before the shuffle."""
    cols = [c for c in df.columns]
    sp = df.select(qcol(order_by).alias("__key"), *[value_text(df, c).alias(f"s{i}") for i, c in enumerate(cols)])
    args = ", ".join(f"{i}, s{i}" for i in range(len(cols)))
    long = sp.select("__key", F.expr(f"stack({len(cols)}, {args}) AS (pos, value)")).where(
        F.col("value").isNotNull()
    )
    w = Window.partitionBy("pos").orderBy("__key")
    top = long.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k)
    names = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(cols)), "pos int, column string"))
    return top.join(names, "pos").select("column", F.col("ord").cast("int").alias("ord"), "value")
