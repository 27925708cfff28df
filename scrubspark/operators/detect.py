"""Type detection on text columns: dates (C5/C6, A1) and numeric text.

Two aggregate jobs at most: the date-hint ratio and the shapes that occur for every text
column, then parse counts only for the columns that passed the hint gate and only for
formats of their shapes. Results are O(columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from scrubspark.functions.dates import DATE_FORMATS, folded_shape, formats_of_shapes, parse_date
from scrubspark.functions.text import (
    DATE_HINT_GATE,
    DATE_PARSE_GATE,
    NUMERIC_GATE,
    date_hint,
    reads_as_number,
)
from scrubspark.operators.stats import qcol


def _hint_aggs(i: int, c: str) -> list[Column]:
    return [F.count(qcol(c)).alias(f"n{i}"), F.count_if(date_hint(qcol(c))).alias(f"h{i}")]


def date_ratios(df: DataFrame, text_cols: list[str]) -> dict[str, tuple[int, int]]:
    """column -> (non-null count, values holding a date-looking substring)."""
    if not text_cols:
        return {}
    r = df.agg(*[a for i, c in enumerate(text_cols) for a in _hint_aggs(i, c)]).collect()[0]
    return {c: (int(r[f"n{i}"]), int(r[f"h{i}"])) for i, c in enumerate(text_cols)}


def parse_counts(df: DataFrame, formats: dict[str, list[str]]) -> dict[str, list[int]]:
    """column -> successful parses per format, in the order of the column's formats."""
    aggs = [F.count(parse_date(qcol(c), fmt)).alias(f"p{i}_{j}") for i, c in enumerate(formats) for j, fmt in enumerate(formats[c])]
    if not aggs:
        return {c: [] for c in formats}
    r = df.agg(*aggs).collect()[0]
    return {c: [int(r[f"p{i}_{j}"]) for j in range(len(formats[c]))] for i, c in enumerate(formats)}


def detect_dates(df: DataFrame, text_cols: list[str], formats: list[str] = DATE_FORMATS) -> dict[str, str]:
    """column -> chosen format, for text columns that pass both gates.

    The scan for the hint also gathers the shapes that occur in each column; only formats
    of those shapes are tried, so the cost does not grow with the number of formats."""
    if not text_cols:
        return {}
    # the hint is found once per cell; what has none is no date, so its shape isn't wanted
    probe = df.select(*[x for i, c in enumerate(text_cols) for x in (qcol(c).alias(f"t{i}"), date_hint(qcol(c)).alias(f"d{i}"))])
    aggs, shapes = [], [F.when(F.col(f"d{i}"), folded_shape(F.col(f"t{i}"))).alias(f"f{i}") for i in range(len(text_cols))]
    for i in range(len(text_cols)):
        aggs += [F.count(f"t{i}").alias(f"n{i}"), F.count_if(f"d{i}").alias(f"h{i}"), F.collect_set(f"f{i}").alias(f"s{i}")]
    r = probe.select("*", *shapes).agg(*aggs).collect()[0]
    tried = {}
    for i, c in enumerate(text_cols):
        if r[f"n{i}"] > 0 and r[f"h{i}"] / r[f"n{i}"] >= DATE_HINT_GATE:
            tried[c] = formats_of_shapes(r[f"s{i}"], formats)
    counts = parse_counts(df, tried)
    out = {}
    for c, fmts in tried.items():
        if not fmts:
            continue
        best = max(range(len(fmts)), key=lambda j: (counts[c][j], -j))
        if counts[c][best] / r[f"n{text_cols.index(c)}"] >= DATE_PARSE_GATE:
            out[c] = fmts[best]
    return out


def numeric_text_scan(df: DataFrame, text_cols: list[str], extra: list[Column]) -> tuple[dict[str, tuple[int, int]], Row | None]:
    """column -> (non-null count, values that read as numbers), and the row of ``extra``
    aggregates found in the same scan."""
    aggs = [*extra]
    for i, c in enumerate(text_cols):
        aggs += [F.count(qcol(c)).alias(f"n{i}"), F.count_if(reads_as_number(qcol(c))).alias(f"k{i}")]
    if not aggs:
        return {}, None
    r = df.agg(*aggs).collect()[0]
    return {c: (int(r[f"n{i}"]), int(r[f"k{i}"])) for i, c in enumerate(text_cols)}, r


def numeric_text_counts(df: DataFrame, text_cols: list[str]) -> dict[str, tuple[int, int]]:
    """column -> (non-null count, values that read as numbers)."""
    return numeric_text_scan(df, text_cols, [])[0]


def detect_numeric_text(df: DataFrame, text_cols: list[str], counts: dict[str, tuple[int, int]] | None = None) -> list[str]:
    """Text columns that hold numbers; ``counts``: those of ``numeric_text_counts`` if known."""
    counts = numeric_text_counts(df, text_cols) if counts is None else counts
    return [c for c, (n, k) in counts.items() if n > 0 and k > 0 and k / n >= NUMERIC_GATE]
