"""Chart-ready frames (V1-V8). Rendering is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubspark.operators.analyze import Analysis
from scrubspark.operators.stats import qcol

# --- fixed values -------------------------------------------------------------
PLOT_SAMPLE_LIMIT = 1800
SAMPLE_SEED = 42
MAX_DISTRIBUTION_CHARTS = 4
MAX_HEATMAP_COLUMNS = 8
MIN_HEATMAP_COLUMNS = 3
MAX_CATEGORICAL_CHARTS = 6
MAX_CATEGORY_DISTINCT = 20  # columns with fewer distinct values get a bar chart
BAR_VALUES = 10
MAX_OUTLIER_CHARTS = 3
# -----------------------------------------------------------------------------


def _by_variance(a: Analysis) -> list[tuple[int, str, float | None]]:
    rows = [(i, c, a.moments[c].var) for i, c in enumerate(a.numeric)]
    # largest first, undefined variance last, ties by column position
    return sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0]))


def top_variance(a: Analysis, k: int = MAX_DISTRIBUTION_CHARTS) -> DataFrame:
    """V1: the k numeric columns with the largest sample variance."""
    rows = [(n + 1, c, v) for n, (_, c, v) in enumerate(_by_variance(a)[:k])]
    return a.spark.createDataFrame(rows, "rank int, column string, variance double")


def sample_points(df: DataFrame, k: int = PLOT_SAMPLE_LIMIT, seed: int = SAMPLE_SEED) -> DataFrame:
    """V2: a repeatable sample of at most k rows: the k smallest seeded row
    hashes (a top-k, so each task forwards at most k rows). The hash is the MD5 of
    the values' texts and the seed, which any engine can repeat."""
    texts = [F.coalesce(qcol(c).cast("string"), F.lit("")) for c in df.columns]
    h = F.md5(F.concat_ws("|", *texts, F.lit(str(seed))).cast("binary"))
    return df.withColumn("__h", h).orderBy("__h", *[qcol(c) for c in df.columns]).limit(k).drop("__h")


def distribution_data(a: Analysis, k: int = MAX_DISTRIBUTION_CHARTS) -> DataFrame:
    """V3: histogram frames of the top-variance columns (full data)."""
    cols = [c for _, c, _ in _by_variance(a)[:k]]
    return a.histogram(cols)


def heatmap(a: Analysis) -> DataFrame:
    """V4: correlation (2 dp) among the top-8 variance columns; needs >= 3."""
    if len(a.numeric) < MIN_HEATMAP_COLUMNS:
        return a.spark.createDataFrame([], "column_a string, column_b string, r double")
    cols = [c for _, c, _ in _by_variance(a)[:MAX_HEATMAP_COLUMNS]]
    return a.correlation_matrix(cols).select("column_a", "column_b", F.round("r", 2).alias("r"))


def bar_data(a: Analysis) -> DataFrame:
    """V5: for up to 6 low-cardinality text columns (fewest distinct first,
    NULL counted as a value), their 10 most frequent values."""
    if not a.categorical:
        return a.spark.createDataFrame([], "column string, rank int, value string, count long")
    distinct = a.freq_raw.groupBy("pos").agg(F.count(F.lit(1)).alias("u")).collect()
    elig = sorted(
        [(int(r["u"]), a.categorical[int(r["pos"])], int(r["pos"])) for r in distinct if r["u"] < MAX_CATEGORY_DISTINCT],
        key=lambda t: (t[0], t[1]),
    )[:MAX_CATEGORICAL_CHARTS]
    keep = [p for _, _, p in elig]
    top = a.category_top(BAR_VALUES)
    names = [a.categorical[p] for p in keep]
    return top.where(F.col("column").isin(names)).select("column", "rank", "value", "count")


def box_data(a: Analysis) -> DataFrame:
    """V6: box-plot numbers for the first 3 columns (schema order) that have
    outliers: quartiles, whiskers (furthest values inside the fences), fliers."""
    rows = []
    for c in a.numeric:
        if len(rows) >= MAX_OUTLIER_CHARTS:
            break
        s = a.bin_summary.get(c)
        if not s or s["outliers"] <= 0:
            continue
        q1, med, q3 = a.quartiles[c]
        rows.append((c, q1, med, q3, s["whisker_lo"], s["whisker_hi"], s["outliers"]))
    return a.spark.createDataFrame(
        rows,
        "column string, q1 double, median double, q3 double, whisker_lo double, whisker_hi double, fliers long",
    )


def line_data(a: Analysis) -> DataFrame:
    """V7: the monthly series with a month-start date for plotting."""
    m = a.monthly_mean()
    return m.select(
        "period",
        F.date_format(F.to_date(F.concat("period", F.lit("-01"))), "yyyy-MM-dd").alias("period_start"),
        "value",
    )


def chart_frames(a: Analysis) -> dict[str, DataFrame]:
    """V8: each chart frame only when its precondition holds."""
    out: dict[str, DataFrame] = {}
    if a.numeric:
        out["distributions"] = distribution_data(a)
    if len(a.numeric) >= MIN_HEATMAP_COLUMNS:
        out["correlation_heatmap"] = heatmap(a)
    if a.categorical:
        out["categorical_bars"] = bar_data(a)
    if any(a.outlier_count(c) > 0 for c in a.numeric):
        out["outlier_boxes"] = box_data(a)
    d, v = a.series_columns
    if d is not None and v is not None:
        out["time_series"] = line_data(a)
    return out
