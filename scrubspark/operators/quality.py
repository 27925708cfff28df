"""Quality score, score factors, bands and report facts (Q1-Q8)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.functions.numbers import format_number, safe_number
from scrubspark.operators.analyze import Analysis
from scrubspark.operators.clean import CleanResult

# --- fixed values -------------------------------------------------------------
# penalty = min(35, 0.7*missing%) + min(25, 1.2*duplicate%) + min(20, 1.5*outlier%)
#         + min(10, 10*high-cardinality share) + min(5, 5*conversion share)
PENALTY_MISSING = (0.7, 35)
PENALTY_DUPLICATES = (1.2, 25)
PENALTY_OUTLIERS = (1.5, 20)
PENALTY_HIGH_CARDINALITY = (10, 10)
PENALTY_CONVERSIONS = (5, 5)
# UI bands: >= 80 Strong, >= 60 Needs review, else High risk
UI_BANDS = [(80, "Strong"), (60, "Needs review")]
UI_LOW_BAND = "High risk"
# Guidance bands used in the analyst context text
GUIDE_BANDS = [(90, "very clean"), (70, "generally usable"), (40, "needs review")]
GUIDE_LOW_BAND = "severe problems"
# Correlation strength: |r| > 0.7 strong, >= 0.4 moderate, else weak
STRONG_R = 0.7
MODERATE_R = 0.4
FINDING = (
    "Objective quality score factors: missing cells %s%%, duplicate rows %s%%, "
    "outlier cells %s%%, high-cardinality categorical columns %s."
)
TOP_FACT_VALUES = 5
SAMPLE_MONTHS = 3
CONTEXT_HEADINGS = {
    -2: "Dataset overview:",
    -1: "Cleaning summary:",
    1: "Numeric column statistics:",
    2: "Top positive correlations:",
    3: "Top negative correlations:",
    4: "Categorical breakdowns:",
    5: "Time series:",
    6: "Anomaly and outlier summary:",
}
NO_NUMERIC = "- No numeric columns detected."
NO_PAIRS = "- No qualifying correlation pairs detected."
NO_CATEGORIES = "- No categorical columns detected."
NO_SERIES = "- No time series pattern detected."
NUMERIC_FACT = "- %s: count=%s, mean=%s, median=%s, std=%s, skewness=%s, outliers=%s, distribution=%s"
PAIR_FACT = "- %s and %s: r=%s"
CATEGORY_FACT = "- %s: unique=%s of %s rows, high_cardinality=%s, top values: %s"
SERIES_FACTS = [
    "- Date column: %s",
    "- Value column: %s",
    "- Trend direction: %s",
    "- Slope: %s",
    "- Monthly aggregation sample start: %s",
    "- Monthly aggregation sample end: %s",
]
# -----------------------------------------------------------------------------


def score_inputs(res: CleanResult, a: Analysis) -> DataFrame:
    """One row with every number the score needs (all O(1))."""
    spark = a.spark
    pre = res.pre_profile
    _, outlier_pct = a.outlier_totals()
    row = (
        pre.rows,
        len(pre.columns),
        res.plan.duplicates_removed,
        pre.missing_cells,
        float(outlier_pct),
        a.high_cardinality_count,
        len(a.categorical),
        len(res.plan.conversions),
    )
    return spark.createDataFrame(
        [row],
        "rows_before long, total_columns long, duplicate_rows long, missing_cells long, "
        "outlier_percentage double, high_cardinality_columns long, categorical_columns long, "
        "type_conversions long",
    )


def _capped(x: Column, factor_cap: tuple[float, float]) -> Column:
    f, cap = factor_cap
    return F.least(F.lit(float(cap)), x * F.lit(float(f)))


def score_from_inputs(inp: DataFrame) -> DataFrame:
    """Q1: deterministic 0-100 score and its factors (half-even rounding)."""
    rows = F.greatest(F.col("rows_before"), F.lit(0)).cast("double")
    cells = rows * F.col("total_columns")
    missing = F.when(cells > 0, F.col("missing_cells") / cells * 100).otherwise(F.lit(0.0))
    dup = F.when(rows > 0, F.col("duplicate_rows") / rows * 100).otherwise(F.lit(0.0))
    hc_share = F.col("high_cardinality_columns") / F.greatest(F.col("categorical_columns"), F.lit(1))
    conv_share = F.when(
        F.col("total_columns") > 0, F.col("type_conversions") / F.col("total_columns")
    ).otherwise(F.lit(0.0))
    penalty = (
        _capped(missing, PENALTY_MISSING)
        + _capped(dup, PENALTY_DUPLICATES)
        + _capped(F.col("outlier_percentage"), PENALTY_OUTLIERS)
        + _capped(hc_share, PENALTY_HIGH_CARDINALITY)
        + _capped(conv_share, PENALTY_CONVERSIONS)
    )
    score = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - penalty)), 0).cast("int")
    return inp.select(
        score.alias("score"),
        F.bround(missing, 2).alias("missing_cell_percentage"),
        F.bround(dup, 2).alias("duplicate_row_percentage"),
        F.bround(F.col("outlier_percentage"), 2).alias("outlier_percentage"),
        F.col("high_cardinality_columns").cast("long").alias("high_cardinality_columns"),
        F.col("type_conversions").cast("long").alias("type_conversions"),
    )


def quality_score(res: CleanResult, a: Analysis) -> DataFrame:
    return score_from_inputs(score_inputs(res, a))


def score_finding(score: DataFrame) -> DataFrame:
    """Q2: the factor summary line placed first among findings."""
    line = F.format_string(
        FINDING,
        F.col("missing_cell_percentage").cast("string"),
        F.col("duplicate_row_percentage").cast("string"),
        F.col("outlier_percentage").cast("string"),
        F.col("high_cardinality_columns").cast("string"),
    )
    return score.select("score", line.alias("finding"))


def band(score: Column, bands, low: str) -> Column:
    expr = None
    for lo, name in bands:
        expr = F.when(score >= lo, F.lit(name)) if expr is None else expr.when(score >= lo, F.lit(name))
    return expr.otherwise(F.lit(low))


def clamp_score(x: Column) -> Column:
    """UI clamp: a number in [0, 100], rounded; anything else is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(safe_number(x), 0))).cast("int")


def score_band(score: DataFrame) -> DataFrame:
    """Q3: UI band and the guidance band of a score."""
    s = clamp_score(F.col("score"))
    return score.select(
        s.alias("score"),
        band(s, UI_BANDS, UI_LOW_BAND).alias("band"),
        band(s, GUIDE_BANDS, GUIDE_LOW_BAND).alias("guidance_band"),
    )


def correlation_strength(pairs: DataFrame) -> DataFrame:
    """Q4: strong / moderate / weak tone for each r."""
    r = F.abs(F.col("r"))
    tone = F.when(r > STRONG_R, "strong").when(r >= MODERATE_R, "moderate").otherwise("weak")
    return pairs.withColumn("strength", tone)


def score_factors() -> Column:
    """The factors of a score as compact JSON text."""
    names = ["missing_cell_percentage", "duplicate_row_percentage", "outlier_percentage", "high_cardinality_columns", "type_conversions"]
    return F.to_json(F.struct(*names))


def merge_findings(reports: DataFrame, score: DataFrame) -> DataFrame:
    """Q2: each report's findings with the factor line of ``score`` (one row) put first
    unless it is among them, and the objective score with its factors.

    ``reports`` has ai_report as JSON text; findings that are no list of text count as
    none. Adds data_quality_score, findings (array) and score_factors (JSON text)."""
    row = score_finding(score).join(score, "score").select("score", "finding", score_factors().alias("factors")).first()
    line = F.lit(row["finding"])
    own = F.from_json(F.get_json_object("ai_report", "$.data_quality_assessment.findings"), "array<string>")
    own = F.coalesce(own, F.array().cast("array<string>"))
    return reports.select(
        "*",
        F.lit(row["score"]).alias("data_quality_score"),
        F.when(F.array_contains(own, line), own).otherwise(F.concat(F.array(line), own)).alias("findings"),
        F.lit(row["factors"]).alias("score_factors"),
    )


def _numeric_facts(a: Analysis) -> DataFrame:
    d = a.describe_numeric()
    shape = a.shape_class().select("column", "classification")
    pos = a.spark.createDataFrame(list(enumerate(a.numeric)), "ord int, column string")
    std = F.when(F.col("count") > 1, format_number(F.col("std"))).otherwise(F.lit("0"))
    skew = F.when(F.col("count") > 2, format_number(F.col("skewness"))).otherwise(F.lit("0"))
    line = F.format_string(
        NUMERIC_FACT,
        F.col("column"),
        F.col("count").cast("string"),
        format_number(F.col("mean")),
        format_number(F.col("median")),
        std,
        skew,
        F.col("outlier_count").cast("string"),
        F.col("classification"),
    )
    return d.join(shape, "column").join(pos, "column").select(F.lit(1).alias("section"), "ord", line.alias("line"))


def _corr_facts(a: Analysis, direction: str, section: int) -> DataFrame:
    top = a.correlation_top().where(F.col("direction") == direction)
    line = F.format_string(PAIR_FACT, F.col("column_a"), F.col("column_b"), format_number(F.col("r")))
    return top.select(F.lit(section).alias("section"), F.col("rank").alias("ord"), line.alias("line"))


def _categorical_facts(a: Analysis) -> DataFrame:
    top = a.category_top(TOP_FACT_VALUES)
    item = F.struct(
        F.col("rank"),
        F.format_string("%s (%s rows, %s%%)", F.col("value"), F.col("count").cast("string"), format_number(F.col("percentage"))).alias("t"),
    )
    values = top.groupBy("column").agg(F.array_sort(F.collect_list(item)).alias("items"))
    card = a.cardinality()
    pos = a.spark.createDataFrame(list(enumerate(a.categorical)), "ord int, column string")
    hc = F.when(F.col("high_cardinality"), F.lit("True")).otherwise(F.lit("False"))
    line = F.format_string(
        CATEGORY_FACT,
        F.col("column"),
        F.col("unique_count").cast("string"),
        F.col("total_rows").cast("string"),
        hc,
        F.array_join(F.transform("items", lambda x: x["t"]), ", "),
    )
    return card.join(values, "column").join(pos, "column").select(F.lit(4).alias("section"), "ord", line.alias("line"))


def _lines(spark, section: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(section, i, t) for i, t in enumerate(lines)], "section int, ord int, line string")


def _series_facts(a: Analysis) -> DataFrame:
    """Trend and the first and last months, from the analysis' one monthly frame."""
    t = a.trend().collect()[0]
    if not t["detected"]:
        return _lines(a.spark, 5, [NO_SERIES])
    record = F.to_json(F.struct("period", F.round("value", 6).alias("value")))  # beyond that, sums depend on their order
    months = a.monthly_mean().agg(F.array_sort(F.collect_list(F.struct("period", record.alias("j")))).alias("m")).select(
        F.transform("m", lambda x: x["j"]).alias("m")
    )
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    last = F.when(F.size("m") > SAMPLE_MONTHS, F.slice("m", -SAMPLE_MONTHS, SAMPLE_MONTHS)).otherwise(F.array().cast("array<string>"))
    r = months.select(
        listed(F.slice("m", 1, SAMPLE_MONTHS)).alias("first"), listed(last).alias("last"), format_number(F.lit(t["slope"])).alias("slope")
    ).first()
    return _lines(
        a.spark, 5,
        [SERIES_FACTS[0] % t["date_column"], SERIES_FACTS[1] % t["value_column"], SERIES_FACTS[2] % t["trend_direction"],
         SERIES_FACTS[3] % r["slope"], SERIES_FACTS[4] % r["first"], SERIES_FACTS[5] % r["last"]],
    )


def overview_facts(a: Analysis) -> DataFrame:
    """Q6: the dataset overview block."""
    kinds = [(a.numeric, "Numeric columns"), (a.categorical, "Categorical columns"), (a.datetime, "Datetime columns detected")]
    lines = [f"- Total rows: {a.rows}", f"- Total columns: {len(a.columns)}"]
    return _lines(a.spark, -2, lines + [f"- {name}: {len(cols)} ({', '.join(cols)})" for cols, name in kinds])


def cleaning_facts(res: CleanResult) -> DataFrame:
    """Q6: the cleaning block; lists as compact JSON text, whole."""
    spark, p = res.table.sparkSession, res.plan
    total = p.summary(spark).first()
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]  # noqa: E731  one row per column
    packed = lambda value: json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    changed = sorted(r["column"] for r in p.change_log(spark).select("column").collect())
    lines = [
        f"- Rows before cleaning: {total['rows_before']}",
        f"- Rows after cleaning: {total['rows_after']}",
        f"- Full-row duplicates removed: {total['duplicates_removed']}",
        f"- Nulls filled: {total['nulls_filled']}",
        f"- Type conversions: {packed(sorted(rows(p.conversion_log(spark)), key=str))}",
        f"- Columns cleaned: {packed(changed)}",
    ]
    return _lines(spark, -1, lines)


def outlier_facts(a: Analysis) -> DataFrame:
    """Q6: the anomaly block."""
    total, pct = a.outlier_totals()
    spark = a.spark
    head = spark.range(1).select(F.lit(6).alias("section"), F.lit(1).alias("ord"), F.concat(F.lit("- Overall outlier percentage: "), format_number(F.lit(float(pct))), F.lit("%")).alias("line"))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "column", "outlier_count")))
    most = a.outlier_ranking().agg(F.to_json(F.transform(ranked, lambda x: F.struct(x["column"].alias("column"), x["outlier_count"].alias("outlier_count")))).alias("j"))
    return (
        _lines(spark, 6, [f"- Total outliers detected: {total}"])
        .unionByName(head)
        .unionByName(most.select(F.lit(6).alias("section"), F.lit(2).alias("ord"), F.concat(F.lit("- Columns with most outliers: "), F.coalesce("j", F.lit("[]"))).alias("line")))
    )


def report_facts(a: Analysis) -> DataFrame:
    """Q5: (section, ord, line) fact lines for the report context."""
    spark = a.spark
    parts = [_numeric_facts(a) if a.numeric else _lines(spark, 1, [NO_NUMERIC])]
    top = a.correlation_top()
    directions = {r["direction"] for r in top.select("direction").collect()}  # at most ten rows
    for direction, section in (("positive", 2), ("negative", 3)):
        parts.append(_corr_facts(a, direction, section) if direction in directions else _lines(spark, section, [NO_PAIRS]))
    parts.append(_categorical_facts(a) if a.categorical else _lines(spark, 4, [NO_CATEGORIES]))
    parts.append(_series_facts(a))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("section").cast("int"), F.col("ord").cast("int"), "line")


def report_context(a: Analysis, res: CleanResult | None = None) -> DataFrame:
    """Q6: overview, cleaning (if given), facts and outliers, each block under its
    heading, as one text; never cut."""
    spark = a.spark
    parts = [overview_facts(a), report_facts(a), outlier_facts(a)] + ([cleaning_facts(res)] if res is not None else [])
    heads = [(s, -1, h) for s, h in CONTEXT_HEADINGS.items() if res is not None or s != -1]
    out = spark.createDataFrame(heads, "section int, ord int, line string")
    for p in parts:
        out = out.unionByName(p.select(F.col("section").cast("int"), F.col("ord").cast("int"), "line"))
    return out.agg(
        F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY section, ord)").alias("context"),
        F.count(F.lit(1)).alias("lines"),
    )
