"""Named queries over the driver tables (one per operator of the inventory).

Each function takes (spark, sf_dir) and returns a DataFrame whose doubles are
rounded to 6 decimals and whose timestamps are ISO text, so results compare
exactly with the DuckDB texts in ``scrubspark.oracle``. Shared work (one clean
of ``dirty_orders``, one analysis per table) is memoised per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.functions.dates import parse_date
from scrubspark.functions.numbers import format_number, safe_number
from scrubspark.operators import charts, history, quality
from scrubspark.operators.analyze import Analysis, analysis_sections
from scrubspark.operators.clean import CleanResult, clean, strip_columns
from scrubspark.operators.detect import date_ratios, detect_dates, numeric_text_counts
from scrubspark.operators.names import normalize_header_column, storage_names
from scrubspark.operators.profile import duplicate_row_count, sample_values
from scrubspark.operators.stats import qcol
from scrubspark.functions.jsonsafe import is_json_object, json_rows, lenient_json
from scrubspark.session import shared_folder
from scrubspark.sources import files
from scrubspark.sources.tables import dirty_orders, table

# Shared work of one application and data folder; work of another one is released.
_memo: dict = {}


def _shared(spark: SparkSession, sf: str, name: str, make):
    scope = (spark.sparkContext.applicationId, sf)
    for old in [k for k in _memo if k[0] != scope]:
        held = _memo.pop(old)
        if old[0][0] == scope[0]:
            held.close()
    if (scope, name) not in _memo:
        _memo[scope, name] = make()
    return _memo[scope, name]


def canon(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, timestamps as ISO text (comparison-stable form)."""
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def cleaned(spark: SparkSession, sf: str) -> CleanResult:
    return _shared(spark, sf, "clean", lambda: clean(dirty_orders(spark, sf)))


def _source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name == "clean_dirty_orders":
        return cleaned(spark, sf).table
    if name == "wide_lineitem":
        return wide_lineitem(spark, sf)
    if name == "wide_orders":
        return wide_orders(spark, sf)
    return table(spark, sf, name)


def analysis(spark: SparkSession, sf: str, name: str) -> Analysis:
    return _shared(spark, sf, f"analysis {name}", lambda: Analysis(_source(spark, sf, name)))


def wide_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` with three more numeric columns (eleven in all)."""
    return table(spark, sf, "lineitem").selectExpr(
        "*", "l_quantity * 3 AS quantity_3", "l_extendedprice * (1 - l_discount) AS net", "CAST(l_linenumber % 2 AS INT) AS odd_line"
    )


def wide_orders(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` with six more text columns (eight in all)."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "CAST(o_orderkey % 3 AS STRING) AS k3", "CAST(o_orderkey % 5 AS STRING) AS k5",
        "CAST(o_orderkey % 7 AS STRING) AS k7", "CAST(o_orderkey % 11 AS STRING) AS k11", "CAST(o_orderkey % 13 AS STRING) AS k13",
        "CAST(o_orderkey % 40 AS STRING) AS k40",
    )


# ----------------------------------------------------------------------------- profile (P)


def q_profile_columns(spark, sf):
    return canon(cleaned(spark, sf).pre_profile.frame(spark))


def q_profile_samples(spark, sf):
    return sample_values(table(spark, sf, "orders"), "o_orderkey")


def q_duplicate_rows(spark, sf):
    d = dirty_orders(spark, sf)
    raw = duplicate_row_count(d)
    stripped = duplicate_row_count(strip_columns(d))
    return spark.createDataFrame([(raw, stripped)], "raw_duplicate_rows long, stripped_duplicate_rows long")


# ----------------------------------------------------------------------------- cleaning (C)


def q_strip_text(spark, sf):
    return canon(strip_columns(dirty_orders(spark, sf)))


def q_strip_counts(spark, sf):
    p = cleaned(spark, sf).plan
    rows = [(d.name, d.stripped) for d in p.columns if d.text]
    return spark.createDataFrame(rows, "column string, stripped_values long")


def q_dedup_rows(spark, sf):
    return canon(cleaned(spark, sf).dedup)


def q_date_hint_ratio(spark, sf):
    dd = cleaned(spark, sf).dedup
    text = [f.name for f in dd.schema.fields if isinstance(f.dataType, T.StringType)]
    r = date_ratios(dd, text)
    rows = [(c, n, h, (h / n) if n else 0.0) for c, (n, h) in r.items()]
    return canon(spark.createDataFrame(rows, "column string, non_null long, hinted long, hint_ratio double"))


def q_cast_dates(spark, sf):
    res = cleaned(spark, sf)
    sel = []
    for d in res.plan.columns:
        c = qcol(d.name)
        sel.append((d.converted(c) if d.conversion == "datetime" else c).alias(d.name))
    return canon(res.dedup.select(*sel))


def q_numeric_ratio(spark, sf):
    res = cleaned(spark, sf)
    text = [d.name for d in res.plan.columns if d.text and d.conversion != "datetime"]
    r = numeric_text_counts(res.dedup, text)
    rows = [(c, n, k, (k / n) if n else 0.0) for c, (n, k) in r.items()]
    return canon(spark.createDataFrame(rows, "column string, non_null long, numeric long, numeric_ratio double"))


def q_cast_numbers(spark, sf):
    return canon(cleaned(spark, sf).converted)


def q_fill_median(spark, sf):
    p = cleaned(spark, sf).plan
    rows = [(d.new_name, float(d.fill_value) if d.nulls_filled else None, d.nulls_filled) for d in p.columns if d.fill == "median"]
    return canon(spark.createDataFrame(rows, "column string, fill_value double, nulls_filled long"))


def q_fill_keeps_digits(spark, sf):
    """Ids of 25 digits and beyond 2^53 with gaps: filled in their own types."""
    ids = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "IF(o_orderkey % 7 = 0, NULL, CAST('1234567890123456' AS DECIMAL(38,0)) * 1000000000 + o_orderkey) AS long_id",
        "IF(o_orderkey % 11 = 0, NULL, 9007199254740993 + o_orderkey) AS odd_id",
        "IF(o_orderkey % 13 = 0, NULL, CAST(o_totalprice AS DECIMAL(14,2))) AS price",
    )
    res = clean(ids)
    return res.table.select("o_orderkey", *[qcol(c).cast("decimal(38,3)").cast("string").alias(c) for c in ("long_id", "odd_id", "price")])


def q_fill_unknown(spark, sf):
    p = cleaned(spark, sf).plan
    rows = [(d.new_name, d.nulls_filled) for d in p.columns if d.fill == "unknown"]
    return spark.createDataFrame(rows, "column string, nulls_filled long")


def q_keep_date_nulls(spark, sf):
    res = cleaned(spark, sf)
    t = res.table
    dts = [f.name for f in t.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    if not dts:
        return spark.createDataFrame([], "column string, null_count long, nulls_filled long")
    r = t.agg(*[F.count_if(qcol(c).isNull()).alias(f"n{i}") for i, c in enumerate(dts)]).collect()[0]
    rows = [(c, int(r[f"n{i}"]), 0) for i, c in enumerate(dts)]
    return spark.createDataFrame(rows, "column string, null_count long, nulls_filled long")


def q_normalize_headers(spark, sf):
    part = table(spark, sf, "part")
    return normalize_header_column(part, "p_type", "p_partkey")


def q_conversion_log(spark, sf):
    return cleaned(spark, sf).plan.conversion_log(spark)


def q_change_log(spark, sf):
    cl = cleaned(spark, sf).plan.change_log(spark)
    return cl.select(
        "column", "original_column", "original_dtype", "converted_dtype", "nulls_filled",
        F.array_join("transformations", "; ").alias("transformations"),
    )


def q_clean_report(spark, sf):
    return cleaned(spark, sf).plan.summary(spark)


def q_clean_table(spark, sf):
    return canon(cleaned(spark, sf).table)


# ----------------------------------------------------------------------------- analysis (A)


def q_column_types(spark, sf):
    return analysis(spark, sf, "orders").column_types().drop("detected_from_text")


def q_overview(spark, sf):
    return canon(analysis(spark, sf, "orders").overview())


def q_describe_numeric(spark, sf):
    return canon(analysis(spark, sf, "lineitem").describe_numeric())


def q_outlier_counts(spark, sf):
    return canon(analysis(spark, sf, "events").outlier_counts())


def q_flag_outliers(spark, sf):
    a = analysis(spark, sf, "documents")
    f = a.flag_outliers()
    return f.select("doc_id", "doc_id_is_outlier", "n_chars_is_outlier")


def q_outlier_ranking(spark, sf):
    return canon(analysis(spark, sf, "documents").outlier_ranking())


def q_category_top10(spark, sf):
    return canon(analysis(spark, sf, "orders").category_top())


def q_cardinality(spark, sf):
    return canon(analysis(spark, sf, "customer").cardinality())


def q_correlation_matrix(spark, sf):
    return canon(analysis(spark, sf, "lineitem").correlation_matrix())


def q_correlation_top(spark, sf):
    return canon(analysis(spark, sf, "lineitem").correlation_top())


def q_histogram_auto(spark, sf):
    return canon(analysis(spark, sf, "orders").histogram())


def q_bimodal_check(spark, sf):
    return analysis(spark, sf, "part").bimodal_check()


def q_shape_class(spark, sf):
    return canon(analysis(spark, sf, "events").shape_class())


def q_pick_series(spark, sf):
    return analysis(spark, sf, "orders").pick_series()


def q_monthly_mean(spark, sf):
    return canon(analysis(spark, sf, "orders").monthly_mean())


def q_trend(spark, sf):
    return canon(analysis(spark, sf, "orders").trend())


# ----------------------------------------------------------------------------- charts (V)


def q_top_variance(spark, sf):
    # variances near 1e9: six decimals would be beyond what a sum of doubles settles
    return canon(charts.top_variance(analysis(spark, sf, "lineitem"), 8), 2)


def q_sample_points(spark, sf):
    return canon(charts.sample_points(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")))


def q_heatmap(spark, sf):
    return canon(charts.heatmap(analysis(spark, sf, "lineitem")))


def q_bar_data(spark, sf):
    return canon(charts.bar_data(analysis(spark, sf, "orders")))


def q_box_data(spark, sf):
    return canon(charts.box_data(analysis(spark, sf, "events")))


def q_line_data(spark, sf):
    return canon(charts.line_data(analysis(spark, sf, "orders")))


# ----------------------------------------------------------------------------- quality (Q)


def _score(spark, sf):
    return quality.quality_score(cleaned(spark, sf), analysis(spark, sf, "clean_dirty_orders"))


def q_quality_score(spark, sf):
    return canon(_score(spark, sf))


def q_score_finding(spark, sf):
    return quality.score_finding(_score(spark, sf))


def q_score_band(spark, sf):
    return quality.score_band(_score(spark, sf))


def q_corr_strength(spark, sf):
    return canon(quality.correlation_strength(analysis(spark, sf, "lineitem").correlation_top()))


def q_report_facts(spark, sf):
    return quality.report_facts(analysis(spark, sf, "orders"))


def q_report_context(spark, sf):
    return quality.report_context(analysis(spark, sf, "orders"))


def q_cleaning_facts(spark, sf):
    return quality.cleaning_facts(cleaned(spark, sf)).select("ord", "line")


def q_findings_merge(spark, sf):
    docs = table(spark, sf, "documents")
    line = quality.score_finding(_score(spark, sf)).first()["finding"]  # some reports have it already
    own = F.when(F.col("doc_id") % 3 == 0, F.array(F.col("source"), F.lit(line))).when(F.col("doc_id") % 3 == 1, F.array("source"))
    report = F.to_json(F.struct(F.struct(own.alias("findings"), F.lit(1).alias("score")).alias("data_quality_assessment")))
    merged = quality.merge_findings(docs.select("doc_id", report.alias("ai_report")), _score(spark, sf))
    return merged.select("doc_id", "data_quality_score", F.array_join("findings", " / ").alias("findings"), "score_factors")


def q_safe_numbers(spark, sf):
    d = dirty_orders(spark, sf)
    return canon(d.select("o_orderkey", safe_number("price_text", "price").alias("number"), format_number(F.col("price")).alias("shown")))


def q_lenient_json(spark, sf):
    conv = table(spark, sf, "conversations")
    text = F.concat(
        F.col("text"),
        F.lit("\n```json\n{\"turn\": "),
        F.col("turn").cast("string"),
        F.lit(", \"role\": \""),
        F.col("role"),
        F.lit("\"}\n```"),
    )
    v = lenient_json(text)
    return conv.select(
        "conv_id",
        "turn",
        is_json_object(v).alias("is_object"),
        F.variant_get(v, "$.turn", "long").alias("parsed_turn"),
        F.variant_get(v, "$.role", "string").alias("parsed_role"),
    )


# ----------------------------------------------------------------------------- history (H), files (S)


def _reports(spark, sf):
    return history.reports_from_documents(table(spark, sf, "documents"))


def q_history_list(spark, sf):
    return history.list_reports(_reports(spark, sf), "src1")


def q_history_fetch(spark, sf):
    return history.fetch_report(_reports(spark, sf), "21", "src1")


def q_history_isolation(spark, sf):
    return history.fetch_report(_reports(spark, sf), "21", "src2")


def q_storage_names(spark, sf):
    return storage_names(table(spark, sf, "pages"), "url")


def q_preview(spark, sf):
    return canon(files.preview(table(spark, sf, "orders"), 10, ["o_orderkey"]))


def q_json_rows(spark, sf):
    """The JSON text of each event, parsed again."""
    back = F.from_json("json", "event_id long, ts string, user_id long, event_type string, value double, props string")
    return canon(json_rows(table(spark, sf, "events")).select(back.alias("j")).select("j.*"))


def q_csv_typing(spark, sf):
    orders = table(spark, sf, "orders")
    texts = orders.select(
        *[qcol(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")],
        F.concat(F.lit("1234567890123456789"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("long_id"),
        (F.col("o_custkey") % 2 == 0).cast("string").alias("even"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey").cast("string")).alias("gaps"),
    )
    return canon(files.type_text_columns(texts)).withColumn("long_id", F.col("long_id").cast("string"))


def q_csv_round_trip(spark, sf):
    """Sink and read-back of a delimited file in the shared folder."""
    base = shared_folder(spark, "csv")
    return canon(files.read_cleaned(spark, files.write_cleaned(table(spark, sf, "customer"), files.cleaned_path(base, "customer.csv", "csv"), "csv")))


def q_csv_latin1(spark, sf):
    """A delimited file in ISO-8859-1 with semicolons, recognised and read."""
    path = shared_folder(spark, "latin1")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" é, à")).alias("c_name"), "c_acctbal")
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return canon(files.read_csv(spark, path))


def q_csv_quoted(spark, sf):
    """Quotes, delimiters, backslashes and line breaks in fields, written and read by byte ranges."""
    path = shared_folder(spark, "quoted")
    note = F.concat(F.lit('say "'), F.col("c_name"), F.lit('", then;\n\\ and\t"'), F.col("c_custkey").cast("string"), F.lit("\n, end"))
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, note).otherwise(F.col("c_name")).alias("note"), "c_acctbal")
    files.write_cleaned(rows, path, "csv")
    return canon(files.read_csv(spark, path))


def q_csv_folder(spark, sf):
    """A folder of files with other headers, delimiters and encodings, united by name."""
    path = shared_folder(spark, "folder")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" é, à")).alias("c_name"), "c_acctbal")
    kinds = [(["c_name", "c_custkey", "c_acctbal"], ",", "UTF-8"), (["c_acctbal", "c_name", "c_custkey"], ";", "ISO-8859-1"), (["c_custkey", "c_name"], "|", "UTF-8")]
    for k, (columns, sep, encoding) in enumerate(kinds):
        own = rows.filter(F.col("c_custkey") % len(kinds) == k).select(*columns)
        own.write.mode("append").options(header=True, sep=sep, encoding=encoding, escape='"').csv(path)
    return canon(files.read_csv(spark, path).select("c_custkey", "c_name", "c_acctbal"))


def q_delimiter_counts(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return canon(files.delimiter_counts(lines, "line"))


def q_date_shapes(spark, sf):
    """Order dates written in five shapes, recognised and read back."""
    d = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    shapes = {
        "fraction": "yyyy-MM-dd HH:mm:ss.SSS", "zone": "yyyy-MM-dd'T'HH:mm:ss'Z'", "minutes": "M/d/yyyy HH:mm", "day_month": "d-MMM-yyyy", "month_day": "MMM d yyyy",
    }
    texts = d.select("o_orderkey", *[F.date_format("d", f).alias(n) for n, f in shapes.items()])
    formats = detect_dates(texts, list(shapes))
    return canon(texts.select("o_orderkey", *[(parse_date(n, formats[n]) if n in formats else F.col(n)).alias(n) for n in shapes]))


def q_history_rows(spark, sf):
    return history.report_rows(_reports(spark, sf))


def q_history_append(spark, sf):
    """The stored history after one batch was written twice and another once."""
    path = shared_folder(spark, "history")
    reports = _reports(spark, sf)
    for batch in ("first", "first", "second"):
        history.append_reports(reports, path, batch)
    return history.read_reports(spark, path).drop("created_at")


def q_history_compacted(spark, sf):
    """As above, one batch appended again after its files were joined with the others."""
    path = shared_folder(spark, "history")
    reports = _reports(spark, sf)
    for batch in ("first", "second"):
        history.append_reports(reports, path, batch)
    history.drop_files(spark, history.compact_reports(spark, path))
    history.append_reports(reports, path, "first")
    return history.read_reports(spark, path).drop("created_at")


def q_history_client(spark, sf):
    """One client's rows, read from its bucket."""
    path = shared_folder(spark, "history")
    history.append_reports(_reports(spark, sf), path, "first")
    return history.read_reports(spark, path, "src1").drop("created_at")


def q_distribution_data(spark, sf):
    return canon(charts.distribution_data(analysis(spark, sf, "lineitem")))


def _sizes(spark, frames, name):
    return spark.createDataFrame([(k, f.count()) for k, f in frames.items()], f"{name} string, row_count long")


def q_chart_bundle(spark, sf):
    return _sizes(spark, charts.chart_frames(analysis(spark, sf, "orders")), "chart")


def q_analysis_sections(spark, sf):
    return _sizes(spark, analysis_sections(analysis(spark, sf, "orders")), "section")


def q_top_variance_wide(spark, sf):
    return canon(charts.top_variance(analysis(spark, sf, "wide_lineitem"), 8), 2)


def q_heatmap_wide(spark, sf):
    return canon(charts.heatmap(analysis(spark, sf, "wide_lineitem")))


def q_bar_data_wide(spark, sf):
    return canon(charts.bar_data(analysis(spark, sf, "wide_orders")))


QUERIES = {
    "profile_columns": q_profile_columns,
    "profile_samples": q_profile_samples,
    "duplicate_rows": q_duplicate_rows,
    "strip_text": q_strip_text,
    "strip_counts": q_strip_counts,
    "dedup_rows": q_dedup_rows,
    "date_hint_ratio": q_date_hint_ratio,
    "cast_dates": q_cast_dates,
    "numeric_ratio": q_numeric_ratio,
    "cast_numbers": q_cast_numbers,
    "fill_median": q_fill_median,
    "fill_keeps_digits": q_fill_keeps_digits,
    "fill_unknown": q_fill_unknown,
    "keep_date_nulls": q_keep_date_nulls,
    "normalize_headers": q_normalize_headers,
    "conversion_log": q_conversion_log,
    "change_log": q_change_log,
    "clean_report": q_clean_report,
    "clean_table": q_clean_table,
    "column_types": q_column_types,
    "overview": q_overview,
    "describe_numeric": q_describe_numeric,
    "outlier_counts": q_outlier_counts,
    "flag_outliers": q_flag_outliers,
    "outlier_ranking": q_outlier_ranking,
    "category_top10": q_category_top10,
    "cardinality": q_cardinality,
    "correlation_matrix": q_correlation_matrix,
    "correlation_top": q_correlation_top,
    "histogram_auto": q_histogram_auto,
    "bimodal_check": q_bimodal_check,
    "shape_class": q_shape_class,
    "pick_series": q_pick_series,
    "monthly_mean": q_monthly_mean,
    "trend": q_trend,
    "top_variance": q_top_variance,
    "sample_points": q_sample_points,
    "heatmap": q_heatmap,
    "bar_data": q_bar_data,
    "box_data": q_box_data,
    "line_data": q_line_data,
    "quality_score": q_quality_score,
    "score_finding": q_score_finding,
    "score_band": q_score_band,
    "corr_strength": q_corr_strength,
    "report_facts": q_report_facts,
    "report_context": q_report_context,
    "lenient_json": q_lenient_json,
    "history_list": q_history_list,
    "history_fetch": q_history_fetch,
    "history_isolation": q_history_isolation,
    "storage_names": q_storage_names,
    "preview": q_preview,
    "json_rows": q_json_rows,
    "csv_typing": q_csv_typing,
    "csv_round_trip": q_csv_round_trip,
    "csv_latin1": q_csv_latin1,
    "csv_quoted": q_csv_quoted,
    "csv_folder": q_csv_folder,
    "delimiter_counts": q_delimiter_counts,
    "date_shapes": q_date_shapes,
    "history_rows": q_history_rows,
    "history_append": q_history_append,
    "history_compacted": q_history_compacted,
    "history_client": q_history_client,
    "distribution_data": q_distribution_data,
    "chart_bundle": q_chart_bundle,
    "analysis_sections": q_analysis_sections,
    "top_variance_wide": q_top_variance_wide,
    "heatmap_wide": q_heatmap_wide,
    "bar_data_wide": q_bar_data_wide,
    "findings_merge": q_findings_merge,
    "cleaning_facts": q_cleaning_facts,
    "safe_numbers": q_safe_numbers,
}
