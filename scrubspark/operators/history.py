"""Report history (H1-H4): an append-only store of Parquet rows under client buckets.

``rows/bucket=k`` holds the rows of the clients that hash to bucket k, ``commits`` one row
per append that came to its end. Only rows of a batch's last commit are read, so an append
that fails on its way leaves nothing to see. Listing and fetching take a client id and read
that client's bucket only, whatever the number of appends; ``compact_reports`` joins the
small files of many appends.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.operators.names import filename_of

# --- fixed values -------------------------------------------------------------
HISTORY_PAGE = 20
# -----------------------------------------------------------------------------

BUCKETS = 64  # part of a store's layout
CONTENT = ["client_id", "dataset_path", "ai_report", "analysis_results"]
REPORT_COLUMNS = ["id", "created_at", "client_id", "dataset_path", "ai_report", "analysis_results"]


def report_rows(reports: DataFrame) -> DataFrame:
    """H1: report rows with a digest of their content as id."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CONTENT]
    sized = [x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]
    return reports.select(
        F.sha2(F.concat(*sized), 256).alias("id"),
        "client_id",
        "dataset_path",
        F.col("ai_report").cast("string").alias("ai_report"),
        F.col("analysis_results").cast("string").alias("analysis_results"),
    )


def _bucket(client_id: Column) -> Column:
    return F.pmod(F.xxhash64(client_id.cast("string")), F.lit(BUCKETS)).cast("int")


def _store(rows: DataFrame, path: str) -> None:
    """Write rows under their buckets, few files a bucket (a large one over several tasks)."""
    rows.withColumn("bucket", _bucket(F.col("client_id"))).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/rows")


def append_reports(reports: DataFrame, path: str, batch: str | None = None) -> None:
    """H1: add rows (dataset_path, ai_report, analysis_results, client_id); the store
    sets id and created_at.

    An append with the name of an earlier batch replaces that batch, so a retried one is
    stored once; without a name every call is a batch of its own. The id is a digest of
    the batch, the row's content (nulls apart from empty text) and, for equal rows of a batch,
    their number: the same in every attempt of a batch, different in every other batch."""
    batch, attempt = batch if batch is not None else uuid.uuid4().hex, uuid.uuid4().hex
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in CONTENT])
    equal = report_rows(reports).groupBy("id", *CONTENT).agg(F.count(F.lit(1)).alias("n"))
    each = equal.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    own = F.sha2(F.concat_ws(":", F.lit(str(len(batch))), F.lit(batch), "id", nulls, "copy"), 256)
    out = each.withColumns({"id": own, "created_at": F.current_timestamp(), "batch": F.lit(batch), "attempt": F.lit(attempt)})
    _store(out.select(*REPORT_COLUMNS, "batch", "attempt"), path)
    done = reports.sparkSession.createDataFrame([(batch, attempt, 0)], "batch string, attempt string, generation int")
    done.coalesce(1).select("batch", "attempt", F.current_timestamp().alias("at"), "generation").write.mode("append").parquet(f"{path}/commits")


def _last_commits(commits: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("attempt", "at", "generation"), F.struct("at", "generation", "attempt"))
    return commits.groupBy("batch").agg(last.alias("c")).select("batch", "c.*")


def read_reports(spark: SparkSession, path: str, client_id: str | None = None) -> DataFrame:
    """The committed rows, of one client (from its bucket alone) or of all."""
    last = _last_commits(spark.read.parquet(f"{path}/commits")).select("batch", "attempt")
    if client_id is None:
        rows = spark.read.parquet(f"{path}/rows")
    else:
        bucket = spark.range(1).select(_bucket(F.lit(client_id))).first()[0]
        try:
            rows = spark.read.parquet(f"{path}/rows/bucket={bucket}").where(F.col("client_id") == F.lit(client_id))
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.read.parquet(f"{path}/rows").where(F.lit(False))  # nobody's rows are in that bucket
    return rows.join(last, ["batch", "attempt"], "left_semi").select(*REPORT_COLUMNS)


def compact_reports(spark: SparkSession, path: str) -> list[str]:
    """Write the committed rows anew in few files a bucket; return the files that they
    replace. Those can be given to ``drop_files`` as soon as no reader from before uses
    them. Appends may run meanwhile, another compaction may not. Rows keep their batch,
    so a named batch can still be replaced. Files of appends that never came to a commit
    stay, as they may still be in work."""
    commits = spark.read.parquet(f"{path}/commits")  # before the rows: all rows of these commits are listed
    rows = spark.read.parquet(f"{path}/rows").select("*", F.col("_metadata.file_path").alias("file"))
    # one name per file
    old = [r["file"] for r in rows.join(commits.select("attempt").distinct(), "attempt", "left_semi").select("file").distinct().collect()]
    attempt, last = F.lit(uuid.uuid4().hex), _last_commits(commits)
    current = rows.join(last.select("batch", "attempt"), ["batch", "attempt"], "left_semi")
    _store(current.withColumn("attempt", attempt).select(*REPORT_COLUMNS, "batch", "attempt"), path)
    moved = last.select("batch", attempt.alias("attempt"), "at", (F.col("generation") + 1).alias("generation"))
    moved.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return old + commits.inputFiles()


def drop_files(spark: SparkSession, files: list[str]) -> None:
    """Delete files that a compaction has replaced."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for file in files:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        at.getFileSystem(conf).delete(at, False)


def list_reports(reports: DataFrame, client_id: str | None, limit: int = HISTORY_PAGE) -> DataFrame:
    """H2/H4: one client's newest reports with fields read from the JSON."""
    schema_cols = [
        F.col("id"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.col("dataset_path"),
        filename_of(F.col("dataset_path")).alias("filename"),
        F.get_json_object("ai_report", "$.executive_summary").alias("executive_summary"),
        F.get_json_object("ai_report", "$.data_quality_assessment.score").try_cast("int").alias("data_quality_score"),
        F.get_json_object("analysis_results", "$.dataset_overview.total_rows").try_cast("long").alias("row_count"),
    ]
    if not client_id:
        return reports.where(F.lit(False)).select(*schema_cols)
    top = reports.where(F.col("client_id") == F.lit(client_id)).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    return top.select(*schema_cols)


def fetch_report(reports: DataFrame, report_id: str, client_id: str | None) -> DataFrame:
    """H3/H4: one report by id *and* client; empty when they do not match."""
    cols = [
        F.col("id").alias("report_id"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        "dataset_path",
        "ai_report",
        "analysis_results",
    ]
    if not client_id:
        return reports.where(F.lit(False)).select(*cols)
    return (
        reports.where((F.col("id") == F.lit(report_id)) & (F.col("client_id") == F.lit(client_id)))
        .limit(1)
        .select(*cols)
    )


def reports_from_documents(documents: DataFrame) -> DataFrame:
    """A report table derived from ``documents`` (one report per document)."""
    return documents.select(
        F.col("doc_id").cast("string").alias("id"),
        (F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)).alias("created_at"),
        F.col("source").alias("client_id"),
        F.format_string("cleaned/%s_report_%s.csv", F.col("lang"), F.col("doc_id").cast("string")).alias("dataset_path"),
        F.to_json(
            F.struct(
                F.format_string("Report in %s over %s characters", F.col("lang"), F.col("n_chars").cast("string")).alias("executive_summary"),
                F.struct((F.col("n_chars") % 101).alias("score")).alias("data_quality_assessment"),
            )
        ).alias("ai_report"),
        F.to_json(F.struct(F.struct(F.col("n_chars").alias("total_rows")).alias("dataset_overview"))).alias("analysis_results"),
    )
