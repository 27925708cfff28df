"""Report rows from a folder of JSON files -> append-only history table."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from scrubspark.operators.history import append_reports

REPORT_INPUT_SCHEMA = "client_id string, dataset_path string, ai_report string, analysis_results string"


def stream_reports(
    spark: SparkSession,
    source_dir: str,
    history_path: str,
    checkpoint: str | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Store each micro-batch of incoming report rows with ``append_reports``.

    The progress folder is ``checkpoint``, or a folder that the configured
    ``spark.checkpoint.dir`` and the history path determine, so that a later session
    finds it again; without either it is an error. A micro-batch is written under its
    own number in that folder: one that Spark repeats after a failure replaces its first writing."""
    if checkpoint is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            raise ValueError("pass a progress folder or set spark.checkpoint.dir")
        checkpoint = f"{root.rstrip('/')}/history_stream-{hashlib.sha256(history_path.encode()).hexdigest()[:16]}"
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    src = spark.readStream.schema(REPORT_INPUT_SCHEMA).json(source_dir)
    w = (
        src.writeStream.foreachBatch(lambda rows, number: append_reports(rows, history_path, f"{name}-{number}"))
        .option("checkpointLocation", checkpoint)
    )
    if once:
        w = w.trigger(availableNow=True)
    return w.start()
