"""Streaming entry points.

The analysed workload is request/response over whole tables, so the only
streaming piece is the report history: report rows arriving as JSON files are
stored in the history table (H1) batch by batch. Spark's progress folder tells
which files were read; a repeated batch replaces its first writing.
"""

from scrubspark.streaming.history_stream import stream_reports

__all__ = ["stream_reports"]
