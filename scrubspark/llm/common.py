"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.session import checkpoint_dir

BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
PART_BYTES = 4 << 20  # a text is split into words in parts of about this size
_BLANK = b" \t\n\v\f\r"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers by rows and bytes, so
    that a run of very long texts does not meet in one batch."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = str(spark.conf.get(key, None)).lower()
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder (reliable, eager)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_remainder(col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(col.cast("string")) % modulus


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array laid end to end, and the n + 1 offsets (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    return np.frombuffer(data, np.uint8)[lo:hi], offsets - lo


def str_list(texts: pa.Array) -> list[str]:
    """Python strings of a string array (null: empty)."""
    return [t or "" for t in texts.to_pylist()]


def word_parts(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order (runs without ASCII white space), in lists of bounded
    size; cuts lie at white space."""
    at = 0
    while at < len(raw):
        end = at + PART_BYTES
        while end < len(raw) and raw[end] not in _BLANK:
            end += 1
        yield raw[at:end].split()
        at = end


def union_min_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list by alternating star contraction.

    Large-star joins every larger neighbour of a node to the node's smallest
    neighbour, small-star does the same for the smaller ones; both keep the
    components and shrink the graph to stars in about log(n) rounds. Each round
    is checkpointed in the shared folder. A hub's neighbours are never gathered:
    only the minimum per node is aggregated (with partial aggregation) and joined
    back, and skewed joins are split by adaptive execution.

    Returns (node, root) for every node that has an edge; root is the smallest
    node of its component. Self loops and repeated edges are allowed; an empty
    edge list gives an empty frame.
    """
    e = checkpointed(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct()
    )

    def round_of(e: DataFrame, larger: bool) -> DataFrame:
        # one direction per edge: u is the node, v its neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else (
            e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        )
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        j = both.join(low, "u")
        if larger:
            out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                low.select("u", F.col("m").alias("v"))
            )
        return out.filter("u <> v").distinct()

    def signature(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(F.greatest("u", "v"), F.least("u", "v")).cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = signature(e)
    while before[0]:
        e = checkpointed(round_of(round_of(e, True), False))
        now = signature(e)
        if now == before:
            break
        before = now
    stars = e.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root")).distinct()
