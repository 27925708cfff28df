"""Grouping of equal rows without a shuffle of the rows that have no equal.

First every row is counted by the 64-bit hash of its cells, so that only hashes are
shuffled. Hashes that occur more than once set bits in a filter of 2^``FILTER_BITS`` bits,
which is broadcast as at most half a million words of 64 bits. A row whose bit is not set has no
equal and stays where it was read; the others are grouped by all their cells, so unlike
rows of one hash or bit cost a shuffle, never a row. A filter that many millions of
repeated hashes fill lets more rows through to the grouping, at most all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubspark.operators.stats import qcol
from scrubspark.session import persist_reliably

FILTER_BITS = 25

HASH, REPEAT = "__hash", "__repeat"


def _word(bits: int) -> Column:
    return F.shiftrightunsigned(HASH, 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1))


def _bit() -> Column:
    return F.col(HASH).bitwiseAND(F.lit(63)).cast("int")


def mark_repeats(rows: DataFrame, names: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a column that is false only where no other row has the same ``names``."""
    hashed = rows.withColumn(HASH, F.xxhash64(F.lit(0), *[qcol(n) for n in names]))
    seen = hashed.groupBy(HASH).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = seen.groupBy(_word(bits).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit())).alias("__bits"))
    return (
        hashed.withColumn("__word", _word(bits))
        .join(F.broadcast(words), "__word", "left")
        .withColumn(REPEAT, F.coalesce(F.getbit("__bits", _bit()) == 1, F.lit(False)))
        .drop("__word", "__bits", HASH)
    )


@dataclass
class EqualRows:
    """Rows that differ (``frame``: the keys, ``__n`` rows each, ``__same`` of them marked)."""

    frame: DataFrame
    alone: DataFrame
    groups: DataFrame
    persisted: list


def group_equal(rows: DataFrame, names: list[str], same: str, checkpoint: bool = False, bits: int = FILTER_BITS) -> EqualRows:
    """Groups of rows with equal ``names`` (NULL equals NULL); ``same`` is a boolean column
    whose true rows are counted in ``__same``. Rows and groups are persisted (or checkpointed),
    as every later job reads them."""
    marked = mark_repeats(rows, names, bits)
    marked = persist_reliably(marked) if checkpoint else marked.persist(StorageLevel.MEMORY_AND_DISK)
    keys = [qcol(n) for n in names]
    alone = marked.where(~F.col(REPEAT)).select(*keys, F.lit(1).cast("long").alias("__n"), qcol(same).cast("long").alias("__same"))
    groups = (
        marked.where(F.col(REPEAT))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"), F.count_if(qcol(same)).alias("__same"))
    )
    groups = persist_reliably(groups) if checkpoint else groups.persist(StorageLevel.MEMORY_AND_DISK)
    return EqualRows(alone.unionAll(groups), alone, groups, [marked, groups])
