"""Records of delimited files whose quoted fields hold line breaks, read in byte ranges.

A range of a file does not know whether it begins inside a quoted field. So each range is
walked for both answers and reports, per answer, how it ends and whether a record ends in
it (``scan_ranges``). That is a function on two states per range; a window over the ranges
of a file composes them and so gives the state in which each begins. A second scan then
cuts every range into records from its own first record on; a record that passes the end
of a range is put together from the pieces that the ranges hold (``read_records``).

The walk follows the quoting rule of RFC 4180 and what spreadsheets make of it: a field
that begins with a quote ends at the next quote that is not doubled; a quote elsewhere is
a character like others. It depends on the delimiter, so all candidates are walked at once
and the chosen one is judged on delimiters outside quotes.

Ranges are those of Spark's text source. A file's ranges meet in one window task and the
ranges that begin inside quotes are broadcast: both are counts of ranges, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubspark.session import persist_reliably

BATCH_BYTES = 4 << 20
BATCH_RECORDS = 10_000
MIN_PARTITIONS = "spark.sql.files.minPartitionNum"


def walk(line: bytes, delimiter: bytes, inside: bool) -> tuple[bool, int]:
    """Walk one line that begins inside a quoted field or at a record's start.

    Returns whether it ends inside a quoted field, and its delimiters outside quotes."""
    at, count = 0, 0
    while True:
        if inside:
            while True:
                end = line.find(b'"', at)
                if end < 0:
                    return True, count
                at = end + 1
                if line[at : at + 1] != b'"':
                    break
                at += 1
            inside = False
        elif line[at : at + 1] == b'"':
            inside, at = True, at + 1
            continue
        at = line.find(delimiter, at)
        if at < 0:
            return False, count
        at, count = at + 1, count + 1


@dataclass
class _Walk:
    """A range under one delimiter and one answer."""

    inside: bool
    broke: bool = False  # a record ended in the range
    count: int | None = None  # delimiters of the current record, None if it began before
    stats: list[int] = field(default_factory=lambda: [0, 1 << 62, -1, 0, 0])  # records, least, most, sum, squares

    def line(self, line: bytes, delimiter: bytes, quoted: bool) -> None:
        begins = not self.inside
        if quoted:
            self.inside, n = walk(line, delimiter, self.inside)
        else:
            n = 0 if self.inside else line.count(delimiter)
        if begins:
            if not self.inside and not line.strip():
                self.broke = True
                return  # a blank line is no record
            self.count = 0
        if self.count is not None:
            self.count += n
        if not self.inside:
            self.broke = True
            if self.count is not None:
                s = self.stats
                self.stats = [s[0] + 1, min(s[1], self.count), max(s[2], self.count), s[3] + self.count, s[4] + self.count**2]


_STATS = ("n", "least", "most", "total", "squares")
_RANGE = "file string, block long, delimiter int, filled boolean, " + ", ".join(
    f"ends{k} boolean, broke{k} boolean, " + ", ".join(f"{s}{k} long" for s in _STATS) for k in (0, 1)
)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    """((file, block), lines) in order; a range comes in several pieces."""
    for batch in batches:
        files, blocks, lines = (c.to_pylist() for c in batch.columns)
        first = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or (files[k], blocks[k]) != (files[first], blocks[first]):
                yield (files[first], blocks[first]), lines[first:k]
                first = k


def scan_ranges(spark: SparkSession, paths: list[str], delimiters: list[str]) -> DataFrame:
    """(file, delimiter, block, state, owner, header_block, ...): per range and candidate whether it
    begins inside quotes (state 1), the range in which the record at its start began, the file's
    first range with text, and counts of delimiters over the records inside the range."""
    marks = [d.encode() for d in delimiters]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(key, walks, filled):
            rows = []
            for d, pair in enumerate(walks):
                rows.append([*key, d, filled, *[x for w in pair for x in (w.inside, w.broke, *w.stats)]])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

        names = [c.split()[0] for c in _RANGE.split(", ")]
        now, walks, filled = None, [], False
        for key, lines in _by_range(batches):
            if key != now:
                if now:
                    yield report(now, walks, filled)
                now, walks, filled = key, [(_Walk(False), _Walk(True)) for _ in marks], False
            for line in lines:
                quoted = b'"' in line
                filled = filled or bool(line.strip())
                for mark, (a, b) in zip(marks, walks):
                    a.line(line, mark, quoted)
                    b.line(line, mark, quoted)
        if now:
            yield report(now, walks, filled)

    return _with_states(_lines(spark, paths).mapInArrow(run, _RANGE.replace("delimiter int", "delimiter long")))


def _with_states(ranges: DataFrame) -> DataFrame:
    """The state in which each range begins: the ranges before it composed. The last of them
    that ends alike from both states gives a state, those behind it keep or swap it."""
    order = Window.partitionBy("file", "delimiter").orderBy("block")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    swap = (F.col("ends0") & ~F.col("ends1")).cast("int")
    ranges = ranges.withColumn("swaps", F.sum(swap).over(upto))
    fixed = F.when(F.col("ends0") == F.col("ends1"), F.struct(F.col("ends0").cast("int").alias("to"), "swaps"))
    ranges = ranges.withColumn("fixed", F.last(fixed, ignorenulls=True).over(before)).withColumn("so_far", F.lag("swaps").over(order))
    behind = F.coalesce("so_far", F.lit(0)) - F.coalesce("fixed.swaps", F.lit(0))
    ranges = ranges.withColumn("state", (F.coalesce("fixed.to", F.lit(0)) + behind) % 2)
    pick = lambda name: F.when(F.col("state") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    whole = Window.partitionBy("file", "delimiter")
    # the range in which a record begins that is open at its end
    opens = F.when((F.col("state") == 0) | pick("broke"), F.col("block"))
    ranges = ranges.withColumns({"opens": opens, **{s: pick(s) for s in _STATS}})
    first = F.min("block").over(whole)
    return ranges.select(
        "file", "delimiter", "block", F.col("state").cast("int").alias("state"),
        F.coalesce(F.last("opens", ignorenulls=True).over(before), first).alias("owner"),
        F.coalesce(F.min(F.when(F.col("filled"), F.col("block"))).over(whole), first).alias("header_block"),
        *_STATS,
    )


def _cut(known: dict[str, dict[int, tuple[int, int]]], headers: dict[str, int], marks: dict[str, bytes]):
    """Rows (file, owner, block, line, header, delimiters, record): whole records have no owner."""
    names = ["file", "owner", "block", "line", "header", "delimiters", "record"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        now, inside, held, owner, count, line_no, header = None, False, [], None, 0, 0, False

        def add(owner, record):
            nonlocal size
            out.append((now[0], owner, now[1], line_no, header, count, record))
            size += len(record)

        for key, lines in _by_range(batches):
            if key != now:
                if held:
                    add(now[1] if owner is None else owner, b"\n".join(held))
                if key[1] not in known.get(key[0], {}):
                    raise RuntimeError(f"the ranges of {key[0]} changed between two scans; read it again")
                now, held, count, line_no = key, [], 0, 0
                state, begun = known[key[0]][key[1]]
                inside, owner = bool(state), begun if state else None
                header = headers[key[0]] == key[1] and not inside
            mark = marks[key[0]]
            for line in lines:
                line_no += 1
                if b'"' in line:
                    inside, n = walk(line, mark, inside)
                    count += n
                elif not inside:
                    count += line.count(mark)
                held.append(line)
                if inside:
                    continue
                record = (b"\n".join(held) if len(held) > 1 else line).removesuffix(b"\r")
                if owner is not None:
                    add(owner, record)
                elif record.strip():
                    add(None, record)
                    header = False
                held, owner, count = [], None, 0
                if len(out) >= BATCH_RECORDS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out, size = [], 0
        if held:
            add(now[1] if owner is None else owner, b"\n".join(held))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def read_records(spark: SparkSession, paths: list[str], delimiters: list[str], choose) -> tuple[DataFrame, dict[str, str]]:
    """(file, header, delimiters, record) of some files, and the delimiter of each file.

    ``choose`` picks from the statistics of all candidates of a file. Blank lines are no
    records. The result is written to the checkpoint folder, as the ranges of a later scan
    may differ."""
    held = spark.conf.get(MIN_PARTITIONS, None)
    spark.conf.set(MIN_PARTITIONS, held or str(spark.sparkContext.defaultParallelism))  # both scans cut alike
    try:
        ranges = persist_reliably(scan_ranges(spark, paths, delimiters), spark)
        sums = ranges.groupBy("file", "delimiter").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
        per_file: dict[str, dict[int, tuple]] = {}
        for r in sums.collect():
            per_file.setdefault(r["file"], {})[r["delimiter"]] = (r["n"], r["least"], r["total"], r["squares"])
        chosen = {f: choose(stats) for f, stats in per_file.items()}
        known: dict[str, dict[int, tuple[int, int]]] = {}
        headers: dict[str, int] = {}
        for r in ranges.filter(F.col("delimiter") == F.element_at(_as_map(chosen), F.col("file"))).select("file", "block", "state", "owner", "header_block").collect():
            known.setdefault(r["file"], {})[r["block"]] = (r["state"], r["owner"])
            headers[r["file"]] = r["header_block"]
        marks = {f: delimiters[d].encode() for f, d in chosen.items()}
        schema = "file string, owner long, block long, line long, header boolean, delimiters int, record binary"
        cut = persist_reliably(_lines(spark, paths).mapInArrow(_cut(known, headers, marks), schema), spark)
    finally:
        if held is None:
            spark.conf.unset(MIN_PARTITIONS)
    # pieces of records that pass the end of a range
    pieces = cut.filter("owner is not null").groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", F.hex("record").alias("r")))).alias("p"),
        F.max("header").alias("header"),
        F.sum("delimiters").cast("int").alias("delimiters"),
    )
    joined = F.unhex(F.array_join(F.transform("p", lambda x: x["r"]), "0A"))
    stitched = pieces.select("file", "header", "delimiters", joined.alias("record"))
    return cut.filter("owner is null").select("file", "header", "delimiters", "record").unionByName(stitched), {f: delimiters[d] for f, d in chosen.items()}


def _as_map(chosen: dict[str, int]):
    return F.create_map(*[x for f, d in sorted(chosen.items()) for x in (F.lit(f), F.lit(d).cast("long"))])
