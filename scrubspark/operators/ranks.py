"""Exact order statistics of many columns by radix selection.

A value becomes a key whose unsigned order is the value's: 64 bits for doubles and
integers, 128 for decimals. A pass counts, for every wanted rank of every column, how many
keys that share the digits found so far have which next digit of 16 bits; the digit that
holds the rank is then known. So a double takes at most four passes and a decimal at most
eight, whatever the distribution, and a rank whose remaining keys are all equal is found
at once. No value is joined with anything: tasks sort and count batches with numpy, Spark
adds up at most 65,536 digits per rank, and the driver gets one row per rank and pass.

Nulls and NaN take no part; infinities are values like others; -0.0 and 0.0 are one value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGIT = 16
_TOP = np.uint64(1 << 63)
_DIGITS = "tid int, digit int, n long, lo struct<a:long,b:long>, hi struct<a:long,b:long>"


def words_of(dt: T.DataType) -> int:
    """64-bit words of a key of this type."""
    return 2 if isinstance(dt, T.DecimalType) else 1


def keys_of(column: pa.Array) -> list[np.ndarray]:
    """Keys of the non-null values: unsigned words, the highest first."""
    column = column.drop_null()
    if pa.types.is_floating(column.type):
        v = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        v = v[~np.isnan(v)] + 0.0  # -0.0 becomes 0.0
        bits = v.view(np.uint64)
        return [np.where(bits & _TOP != 0, ~bits, bits | _TOP)]
    if pa.types.is_decimal(column.type):
        raw = np.frombuffer(column.buffers()[1], np.uint64)[2 * column.offset : 2 * (column.offset + len(column))]
        return [raw[1::2] ^ _TOP, raw[::2]]
    return [column.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64) ^ _TOP]


def value_of(key: tuple[int, int], dt: T.DataType) -> float | int | Decimal:
    """The value of a key (its words as unsigned integers)."""
    a, b = key
    if isinstance(dt, T.DecimalType):
        whole = ((a ^ 1 << 63) << 64 | b) - (1 << 128 if not a >> 63 else 0)
        return Decimal(whole).scaleb(-dt.scale, Context(prec=60))
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        bits = a ^ 1 << 63 if a >> 63 else ~a & (1 << 64) - 1
        return float(np.asarray([bits], np.uint64).view(np.float64)[0])
    return (a ^ 1 << 63) - (1 << 64 if not a >> 63 else 0)


@dataclass
class _Search:
    """Ranks of one column whose keys share their first digits."""

    pos: int
    prefix: int  # the digits found so far, as one number
    ranks: dict[int, int]  # wanted rank -> rank among the keys with this prefix


def _signed(word: np.ndarray) -> pa.Array:
    return pa.array((word ^ _TOP).view(np.int64))


def _count_digits(searches: list[tuple[int, int, int]], words: list[int], step: int):
    """Rows (tid, digit, n, lo, hi) per batch: keys of every search by their next digit, with
    the smallest and largest key."""
    word, shift = divmod(step * DIGIT, 64)
    shift = np.uint64(64 - DIGIT - shift)

    def same(keys: list[np.ndarray], prefix: int) -> np.ndarray:
        on = np.ones(len(keys[0]), bool)
        whole, part = divmod(step, 4)
        for w in range(whole):
            on &= keys[w] == np.uint64(prefix >> DIGIT * (step - 4 * (w + 1)) & (1 << 64) - 1)
        if part:
            on &= keys[whole] >> np.uint64(64 - DIGIT * part) == np.uint64(prefix & (1 << DIGIT * part) - 1)
        return on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[int, list[np.ndarray]] = {}
            out = []
            for tid, pos, prefix in searches:
                if pos not in made:
                    keys = keys_of(batch.column(pos))
                    by = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
                    made[pos] = [k[by] for k in keys]
                keys = made[pos]
                if step:
                    on = same(keys, prefix)
                    keys = [k[on] for k in keys]
                if not len(keys[0]):
                    continue
                digit = (keys[word] >> shift & np.uint64((1 << DIGIT) - 1)).astype(np.int32)
                head = np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1]]))
                last = np.append(head[1:], len(digit)) - 1
                out.append((np.full(len(head), tid, np.int32), digit[head], last - head + 1, [k[head] for k in keys], [k[last] for k in keys]))
            if out:
                tid, digit, n = (np.concatenate(c) for c in list(zip(*out))[:3])
                ends = []
                for side in (3, 4):
                    a = np.concatenate([o[side][0] for o in out])
                    b = np.concatenate([o[side][1] if len(o[side]) > 1 else np.zeros(len(o[0]), np.uint64) for o in out])
                    ends.append(pa.StructArray.from_arrays([_signed(a), _signed(b)], names=["a", "b"]))
                yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(digit), pa.array(n.astype(np.int64)), *ends], names=["tid", "digit", "n", "lo", "hi"])

    return run


def order_statistics(frame: DataFrame, wanted: dict[int, set[int]]) -> dict[tuple[int, int], float | int | Decimal]:
    """(column position, rank) -> value, ranks from 0 in ascending order of the non-null values.

    ``frame`` holds numeric columns (best cached, as it is scanned once per pass); every rank
    must be below its column's number of values. Values come in the column's own type."""
    spark, fields = frame.sparkSession, frame.schema.fields
    steps = [4 * words_of(f.dataType) for f in fields]
    searches = [_Search(pos, 0, {r: r for r in ranks}) for pos, ranks in wanted.items() if ranks]
    found: dict[tuple[int, int], float | int | Decimal] = {}
    step = 0
    while searches:
        active = sorted({s.pos for s in searches})
        at = {pos: k for k, pos in enumerate(active)}
        rows = frame.select(*[F.col(f"`{fields[p].name}`") for p in active])
        plan = [(tid, at[s.pos], s.prefix) for tid, s in enumerate(searches)]
        counted = rows.mapInArrow(_count_digits(plan, steps, step), _DIGITS)
        digits = counted.groupBy("tid", "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        before = F.sum("n").over(Window.partitionBy("tid").orderBy("digit")) - F.col("n")
        ranks = [(tid, rank, nth) for tid, s in enumerate(searches) for rank, nth in s.ranks.items()]
        table = F.broadcast(spark.createDataFrame(ranks, "tid int, rank long, nth long"))
        hit = digits.withColumn("before", before).join(table, "tid").where("nth >= before and nth < before + n")
        following: dict[tuple[int, int], _Search] = {}
        for r in hit.collect():
            s = searches[r["tid"]]
            dt = fields[s.pos].dataType
            if r["lo"] == r["hi"] or step + 1 == steps[s.pos]:
                found[s.pos, r["rank"]] = value_of(tuple(x + (1 << 63) for x in r["lo"]), dt)
                continue
            prefix = s.prefix << DIGIT | r["digit"]
            own = following.setdefault((s.pos, prefix), _Search(s.pos, prefix, {}))
            own.ranks[r["rank"]] = r["nth"] - r["before"]
        searches = [following[k] for k in sorted(following)]
        step += 1
    return found
