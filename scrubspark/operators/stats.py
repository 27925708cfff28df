"""Shared statistics frames over the numeric columns of one table.

* ``moments``      two scans of plain sums (count/sum/min/max, then centred
                   power sums): mean, std, var, min, max, skew, kurtosis per
                   column (partial aggregation, one tiny exchange per batch).
* ``pair_correlations``  one scan that adds up blocks of products of centred
                   values: pairwise-complete Pearson r of all columns.
* ``quantiles``    exact linear-interpolated quantiles by radix selection of the
                   ranks (``operators.ranks``): at most four scans for all columns.
* ``bins``         one pass that assigns every value its histogram bin and
                   counts IQR outliers and box-plot whiskers per (column, bin).

Results that reach the driver are O(columns); correlations stay a DataFrame.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.operators.ranks import order_statistics

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
    T.BooleanType,
)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Aggregate expressions per job; keeps generated code small for wide tables.
_AGG_BATCH = 240


def qcol(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_value(df: DataFrame, name: str) -> Column:
    """Column as double: bool -> 0/1, float NaN -> NULL."""
    dt = df.schema[name].dataType
    c = qcol(name)
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    c = c.cast("double")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    return c


def numeric_projection(df: DataFrame, cols: list[str]) -> DataFrame:
    """Narrow frame ``v0..vN`` (double) used by every numeric pass."""
    return df.select(*[numeric_value(df, c).alias(f"v{i}") for i, c in enumerate(cols)])


def long_values(proj: DataFrame, n_cols: int) -> DataFrame:
    """(pos int, v double) for every non-null cell of ``proj`` (a Generate in
    the same stage as the scan; no shuffle)."""
    if n_cols == 0:
        return proj.sparkSession.createDataFrame([], "pos int, v double")
    args = ", ".join(f"{i}, v{i}" for i in range(n_cols))
    return proj.select(F.expr(f"stack({n_cols}, {args}) AS (pos, v)")).where(F.col("v").isNotNull())


# ----------------------------------------------------------------------------- moments


@dataclass
class ColumnMoments:
    n: int
    mean: float | None
    std: float | None  # sample, NULL when n < 2
    var: float | None
    min: float | None
    max: float | None
    skew: float  # bias-corrected, 0 when n <= 2 or constant
    kurt: float  # bias-corrected excess, 0 when n <= 3 or constant


def _adjust_skew(n: int, g1: float | None) -> float:
    if n <= 2 or g1 is None or math.isnan(g1):
        return 0.0
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def _adjust_kurt(n: int, g2: float | None) -> float:
    if n <= 3 or g2 is None or math.isnan(g2):
        return 0.0
    return ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))


def _agg_batches(df: DataFrame, exprs: list[Column]) -> dict:
    """Run plain aggregates in batches of ``_AGG_BATCH`` per job; one row each."""
    out: dict = {}
    for start in range(0, len(exprs), _AGG_BATCH):
        out.update(df.agg(*exprs[start : start + _AGG_BATCH]).collect()[0].asDict())
    return out


def moments(df: DataFrame, cols: list[str]) -> tuple[int, dict[str, ColumnMoments]]:
    """Row count and per-column moments, in two scans of plain sums (more for
    very wide tables, ``_AGG_BATCH`` aggregates each):

    1. count, sum, min, max, sample variance per column (-> mean);
    2. sums of the 2nd-4th powers of ``v - mean`` per column.

    Centring on the mean keeps the power sums free of cancellation (the same
    two-pass arithmetic a single-machine library uses), and plain ``sum``
    aggregates stay small in generated code, so wide tables batch well.
    """
    vals = [numeric_value(df, c) for c in cols]
    first = [F.count(F.lit(1)).alias("__rows")]
    for i, x in enumerate(vals):
        first += [
            F.count(x).alias(f"n{i}"),
            F.sum(x).alias(f"s{i}"),
            F.min(x).alias(f"lo{i}"),
            F.max(x).alias(f"hi{i}"),
            F.var_samp(x).alias(f"var{i}"),
        ]
    r1 = _agg_batches(df, first)
    rows = int(r1["__rows"])
    n = [int(r1[f"n{i}"]) for i in range(len(cols))]
    mean = [(r1[f"s{i}"] / n[i]) if n[i] else None for i in range(len(cols))]
    d = [x - F.lit(mean[i]) if mean[i] is not None else F.lit(None).cast("double") for i, x in enumerate(vals)]

    second = []
    for i in range(len(cols)):
        second += [
            F.sum(d[i]).alias(f"d1_{i}"),
            F.sum(d[i] * d[i]).alias(f"d2_{i}"),
            F.sum(d[i] * d[i] * d[i]).alias(f"d3_{i}"),
            F.sum(d[i] * d[i] * d[i] * d[i]).alias(f"d4_{i}"),
        ]
    r2 = _agg_batches(df, second) if second else {}

    out: dict[str, ColumnMoments] = {}
    for i, c in enumerate(cols):
        k = n[i]
        if k == 0:
            out[c] = ColumnMoments(0, None, None, None, None, None, 0.0, 0.0)
            continue
        s1, s2, s3, s4 = (r2[f"d{p}_{i}"] or 0.0 for p in (1, 2, 3, 4))
        delta = s1 / k
        m2 = s2 - k * delta * delta
        m3 = s3 - 3 * delta * s2 + 2 * k * delta**3
        m4 = s4 - 4 * delta * s3 + 6 * delta * delta * s2 - 3 * k * delta**4
        var = r1[f"var{i}"] if k > 1 else None
        if m2 > 0:
            g1 = math.sqrt(k) * m3 / m2**1.5
            g2 = k * m4 / (m2 * m2) - 3.0
        else:
            g1 = g2 = None
        out[c] = ColumnMoments(
            n=k,
            mean=mean[i],
            std=math.sqrt(max(var, 0.0)) if var is not None else None,
            var=max(var, 0.0) if var is not None else None,
            min=r1[f"lo{i}"],
            max=r1[f"hi{i}"],
            skew=_adjust_skew(k, g1) if m2 > 0 else 0.0,
            kurt=_adjust_kurt(k, g2) if m2 > 0 else 0.0,
        )

    return rows, out


# ----------------------------------------------------------------------------- correlations

_SUMS = ("n", "x", "y", "xx", "yy", "xy")
_GRAM = "i int, salt int, " + ", ".join(f"{k} array<double>" for k in _SUMS)
_CELLS = 1 << 20  # pairs whose sums a task holds at once (48 MB)
_MERGE = 64  # partial rows of a column that are added up together before the rest


def _gram_rows(means: list[float], lo: int, hi: int):
    """Per task one row per column i of lo .. hi - 1: sums over rows in which i and j are both present,
    for every j from lo on, of 1, x, y, x*x, y*y and x*y (x, y: values of i and j minus their means)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.asarray(means)[lo:]
        total = {k: np.zeros((hi - lo, len(m))) for k in _SUMS}
        seen = False
        for batch in batches:
            seen = True
            y = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[lo:]], axis=1)
            here = ~np.isnan(y)
            y, w = np.where(here, y - m, 0.0), here.astype(float)
            x, v = y[:, : hi - lo].T, w[:, : hi - lo].T
            with np.errstate(invalid="ignore"):  # infinities make a pair undefined
                total["n"] += v @ w
                total["x"] += x @ w
                total["y"] += v @ y
                total["xx"] += (x * x) @ w
                total["yy"] += v @ (y * y)
                total["xy"] += x @ y
        if seen:
            salt = TaskContext.get().partitionId() % _MERGE
            cols = [pa.array(range(lo, hi), pa.int32()), pa.array([salt] * (hi - lo), pa.int32())]
            cols += [pa.array(list(total[k]), pa.list_(pa.float64())) for k in _SUMS]
            yield pa.RecordBatch.from_arrays(cols, names=["i", "salt", *_SUMS])

    return run


def _add_rows(table):
    """Sum of the arrays of a group of partial rows."""
    arrays = [pa.array([np.sum([np.asarray(a.values) for a in table.column(k)], axis=0)], pa.list_(pa.float64())) for k in _SUMS]
    return pa.table([table.column("i")[:1], table.column("salt")[:1], *arrays], names=["i", "salt", *_SUMS])


def pair_correlations(proj: DataFrame, means: list[float | None], constant: list[bool]) -> DataFrame:
    """(i, j, r), i < j: pairwise-complete Pearson r of the columns of ``proj``, NULL where
    undefined. Tasks add up blocks of products, and the sums of a column are merged in two
    steps, so that no task holds more than some of them. A scan covers as many columns i as
    ``_CELLS`` pairs allow: about a thousand columns take one scan, wider tables a band of
    the matrix each."""
    centre = [m if m is not None and math.isfinite(m) else 0.0 for m in means]
    p, each = len(centre), None
    band = max(1, _CELLS // p)
    for lo in range(0, p, band):
        parts = proj.mapInArrow(_gram_rows(centre, lo, min(lo + band, p)), _GRAM)
        merged = parts.groupBy("i", "salt").applyInArrow(_add_rows, _GRAM).groupBy("i").applyInArrow(_add_rows, _GRAM)
        rows = merged.select("i", F.posexplode(F.arrays_zip(*_SUMS)).alias("at", "s")).select("i", (F.col("at") + lo).alias("j"), "s.*").where("j > i")
        each = rows if each is None else each.unionByName(rows)
    n = F.col("n")
    cxx, cyy, cxy = (F.col(k) - F.col(a) * F.col(b) / n for k, a, b in (("xx", "x", "x"), ("yy", "y", "y"), ("xy", "x", "y")))
    flat = [k for k, c in enumerate(constant) if c]
    ok = (n >= 2) & (cxx > 0) & (cyy > 0) & ~F.isnan(cxy) & ~F.col("i").isin(flat) & ~F.col("j").isin(flat)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cxy / F.sqrt(cxx * cyy)))
    return each.select("i", "j", F.when(ok, r).alias("r"))


# ----------------------------------------------------------------------------- quantiles


def _virtual_index(n: int, p: float) -> float:
    # linear method: n*p + (1 - p) - 1, evaluated like numpy
    return n * p + (1.0 + p * (1.0 - 1.0 - 1.0)) - 1.0


def lerp(a: float, b: float, t: float) -> float:
    if a == b or t == 0.0:  # also keeps infinities, whose difference is no number
        return a
    diff = b - a
    if t >= 0.5:
        return b - diff * (1.0 - t)
    return a + diff * t


def median_ranks(n: int) -> tuple[int, int]:
    """The two ranks whose values' mean is the median of n values (equal if n is odd)."""
    return (n - 1) // 2, n // 2


def quantiles(
    spark: SparkSession,
    proj: DataFrame,
    info: dict[int, tuple[int, float | None, float | None]],
    probs: list[float],
    exact: bool = True,
    accuracy: int = 10000,
) -> dict[int, list[float | None]]:
    """Quantiles (linear interpolation) per column position.

    ``proj`` is the numeric projection (``v0..vN``), ideally cached; ``info``
    maps position -> (non-null count, min, max) from ``moments``. Exact mode selects the
    wanted ranks digit by digit (``ranks.order_statistics``): at most four scans of ``proj``
    for all columns together, whatever their values. Infinities are values like others.
    """
    out: dict[int, list[float | None]] = {p: [None] * len(probs) for p in info}
    live = {p: v for p, v in info.items() if v[0] > 0}
    if not live:
        return out
    if not exact:
        arr = F.array(*[F.lit(float(q)) for q in probs])
        long = long_values(proj, len(proj.columns))
        rows = long.where(F.col("pos").isin(list(live))).groupBy("pos").agg(F.percentile_approx("v", arr, accuracy).alias("q")).collect()
        for r in rows:
            out[int(r["pos"])] = [float(x) for x in r["q"]]
        return out

    plan: dict[int, list[tuple[int, int, float]]] = {}
    wanted: dict[int, set[int]] = {}
    found: dict[tuple[int, int], float] = {}
    for pos, (n, mn, mx) in live.items():
        plan[pos] = []
        for q in probs:
            h = _virtual_index(n, q)
            lo = min(max(int(math.floor(h)), 0), n - 1)
            plan[pos].append((lo, min(lo + 1, n - 1), h - math.floor(h)))
        ranks = {r for spec in plan[pos] for r in spec[:2]}
        if mn == mx:
            found |= {(pos, r): float(mn) for r in ranks}
        else:
            wanted[pos] = ranks
    found |= order_statistics(proj, wanted)
    for pos, specs in plan.items():
        out[pos] = [lerp(found[pos, lo], found[pos, hi], t) for lo, hi, t in specs]
    return out


# ----------------------------------------------------------------------------- histogram / bounds


@dataclass
class BinSpec:
    first: float
    last: float
    k: int
    step: float


def auto_bins(n: int, mn: float, mx: float, q1: float, q3: float, integral: bool) -> BinSpec:
    """Equal-width "auto" rule: width = min(max(FD, sqrt/2), Sturges); integer
    columns get width >= 1; k = ceil(range / width), 1 when the width is 0."""
    first, last = float(mn), float(mx)
    if not math.isfinite(first) or not math.isfinite(last):
        return BinSpec(first, last, 1, 0.0)  # an infinite range has one bin
    if first == last:
        first, last = first - 0.5, last + 0.5
    ptp = float(mx - mn)
    sqrt_bw = ptp / math.sqrt(n)
    sturges_bw = ptp / (math.log2(n) + 1.0)
    fd_bw = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    fd_corr = max(fd_bw, sqrt_bw / 2)
    width = min(fd_corr, sturges_bw) if fd_corr else sturges_bw
    if width:
        if integral and width < 1:
            width = 1
        k = int(math.ceil((last - first) / width))
    else:
        k = 1
    k = max(k, 1)
    return BinSpec(first, last, k, (last - first) / k)


def bin_index(v: Column, first: Column, last: Column, k: Column, step: Column) -> Column:
    """1-based bin with edges i*step + first (last edge = ``last``, closed)."""
    denom = last - first
    g0 = F.floor((v - first) / denom * k).cast("int")
    g1 = F.least(F.greatest(g0, F.lit(0)), k - 1)

    def edge(i: Column) -> Column:
        return F.when(i >= k, last).otherwise(i.cast("double") * step + first)

    g2 = F.when(v < edge(g1), g1 - 1).otherwise(g1)
    g3 = F.when((v >= edge(g2 + 1)) & (g2 != k - 1), g2 + 1).otherwise(g2)
    return g3 + 1


def bins_pass(spark: SparkSession, proj: DataFrame, params: list[tuple]) -> DataFrame:
    """One scan: per (pos, bin) count, min, max, IQR outliers and whisker
    candidates. ``params`` rows: (pos, first, last, k, step, lo_fence, hi_fence);
    fences are NULL when the IQR is 0 or undefined."""
    schema = (
        "pos int, first double, last double, k int, step double, lo_fence double, hi_fence double"
    )
    # an infinite range has one bin: any finite edges do, with its values put inside
    finite = [(p, *((a, z, k, s) if math.isfinite(z - a) else (0.0, 1.0, 1, 1.0)), lo, hi) for p, a, z, k, s, lo, hi in params]
    pdf = spark.createDataFrame(finite, schema)
    long = long_values(proj, len(proj.columns))
    j = long.join(F.broadcast(pdf), "pos").withColumn("inside", F.greatest("first", F.least("last", "v")))
    v = F.col("v")
    b = bin_index(F.col("inside"), F.col("first"), F.col("last"), F.col("k"), F.col("step"))
    out_flag = (v < F.col("lo_fence")) | (v > F.col("hi_fence"))
    return j.groupBy("pos", b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if(F.coalesce(out_flag, F.lit(False))).alias("outliers"),
        F.min(F.when(v >= F.col("lo_fence"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("hi_fence"), v)).alias("whisker_hi"),
    )
