"""Cleaning pipeline (C1-C16): strip -> dedup -> dates -> numbers -> fill -> rename.

Jobs, in order (the raw rows are persisted for the first two):
  1. raw rows: rows, nulls and strip-change counts in one aggregate; exact
     distinct counts from one (column, value) aggregate
  2. rows counted by the hash of their stripped values, then only those that may have an
     equal grouped by the values themselves (persisted): raw duplicates, duplicates removed
     and the dedup frame
  3. date detection on the deduplicated rows (hint ratio, then parse counts)
  4. numeric-text detection on the remaining text columns; the same scan counts the missing
     cells of the numeric ones, so that nothing is converted just to be counted
  5. exact medians of the numeric columns that need filling (radix selection), in their own types
The cleaned table itself is one lazy projection over the persisted dedup frame.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import ROUND_HALF_EVEN, Context, Decimal
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.functions.text import normalize_headers, strip_text
from scrubspark.operators import stats
from scrubspark.operators.dedup import group_equal
from scrubspark.operators.detect import detect_dates, detect_numeric_text, numeric_text_scan
from scrubspark.operators.profile import Profile, groupable, is_missing, profile, row_digest
from scrubspark.operators.stats import qcol
from scrubspark.plans.cleanplan import CleanPlan, ColumnDecision


#: Decimal digits that hold every value of a whole type.
WHOLE_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def strip_columns(df: DataFrame) -> DataFrame:
    """Unicode whitespace stripped from every text column."""
    return df.select(
        *[
            strip_text(qcol(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else qcol(f.name)
            for f in df.schema.fields
        ]
    )


def strip_counts(df: DataFrame) -> dict[str, int]:
    """Values changed by the strip, per text column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return {}
    r = df.agg(*[F.count_if(qcol(c) != strip_text(qcol(c))).alias(f"s{i}") for i, c in enumerate(text)]).collect()[0]
    return {c: int(r[f"s{i}"]) for i, c in enumerate(text)}


def medians(df: DataFrame, counts: dict[str, int], exact: bool = True) -> dict[str, tuple]:
    """Per column the two values around its median (equal ones if the number of values is odd),
    in the column's own type; (None, None) if it has no values. ``counts``: values per column."""
    live = [c for c, n in counts.items() if n]
    out: dict[str, tuple] = {c: (None, None) for c in counts}
    if not live:
        return out
    sel = []
    for c in live:
        dt = df.schema[c].dataType
        own = qcol(c) if isinstance(dt, T.DecimalType) else qcol(c).cast("long") if isinstance(dt, stats.INTEGRAL_TYPES) else stats.numeric_value(df, c)
        sel.append(own.alias(f"v{len(sel)}"))
    # narrow, persisted for the few search passes (text is converted once, not once per pass)
    proj = df.select(*sel).persist(StorageLevel.MEMORY_AND_DISK)
    if exact:
        ranks = [stats.median_ranks(counts[c]) for c in live]
        found = stats.order_statistics(proj, {j: set(pair) for j, pair in enumerate(ranks)})
        out |= {c: (found[j, ranks[j][0]], found[j, ranks[j][1]]) for j, c in enumerate(live)}
    else:
        r = proj.agg(*[F.percentile_approx(f"v{j}", 0.5).alias(f"v{j}") for j in range(len(live))]).first()
        out |= {c: (r[j], r[j]) for j, c in enumerate(live)}
    proj.unpersist()
    return out


def median_fill(low, high, dt: T.DataType) -> tuple[float | int | Decimal, T.DataType]:
    """The mean of two values of a type and the type of the filled column.

    Floating columns stay what they are. Whole and decimal ones stay what they are if the mean
    is a value of the type; else they get one more decimal place, so that no digit of any cell
    changes. Where 38 digits leave no room for it the mean is rounded, half to even."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return (0.0 if low is None else stats.lerp(low, high, 0.5)), dt
    if low is None:
        return 0, dt
    precision, scale = (dt.precision, dt.scale) if isinstance(dt, T.DecimalType) else (WHOLE_DIGITS[type(dt)], 0)
    wide = Context(prec=60)
    mean = wide.divide(wide.add(Decimal(low), Decimal(high)), Decimal(2))
    if mean == mean.quantize(Decimal(1).scaleb(-scale), context=wide):
        return (int(mean) if not isinstance(dt, T.DecimalType) else mean), dt
    if precision < 38:
        return mean, T.DecimalType(precision + 1, scale + 1)
    return mean.quantize(Decimal(1).scaleb(-scale), ROUND_HALF_EVEN, wide), dt


@dataclass
class CleanResult:
    table: DataFrame
    plan: CleanPlan
    pre_profile: Profile
    stripped: DataFrame
    dedup: DataFrame
    converted: DataFrame
    exact: bool = True
    _persisted: list = field(default_factory=list)

    @cached_property
    def post_profile(self) -> Profile:
        return profile(self.table, exact=self.exact)

    def report(self) -> dict[str, DataFrame]:
        spark = self.table.sparkSession
        return {
            "summary": self.plan.summary(spark),
            "change_log": self.plan.change_log(spark),
            "conversion_log": self.plan.conversion_log(spark),
            "nulls_filled_by_column": self.plan.nulls_by_column(spark),
            "pre_clean_profile": self.pre_profile.frame(spark),
            "post_clean_profile": self.post_profile.frame(spark),
        }

    def close(self) -> None:
        for d in self._persisted:
            d.unpersist()


def dealt_evenly(df: DataFrame) -> DataFrame:
    """Rows of few files dealt to all cores: a file is read by as few tasks as it has row groups,
    and rows that are not shuffled later would stay where they were read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def clean(df: DataFrame, exact: bool = True, checkpoint: bool = False) -> CleanResult:
    spark = df.sparkSession
    # untyped all-null columns behave as numbers (filled with 0)
    df = df.select(
        *[
            qcol(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.NullType) else qcol(f.name)
            for f in df.schema.fields
        ]
    )
    fields = df.schema.fields
    text_cols = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    stripped = strip_columns(df)
    # six scans of the raw rows follow: read, or derived, once
    df = dealt_evenly(df).persist(StorageLevel.MEMORY_AND_DISK)

    # job 1: raw profile (rows, nulls, distinct) with the strip-change counts in the same scan
    strip_aggs = [F.count_if(qcol(c) != strip_text(qcol(c))).alias(f"strip_{i}") for i, c in enumerate(text_cols)]
    pre = profile(df, exact=exact, duplicates=False, extra=strip_aggs)
    stripped_counts = {c: int(pre.extra[f"strip_{i}"]) for i, c in enumerate(text_cols)}

    # job 2: equal rows by their stripped values (persisted: every later job reads them).
    # Rows that the strip leaves alone are equal as raw rows iff they share a group;
    # only rows that it changes are compared by a digest of their raw cells.
    changed = F.lit(False)
    for c in text_cols:
        changed = changed | F.coalesce(qcol(c) != strip_text(qcol(c)), F.lit(False))
    keys = [strip_text(k).alias(f.name) if f.name in text_cols else k.alias(f.name) for f, k in zip(fields, groupable(df))]
    equal = group_equal(df.select(*keys, (~changed).alias("__as_read")), [f.name for f in fields], "__as_read", checkpoint)
    grouped, persisted = equal.frame, equal.persisted
    g = grouped.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("__n") - 1).alias("dups"),
        F.sum(F.greatest(F.col("__same") - 1, F.lit(0))).alias("same_dups"),
    ).collect()[0]
    raw_dups = int(g["same_dups"] or 0)
    if any(stripped_counts.values()):
        d = df.where(changed).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(row_digest(df)).alias("u")).collect()[0]
        raw_dups += d["n"] - d["u"]
    pre.duplicate_rows = raw_dups
    df.unpersist()
    # grouping turned maps and variants into JSON text; restore the original types
    restore = {T.MapType: lambda f: F.from_json(qcol(f.name), f.dataType), T.VariantType: lambda f: F.parse_json(qcol(f.name))}
    dedup = grouped.select(*[restore.get(type(f.dataType), lambda f: qcol(f.name))(f).alias(f.name) for f in fields])

    plan = CleanPlan(
        rows_before=pre.rows,
        rows_after=int(g["rows"]),
        raw_duplicate_rows=int(pre.duplicate_rows or 0),
        duplicates_removed=int(g["dups"] or 0),
    )
    new_names = normalize_headers(spark, df.columns)
    for f, new in zip(fields, new_names):
        plan.columns.append(
            ColumnDecision(
                name=f.name,
                new_name=new,
                original_dtype=f.dataType.simpleString(),
                text=isinstance(f.dataType, T.StringType),
                stripped=stripped_counts.get(f.name, 0),
                converted_dtype=f.dataType.simpleString(),
            )
        )
    by_name = {d.name: d for d in plan.columns}

    # jobs 3-4: type detection on the deduplicated rows
    date_fmts = detect_dates(dedup, text_cols)
    for c, fmt in date_fmts.items():
        by_name[c].conversion, by_name[c].date_format = "datetime", fmt
    remaining = [c for c in text_cols if c not in date_fmts]
    native = [f.name for f in dedup.schema.fields if stats.is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType)]
    counts, r = numeric_text_scan(dedup, remaining, [F.count_if(is_missing(dedup, c)).alias(f"m{i}") for i, c in enumerate(native)])
    for c in detect_numeric_text(dedup, remaining, counts):
        by_name[c].conversion = "numeric"
    converted = plan.convert(dedup)
    for f in converted.schema.fields:
        by_name[f.name].converted_dtype = f.dataType.simpleString()

    numeric = [
        f.name
        for f in converted.schema.fields
        if stats.is_numeric(f.dataType) and not isinstance(f.dataType, T.BooleanType)
    ]
    # cells without a value after the conversion (dates that don't parse stay missing, uncounted)
    missing = {c: int(r[f"m{i}"]) for i, c in enumerate(native)}
    missing |= {c: plan.rows_after - (k if c in numeric else n) for c, (n, k) in counts.items()}

    # job 5: exact medians for numeric columns with missing values, in the columns' own types
    need = [c for c in numeric if missing[c] > 0]
    found = medians(converted, {c: plan.rows_after - missing[c] for c in need}, exact)

    for f in converted.schema.fields:
        d = by_name[f.name]
        n_missing = missing.get(f.name, 0)
        if f.name in numeric:
            d.fill = "median"
            d.nulls_filled = n_missing
            if f.name in found:
                d.fill_value, kind = median_fill(*found[f.name], f.dataType)
                d.converted_dtype = kind.simpleString()
        elif isinstance(f.dataType, T.StringType):
            d.fill = "unknown"
            d.nulls_filled = n_missing

    table = plan.apply(dedup)
    return CleanResult(
        table=table,
        plan=plan,
        pre_profile=pre,
        stripped=stripped,
        dedup=dedup,
        converted=converted,
        exact=exact,
        _persisted=persisted,
    )
