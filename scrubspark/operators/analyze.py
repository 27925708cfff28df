"""Analysis of one (cleaned) table: A1-A15.

``Analysis(df)`` types the columns (A1) and lazily builds the shared frames:

* numeric projection (persisted) -> moments, exact quantiles, bins pass
* categorical frequency frame (persisted) -> top values, cardinality, bars

Report frames are small DataFrames keyed by ``column``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.functions.dates import parse_date
from scrubspark.functions.text import UNKNOWN_TEXT
from scrubspark.operators import stats
from scrubspark.operators.detect import detect_dates
from scrubspark.operators.profile import WIDE_TEXT, narrow_text
from scrubspark.operators.stats import DATETIME_TYPES, qcol

# --- fixed values -------------------------------------------------------------
OUTLIER_IQR_FACTOR = 1.5
TOP_CATEGORIES = 10
HIGH_CARDINALITY_SHARE = 0.5
TOP_CORRELATION_PAIRS = 5
TOP_OUTLIER_COLUMNS = 5
SKEW_SHAPE = 0.5  # |skew| beyond this -> right / left skewed
HIGH_SKEW = 1.0
BIMODAL_MIN_ROWS = 30
BIMODAL_MIN_DISTINCT = 5
BIMODAL_MIN_BINS = 5
BIMODAL_PEAK_SHARE = 0.2
TREND_SHARE = 0.01
# -----------------------------------------------------------------------------

QUARTILES = [0.25, 0.5, 0.75]


class Analysis:
    """Shared state for analysing one table; every report is a DataFrame."""

    def __init__(self, df: DataFrame, exact: bool = True, detect: bool = True):
        self.spark = df.sparkSession
        self.exact = exact
        self.source = df
        text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        self.date_formats = detect_dates(df, text_cols) if detect and text_cols else {}
        sel = []
        for f in df.schema.fields:
            if f.name in self.date_formats:
                sel.append(parse_date(qcol(f.name), self.date_formats[f.name]).alias(f.name))
            else:
                sel.append(qcol(f.name))
        self.df = df.select(*sel)
        fields = self.df.schema.fields
        self.columns = [f.name for f in fields]
        self.datetime = [f.name for f in fields if isinstance(f.dataType, DATETIME_TYPES)]
        self.numeric = [f.name for f in fields if stats.is_numeric(f.dataType)]
        self.categorical = [
            f.name for f in fields if isinstance(f.dataType, T.StringType) and f.name not in self.datetime
        ]
        self.integral = {
            i for i, c in enumerate(self.numeric) if isinstance(self.df.schema[c].dataType, stats.INTEGRAL_TYPES)
        }
        self._persisted: list[DataFrame] = []

    # ------------------------------------------------------------------ shared frames
    def _persist(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._persisted.append(df)
        return df

    def close(self) -> None:
        for d in self._persisted:
            d.unpersist()
        self._persisted.clear()

    @cached_property
    def proj(self) -> DataFrame:
        return self._persist(stats.numeric_projection(self.df, self.numeric))

    @cached_property
    def _moments(self):
        rows, m = stats.moments(self.proj, [f"v{i}" for i in range(len(self.numeric))])
        return rows, {self.numeric[i]: m[f"v{i}"] for i in range(len(self.numeric))}

    @property
    def rows(self) -> int:
        if not self.numeric:
            return self._row_count
        return self._moments[0]

    @cached_property
    def _row_count(self) -> int:
        return int(self.df.count())

    @property
    def moments(self) -> dict[str, stats.ColumnMoments]:
        return self._moments[1]

    @cached_property
    def quartiles(self) -> dict[str, list[float | None]]:
        info = {i: (m.n, m.min, m.max) for i, (c, m) in enumerate((c, self.moments[c]) for c in self.numeric)}
        q = stats.quantiles(self.spark, self.proj, info, QUARTILES, exact=self.exact)
        return {c: q[i] for i, c in enumerate(self.numeric)}

    @cached_property
    def bin_specs(self) -> dict[int, stats.BinSpec]:
        out = {}
        for i, c in enumerate(self.numeric):
            m = self.moments[c]
            if m.n == 0:
                continue
            q1, _, q3 = self.quartiles[c]
            out[i] = stats.auto_bins(m.n, m.min, m.max, q1, q3, i in self.integral)
        return out

    def fences(self, c: str) -> tuple[float | None, float | None]:
        q1, _, q3 = self.quartiles[c]
        if q1 is None or q3 is None:
            return None, None
        iqr = q3 - q1
        if iqr == 0 or iqr != iqr:
            return None, None
        return q1 - OUTLIER_IQR_FACTOR * iqr, q3 + OUTLIER_IQR_FACTOR * iqr

    @cached_property
    def bins(self) -> DataFrame:
        """(pos, bin, count, min, max, outliers, whisker_lo, whisker_hi)."""
        params = []
        for i, spec in self.bin_specs.items():
            lo, hi = self.fences(self.numeric[i])
            params.append((i, spec.first, spec.last, spec.k, spec.step, lo, hi))
        if not params:
            return self.spark.createDataFrame(
                [],
                "pos int, bin int, count long, min double, max double, outliers long, "
                "whisker_lo double, whisker_hi double",
            )
        return self._persist(stats.bins_pass(self.spark, self.proj, params))

    @cached_property
    def bin_summary(self) -> dict[str, dict]:
        """Per column: outliers, whiskers, bimodal flag (small collect)."""
        if not self.bin_specs:
            return {}
        spec_rows = [(i, s.k) for i, s in self.bin_specs.items()]
        kdf = self.spark.createDataFrame(spec_rows, "pos int, k int")
        b = self.bins
        per = b.groupBy("pos").agg(
            F.sum("outliers").alias("outliers"),
            F.min("whisker_lo").alias("whisker_lo"),
            F.max("whisker_hi").alias("whisker_hi"),
            F.max("count").alias("maxc"),
            F.count(F.lit(1)).alias("nonempty"),
            F.count_if(F.col("min") != F.col("max")).alias("multi"),
        )
        prev = b.select("pos", (F.col("bin") + 1).alias("bin"), F.col("count").alias("prev"))
        nxt = b.select("pos", (F.col("bin") - 1).alias("bin"), F.col("count").alias("next"))
        peaks = (
            b.select("pos", "bin", "count")
            .join(prev, ["pos", "bin"], "left")
            .join(nxt, ["pos", "bin"], "left")
            .join(F.broadcast(kdf), "pos")
            .join(per.select("pos", "maxc"), "pos")
            .where(
                (F.col("bin") > 1)
                & (F.col("bin") < F.col("k"))
                & (F.col("count") > F.coalesce("prev", F.lit(0)))
                & (F.col("count") > F.coalesce("next", F.lit(0)))
                & (F.col("count") >= F.col("maxc") * BIMODAL_PEAK_SHARE)
            )
            .groupBy("pos")
            .agg(F.count(F.lit(1)).alias("peaks"))
        )
        rows = per.join(peaks, "pos", "left").collect()
        out = {}
        for r in rows:
            i = int(r["pos"])
            c = self.numeric[i]
            n = self.moments[c].n
            k = self.bin_specs[i].k
            enough_distinct = r["nonempty"] >= BIMODAL_MIN_DISTINCT or (r["nonempty"] == 4 and r["multi"] >= 1)
            bimodal = (
                n >= BIMODAL_MIN_ROWS
                and enough_distinct
                and k >= BIMODAL_MIN_BINS
                and (r["peaks"] or 0) >= 2
            )
            out[c] = {
                "outliers": int(r["outliers"] or 0),
                "whisker_lo": r["whisker_lo"],
                "whisker_hi": r["whisker_hi"],
                "bimodal": bool(bimodal),
            }
        return out

    def outlier_count(self, c: str) -> int:
        return self.bin_summary.get(c, {}).get("outliers", 0)

    # ------------------------------------------------------------------ A1 / A2
    def column_types(self) -> DataFrame:
        rows = []
        for i, f in enumerate(self.df.schema.fields):
            if f.name in self.datetime:
                kind = "datetime"
            elif f.name in self.numeric:
                kind = "numeric"
            elif f.name in self.categorical:
                kind = "categorical"
            else:
                kind = "other"
            rows.append((i, f.name, f.dataType.simpleString(), kind, f.name in self.date_formats))
        return self.spark.createDataFrame(
            rows, "position int, column string, dtype string, kind string, detected_from_text boolean"
        )

    def outlier_totals(self) -> tuple[int, float]:
        total = sum(self.outlier_count(c) for c in self.numeric)
        denom = self.rows * len(self.numeric)
        return total, (total / denom * 100) if denom else 0.0

    def overview(self) -> DataFrame:
        total, pct = self.outlier_totals()
        row = (
            self.rows,
            len(self.columns),
            len(self.numeric),
            len(self.categorical),
            len(self.datetime),
            ", ".join(self.numeric),
            ", ".join(self.categorical),
            ", ".join(self.datetime),
            total,
            float(pct),
        )
        return self.spark.createDataFrame(
            [row],
            "total_rows long, total_columns long, numeric_columns_count long, categorical_columns_count long, "
            "datetime_columns_detected long, numeric_columns string, categorical_columns string, "
            "datetime_columns string, total_outliers_detected long, overall_outlier_percentage double",
        )

    # ------------------------------------------------------------------ A3 / A4 / A5
    def describe_rows(self) -> list[tuple]:
        out = []
        for c in self.numeric:
            m = self.moments[c]
            q1, med, q3 = self.quartiles[c]
            oc = self.outlier_count(c)
            out.append(
                (
                    c,
                    m.n,
                    m.mean if m.n else None,
                    med,
                    (m.std if m.n > 1 else 0.0),
                    m.min,
                    m.max,
                    q1,
                    q3,
                    m.skew,
                    m.kurt,
                    oc,
                    (oc / self.rows * 100) if self.rows else 0.0,
                )
            )
        return out

    def describe_numeric(self) -> DataFrame:
        return self.spark.createDataFrame(
            self.describe_rows(),
            "column string, count long, mean double, median double, std double, min double, max double, "
            "percentile_25 double, percentile_75 double, skewness double, kurtosis double, "
            "outlier_count long, outlier_percentage double",
        )

    def outlier_counts(self) -> DataFrame:
        return self.describe_numeric().select("column", "outlier_count", "outlier_percentage")

    def outlier_ranking(self, top: int = TOP_OUTLIER_COLUMNS) -> DataFrame:
        rows = [(i, c, self.outlier_count(c)) for i, c in enumerate(self.numeric)]
        rows.sort(key=lambda r: (-r[2], r[0]))
        out = [
            (rank + 1, c, oc, (oc / self.rows * 100) if self.rows else 0.0)
            for rank, (_, c, oc) in enumerate(rows[:top])
        ]
        return self.spark.createDataFrame(
            out, "rank int, column string, outlier_count long, outlier_percentage double"
        )

    def flag_outliers(self) -> DataFrame:
        """Row-level flags ``<column>_is_outlier`` for every numeric column."""
        extra = []
        for c in self.numeric:
            lo, hi = self.fences(c)
            x = stats.numeric_value(self.df, c)
            if lo is None:
                flag = F.lit(False)
            else:
                flag = F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))
            extra.append(flag.alias(f"{c}_is_outlier"))
        return self.df.select("*", *extra)

    # ------------------------------------------------------------------ A6 / A7
    @cached_property
    def freq_raw(self) -> DataFrame:
        """(pos, value, count) over categorical columns, NULL kept as a value.

        Text of more than ``WIDE_TEXT`` characters stands as its SHA-256 (64 hex digits,
        no shorter text has its length), so that long text is neither shuffled nor kept."""
        cats = self.categorical
        if not cats:
            return self.spark.createDataFrame([], "pos int, value string, count long")
        sp = self.df.select(*[narrow_text(qcol(c)).alias(f"s{i}") for i, c in enumerate(cats)])
        args = ", ".join(f"{i}, s{i}" for i in range(len(cats)))
        long = sp.select(F.expr(f"stack({len(cats)}, {args}) AS (pos, value)"))
        return self._persist(long.groupBy("pos", "value").agg(F.count(F.lit(1)).alias("count")))

    @cached_property
    def freq(self) -> DataFrame:
        """Frequencies after NULL -> 'Unknown' (merged with literal 'Unknown')."""
        fr = self.freq_raw
        keep = fr.where(F.col("value").isNotNull() & (F.col("value") != UNKNOWN_TEXT))
        unk = (
            fr.where(F.col("value").isNull() | (F.col("value") == UNKNOWN_TEXT))
            .groupBy("pos")
            .agg(F.sum("count").alias("count"))
            .select("pos", F.lit(UNKNOWN_TEXT).alias("value"), "count")
        )
        return keep.unionByName(unk)

    def _wide_values(self, top: DataFrame) -> DataFrame:
        """``top`` (pos, rank, value, count) with the digests' texts: the few digests are
        looked up in the columns that hold them, all columns in one scan."""
        held = top.where(F.length("value") > WIDE_TEXT).select("pos", "value").collect()  # k per column
        if not held:
            return top
        cells = []
        for pos in sorted({r["pos"] for r in held}):
            c, keys = qcol(self.categorical[pos]), [r["value"] for r in held if r["pos"] == pos]
            digest = narrow_text(c)
            cells.append(F.when(digest.isin(keys), F.struct(F.lit(pos).alias("pos"), digest.alias("value"), c.alias("text"))))
        found = self.df.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).select("cell.*")
        texts = found.groupBy("pos", "value").agg(F.first("text").alias("text"))
        return top.join(F.broadcast(texts), ["pos", "value"], "left").withColumn("value", F.coalesce("text", "value")).drop("text")

    def _names(self, cols: list[str], name: str = "column") -> DataFrame:
        return F.broadcast(
            self.spark.createDataFrame(list(enumerate(cols)), f"pos int, {name} string")
        )

    def category_top(self, top: int = TOP_CATEGORIES) -> DataFrame:
        """Most frequent values per column; of equally frequent ones the first by text
        (long ones by digest) count."""
        w = Window.partitionBy("pos").orderBy(F.desc("count"), F.asc("value"))
        ranked = self.freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        total = self.rows
        return self._wide_values(ranked).join(self._names(self.categorical), "pos").select(
            "column",
            F.col("rank").cast("int").alias("rank"),
            "value",
            F.col("count").cast("long").alias("count"),
            (F.col("count") / F.lit(total) * 100 if total else F.lit(0.0)).cast("double").alias("percentage"),
        )

    def cardinality(self) -> DataFrame:
        per = self.freq.groupBy("pos").agg(F.count(F.lit(1)).alias("unique_count"))
        total = self.rows
        return per.join(self._names(self.categorical), "pos").select(
            "column",
            F.col("unique_count").cast("long").alias("unique_count"),
            F.lit(total).cast("long").alias("total_rows"),
            (F.col("unique_count") / F.lit(total) if total else F.lit(0.0)).cast("double").alias("unique_ratio"),
            (
                (F.col("unique_count") > F.lit(total * HIGH_CARDINALITY_SHARE)) if total else F.lit(False)
            ).alias("high_cardinality"),
        )

    @cached_property
    def high_cardinality_count(self) -> int:
        if not self.categorical:
            return 0
        return int(self.cardinality().where("high_cardinality").count())

    # ------------------------------------------------------------------ A8 / A9
    @cached_property
    def pairs(self) -> DataFrame:
        """(i, j, r) for numeric column positions i < j."""
        if len(self.numeric) < 2:
            return self.spark.createDataFrame([], "i int, j int, r double")
        m = [self.moments[c] for c in self.numeric]
        return self._persist(stats.pair_correlations(self.proj, [x.mean for x in m], [x.min == x.max for x in m]))

    def correlation_matrix(self, cols: list[str] | None = None) -> DataFrame:
        """Pearson r of every ordered pair, the diagonal included."""
        keep = [i for i, c in enumerate(self.numeric) if cols is None or c in cols] if len(self.numeric) >= 2 else []
        schema = "column_a string, column_b string, r double"
        if not keep:
            return self.spark.createDataFrame([], schema)
        p = self.pairs.where(F.col("i").isin(keep) & F.col("j").isin(keep))
        names = F.array(*[F.lit(c) for c in self.numeric])
        name = lambda c: F.element_at(names, F.col(c) + 1)
        upper = p.select(name("i").alias("column_a"), name("j").alias("column_b"), "r")
        lower = p.select(name("j").alias("column_a"), name("i").alias("column_b"), "r")
        own = [(self.numeric[i],) * 2 + (1.0 if (self.moments[self.numeric[i]].var or 0) > 0 else None,) for i in keep]
        return upper.unionByName(lower).unionByName(self.spark.createDataFrame(own, schema))

    def correlation_top(self, top: int = TOP_CORRELATION_PAIRS) -> DataFrame:
        """The strongest positive and negative pairs; ties by column position."""
        found = self.pairs.where(F.col("r") != 0)
        parts = []
        for direction, side, order in (("positive", F.col("r") > 0, F.desc("r")), ("negative", F.col("r") < 0, F.asc("r"))):
            best = found.where(side).orderBy(order, "i", "j").limit(top).collect()  # at most ``top`` rows
            parts += [(direction, k + 1, self.numeric[r["i"]], self.numeric[r["j"]], r["r"]) for k, r in enumerate(best)]
        return self.spark.createDataFrame(
            parts, "direction string, rank int, column_a string, column_b string, r double"
        )

    # ------------------------------------------------------------------ A10 / A11
    def shape_rows(self) -> list[tuple]:
        out = []
        for c in self.numeric:
            m = self.moments[c]
            s = m.skew
            if self.bin_summary.get(c, {}).get("bimodal"):
                cls = "bimodal"
            elif s > SKEW_SHAPE:
                cls = "right-skewed"
            elif s < -SKEW_SHAPE:
                cls = "left-skewed"
            else:
                cls = "normal"
            out.append((c, cls, float(s), bool(s > HIGH_SKEW or s < -HIGH_SKEW)))
        return out

    def shape_class(self) -> DataFrame:
        return self.spark.createDataFrame(
            self.shape_rows(), "column string, classification string, skewness double, high_skew boolean"
        )

    def bimodal_check(self) -> DataFrame:
        rows = [(c, bool(self.bin_summary.get(c, {}).get("bimodal", False))) for c in self.numeric]
        return self.spark.createDataFrame(rows, "column string, bimodal boolean")

    def histogram(self, cols: list[str] | None = None) -> DataFrame:
        """Auto-bin histogram, empty bins included: (column, bin, lo, hi, count)."""
        cols = cols if cols is not None else self.numeric
        idx = [i for i, c in enumerate(self.numeric) if c in cols and i in self.bin_specs]
        if not idx:
            return self.spark.createDataFrame([], "column string, bin int, lo double, hi double, count long")
        specs = [(i, self.numeric[i], s.first, s.last, s.k, s.step) for i, s in self.bin_specs.items() if i in idx]
        sdf = self.spark.createDataFrame(specs, "pos int, column string, first double, last double, k int, step double")
        # every bin 1..k, generated distributed from the specs (k grows ~ sqrt(rows))
        all_bins = sdf.select("pos", "column", "first", "last", "k", "step", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("bin"))
        counts = self.bins.select("pos", "bin", "count")
        edge_lo = (F.col("bin") - 1).cast("double") * F.col("step") + F.col("first")
        edge_hi = F.when(F.col("bin") == F.col("k"), F.col("last")).otherwise(
            F.col("bin").cast("double") * F.col("step") + F.col("first")
        )
        return all_bins.join(counts, ["pos", "bin"], "left").select(
            "column",
            F.col("bin").cast("int").alias("bin"),
            edge_lo.alias("lo"),
            edge_hi.alias("hi"),
            F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        )

    # ------------------------------------------------------------------ A12-A14
    @cached_property
    def series_columns(self) -> tuple[str | None, str | None]:
        if not self.datetime or not self.numeric:
            return None, None
        counts = self.df.agg(*[F.count(qcol(c)).alias(f"d{i}") for i, c in enumerate(self.datetime)]).collect()[0]
        best_d = max(range(len(self.datetime)), key=lambda i: (counts[f"d{i}"], -i))
        best_v = None
        for i, c in enumerate(self.numeric):
            v = self.moments[c].var
            if v is None or v != v:
                continue
            if best_v is None or v > self.moments[self.numeric[best_v]].var:
                best_v = i
        return self.datetime[best_d], (self.numeric[best_v] if best_v is not None else None)

    @cached_property
    def _monthly(self) -> DataFrame:
        d, v = self.series_columns
        if d is None or v is None:
            return self.spark.createDataFrame([], "period string, value double")
        x = stats.numeric_value(self.df, v)
        return self._persist(
            self.df.select(qcol(d).alias("d"), x.alias("x"))
            .where(F.col("d").isNotNull() & F.col("x").isNotNull())
            .groupBy(F.date_format("d", "yyyy-MM").alias("period"))
            .agg(F.avg("x").alias("value"))
        )

    def monthly_mean(self) -> DataFrame:
        """Mean of the series per month with rows; one row per month, kept for all uses."""
        return self._monthly

    def trend(self) -> DataFrame:
        d, v = self.series_columns
        schema = "date_column string, value_column string, detected boolean, months long, trend_direction string, slope double"
        if d is None or v is None:
            return self.spark.createDataFrame([(d, v, False, 0, None, None)], schema)
        m = self.monthly_mean()
        # months are few (one row per calendar month): ordinal by a global window
        idx = m.withColumn("i", (F.row_number().over(Window.orderBy("period")) - 1).cast("double"))
        agg = idx.agg(
            F.count(F.lit(1)).alias("months"),
            F.regr_slope("value", "i").alias("slope"),
            F.avg("value").alias("mean"),
        )
        slope = F.when(F.col("months") >= 2, F.col("slope")).otherwise(F.lit(0.0))
        base = F.greatest(F.abs(F.col("mean")), F.lit(1.0))
        direction = (
            F.when(F.col("months") < 2, F.lit("flat"))
            .when(F.col("slope") > base * TREND_SHARE, F.lit("increasing"))
            .when(F.col("slope") < base * -TREND_SHARE, F.lit("decreasing"))
            .otherwise(F.lit("flat"))
        )
        return agg.select(
            F.lit(d).alias("date_column"),
            F.lit(v).alias("value_column"),
            (F.col("months") > 0).alias("detected"),
            F.col("months").cast("long").alias("months"),
            F.when(F.col("months") > 0, direction).alias("trend_direction"),
            F.when(F.col("months") > 0, slope).alias("slope"),
        )

    def pick_series(self) -> DataFrame:
        d, v = self.series_columns
        return self.spark.createDataFrame([(d, v)], "date_column string, value_column string")


def analysis_sections(a: Analysis) -> dict[str, DataFrame]:
    """Every section of an analysis as a DataFrame."""
    return {
        "column_types": a.column_types(),
        "overview": a.overview(),
        "descriptive_stats": a.describe_numeric(),
        "categorical_top": a.category_top(),
        "cardinality": a.cardinality(),
        "correlation_matrix": a.correlation_matrix(),
        "correlation_top": a.correlation_top(),
        "distribution": a.shape_class(),
        "outlier_ranking": a.outlier_ranking(),
        "monthly": a.monthly_mean(),
        "trend": a.trend(),
    }


def analyze(df: DataFrame, exact: bool = True) -> dict[str, DataFrame]:
    """Whole analysis of a table."""
    return analysis_sections(Analysis(df, exact=exact))
