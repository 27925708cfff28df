"""CleanPlan: the per-column decisions of one cleaning run.

The plan is O(columns) and is produced by a few aggregate jobs; ``apply``
turns it into one lazy projection, so the cleaned table is never materialised
by the planner itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubspark.functions.dates import parse_date
from scrubspark.functions.text import UNKNOWN_TEXT, coerce_numeric_text
from scrubspark.operators.stats import qcol


@dataclass
class ColumnDecision:
    name: str
    new_name: str
    original_dtype: str
    text: bool = False
    stripped: int = 0
    conversion: str | None = None  # "datetime" | "numeric"
    date_format: str | None = None
    converted_dtype: str = ""
    fill: str | None = None  # "median" | "unknown"
    fill_value: float | int | Decimal | None = None
    nulls_filled: int = 0

    def transformations(self) -> list[str]:
        steps = []
        if self.stripped:
            steps.append(f"stripped whitespace from {self.stripped} values")
        if self.conversion == "datetime":
            steps.append("converted to datetime")
        if self.conversion == "numeric":
            steps.append("converted numeric text to number")
        if self.fill == "median" and self.nulls_filled:
            steps.append("filled numeric nulls with median")
        if self.fill == "unknown" and self.nulls_filled:
            steps.append(f'filled text nulls with "{UNKNOWN_TEXT}"')
        if self.new_name != self.name:
            steps.append(f'renamed column to "{self.new_name}"')
        return steps

    def converted(self, c: Column) -> Column:
        if self.conversion == "datetime":
            return parse_date(c, self.date_format)
        if self.conversion == "numeric":
            return coerce_numeric_text(c)
        return c

    def filled(self, c: Column) -> Column:
        if self.fill == "median" and self.nulls_filled:
            kind = self.converted_dtype
            c, v = c.cast(kind), F.lit(0 if self.fill_value is None else self.fill_value).cast(kind)
            return F.coalesce(F.when(~F.isnan(c), c) if kind in ("float", "double") else c, v)
        if self.fill == "unknown" and self.nulls_filled:
            return F.coalesce(c, F.lit(UNKNOWN_TEXT))
        return c


@dataclass
class CleanPlan:
    columns: list[ColumnDecision] = field(default_factory=list)
    rows_before: int = 0
    rows_after: int = 0
    raw_duplicate_rows: int = 0
    duplicates_removed: int = 0

    # ---------------------------------------------------------------- apply
    def convert(self, dedup: DataFrame) -> DataFrame:
        return dedup.select(*[d.converted(qcol(d.name)).alias(d.name) for d in self.columns])

    def fill(self, converted: DataFrame) -> DataFrame:
        return converted.select(*[d.filled(qcol(d.name)).alias(d.name) for d in self.columns])

    def rename(self, filled: DataFrame) -> DataFrame:
        return filled.select(*[qcol(d.name).alias(d.new_name) for d in self.columns])

    def apply(self, dedup: DataFrame) -> DataFrame:
        return self.rename(self.fill(self.convert(dedup)))

    # ---------------------------------------------------------------- reports
    @property
    def nulls_filled(self) -> int:
        return sum(d.nulls_filled for d in self.columns)

    @property
    def conversions(self) -> list[ColumnDecision]:
        return [d for d in self.columns if d.conversion]

    def cleaned_columns(self) -> list[ColumnDecision]:
        return [
            d
            for d in self.columns
            if d.transformations() or d.nulls_filled or d.original_dtype != d.converted_dtype
        ]

    def conversion_log(self, spark: SparkSession) -> DataFrame:
        # date conversions are logged before numeric ones, as they run first
        order = [d for d in self.columns if d.conversion == "datetime"]
        order += [d for d in self.columns if d.conversion == "numeric"]
        rows = [(d.new_name, d.original_dtype, d.converted_dtype, d.conversion) for d in order]
        return spark.createDataFrame(
            rows, "column string, original_dtype string, converted_dtype string, conversion string"
        )

    def change_log(self, spark: SparkSession, changed_only: bool = True) -> DataFrame:
        cols = self.cleaned_columns() if changed_only else self.columns
        rows = [
            (
                d.new_name,
                d.name,
                d.original_dtype,
                d.converted_dtype,
                d.nulls_filled,
                d.transformations(),
            )
            for d in cols
        ]
        return spark.createDataFrame(
            rows,
            "column string, original_column string, original_dtype string, converted_dtype string, "
            "nulls_filled long, transformations array<string>",
        )

    def nulls_by_column(self, spark: SparkSession) -> DataFrame:
        rows = [(d.new_name, d.nulls_filled) for d in self.columns]
        return spark.createDataFrame(rows, "column string, nulls_filled long")

    def summary(self, spark: SparkSession) -> DataFrame:
        row = (
            self.rows_before,
            self.rows_after,
            self.duplicates_removed,
            self.raw_duplicate_rows,
            self.nulls_filled,
            len(self.conversions),
            len(self.cleaned_columns()),
        )
        return spark.createDataFrame(
            [row],
            "rows_before long, rows_after long, duplicates_removed long, raw_duplicate_rows long, "
            "nulls_filled long, type_conversions long, columns_cleaned long",
        )
