"""JSON-safe projections and lenient JSON extraction from free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubspark.functions.text import strip_text


def json_safe_columns(df: DataFrame) -> list[Column]:
    """NaN / +-inf -> NULL, timestamps and dates -> ISO text; rest unchanged."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return out


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, NaN and inf written as null."""
    return df.select(F.to_json(F.struct(*json_safe_columns(df))).alias("json"))


def defence(text: Column) -> Column:
    """Trim, drop a leading ```/```json fence and a trailing ``` fence."""
    t = strip_text(text)
    t = F.regexp_replace(t, r"(?i)^```(?:json)?", "")
    t = strip_text(t)
    t = F.regexp_replace(t, r"```$", "")
    return strip_text(t)


def lenient_json(text: Column) -> Column:
    """VARIANT of the whole (de-fenced) text if it parses, else of the greedy
    ``{...}`` span inside it; NULL when neither parses."""
    t = defence(text)
    return F.coalesce(
        F.try_parse_json(t),
        F.try_parse_json(F.regexp_extract(t, r"(?s)(\{.*\})", 1)),
    )


def is_json_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
