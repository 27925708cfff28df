"""Number formatting helpers for report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_number(c: Column | str, fractional: bool = True) -> Column:
    """Floats with 3 decimals, integers as they are, NULL as ``N/A``."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.format_string("%.3f", c.cast("double")) if fractional else c.cast("string")
    return F.when(c.isNull(), F.lit("N/A")).otherwise(text)  # formatted, a null would be text


def safe_number(*cols: Column | str) -> Column:
    """First value that reads as a finite-or-infinite number (not NaN); else 0."""
    parts = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        d = c.cast("string").try_cast("double")
        parts.append(F.when(~F.isnan(d), d))
    return F.coalesce(*parts, F.lit(0.0))
