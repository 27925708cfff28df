"""Column expressions (built-in Spark SQL functions only, so they stay in codegen)."""

from scrubspark.functions.text import (
    DATE_HINT_PATTERN,
    coerce_numeric_text,
    date_hint,
    normalize_header_expr,
    normalize_headers,
    strip_text,
)
from scrubspark.functions.dates import DATE_FORMATS, parse_date
from scrubspark.functions.jsonsafe import json_safe_columns, lenient_json
from scrubspark.functions.numbers import format_number, safe_number

__all__ = [
    "DATE_HINT_PATTERN",
    "DATE_FORMATS",
    "coerce_numeric_text",
    "date_hint",
    "normalize_header_expr",
    "normalize_headers",
    "strip_text",
    "parse_date",
    "json_safe_columns",
    "lenient_json",
    "format_number",
    "safe_number",
]
