"""Date parsing: one format per column, chosen by the most successful parses."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: candidate formats with the shape of their text, in tie-break order ---
DATE_SHAPES = {
    "yyyy-M-d": r"\d{4}-\d{1,2}-\d{1,2}",
    "yyyy-M-d H:m:s": r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}",
    "yyyy-M-d'T'H:m:s": r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}",
    "yyyy-M-d H:m": r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}",
    "M/d/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "d/M/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "yyyy/M/d": r"\d{4}/\d{1,2}/\d{1,2}",
    "M/d/yyyy H:m:s": r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}",
    "d.M.yyyy": r"\d{1,2}\.\d{1,2}\.\d{4}",
    "yyyy.M.d": r"\d{4}\.\d{1,2}\.\d{1,2}",
    "MMM d, yyyy": r"[A-Za-z]{3} \d{1,2}, \d{4}",
    "MMMM d, yyyy": r"[A-Za-z]{3,9} \d{1,2}, \d{4}",
    "d MMM yyyy": r"\d{1,2} [A-Za-z]{3} \d{4}",
    "d MMMM yyyy": r"\d{1,2} [A-Za-z]{3,9} \d{4}",
    "M/d/yy": r"\d{1,2}/\d{1,2}/\d{2}",
    "M-d-yyyy": r"\d{1,2}-\d{1,2}-\d{4}",
    # fractions of a second, time zones (read as UTC instants), other common forms
    "yyyy-M-d H:m:s.SSSSSSSSS": r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,9}",
    "yyyy-M-d'T'H:m:s.SSSSSSSSS": r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,9}",
    "yyyy-M-d'T'H:m:s[.SSSSSSSSS]XXX": r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2})",
    "yyyy-M-d H:m:s[.SSSSSSSSS]XXX": r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2})",
    "M/d/yyyy H:m": r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}",
    "d/M/yyyy H:m": r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}",
    "d/M/yyyy H:m:s": r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}",
    "d-MMM-yyyy": r"\d{1,2}-[A-Za-z]{3}-\d{4}",
    "MMM d yyyy": r"[A-Za-z]{3} \d{1,2} \d{4}",
    "MMMM d yyyy": r"[A-Za-z]{3,9} \d{1,2} \d{4}",
}
DATE_FORMATS = list(DATE_SHAPES)
# -----------------------------------------------------------------------------


def parse_date(c: Column | str, fmt: str) -> Column:
    """Text -> timestamp with one pattern; anything else -> NULL.

    Only text of the format's shape is handed to the parser: a failed parse costs many
    times a failed match. Month names are read in any case."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    shape, text = DATE_SHAPES.get(fmt), c
    if "MMM" in fmt:  # initcap capitalises after blanks
        text, fmt = F.initcap(F.replace(c, F.lit("-"), F.lit(" "))), fmt.replace("-", " ")
    parsed = F.try_to_timestamp(text, F.lit(fmt))
    return F.when(c.rlike(f"^(?:{shape})$"), parsed) if shape else parsed


#: Bytes of text above which no value has a known shape.
DATE_BYTES = 40


def folded_shape(c: Column) -> Column:
    """Text of a known date shape with digits as ``9`` and letters as ``a``; else NULL.

    The folded texts of a column are few (a few thousand at most), whatever its values."""
    known = "|".join(dict.fromkeys(DATE_SHAPES.values()))
    letters, digits = string.ascii_letters, string.digits
    folded = F.translate(c, letters + digits, "a" * len(letters) + "9" * len(digits))
    return F.when((F.octet_length(c) <= DATE_BYTES) & c.rlike(f"^(?:{known})$"), folded)


def formats_of_shapes(folded: list[str], formats: list[str]) -> list[str]:
    """Those of ``formats`` that some text of these shapes may have, in their order.
    A format without a known shape is always among them."""
    out = []
    for fmt in formats:
        shape = DATE_SHAPES.get(fmt)
        # letters that a shape names are folded in the texts as well
        if shape is None or any(re.match(f"(?:{re.sub('[TZ]', 'a', shape.replace('A-Za-z', 'a'))})$", text) for text in folded):
            out.append(fmt)
    return out
