"""Log-line expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's): error patterns, matched case-insensitively.
ERROR_PATTERNS = ["ERROR", "Exception", "Error:", "Failed", "Traceback", "Critical"]

TIMESTAMP_PATTERN = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"


def line_timestamp(line: str = "line") -> Column:
    """first ``YYYY-MM-DD HH:MM:SS`` in the line as a timestamp; null if absent/unparsable."""
    text = F.regexp_extract(F.col(line), TIMESTAMP_PATTERN, 1)
    return F.when(text == "", F.lit(None).cast("timestamp_ntz")).otherwise(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def within_age(ts: Column, as_of: Column, hours: int = 24) -> Column:
    """keep lines without a timestamp, or not older than ``as_of - hours``."""
    return ts.isNull() | (ts >= as_of - F.make_interval(hours=F.lit(hours)))


def error_pattern() -> str:
    return "(?i)" + "|".join(_escape(p) for p in ERROR_PATTERNS)


def _escape(p: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in p)


def is_error_line(line: str = "line") -> Column:
    """any error pattern matches, ignoring case."""
    return F.col(line).rlike(error_pattern())
