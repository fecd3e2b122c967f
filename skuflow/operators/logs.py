"""Log error monitoring as batch operators (S10, A20, W8); streaming twins in ``skuflow.streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuflow.functions.logs import is_error_line, line_timestamp, within_age
from skuflow.functions.text import py_strip
from skuflow.sources.log_files import read_new_lines


LOG_ORDER = ("file", "position")


def read_logs(spark: SparkSession, root: str, positions: dict | None = None) -> tuple[DataFrame, dict]:
    """Lines of ``<root>/log_name=<name>/*`` written since ``positions`` (None: all), and the new positions.

    Rows are (log_name, line, file, position), ordered by ``LOG_ORDER``. A missing root has no lines.
    """
    return read_new_lines(spark, root, positions)


def error_lines(lines: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Recent (or undated) lines matching an error pattern, stripped."""
    as_of_col = F.lit(as_of).cast("timestamp_ntz") if not hasattr(as_of, "_jc") else as_of
    ts = line_timestamp("line")
    return (lines.withColumn("ts", ts)
            .filter(within_age(F.col("ts"), as_of_col, hours) & is_error_line("line"))
            .withColumn("line", py_strip("line")))


def error_counts(errors: DataFrame) -> DataFrame:
    """Errors per log plus the total (``rollup``: the total row has log_name null)."""
    return errors.rollup("log_name").agg(F.count(F.lit(1)).alias("errors"))


def error_digest(errors: DataFrame, first: int = 10, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """The first ``first`` errors per log and how many more there are.

    ``row_number() <= first`` runs as a WindowGroupLimit (only ``first`` rows
    per log leave each task); the per-log totals come from a separate
    aggregation rather than a count over the whole window partition.
    """
    w = Window.partitionBy("log_name").orderBy(*order)
    head = errors.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= first)
    totals = errors.groupBy("log_name").agg(F.count(F.lit(1)).alias("total"))
    return (head.join(totals, "log_name")
            .withColumn("more", F.greatest(F.col("total") - F.lit(first), F.lit(0)))
            .select("log_name", "rank", "line", "total", "more"))
