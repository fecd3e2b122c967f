"""Incremental log monitoring (ST1-ST3).

The stream's source (``skuflow.sources.log_files``) has a position in each log file as its offset, so
Spark's checkpoint is the table of last positions: each run of ``trigger(availableNow=True)`` reads what
was appended since the previous run, and truncated or rotated files from their start. Late lines are
bounded by a watermark so windowed state stays finite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.functions.logs import is_error_line, line_timestamp, within_age
from skuflow.functions.text import py_strip
from skuflow.operators.logs import LOG_ORDER, error_digest
from skuflow.sources.log_files import stream_new_lines


def log_stream(spark: SparkSession, root: str, places: bool = False) -> DataFrame:
    """Streaming lines (with ``places`` also their file and position) of ``<root>/log_name=<name>/*``."""
    lines = stream_new_lines(spark, root)
    return lines if places else lines.select("log_name", "line")


def error_stream(lines: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """ST1: F18-F20 on a stream (age cut-off against a fixed ``as_of``, kept explicit for replay)."""
    ts = line_timestamp("line")
    return (lines.withColumn("ts", ts)
            .filter(within_age(F.col("ts"), F.lit(as_of).cast("timestamp_ntz"), hours) & is_error_line("line"))
            .withColumn("line", py_strip("line")))


def run_error_monitor(spark: SparkSession, root: str, sink: str, checkpoint: str, as_of: str,
                      hours: int = 24) -> None:
    """ST1: append new error lines to a Parquet table; offsets live in ``checkpoint``."""
    q = (error_stream(log_stream(spark, root), as_of, hours).writeStream
         .format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def run_windowed_counts(spark: SparkSession, root: str, sink: str, checkpoint: str,
                        window: str = "1 hour", watermark: str = "2 hours") -> None:
    """ST2: error counts per (log, hourly window), emitted once the watermark closes a window.

    Lines without a timestamp have no event time and are not windowed (ST1
    still reports them).
    """
    lines = log_stream(spark, root)
    errs = (lines.withColumn("ts", line_timestamp("line")).filter(is_error_line("line") & F.col("ts").isNotNull())
            .withColumn("ts", F.col("ts").cast("timestamp")))
    counts = (errs.withWatermark("ts", watermark)
              .groupBy("log_name", F.window("ts", window).alias("w"))
              .agg(F.count(F.lit(1)).alias("errors"))
              .select("log_name", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      "errors"))
    q = (counts.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def run_digest(spark: SparkSession, root: str, sink: str, checkpoint: str, as_of: str,
               first: int = 10) -> None:
    """ST3: per micro-batch, the first ``first`` errors per log and the remainder count.

    Errors are taken in the order of file and position. Every batch overwrites its own
    ``batch_id=`` folder, so a replayed batch leaves one copy.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        error_digest(batch, first, LOG_ORDER).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    q = (error_stream(log_stream(spark, root, places=True), as_of).writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
