"""Resumable extraction of bid chunks (ST6).

The reference saves a partial CSV every 1000 bids and resumes from it after a
crash. A file stream over the chunk folder gives the same guarantee with
exactly-once file bookkeeping: the checkpoint records which chunk files were
committed, so a restarted run continues with the unprocessed ones.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from skuflow.operators.flatten import correlation_extract
from skuflow.schemas import BID


def run_extraction(spark: SparkSession, chunks: str, sink: str, checkpoint: str,
                   max_files_per_trigger: int | None = None) -> None:
    """ST6: JSON-lines bid chunks -> P13 correlation rows -> Parquet, resumable via the checkpoint."""
    reader = spark.readStream.schema(BID)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = correlation_extract(reader.json(chunks))
    q = (rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
