"""Feedback intake and consumption as streams (ST4, ST5, ST7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.operators.feedback import accepted, feedback_stats, unprocessed, validate_feedback

RAW_FEEDBACK = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("maker", T.StringType()),
    T.StructField("series", T.StringType()),
    T.StructField("model_year", T.StringType()),
    T.StructField("model_family", T.StringType()),
    T.StructField("predicted_sku", T.StringType()),
    T.StructField("is_correct", T.BooleanType()),
    T.StructField("correct_sku", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("timestamp", T.StringType()),
])


def run_intake(spark: SparkSession, source: str, table: str, rejects: str, checkpoint: str) -> None:
    """ST4: JSON feedback files -> validation (P20) -> feedback table + rejects table.

    One ``foreachBatch`` writes both outputs from the same validated batch, each into the batch's
    own ``batch_id=`` folder, so a replayed batch overwrites itself.
    """
    raw = spark.readStream.schema(RAW_FEEDBACK).json(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        v = validate_feedback(batch).cache()
        accepted(v).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")
        v.filter(F.col("reject_reason").isNotNull()).write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
        v.unpersist()

    q = (raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def running_stats(spark: SparkSession, table: str, schema: T.StructType, name: str) -> DataFrame:
    """ST5: running feedback statistics (complete mode: one row of state) into a memory table."""
    stream = spark.readStream.schema(schema).parquet(table)
    q = (feedback_stats(stream).writeStream.format("memory").queryName(name).outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def run_daily_accuracy(spark: SparkSession, table: str, schema: T.StructType, sink: str, checkpoint: str,
                       watermark: str = "1 day") -> None:
    """ST5/R8: daily accuracy windows emitted in append mode once the watermark passes."""
    stream = spark.readStream.schema(schema).parquet(table)
    ts = F.col("timestamp").cast("timestamp")
    agg = (stream.withColumn("ts", ts).withWatermark("ts", watermark)
           .groupBy(F.window("ts", "1 day").alias("w"))
           .agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
           .select(F.col("w.start").alias("window_start"), "accuracy", "n"))
    q = (agg.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def run_consumption(spark: SparkSession, table: str, schema: T.StructType, sink: str, checkpoint: str,
                    watermark: str = "1 day") -> None:
    """ST7: unprocessed feedback consumed exactly once into the retraining table.

    The stream's checkpoint replaces the ``processed`` flag: every run picks
    up only files appended since the last one. Repeated submissions of an id
    are dropped within ``watermark`` of *ingestion* time: feedback timestamps
    are client clocks in any order, so an event-time watermark would discard
    old-but-new feedback as late, which must never happen here.
    """
    stream = spark.readStream.schema(schema).parquet(table)
    rows = (unprocessed(stream).withColumn("ingest_ts", F.current_timestamp())
            .withWatermark("ingest_ts", watermark).dropDuplicatesWithinWatermark(["id"]).drop("ingest_ts"))
    q = (rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
