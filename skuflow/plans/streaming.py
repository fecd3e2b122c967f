"""Streaming queries (ST1-ST7): each stream runs to completion (``availableNow``) from a
checkpoint in the shared folder, and its sink is returned as a batch DataFrame.
Where the sink content is deterministic it is checked against the batch twin's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skuflow.plans.feedback import AS_OF, _L_ERR, grown_logs
from skuflow.plans.registry import query, with_bases
from skuflow.session import scratch_path
from skuflow.sources.bases import Bases
from skuflow.sources.bids import chunk_count, stage_bids_json
from skuflow.streaming import extraction as sx
from skuflow.streaming import feedback as sf
from skuflow.streaming import logs as sl


def _stage_logs(spark, sf_dir, arrivals=(("app", "database"), ("retraining",))):
    """Log files land in two arrivals (some logs first, the rest later)."""
    root = scratch_path(spark, "logs-stream")
    lines = Bases(spark, sf_dir).logs().select("log_name", F.col("line").alias("value"))
    for names in arrivals:
        lines.filter(F.col("log_name").isin(*names)).write.mode("append").partitionBy("log_name").text(root)
        yield root


@query("ST1_incremental_log_monitor", with_bases("L") + f"SELECT log_name, line FROM ({_L_ERR}) e")
def st1_monitor(spark, sf_dir):
    """Three runs over one checkpoint, between which logs are appended to or begun anew."""
    sink, ck = scratch_path(spark, "st1-sink"), scratch_path(spark, "st1-ck")
    for root in grown_logs(spark, Bases(spark, sf_dir).logs()):
        sl.run_error_monitor(spark, root, sink, ck, AS_OF, 24)
    return spark.read.parquet(sink).select("log_name", "line")


@query("ST2_windowed_error_counts", with_bases("L") + """
, ER AS (SELECT log_name, ts FROM (SELECT *, CASE WHEN regexp_extract(line, '(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2})', 1) = '' THEN NULL
          ELSE try_strptime(regexp_extract(line, '(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2})', 1), '%Y-%m-%d %H:%M:%S') END AS ts FROM L) x
         WHERE ts IS NOT NULL AND regexp_matches(line, '(?i)(ERROR|Exception|Error:|Failed|Traceback|Critical)'))
, WM AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM ER)
SELECT log_name, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       CAST(count(*) AS BIGINT) AS errors
FROM ER GROUP BY 1, 2, 3 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT wm FROM WM)
""")
def st2_windows(spark, sf_dir):
    """Hourly error counts with a 2-hour watermark; open windows stay in state (not emitted)."""
    sink, ck = scratch_path(spark, "st2-sink"), scratch_path(spark, "st2-ck")
    root = None
    for root in _stage_logs(spark, sf_dir, arrivals=(("app", "database", "retraining"),)):
        pass
    sl.run_windowed_counts(spark, root, sink, ck, "1 hour", "2 hours")
    out = spark.read.parquet(sink)
    return out.select("log_name", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "errors")


@query("ST3_error_digest", with_bases("L") + f"""
SELECT log_name, CAST(count(*) AS BIGINT) AS total, CAST(greatest(count(*) - 10, 0) AS BIGINT) AS more,
       CAST(least(count(*), 10) AS BIGINT) AS shown
FROM ({_L_ERR}) e GROUP BY log_name
""")
def st3_digest(spark, sf_dir):
    sink, ck = scratch_path(spark, "st3-sink"), scratch_path(spark, "st3-ck")
    root = None
    for root in _stage_logs(spark, sf_dir, arrivals=(("app", "database", "retraining"),)):
        pass
    sl.run_digest(spark, root, sink, ck, AS_OF, 10)
    d = spark.read.parquet(sink)
    return d.groupBy("log_name", "total", "more").agg(F.count(F.lit(1)).alias("shown"))


def _raw_feedback(spark, sf_dir):
    """Intake records as JSON files: some lack required fields, some lack a timestamp."""
    e = Bases(spark, sf_dir).feedback()
    n = F.col("id").cast("long")
    raw = e.select(
        "id", F.when(n % 11 != 0, F.col("description")).alias("description"), "maker", "series",
        "model_year", "model_family", F.when(n % 13 != 0, F.col("predicted_sku")).alias("predicted_sku"),
        F.when(n % 17 != 0, F.col("is_correct")).alias("is_correct"), "correct_sku", "confidence",
        F.when(n % 7 != 0, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("timestamp"))
    path = scratch_path(spark, "feedback-intake")
    raw.write.json(path)
    return path


@query("ST4_feedback_intake_stream", with_bases("E") + """
, RAW AS (SELECT CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN NULL ELSE description END AS description,
                 CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN NULL ELSE predicted_sku END AS predicted_sku,
                 CASE WHEN CAST(id AS BIGINT) % 17 = 0 THEN NULL ELSE is_correct END AS is_correct FROM E)
SELECT CASE WHEN description IS NULL THEN 'missing_description'
            WHEN predicted_sku IS NULL THEN 'missing_predicted_sku'
            WHEN is_correct IS NULL THEN 'missing_is_correct' ELSE 'valid' END AS reason,
       CAST(count(*) AS BIGINT) AS n FROM RAW GROUP BY 1
""")
def st4_intake(spark, sf_dir):
    src = _raw_feedback(spark, sf_dir)
    table, rejects, ck = (scratch_path(spark, "fb-table"), scratch_path(spark, "fb-rejects"),
                          scratch_path(spark, "st4-ck"))
    sf.run_intake(spark, src, table, rejects, ck)
    ok = spark.read.parquet(table).groupBy(F.lit("valid").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    bad = spark.read.parquet(rejects).groupBy(F.col("reject_reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("n"))
    return ok.unionByName(bad)


def _feedback_table(spark, sf_dir, arrivals):
    """Feedback table written in arrivals (groups of makers); yields after each append."""
    e = Bases(spark, sf_dir).feedback()
    path = scratch_path(spark, "feedback-parquet")
    for makers in arrivals:
        e.filter(F.col("maker").isin(*makers)).write.mode("append").parquet(path)
        yield path, e.schema


@query("ST5_running_feedback_stats", with_bases("E") + """
SELECT CAST(count(*) AS BIGINT) AS total_count,
       CAST(count(*) FILTER (WHERE is_correct) AS BIGINT) AS correct_count,
       CAST(count(*) FILTER (WHERE NOT is_correct) AS BIGINT) AS incorrect_count,
       CAST(count(*) FILTER (WHERE NOT processed) AS BIGINT) AS unprocessed_count,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_correct) * 1.0 / count(*) ELSE 0.0 END, 6) AS accuracy_rate
FROM E
""")
def st5_stats(spark, sf_dir):
    path, schema = next(_feedback_table(spark, sf_dir, arrivals=[["Renault", "MAZDA", "ford", "Chevrolet"]]))
    out = sf.running_stats(spark, path, schema, "st5_" + uuid.uuid4().hex[:8])
    return out.select("total_count", "correct_count", "incorrect_count", "unprocessed_count",
                      F.round("accuracy_rate", 6).alias("accuracy_rate"))


@query("ST5_daily_accuracy_windows", with_bases("E") + """
, WM AS (SELECT max(timestamp) - INTERVAL 1 DAY AS wm FROM E)
SELECT date_trunc('day', timestamp) AS window_start, round(avg(CAST(is_correct AS DOUBLE)), 6) AS accuracy,
       CAST(count(*) AS BIGINT) AS n
FROM E GROUP BY 1 HAVING date_trunc('day', timestamp) + INTERVAL 1 DAY <= (SELECT wm FROM WM)
""")
def st5_daily(spark, sf_dir):
    path, schema = next(_feedback_table(spark, sf_dir, arrivals=[["Renault", "MAZDA", "ford", "Chevrolet"]]))
    sink, ck = scratch_path(spark, "st5-sink"), scratch_path(spark, "st5-ck")
    sf.run_daily_accuracy(spark, path, schema, sink, ck, "1 day")
    out = spark.read.parquet(sink)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.round("accuracy", 6).alias("accuracy"), "n")


@query("ST6_resumable_extraction", with_bases("B") + """
SELECT maker, series, model, referencia AS SKU, descripcion AS description FROM B
WHERE has_item AND referencia IS NOT NULL AND descripcion IS NOT NULL
""")
def st6_extraction(spark, sf_dir):
    """Bid chunks consumed a quarter per micro-batch (one file, if there are four); the checkpoint records committed chunks."""
    bids = Bases(spark, sf_dir).bids()
    chunks = stage_bids_json(bids, chunks=4)
    sink, ck = scratch_path(spark, "st6-sink"), scratch_path(spark, "st6-ck")
    sx.run_extraction(spark, chunks, sink, ck, max_files_per_trigger=-(-chunk_count(bids, 4) // 4))
    return spark.read.parquet(sink)


@query("ST7_unprocessed_consumption", with_bases("E") +
       "SELECT id, maker, predicted_sku FROM E WHERE NOT processed")
def st7_consumption(spark, sf_dir):
    """Feedback appended in two arrivals; each run consumes only the new files, once."""
    sink, ck = scratch_path(spark, "st7-sink"), scratch_path(spark, "st7-ck")
    for path, schema in _feedback_table(spark, sf_dir, arrivals=[["Renault", "MAZDA"], ["ford", "Chevrolet"]]):
        sf.run_consumption(spark, path, schema, sink, ck, "1 day")
    return spark.read.parquet(sink).select("id", "maker", "predicted_sku")

