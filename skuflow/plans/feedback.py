"""Queries over the feedback (E), retraining-history (H) and log (L) bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.functions.logs import ERROR_PATTERNS, is_error_line, line_timestamp
from skuflow.operators import feedback as fb
from skuflow.operators import flatten as fl
from skuflow.operators import logs as lg
from skuflow.plans import sqltext as q
from skuflow.plans.registry import query, with_bases
from skuflow.session import scratch_path
from skuflow.sinks import versions
from skuflow.sources.bases import Bases

R = 6
AS_OF = "2024-01-31 00:00:00"  # log monitor's "now" for the L basis (data spans 2024-01-01..30)
SNAPSHOT_OLD, SNAPSHOT_NEW = "2024-01-30T00:00:00", "2024-01-31T00:00:00"


def _e(spark, sf_dir):
    return Bases(spark, sf_dir).feedback()


def _rnd(c):
    return F.round(F.col(c), R).alias(c)


_USABLE = """CASE WHEN is_correct THEN predicted_sku
                  WHEN NOT is_correct AND correct_sku IS NOT NULL AND correct_sku <> '' THEN correct_sku END"""
_R1 = f"""SELECT maker, series, model_year AS model, description AS descripcion, {_USABLE} AS referencia, id
FROM E WHERE ({_USABLE}) IS NOT NULL"""


@query("S9_unprocessed_feedback", with_bases("E") +
       "SELECT id, description, maker, predicted_sku, is_correct, correct_sku FROM E WHERE NOT processed")
def s9_unprocessed(spark, sf_dir):
    return fb.unprocessed(_e(spark, sf_dir)).select("id", "description", "maker", "predicted_sku",
                                                    "is_correct", "correct_sku")


@query("A14_feedback_stats", with_bases("E") + """
SELECT CAST(count(*) AS BIGINT) AS total_count,
       CAST(count(*) FILTER (WHERE is_correct) AS BIGINT) AS correct_count,
       CAST(count(*) FILTER (WHERE NOT is_correct) AS BIGINT) AS incorrect_count,
       CAST(count(*) FILTER (WHERE NOT processed) AS BIGINT) AS unprocessed_count,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_correct) * 1.0 / count(*) ELSE 0.0 END, 6) AS accuracy_rate
FROM E
""")
def a14_stats(spark, sf_dir):
    s = fb.feedback_stats(_e(spark, sf_dir))
    return s.select("total_count", "correct_count", "incorrect_count", "unprocessed_count", _rnd("accuracy_rate"))


@query("T3_recent_feedback", with_bases("E") +
       "SELECT id, timestamp, predicted_sku, is_correct FROM E ORDER BY timestamp DESC, id DESC LIMIT 10")
def t3_recent(spark, sf_dir):
    return fb.recent_feedback(_e(spark, sf_dir), 10).select("id", "timestamp", "predicted_sku", "is_correct")


@query("R1_feedback_training_rows", with_bases("E") + f"SELECT maker, series, model, descripcion, referencia FROM ({_R1}) r")
def r1_rows(spark, sf_dir):
    return fb.feedback_training_rows(_e(spark, sf_dir))


@query("R2_maker_scoped_feedback", with_bases("E") +
       f"SELECT maker, series, model, descripcion, referencia FROM ({_R1}) r WHERE lower(maker) = 'renault'")
def r2_scoped(spark, sf_dir):
    return fb.feedback_training_rows(_e(spark, sf_dir), "renault")


_R3_ORIG = f"""SELECT {q.clean_text("coalesce(maker, '')")} AS maker, {q.clean_text("coalesce(series, '')")} AS series,
       {q.clean_text("coalesce(model, '')")} AS model, {q.clean_text("coalesce(descripcion, '')")} AS descripcion, referencia
FROM P11"""
_R3_FB = f"""SELECT {q.clean_text("coalesce(maker, '')")} AS maker, {q.clean_text("coalesce(series, '')")} AS series,
       {q.clean_text("coalesce(model, '')")} AS model, {q.clean_text("coalesce(descripcion, '')")} AS descripcion, referencia
FROM ({_R1}) r"""


@query("U2_union_original_feedback", with_bases("P11", "E") + f"""
SELECT 'original' AS source, CAST(count(*) AS BIGINT) AS n FROM P11
UNION ALL SELECT 'feedback', CAST(count(*) AS BIGINT) FROM ({_R1}) r
""")
def u2_union(spark, sf_dir):
    b = Bases(spark, sf_dir)
    orig = fl.flatten_v3(b.bids()).withColumn("source", F.lit("original"))
    rows = fb.feedback_training_rows(b.feedback()).withColumn("source", F.lit("feedback"))
    return orig.unionByName(rows).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("R3_retraining_set", with_bases("P11", "E") + f"""
, C3 AS ({_R3_ORIG} UNION ALL {_R3_FB})
, SEL AS (SELECT referencia FROM C3 GROUP BY referencia HAVING count(*) >= 10 ORDER BY count(*) DESC, referencia LIMIT 50)
SELECT maker, series, model, descripcion, referencia FROM C3 WHERE referencia IN (SELECT referencia FROM SEL)
""")
def r3_retraining_set(spark, sf_dir):
    b = Bases(spark, sf_dir)
    return fb.retraining_set(fl.flatten_v3(b.bids()), b.feedback(), None, 10, 50)


@query("J7_mark_processed", with_bases("E") + f"""
, USED AS (SELECT id FROM E WHERE NOT processed AND lower(maker) = 'renault' AND ({_USABLE}) IS NOT NULL)
SELECT id, processed OR id IN (SELECT id FROM USED) AS processed FROM E
""")
def j7_mark(spark, sf_dir):
    e = _e(spark, sf_dir)
    return fb.persist_processed(e, fb.consumed_ids(e, "renault", "used"),
                                scratch_path(spark, "feedback-marked")).select("id", "processed")


@query("R6_consume_feedback_all", with_bases("E") + f"""
, ANYU AS (SELECT count(*) > 0 AS any_usable FROM E
           WHERE NOT processed AND lower(maker) = 'renault' AND ({_USABLE}) IS NOT NULL)
SELECT id, processed OR ((SELECT any_usable FROM ANYU) AND NOT processed) AS processed FROM E
""")
def r6_consume_all(spark, sf_dir):
    e = _e(spark, sf_dir)
    return fb.mark_processed(e, fb.consumed_ids(e, "renault", "all")).select("id", "processed")


@query("R8_accuracy_over_time", with_bases("E") + """
SELECT date_trunc('day', timestamp) AS window_start, round(avg(CAST(is_correct AS DOUBLE)), 6) AS accuracy,
       CAST(count(*) AS BIGINT) AS n FROM E GROUP BY 1
""")
def r8_over_time(spark, sf_dir):
    r = fb.accuracy_over_time(_e(spark, sf_dir), "1 day")
    return r.select("window_start", _rnd("accuracy"), "n")


@query("F23_feedback_display", with_bases("E") + """
SELECT id, CASE WHEN is_correct THEN '-' ELSE coalesce(correct_sku, 'Not provided') END AS correction_display FROM E
""")
def f23_display(spark, sf_dir):
    return fb.display_value(_e(spark, sf_dir)).select("id", "correction_display")


_SEL = """CASE WHEN is_correct THEN predicted_sku ELSE correct_sku END"""
_MAN = """CASE WHEN NOT is_correct AND correct_sku IS NULL THEN 'MANUAL-' || id END"""


@query("F24_feedback_from_selection", with_bases("E") + f"""
, S AS (SELECT id, predicted_sku AS top, {_SEL} AS selected, {_MAN} AS manual FROM E)
, CH AS (SELECT *, coalesce(CASE WHEN manual IS NOT NULL AND manual <> '' THEN manual END, selected) AS chosen FROM S)
SELECT id, coalesce(chosen = top, false) AS is_correct,
       CASE WHEN NOT coalesce(chosen = top, false) THEN chosen END AS correct_sku FROM CH
""")
def f24_selection(spark, sf_dir):
    e = _e(spark, sf_dir)
    s = e.select("id", F.col("predicted_sku").alias("top"),
                 F.when(F.col("is_correct"), F.col("predicted_sku")).otherwise(F.col("correct_sku")).alias("selected"),
                 F.when(~F.col("is_correct") & F.col("correct_sku").isNull(),
                        F.concat(F.lit("MANUAL-"), F.col("id"))).alias("manual"))
    is_correct, correct_sku = fb.feedback_from_selection("top", "selected", "manual")
    return s.select("id", is_correct.alias("is_correct"), correct_sku.alias("correct_sku"))


@query("F25_iso_timestamp", with_bases("E") +
       "SELECT id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM E")
def f25_iso(spark, sf_dir):
    return _e(spark, sf_dir).select("id", fb.iso_timestamp("timestamp").alias("iso"))


@query("P20_feedback_validation", with_bases("E") + """
, RAW AS (SELECT CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN NULL ELSE description END AS description,
                 CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN NULL ELSE predicted_sku END AS predicted_sku,
                 CASE WHEN CAST(id AS BIGINT) % 17 = 0 THEN NULL ELSE is_correct END AS is_correct FROM E)
SELECT CASE WHEN description IS NULL THEN 'missing_description'
            WHEN predicted_sku IS NULL THEN 'missing_predicted_sku'
            WHEN is_correct IS NULL THEN 'missing_is_correct' ELSE 'valid' END AS reason,
       CAST(count(*) AS BIGINT) AS n FROM RAW GROUP BY 1
""")
def p20_validation(spark, sf_dir):
    """Raw intake records (JSON text, some fields absent) parsed and validated."""
    e = _e(spark, sf_dir)
    n = F.col("id").cast("long")
    raw = e.select(F.to_json(F.struct(
        F.when(n % 11 != 0, F.col("description")).alias("description"),
        "maker", "series", "model_year",
        F.when(n % 13 != 0, F.col("predicted_sku")).alias("predicted_sku"),
        F.when(n % 17 != 0, F.col("is_correct")).alias("is_correct"),
        "correct_sku", "confidence")).alias("value"))
    parsed = raw.select(F.from_json("value", "description string, maker string, series string, "
                                    "model_year string, predicted_sku string, is_correct boolean, "
                                    "correct_sku string, confidence double, timestamp string").alias("r")
                        ).select("r.*")
    v = fb.validate_feedback(parsed)
    return v.groupBy(F.coalesce("reject_reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("K11_feedback_append", with_bases("E") + """
SELECT id, is_correct, maker, confidence, false AS processed FROM (
  SELECT id, is_correct, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN '' ELSE maker END AS maker,
         CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN 0.0 ELSE round(confidence, 6) END AS confidence
  FROM E WHERE CAST(id AS BIGINT) % 11 <> 0 AND CAST(id AS BIGINT) % 13 <> 0) v
UNION ALL SELECT id, is_correct, '', 0.0, false FROM E WHERE CAST(id AS BIGINT) % 3 = 0
""")
def k11_append(spark, sf_dir):
    """Two batches of raw feedback, validated, defaulted and appended to one table, read back."""
    path = scratch_path(spark, "feedback-table")
    e = _e(spark, sf_dir)
    n = F.col("id").cast("long")
    first = e.drop("processed").withColumns({
        "description": F.when(n % 11 != 0, F.col("description")),
        "predicted_sku": F.when(n % 13 != 0, F.col("predicted_sku")),
        "maker": F.when(n % 5 != 0, F.col("maker")),
        "confidence": F.when(n % 7 != 0, F.col("confidence"))})
    second = e.filter(n % 3 == 0).select("id", "description", "predicted_sku", "is_correct", "correct_sku",
                                         F.lit(None).cast("string").alias("maker"),
                                         F.lit(None).cast("double").alias("confidence"), "timestamp")
    for batch in (first, second):
        fb.accepted(fb.validate_feedback(batch)).write.mode("append").parquet(path)
    return spark.read.schema("id string, is_correct boolean, maker string, confidence double, processed boolean"
                             ).parquet(path).withColumn("confidence", F.round("confidence", 6))


def _snapshots(spark, sf_dir):
    return spark.read.parquet(_snapshot_root(spark, sf_dir))


def _snapshot_root(spark, sf_dir):
    e = _e(spark, sf_dir)
    root = scratch_path(spark, "feedback-snapshots")
    fb.write_snapshot(e, root, SNAPSHOT_OLD)
    fb.write_snapshot(fb.mark_processed(e, fb.consumed_ids(e, "renault")), root, SNAPSHOT_NEW)
    return root


@query("A22_snapshot_listing", with_bases("E") + f"""
SELECT '{SNAPSHOT_OLD}' AS snapshot_ts, CAST(count(*) AS BIGINT) AS rows FROM E
UNION ALL SELECT '{SNAPSHOT_NEW}', CAST(count(*) AS BIGINT) FROM E
""")
def a22_listing(spark, sf_dir):
    return fb.list_snapshots(_snapshots(spark, sf_dir))


@query("W9_keep_newest_snapshots", with_bases("E") + f"""
SELECT '{SNAPSHOT_NEW}' AS snapshot_ts, CAST(count(*) AS BIGINT) AS rows, CAST(1 AS INTEGER) AS rank FROM E
""")
def w9_retained(spark, sf_dir):
    """Older versions are removed; what is left is listed from the folder itself."""
    root = _snapshot_root(spark, sf_dir)
    fb.prune_snapshots(spark, root, keep=1)
    return fb.retained_snapshots(fb.list_snapshots(spark.read.parquet(root).withColumn(
        "snapshot_ts", F.col("snapshot_ts").cast("string"))), keep=10)


@query("K14_restore_snapshot", with_bases("E") + "SELECT id, processed FROM E")
def k14_restore(spark, sf_dir):
    return fb.restore_snapshot(_snapshots(spark, sf_dir), SNAPSHOT_OLD,
                               scratch_path(spark, "feedback-restored")).select("id", "processed")


@query("K14_flag_versions", with_bases("E") + f"""
, F1 AS (SELECT id, processed OR (lower(maker) = 'renault' AND ({_USABLE}) IS NOT NULL) AS processed, maker, timestamp FROM E
         WHERE CAST(id AS BIGINT) % 5 <> 0)
, F3 AS (SELECT id, processed, maker, timestamp FROM F1 UNION ALL
         SELECT id, processed, maker, timestamp FROM E WHERE CAST(id AS BIGINT) % 5 = 0)
SELECT * FROM (
  SELECT 0 AS version, 'create' AS action, count(*) AS rows, count(*) FILTER (NOT processed) AS unprocessed
  FROM E WHERE CAST(id AS BIGINT) % 5 <> 0
  UNION ALL SELECT 1, 'flag', count(*), count(*) FILTER (NOT processed) FROM F1
  UNION ALL SELECT 2, 'append', count(*), count(*) FILTER (NOT processed) FROM F3
  UNION ALL SELECT 3, 'remove', count(*), count(*) FILTER (NOT processed) FROM F3 WHERE NOT lower(maker) = 'ford'
  UNION ALL SELECT 4, 'compact', count(*), count(*) FILTER (NOT processed) FROM F3 WHERE NOT lower(maker) = 'ford'
  UNION ALL SELECT 5, 'restore 2', count(*), count(*) FILTER (NOT processed) FROM F3) v WHERE version >= 1
""")
def k14_flag_versions(spark, sf_dir):
    """Rows flagged, appended, removed, compacted and an old version restored; the newest five versions stay."""
    e = _e(spark, sf_dir)
    first = F.col("id").cast("long") % 5 != 0
    root = scratch_path(spark, "feedback-versions")
    base = versions.create(e.filter(first), root)
    versions.flag(fb.consumed_ids(versions.read(spark, root, base), "renault"), root, at=base)
    versions.append(e.filter(~first), root)
    versions.remove(e.filter(F.lower("maker") == "ford"), root)
    versions.compact(spark, root)
    versions.restore(spark, root, 2)
    versions.prune(spark, root, keep=5)
    return versions.history(spark, root)


# ----------------------------------------------------------------------------- history (H)
@query("R7_history_accuracy_change", with_bases("H") + """
SELECT timestamp, round(new_accuracy, 6) AS new_accuracy,
       round(lag(new_accuracy) OVER (ORDER BY timestamp), 6) AS previous_accuracy,
       round(new_accuracy - lag(new_accuracy) OVER (ORDER BY timestamp), 6) AS accuracy_change
FROM H
""")
def r7_history(spark, sf_dir):
    h = fb.history_changes(Bases(spark, sf_dir).history())
    return h.select("timestamp", _rnd("new_accuracy"), _rnd("previous_accuracy"), _rnd("accuracy_change"))


@query("R4_promotion_decision", with_bases("H") + """
SELECT timestamp, coalesce(new_accuracy > lag(new_accuracy) OVER (ORDER BY timestamp), true) AS promote FROM H
""")
def r4_promotion(spark, sf_dir):
    h = fb.history_changes(Bases(spark, sf_dir).history())
    return h.select("timestamp", fb.promotion_decision(F.col("new_accuracy"), F.col("previous_accuracy")).alias("promote"))


@query("K12_record_retraining", with_bases("H") + """
SELECT timestamp, CAST(feedback_count AS BIGINT) AS feedback_count, round(new_accuracy, 6) AS new_accuracy FROM (
  SELECT *, coalesce(new_accuracy > lag(new_accuracy) OVER (ORDER BY timestamp), true) AS promote FROM H) x
WHERE promote
""")
def k12_record(spark, sf_dir):
    """R5 + K12: runs that were promoted appended to the history table, read back."""
    h = fb.history_changes(Bases(spark, sf_dir).history())
    promoted = h.filter(fb.promotion_decision(F.col("new_accuracy"), F.col("previous_accuracy")))
    path = scratch_path(spark, "retraining-history")
    promoted.select("timestamp", F.col("feedback_count").cast("long"), "new_accuracy",
                    "previous_accuracy").write.mode("append").parquet(path)
    back = spark.read.parquet(path)
    return back.select("timestamp", "feedback_count", _rnd("new_accuracy"))


@query("F27_retraining_duration", with_bases("E") + """
SELECT date_trunc('day', timestamp) AS run_day,
       round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 60000000.0, 6) AS duration_minutes
FROM E GROUP BY 1
""")
def f27_duration(spark, sf_dir):
    """Run span per day of feedback: first to last event of the run, in minutes."""
    e = _e(spark, sf_dir)
    runs = e.groupBy(F.date_trunc("day", "timestamp").alias("run_day")).agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    return runs.select(F.col("run_day").cast("timestamp_ntz").alias("run_day"),
                       F.round(fb.duration_minutes("start", "end"), R).alias("duration_minutes"))


# ----------------------------------------------------------------------------- logs (L)
_TS_RE = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
_ERR_RE = "(?i)(" + "|".join(p.replace(":", ":") for p in ERROR_PATTERNS) + ")"
_L_TS = f"""CASE WHEN regexp_extract(line, '{_TS_RE}', 1) = '' THEN NULL
            ELSE try_strptime(regexp_extract(line, '{_TS_RE}', 1), '%Y-%m-%d %H:%M:%S') END"""
_L_ERR = f"""SELECT log_name, line_no, {q.strip_ws('line')} AS line, ts FROM (SELECT *, {_L_TS} AS ts FROM L) x
WHERE (ts IS NULL OR ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AND regexp_matches(line, '{_ERR_RE}')"""


def _l(spark, sf_dir):
    return Bases(spark, sf_dir).logs()


@query("F18_log_timestamp", with_bases("L") + f"SELECT log_name, line_no, {_L_TS} AS ts FROM L")
def f18_ts(spark, sf_dir):
    return _l(spark, sf_dir).select("log_name", "line_no", line_timestamp("line").alias("ts"))


@query("F20_error_lines", with_bases("L") +
       f"SELECT log_name, line_no FROM L WHERE regexp_matches(line, '{_ERR_RE}')")
def f20_errors(spark, sf_dir):
    return _l(spark, sf_dir).filter(is_error_line("line")).select("log_name", "line_no")


@query("F19_recent_error_lines", with_bases("L") + f"SELECT log_name, line_no, line FROM ({_L_ERR}) e")
def f19_recent(spark, sf_dir):
    return lg.error_lines(_l(spark, sf_dir), AS_OF, 24).select("log_name", "line_no", "line")


@query("A20_error_counts", with_bases("L") + f"""
SELECT log_name, CAST(count(*) AS BIGINT) AS errors FROM ({_L_ERR}) e GROUP BY ROLLUP (log_name)
""")
def a20_counts(spark, sf_dir):
    return lg.error_counts(lg.error_lines(_l(spark, sf_dir), AS_OF, 24))


@query("W8_error_digest", with_bases("L") + f"""
, ER AS ({_L_ERR})
, RK AS (SELECT *, row_number() OVER (PARTITION BY log_name ORDER BY line_no) AS rank,
                count(*) OVER (PARTITION BY log_name) AS total FROM ER)
SELECT log_name, CAST(rank AS INTEGER) AS rank, line, CAST(total AS BIGINT) AS total,
       CAST(greatest(total - 10, 0) AS BIGINT) AS more FROM RK WHERE rank <= 10
""")
def w8_digest(spark, sf_dir):
    return lg.error_digest(lg.error_lines(_l(spark, sf_dir), AS_OF, 24), 10, ("line_no",))


def grown_logs(spark, lines):
    """Log files in three states, in one folder: written; appended to; ``app`` appended to once more, the
    others truncated and begun anew. Every line of L is new in one of the states."""
    root, parts = scratch_path(spark, "logs"), 4
    third = F.pmod("line_no", F.lit(3))
    states = [third == 0, third <= 1, F.when(F.col("log_name") == "app", True).otherwise(third == 2)]
    for held in states:
        part = F.pmod(F.xxhash64("line_no"), F.lit(parts))
        made = scratch_path(spark, "logs-state")
        lines.where(held).select("log_name", part.alias("part"), third.alias("third"), "line_no", F.col("line").alias("value")).repartition(
            parts, "log_name", "part").sortWithinPartitions("log_name", "part", "third", "line_no").select(
            "log_name", "part", "value").write.partitionBy("log_name", "part").text(made)
        replace_files(spark, made, root)
        yield root


def replace_files(spark, made, root):
    """Files made as ``log_name=x/part=n/<any name>`` take the place of ``root``/log_name=x/n.log."""
    path, jvm = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for log in fs.globStatus(path(f"{made}/log_name=*/part=*/part-*")):
        folder = log.getPath().getParent()
        target = path(f"{root}/{folder.getParent().getName()}/{folder.getName().removeprefix('part=')}.log")
        fs.mkdirs(target.getParent())
        fs.delete(target, False)
        fs.rename(log.getPath(), target)


@query("S10_log_file_scan", with_bases("L") + "SELECT log_name, line FROM L")
def s10_log_scan(spark, sf_dir):
    """Logs that grow and are begun anew between three scans, each from the last positions."""
    found, at = [], None
    for root in grown_logs(spark, _l(spark, sf_dir)):
        lines, at = lg.read_logs(spark, root, at)
        path = scratch_path(spark, "log-lines")
        lines.select("log_name", "line").write.parquet(path)     # the files change after this scan
        found.append(path)
    return spark.read.parquet(*found)
