"""User feedback, retraining sets and table versions.

The feedback store is an append-only Parquet table instead of a row-updating
database: "mark processed" is a join with the consumed ids, which a persisted table keeps as
appended files (``sinks.versions``), and backups become ``snapshot_ts=`` partitions. Statistics that took several
scans become one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuflow.functions.text import clean_text, truthy
from skuflow.operators.split import select_frequent_classes, keep_classes
from skuflow.session import delete_path
from skuflow.sinks import versions

REQUIRED_FIELDS = ["description", "predicted_sku", "is_correct"]


def feedback_id(columns) -> Column:
    """Deterministic id for an appended feedback row (replaces an autoincrement, Q16); absent fields are empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in columns else F.lit("") for c in
             ["description", "maker", "predicted_sku", "is_correct", "correct_sku", "timestamp"]]
    return F.sha2(F.concat_ws("\u0001", *parts), 256).substr(1, 32)


def validate_feedback(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """P20: classify raw feedback rows; ``reject_reason`` is null for valid rows.

    A missing required field rejects the row (the first missing one is named);
    a missing timestamp is defaulted to ``now`` (the job's time by default).
    """
    reason = F.lit(None).cast("string")
    for f in reversed(REQUIRED_FIELDS):
        reason = F.when(F.col(f).isNull(), F.lit(f"missing_{f}")).otherwise(reason)
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    ts = F.coalesce(F.try_to_timestamp(F.col("timestamp").cast("string")).cast("timestamp_ntz"), now)
    # The id comes from what was sent, before any default, so a replay gives the same id.
    key = F.coalesce(F.col("id"), feedback_id(raw.columns)) if "id" in raw.columns else feedback_id(raw.columns)
    return raw.withColumn("reject_reason", reason).withColumn("id", key).withColumn("timestamp", ts)


def accepted(validated: DataFrame) -> DataFrame:
    """Valid rows in table form, with defaults for optional fields and an id."""
    v = validated.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return (v.withColumn("maker", F.coalesce("maker", F.lit("")))
            .withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))
            .withColumn("processed", F.lit(False)))


def unprocessed(feedback: DataFrame) -> DataFrame:
    """Feedback not yet consumed by retraining (filter pushed into the Parquet scan)."""
    return feedback.filter(~F.col("processed"))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Total, correct, incorrect, unprocessed and accuracy (0 when empty), one scan."""
    total = F.count(F.lit(1))
    correct = F.count_if(F.col("is_correct"))
    return feedback.agg(
        total.alias("total_count"),
        correct.cast("long").alias("correct_count"),
        F.count_if(~F.col("is_correct")).cast("long").alias("incorrect_count"),
        F.count_if(~F.col("processed")).cast("long").alias("unprocessed_count"),
        F.when(total > 0, correct / total).otherwise(F.lit(0.0)).alias("accuracy_rate"))


def recent_feedback(feedback: DataFrame, n: int = 10) -> DataFrame:
    """The n most recent rows by parsed timestamp, then id (Q20)."""
    return feedback.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)


def feedback_label() -> Column:
    """Correct -> predicted SKU; incorrect with a (non-empty) correction -> correction."""
    return (F.when(F.col("is_correct"), F.col("predicted_sku"))
            .when(~F.col("is_correct") & truthy("correct_sku"), F.col("correct_sku")))


def feedback_training_rows(feedback: DataFrame, maker: str | None = None,
                           keep_id: bool = False) -> DataFrame:
    """Usable feedback as training rows (maker, series, model, descripcion, referencia)."""
    fb = feedback if maker is None else feedback.filter(F.lower("maker") == maker.lower())
    rows = fb.withColumn("referencia", feedback_label()).filter(F.col("referencia").isNotNull())
    cols = [F.col("maker"), F.col("series"), F.col("model_year").alias("model"),
            F.col("description").alias("descripcion"), F.col("referencia")]
    if keep_id:
        cols.append(F.col("id"))
    return rows.select(*cols)


def preprocess_training_text(df: DataFrame, columns=("maker", "series", "model", "descripcion")) -> DataFrame:
    """F3 on the text columns (fillna('') -> str -> clean_text), as the retraining step does."""
    return df.select(*[clean_text(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
                       if c in columns else F.col(c) for c in df.columns])


def retraining_set(original: DataFrame, feedback: DataFrame, maker: str | None = None,
                   min_examples: int = 10, max_classes: int | None = 50) -> DataFrame:
    """(original ∪ usable feedback) for one maker (or all), preprocessed, classes selected.

    When the original rows carry ``row_id`` it is kept, and feedback rows get
    ``fb:<id>``, so every training row stays addressable (no de-duplication).
    """
    cols = ["maker", "series", "model", "descripcion", "referencia"]
    with_id = "row_id" in original.columns
    orig = preprocess_training_text(original.select(*cols, *(["row_id"] if with_id else [])))
    if maker is not None:
        orig = orig.filter(F.lower("maker") == clean_text(F.lit(maker)))
    fb_rows = feedback_training_rows(feedback, maker, keep_id=with_id)
    if with_id:
        fb_rows = fb_rows.withColumn("row_id", F.concat(F.lit("fb:"), F.col("id"))).drop("id")
    combined = orig.unionByName(preprocess_training_text(fb_rows))
    classes = select_frequent_classes(combined, "referencia", min_examples, max_classes)
    return keep_classes(combined, classes, "referencia", bounded_rows=max_classes)


def promotion_decision(new_accuracy: Column, old_accuracy: Column) -> Column:
    """Promote only when the challenger is strictly better."""
    return F.coalesce(new_accuracy > F.coalesce(old_accuracy, F.lit(float("-inf"))), F.lit(False))


def mark_processed(feedback: DataFrame, consumed_ids: DataFrame) -> DataFrame:
    """``processed = processed OR id in consumed``; an empty id set changes nothing."""
    ids = consumed_ids.select(F.col("id").alias("__id")).distinct()
    j = feedback.join(ids, feedback["id"] == F.col("__id"), "left")
    return j.withColumn("processed", F.col("processed") | F.col("__id").isNotNull()).drop("__id")


def consumed_ids(feedback: DataFrame, maker: str | None = None, mark: str = "used") -> DataFrame:
    """Ids to mark after a retraining run.

    ``mark="used"`` marks only rows that became training rows; ``mark="all"``
    marks every fetched unprocessed row when any row was usable (Q18).
    """
    pending = unprocessed(feedback)
    if mark == "all":
        any_usable = feedback_training_rows(pending, maker).limit(1).count() > 0
        return pending.select("id") if any_usable else pending.select("id").limit(0)
    return feedback_training_rows(pending, maker, keep_id=True).select("id")


def accuracy_over_time(feedback: DataFrame, every: str = "1 day") -> DataFrame:
    """Prediction accuracy per tumbling time window."""
    return (feedback.groupBy(F.window("timestamp", every).alias("w"))
            .agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"),
                 F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), "accuracy", "n"))


def history_changes(history: DataFrame) -> DataFrame:
    """Accuracy change per retraining run (previous = the run before in time).

    The history table holds one row per run (a few per day at most), so the
    ordered window over it is small by construction.
    """
    w = Window.orderBy("timestamp")
    prev = F.coalesce(F.col("previous_accuracy"), F.lag("new_accuracy").over(w)) \
        if "previous_accuracy" in history.columns else F.lag("new_accuracy").over(w)
    return (history.withColumn("previous_accuracy", prev)
            .withColumn("accuracy_change", F.col("new_accuracy") - F.col("previous_accuracy")))


def duration_minutes(start: str, end: str) -> Column:
    """elapsed minutes between two timestamps."""
    return (F.unix_micros(F.col(end).cast("timestamp")) -
            F.unix_micros(F.col(start).cast("timestamp"))) / F.lit(60_000_000.0)


def display_value(feedback: DataFrame) -> DataFrame:
    """'-' for correct rows, else the given correction or 'Not provided'."""
    v = F.when(F.col("is_correct"), F.lit("-")).otherwise(F.coalesce(F.col("correct_sku"), F.lit("Not provided")))
    return feedback.withColumn("correction_display", v)


def feedback_from_selection(top: str, selected: str, manual: str) -> tuple[Column, Column]:
    """(is_correct, correct_sku) from the top prediction, the chosen candidate and a manual entry."""
    chosen = F.coalesce(F.when(truthy(manual), F.col(manual)), F.col(selected))
    is_correct = F.coalesce(chosen == F.col(top), F.lit(False))
    correct_sku = F.when(~is_correct, chosen)
    return is_correct, correct_sku


def iso_timestamp(col: str) -> Column:
    """ISO-8601 text with microseconds (``datetime.isoformat`` layout)."""
    return F.date_format(F.col(col), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


# --------------------------------------------------------------------------- table versions
def write_snapshot(feedback: DataFrame, root: str, snapshot: str) -> str:
    """Store a version of the feedback table under ``snapshot_ts=<snapshot>``."""
    (feedback.withColumn("snapshot_ts", F.lit(snapshot)).write.mode("append")
     .partitionBy("snapshot_ts").parquet(root))
    return root


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    """Versions with their row counts."""
    return snapshots.groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("rows"))


def retained_snapshots(listing: DataFrame, keep: int = 10) -> DataFrame:
    """The ``keep`` newest versions (window over the version list, not the data)."""
    w = Window.orderBy(F.col("snapshot_ts").desc())
    return listing.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= keep)


def prune_snapshots(spark: SparkSession, root: str, keep: int = 10) -> list[str]:
    """W9 acting: remove the folders of all but the ``keep`` newest versions; returns what was removed.

    Only the version list, one name per snapshot, comes to the driver.
    """
    listing = spark.read.parquet(root).select("snapshot_ts").distinct()
    kept = retained_snapshots(listing, keep).select("snapshot_ts")
    old = sorted(str(r["snapshot_ts"]) for r in listing.join(kept, "snapshot_ts", "left_anti").collect())
    for name in old:
        # Partition folders escape these characters of a value.
        folder = "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^" else c for c in name)
        if not delete_path(spark, f"{root}/snapshot_ts={folder}"):
            raise FileNotFoundError(f"{root}/snapshot_ts={folder}")
    return old


def restore_snapshot(snapshots: DataFrame, snapshot: str, path: str | None = None) -> DataFrame:
    """K14 restore: one version (partition-pruned read), written as the table at ``path`` if given."""
    version = snapshots.filter(F.col("snapshot_ts") == snapshot).drop("snapshot_ts")
    if path is None:
        return version
    version.write.mode("overwrite").parquet(path)
    return snapshots.sparkSession.read.schema(version.schema).parquet(path)


def persist_processed(feedback: DataFrame, consumed: DataFrame, root: str) -> DataFrame:
    """J7 persisted: the table as version 0 under ``root``, the consumed ids as version 1, read back."""
    spark = feedback.sparkSession
    base = versions.create(feedback, root)
    return versions.read(spark, root, versions.flag(consumed, root, at=base))
