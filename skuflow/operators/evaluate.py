"""Routing, hierarchical scoring and evaluation metrics.

Scored rows carry the truth and the prediction side by side, so every metric
is one aggregation (partial-aggregated before the shuffle). The per-class
report makes one pass over the scored rows (the truth x prediction confusion
counts) and derives support, predicted counts and true positives from that
small table, then one aggregation for the macro and weighted averages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.operators.ranking import argmax, overall_confidence


def pair_predictions(truth: DataFrame, predictions: DataFrame, on) -> DataFrame:
    """Attach predictions to the truth rows by key (equi-join, left: no prediction stays null)."""
    return truth.join(predictions, on=on, how="left")


def route_maker(rows: DataFrame, model_makers: DataFrame, maker_probs: DataFrame,
                provided: str = "provided_maker", text: str = "descripcion") -> DataFrame:
    """Use the provided maker when it has a SKU model, else the predicted maker.

    ``model_makers`` has one column ``maker``; ``maker_probs`` is long form
    (text, maker, confidence) from the maker model. Adds ``predicted_maker``
    and ``maker_confidence`` (1.0 for a provided maker).
    """
    mm = model_makers.select(F.col("maker").alias("__mm")).distinct()
    best = argmax(maker_probs, text, label="maker", out_label="__pm", out_conf="__pmc")
    j = (rows.join(mm, rows[provided] == F.col("__mm"), "left")
         .join(best, text, "left"))
    use_provided = F.col("__mm").isNotNull()
    return (j.withColumn("predicted_maker", F.when(use_provided, F.col(provided)).otherwise(F.col("__pm")))
            .withColumn("maker_confidence", F.when(use_provided, F.lit(1.0)).otherwise(F.col("__pmc")))
            .drop("__mm", "__pm", "__pmc"))


def score_hierarchical(routed: DataFrame, model_makers: DataFrame, sku_probs: DataFrame,
                       text: str = "descripcion") -> DataFrame:
    """SKU from the routed maker's model; no model -> null SKU with confidence 0.0.

    ``sku_probs`` is long form (maker, text, sku, confidence).
    """
    best = argmax(sku_probs, ["maker", text], label="sku", out_label="__ps", out_conf="__psc")
    best = best.join(model_makers.select("maker").distinct(), "maker", "left_semi")
    j = routed.join(best.withColumnRenamed("maker", "predicted_maker"), ["predicted_maker", text], "left")
    out = (j.withColumn("predicted_sku", F.col("__ps"))
           .withColumn("sku_confidence", F.coalesce(F.col("__psc"), F.lit(0.0)))
           .drop("__ps", "__psc"))
    return out.withColumn("overall_confidence", overall_confidence())


def accuracy(scored: DataFrame, truth: str, pred: str, name: str = "accuracy") -> DataFrame:
    """Share of rows whose prediction equals the truth."""
    hit = F.coalesce((F.col(pred) == F.col(truth)).cast("double"), F.lit(0.0))
    return scored.agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias(name))


def coverage_report(scored: DataFrame, true_maker: str = "maker", true_sku: str = "referencia") -> DataFrame:
    """Maker accuracy, SKU coverage, SKU accuracy over covered rows (0 if none), test size."""
    covered = F.col("predicted_sku").isNotNull()
    sku_hit = F.when(covered, (F.col("predicted_sku") == F.col(true_sku)).cast("double"))
    return scored.agg(
        F.avg((F.col("predicted_maker") == F.col(true_maker)).cast("double")).alias("maker_accuracy"),
        F.coalesce(F.avg(sku_hit), F.lit(0.0)).alias("sku_accuracy"),
        F.avg(covered.cast("double")).alias("sku_coverage"),
        F.count(F.lit(1)).alias("test_size"))


def classification_report(scored: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per-class precision / recall / F1 / support plus macro and weighted averages.

    Classes are the union of true and predicted labels; any 0/0 is 0.
    """
    # Each confusion count adds to its true label's support and hits and to its predicted label's
    # count, so one sum per label gives all metrics; a rollup gives the averages over the labels.
    conf = (scored.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))
    none = F.lit(0).cast("long")

    def part(label, support, predicted, hit):
        return F.struct(label.alias("label"), support.alias("support"), predicted.alias("n_pred"), hit.alias("tp"))

    hit = F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(none)
    parts = F.array(part(F.col("t"), F.col("n"), none, hit),
                    F.when(F.col("p").isNotNull(), part(F.col("p"), none, F.col("n"), none)))
    per = (conf.select(F.explode(F.array_compact(parts)).alias("x")).select("x.*")
           .groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "n_pred", "tp")]))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.select("label", p.alias("precision"), r.alias("recall"), "support")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall") /
                                      (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    names = ("precision", "recall", "f1")
    summed = per.rollup("label").agg(
        F.grouping_id().alias("all"), F.sum("support").alias("support"), *[F.avg(c).alias(c) for c in names],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in names])

    def line(label, prefix=""):
        return F.struct(label.alias("label"), *[F.col(prefix + c).alias(c) for c in ("precision", "recall")],
                        F.col("support"), F.col(prefix + "f1").alias("f1"))

    lines = F.when(F.col("all") == 0, F.array(line(F.col("label")))).otherwise(
        F.array(line(F.lit("macro avg")), line(F.lit("weighted avg"), "w_")))
    return summed.select(F.explode(lines).alias("x")).select("x.*")


def confusion_pairs(scored: DataFrame, truth: str, pred: str) -> DataFrame:
    """(true, predicted, count) for errors only."""
    return (scored.filter(F.col(pred).isNotNull() & (F.col(pred) != F.col(truth)))
            .groupBy(F.col(truth).alias("true_label"), F.col(pred).alias("predicted_label"))
            .agg(F.count(F.lit(1)).alias("count")))


def top_confusions(scored: DataFrame, truth: str, pred: str, k: int = 5) -> DataFrame:
    """T4: the k most frequent misclassifications (ties by labels ascending)."""
    return (confusion_pairs(scored, truth, pred)
            .orderBy(F.col("count").desc(), "true_label", "predicted_label").limit(k))


def maker_errors(scored: DataFrame, true_maker: str = "maker", text: str = "descripcion") -> DataFrame:
    """Rows whose maker was mispredicted."""
    return scored.filter(F.col("predicted_maker") != F.col(true_maker)).select(
        F.col(true_maker).alias("true_maker"), "predicted_maker",
        F.col("maker_confidence").alias("confidence"), F.col(text).alias("description"))


def sku_errors(scored: DataFrame, true_maker: str = "maker", true_sku: str = "referencia",
               text: str = "descripcion") -> DataFrame:
    """SKU wrong where the maker was right and a SKU was predicted."""
    cond = ((F.col("predicted_maker") == F.col(true_maker)) & F.col("predicted_sku").isNotNull()
            & (F.col("predicted_sku") != F.col(true_sku)))
    return scored.filter(cond).select(
        F.col(true_maker).alias("maker"), F.col(true_sku).alias("true_sku"), "predicted_sku",
        F.col("sku_confidence").alias("confidence"), F.col(text).alias("description"))


def errors_per_maker(sku_error_rows: DataFrame) -> DataFrame:
    """SKU errors per maker."""
    return sku_error_rows.groupBy("maker").agg(F.count(F.lit(1)).alias("error_count"))


def accuracy_per_maker(scored: DataFrame, truth: str, pred: str, maker: str = "maker") -> DataFrame:
    """Per-maker accuracy and test size."""
    hit = F.coalesce((F.col(pred) == F.col(truth)).cast("double"), F.lit(0.0))
    return scored.groupBy(maker).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("test_size"))
