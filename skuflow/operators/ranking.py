"""Candidate ranking over class probabilities.

Model output is handled in *long* form: one row per (key, label, confidence).
A spark.ml probability vector becomes long form with ``vector_to_array`` +
``posexplode`` (see ``skuflow.ml.models``); the relational test basis is long
form already. Top-k uses ``row_number() <= k``, which Spark plans as a
``WindowGroupLimit`` that keeps only k rows per key *before* the shuffle, so a
description with very many candidate classes never ships them all. argmax is a
plain ``min(struct(-confidence, label))`` aggregate (partial aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CONFIDENCE = 0.001
TOP_K = 5


def top_candidates(long_df: DataFrame, keys, label: str = "sku", conf: str = "confidence",
                   k: int = TOP_K, min_confidence: float | None = MIN_CONFIDENCE) -> DataFrame:
    """W1 (+P19): per key, the k best labels above ``min_confidence``.

    Output: keys, ``top_sku``, ``top_confidence``, ``top_skus`` (array of
    struct(sku, confidence), best first; ties by label ascending). A key with
    no label above the threshold keeps a row with null ``top_sku``, confidence
    0.0 and an empty list (SURVEY Q13).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    above = (F.col(conf) > F.lit(min_confidence)) if min_confidence is not None else F.lit(True)
    w = Window.partitionBy(*keys).orderBy(above.desc(), F.col(conf).desc(), F.col(label).asc())
    ranked = long_df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= k)
    cand = F.when(above, F.struct(F.col("__rank").alias("r"), F.col(label).alias("sku"),
                                  F.col(conf).cast("double").alias("confidence")))
    grouped = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(cand)).alias("__c"))
    top = F.transform("__c", lambda x: F.struct(x["sku"].alias("sku"), x["confidence"].alias("confidence")))
    return grouped.select(
        *keys,
        F.try_element_at("__c", F.lit(1))["sku"].alias("top_sku"),
        F.coalesce(F.try_element_at("__c", F.lit(1))["confidence"], F.lit(0.0)).alias("top_confidence"),
        top.alias("top_skus"))


def argmax(long_df: DataFrame, keys, label: str = "sku", conf: str = "confidence",
           out_label: str = "predicted", out_conf: str = "confidence") -> DataFrame:
    """Best label and its confidence per key (ties by label ascending)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    best = F.min(F.struct((-F.col(conf)).alias("nc"), F.col(label).alias("l")))
    g = long_df.groupBy(*keys).agg(best.alias("__b"))
    return g.select(*keys, F.col("__b.l").alias(out_label), (-F.col("__b.nc")).alias(out_conf))


def single_candidate(predicted: DataFrame, keys, label: str = "predicted") -> DataFrame:
    """A model without probabilities: the predicted label with confidence 1.0."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return predicted.select(
        *keys, F.col(label).alias("top_sku"), F.lit(1.0).alias("top_confidence"),
        F.array(F.struct(F.col(label).alias("sku"), F.lit(1.0).alias("confidence"))).alias("top_skus"))


def overall_confidence(sku: str = "predicted_sku", maker_conf: str = "maker_confidence",
                       sku_conf: str = "sku_confidence") -> Column:
    """maker confidence x SKU confidence, 0 when no SKU was predicted."""
    return F.when(F.col(sku).isNotNull(), F.col(maker_conf) * F.col(sku_conf)).otherwise(F.lit(0.0))


def confidence_percent(conf: str = "top_confidence") -> Column:
    """confidence as a rounded percentage (half up)."""
    return F.round(F.col(conf) * 100).cast("int")


def confidence_band(conf: str = "top_confidence") -> Column:
    """>= 70 % high, >= 40 % medium, else low (on the rounded percentage)."""
    p = confidence_percent(conf)
    return F.when(p >= 70, F.lit("high")).when(p >= 40, F.lit("medium")).otherwise(F.lit("low"))
