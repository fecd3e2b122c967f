"""Profiling aggregations and top-k reports.

All aggregations are single ``groupBy``/``agg`` steps, so Spark runs a
map-side partial aggregate before the shuffle: what crosses the network is one
row per (task, key), not one per input row. Hot keys (a maker holding a third
of the rows) are therefore harmless here. Top-k reports use
``orderBy(...).limit(k)``, which plans as ``TakeOrderedAndProject`` (a
per-partition heap), never a full sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuflow.functions.text import py_strip


def rows_per_maker(df: DataFrame, maker: str = "maker") -> DataFrame:
    """Number of rows per maker."""
    return df.groupBy(maker).agg(F.count(F.lit(1)).alias("n"))


def distinct_skus_per_maker(df: DataFrame, sku: str = "referencia") -> DataFrame:
    """A2: distinct stripped SKUs per maker (blank SKUs excluded)."""
    s = py_strip(sku)
    return (df.filter(F.col(sku).isNotNull() & (s != ""))
            .groupBy("maker").agg(F.count_distinct(s).alias("n")))


def top_makers(counts: DataFrame, k: int = 10, n: str = "n") -> DataFrame:
    """K makers with the largest count; ties by maker ascending (Q10)."""
    return counts.orderBy(F.col(n).desc(), F.col("maker").asc()).limit(k)


def sku_counts(df: DataFrame, sku: str = "referencia") -> DataFrame:
    """A3: occurrences of each SKU (``value_counts``)."""
    return df.groupBy(sku).agg(F.count(F.lit(1)).alias("n"))


def frequency_buckets(df: DataFrame, sku: str = "referencia") -> DataFrame:
    """A4: SKUs bucketed by occurrence count (1 / 2-5 / 6-10 / 11+) with percentage.

    The percentage uses an un-partitioned window over the (at most four)
    bucket rows after aggregation, so the single-partition window is tiny.
    """
    n = F.col("n")
    bucket = (F.when(n == 1, F.lit("1")).when(n <= 5, F.lit("2-5"))
              .when(n <= 10, F.lit("6-10")).otherwise(F.lit("11+")))
    per_bucket = (sku_counts(df, sku).groupBy(bucket.alias("bucket"))
                  .agg(F.count(F.lit(1)).alias("skus")))
    total = F.sum("skus").over(Window.partitionBy())
    return per_bucket.withColumn("pct", F.round(F.col("skus") * 100.0 / total, 6))


def distinct_profile(df: DataFrame, columns=("SKU", "description", "maker", "series", "model"),
                     approx: bool = False, rsd: float = 0.02) -> DataFrame:
    """Distinct values per column plus the row total, in long form.

    One aggregation computes every column's distinct count; nulls are not
    counted (``nunique``). Missing columns are reported with a null count.
    ``approx=True`` swaps in HyperLogLog++ (``approx_count_distinct``), whose
    state is a fixed few KB per column regardless of data size.
    """
    present = [c for c in columns if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(present):
        fn = (lambda x: F.approx_count_distinct(x, rsd)) if approx else F.count_distinct
        aggs.append(fn(F.col(c)).alias(f"__c{i}"))
    wide = df.agg(*aggs)
    pairs = [F.struct(F.lit("rows").alias("metric"), F.col("__rows").cast("long").alias("value"))]
    for c in columns:
        if c in present:
            v = F.col(f"__c{present.index(c)}").cast("long")
        else:
            v = F.lit(None).cast("long")
        pairs.append(F.struct(F.lit(f"distinct_{c}").alias("metric"), v.alias("value")))
    return wide.select(F.inline(F.array(*pairs)))


def skus_per_description(df: DataFrame, description: str = "description_cleaned",
                         sku: str = "SKU") -> DataFrame:
    """Number of distinct SKUs per (cleaned) description, null rows dropped first."""
    return (df.dropna(subset=[description, sku]).groupBy(description)
            .agg(F.count_distinct(sku).alias("n_skus")))


def ambiguity_summary(per_description: DataFrame) -> DataFrame:
    """Total descriptions, exactly-one / multiple SKU counts and shares, max, mean."""
    n = F.col("n_skus")
    total = F.count(F.lit(1))
    one = F.count_if(n == 1)
    many = F.count_if(n > 1)
    return per_description.agg(
        total.alias("descriptions"),
        one.cast("long").alias("one_sku"),
        many.cast("long").alias("multiple_skus"),
        F.round(F.when(total > 0, one * 100.0 / total).otherwise(0.0), 6).alias("pct_one_sku"),
        F.round(F.when(total > 0, many * 100.0 / total).otherwise(0.0), 6).alias("pct_multiple_skus"),
        F.max(n).cast("long").alias("max_skus"),
        F.round(F.avg(n), 6).alias("mean_skus"),
    )


def most_ambiguous(per_description: DataFrame, k: int = 5,
                   description: str = "description_cleaned") -> DataFrame:
    """The k descriptions mapped to the most SKUs (more than one), ties by text."""
    return (per_description.filter(F.col("n_skus") > 1)
            .orderBy(F.col("n_skus").desc(), F.col(description).asc()).limit(k))


def distinct_before_after(df: DataFrame, raw: str = "description",
                          cleaned: str = "description_cleaned") -> DataFrame:
    """Distinct descriptions before and after cleaning, one aggregation."""
    return df.agg(F.count_distinct(raw).alias("distinct_raw"),
                  F.count_distinct(cleaned).alias("distinct_cleaned"))


def class_size_stats(df: DataFrame, label: str = "referencia") -> DataFrame:
    """Number of classes and min / max / mean examples per class."""
    c = sku_counts(df, label)
    return c.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("min_n"),
                 F.max("n").alias("max_n"), F.round(F.avg("n"), 6).alias("mean_n"))


SKETCH_LG_K = 14        # 16,384 registers: 16 KB a column and arrival at most
SKETCH_ERROR = 1.04 / (1 << SKETCH_LG_K) ** 0.5


def store_profile(df: DataFrame, path: str, arrival: str, columns=("SKU", "description", "maker", "series", "model")) -> str:
    """A6 kept up to date: the rows and one HyperLogLog sketch per column of one arrival, under its own folder.

    Storing an arrival again replaces it. Columns that the arrival does not have get no row. One
    aggregation with partial sketches; what is stored does not grow with the arrival's rows.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", arrival):
        raise ValueError(f"not a folder name: {arrival!r}")
    present = [c for c in columns if c in df.columns]
    sketches = [F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_LG_K).alias(f"__s{i}") for i, c in enumerate(present)]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *sketches)
    pairs = [F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("binary").alias("sketch"))]
    pairs += [F.struct(F.lit(c).alias("column"), F.col(f"__s{i}").alias("sketch")) for i, c in enumerate(present)]
    (wide.select("rows", F.inline(F.array(*pairs))).coalesce(1).write.mode("overwrite")
     .parquet(f"{path}/arrival={arrival}"))
    return path


def stored_profile(spark: SparkSession, path: str, arrivals: Column | None = None, tolerance: float | None = None,
                   rows: DataFrame | None = None) -> DataFrame:
    """A5/A6 of any set of stored arrivals from their sketches alone: (metric, value, bound).

    ``arrivals`` is a condition on the column ``arrival``. ``bound`` is three standard errors of the
    estimate, 0 for exact values. With ``tolerance`` and ``rows`` (the rows of these arrivals), the columns
    whose bound is wider are counted exactly, in one scan of these columns only.
    """
    stored = spark.read.schema("rows long, column string, sketch binary, arrival string").parquet(path)
    if arrivals is not None:
        stored = stored.filter(arrivals)
    total = stored.filter(F.col("column").isNull()).agg(
        F.lit("rows").alias("metric"), F.coalesce(F.sum("rows"), F.lit(0)).alias("value"), F.lit(0).cast("long").alias("bound"))
    value = F.hll_sketch_estimate("sketch")
    merged = (stored.filter(F.col("column").isNotNull()).groupBy("column")
              .agg(F.hll_union_agg("sketch").alias("sketch"))
              .select(F.concat(F.lit("distinct_"), "column").alias("metric"), value.alias("value"),
                      F.ceil(value * F.lit(3 * SKETCH_ERROR)).alias("bound")))
    if tolerance is not None and rows is not None:
        # One row per column of the profile: which of them to count again.
        wide = sorted(r["metric"][len("distinct_"):] for r in merged.filter(F.col("bound") > tolerance).collect())
        if wide:
            exact = distinct_profile(rows.select(*wide), wide).filter("metric <> 'rows'")
            merged = merged.filter(F.col("bound") <= tolerance).unionByName(
                exact.withColumn("bound", F.lit(0).cast("long")))
    return total.unionByName(merged)
