"""Explicit schemas for every source (schema inference is never used)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ITEM = T.StructType([
    T.StructField("referencia", T.StringType()),
    T.StructField("descripcion", T.StringType()),
    T.StructField("precio", T.StringType()),
    T.StructField("cantidad", T.StringType()),
    T.StructField("estado", T.StringType()),
])

BID = T.StructType([
    T.StructField("bid_id", T.StringType()),
    T.StructField("maker", T.StringType()),
    T.StructField("series", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("fabrication_year", T.StringType()),
    T.StructField("items", T.ArrayType(ITEM)),
])

FLAT_COLUMNS = ["maker", "series", "model", "descripcion", "referencia"]
DETAILED_COLUMNS = FLAT_COLUMNS + ["precio", "cantidad", "estado"]

FLAT = T.StructType([T.StructField(c, T.StringType()) for c in FLAT_COLUMNS])
DETAILED = T.StructType([T.StructField(c, T.StringType()) for c in DETAILED_COLUMNS])

CORRELATION = T.StructType([T.StructField(c, T.StringType()) for c in
                            ["maker", "series", "model", "SKU", "description"]])

EQUIVALENCY = T.StructType([T.StructField(c, T.StringType()) for c in
                            ["maker", "series", "canonical_series"]])

HIERARCHY_JSON = "map<string,map<string,array<string>>>"

FEEDBACK = T.StructType([
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
    T.StructField("processed", T.BooleanType()),
])

RETRAINING_HISTORY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("feedback_count", T.LongType()),
    T.StructField("previous_accuracy", T.DoubleType()),
    T.StructField("new_accuracy", T.DoubleType()),
    T.StructField("model_path", T.StringType()),
])

CANDIDATE = T.StructType([
    T.StructField("sku", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Raise ``ValueError`` naming the missing columns (driver-side, schema only)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
