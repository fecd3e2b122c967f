"""Corpus pipeline over ``documents``: the training-data operators as consecutive stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's ``docs``; all but the last return the columns of their input.

quality       documents that the base rule or the trained trees reject go
near_dedup    one document of each near-duplicate group stays, the one with the smallest id
decontaminate documents that hold a window of a benchmark item go
pii           spans of personal data become <KIND>; n_chars follows the new text
bpe           token ids of every document that is left

Null texts fail the quality rule; an empty input gives an empty output in every stage; columns
that documents does not have pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm import bpe, decontaminate as windows, near_dedup as near, pii as personal, quality_rules as rules
from skuflow.llm.common import table
from skuflow.session import scratch_path

KEEP = "__doc_"


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` with renamed columns, so that no column of an operator meets one of them."""
    return docs.select(*[docs[c].alias(KEEP + c) for c in docs.columns])


def back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col(KEEP + c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = rules.train(docs, table(spark, sf_dir, "labels"))
    return back(rules.judge(apart(docs), model, KEEP + "text").where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = windows.scan(apart(docs), table(spark, sf_dir, "benchmark"), KEEP + "text")
    return back(found.where(F.size("hit_words") == 0), docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = personal.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept document; ``round_trip`` tells that decoding gives the text back."""
    return bpe.encode(docs).drop("text")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", pii),
    ("bpe", encode),
]

# Trained quality rules and near-duplicate groups are not expressible in SQL; tests compare
# the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
