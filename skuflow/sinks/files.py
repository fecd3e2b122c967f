"""File sinks.

Writers never coalesce to one file: every task writes its own part file, so
output throughput scales with the cluster. Per-maker outputs are Hive-style
``maker_key=`` partitions (one directory per maker) instead of one file per
maker opened by a single process.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.functions.text import clean_maker_name
from skuflow.sources.files import escape_breaks

# Spark's CSV writer trims values by default; text must round-trip unchanged.
KEEP_WS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _one_line(df: DataFrame) -> DataFrame:
    return df.select(*[escape_breaks(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f.name) for f in df.schema.fields])


def write_flat_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """K1: every field quoted, header, UTF-8; line breaks escaped, so that files split by lines."""
    (_one_line(df).write.mode(mode).options(**KEEP_WS).option("header", True).option("quoteAll", True)
     .option("escape", '"').option("encoding", "UTF-8").csv(path))
    return path


def write_per_maker_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """K2: one CSV set per cleaned maker name under ``maker_key=<key>``.

    Makers with no rows produce no directory. Two makers whose names clean to
    one key share a directory and stay distinguishable by the ``maker`` column.
    A rebalance by key gathers each maker's rows and splits a hot maker over several tasks.
    """
    keyed = _one_line(df).withColumn("maker_key", clean_maker_name("maker"))
    (keyed.hint("rebalance", "maker_key").write.mode(mode).partitionBy("maker_key").options(**KEEP_WS)
     .option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
    return path


def write_sku_lists(skus: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """K3: sorted distinct SKUs per maker as text, one directory per maker key.

    ``repartitionByRange`` on (key, sku) keeps each maker's SKUs in sorted,
    contiguous ranges, so a hot maker spreads over many tasks while each part
    file stays sorted; files of one maker concatenate in order.
    """
    keyed = skus.select(clean_maker_name("maker").alias("maker_key"), F.col("sku")).distinct()
    ordered = keyed.repartitionByRange("maker_key", "sku").sortWithinPartitions("maker_key", "sku")
    ordered.write.mode(mode).partitionBy("maker_key").text(path)
    return path


def write_json_records(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """K4/K8: JSON Lines records (the array/indent form is a single-machine artefact)."""
    df.write.mode(mode).json(path)
    return path


def write_hierarchy(nested: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """K5: one JSON line per maker with sorted series keys and sorted model lists."""
    nested.select(F.to_json(F.struct("maker", "series")).alias("value")).write.mode(mode).text(path)
    return path


def write_series_flat(rows: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """K6: ``;``-separated, every field quoted, for human editing."""
    (rows.select("maker", "series", "canonical_series").write.mode(mode).options(**KEEP_WS)
     .option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"')
     .csv(path))
    return path


def write_summary(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> str:
    """Small summary or long-form report tables as CSV."""
    df.write.mode(mode).options(**KEEP_WS).option("header", True).option("sep", sep).csv(path)
    return path
