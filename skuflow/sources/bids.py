"""Bid sources (S1, S2) and staging of nested bids.

Files may hold one JSON array of bids, one bid, or a bid a line; each is cut into byte ranges that
several tasks read (``sources.json_records``). A bid without an id is named after its file and the byte
where it begins, whatever the ranges.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.schemas import BID
from skuflow.session import scratch_path
from skuflow.sources.json_records import SPLIT_BYTES, read_json_records

CORRUPT = "_corrupt_record"


def read_bid_records(spark: SparkSession, path: str, schema: T.StructType = BID,
                     split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Columns of ``schema`` with ids, ``_corrupt_record`` (the text of a record that does not parse), file, position."""
    raw = read_json_records(spark, path, split_bytes)
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = raw.select("file", "position", F.from_json("value", full, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("bid"))
    place = F.concat("file", F.lit("#"), F.col("position").cast("string"))
    return rows.select(*[F.coalesce("bid.bid_id", place).alias("bid_id") if f.name == "bid_id" else F.col(f"bid.{f.name}").alias(f.name)
                         for f in schema.fields], F.col(f"bid.{CORRUPT}").alias(CORRUPT), "file", "position")


def read_bids(spark: SparkSession, path: str, schema: T.StructType = BID, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Nested bid scan with an explicit schema (no inference pass over the data).

    A record that does not parse is a bid of nulls; ``read_bid_records`` keeps its text.
    """
    return read_bid_records(spark, path, schema, split_bytes).select(*[f.name for f in schema.fields])


def _identified(bids: DataFrame) -> DataFrame:
    place = F.concat("__file", F.lit("#"), F.monotonically_increasing_id().cast("string"))
    return bids.withColumn("bid_id", F.coalesce(F.col("bid_id"), place)).drop("__file")


def read_bid_chunks(spark: SparkSession, glob: str, multiline: bool = False) -> DataFrame:
    """Glob of chunk files; a malformed record/file is kept aside instead of failing the job.

    Records are read as text and parsed in the row, so the raw text of one that does not parse
    stays at hand in ``_corrupt_record`` (nulls elsewhere); ``corrupt_records`` lists them.
    """
    raw = spark.read.option("wholetext", multiline).text(glob).where(F.trim("value") != "").select(
        "value", F.col("_metadata.file_path").alias("__file"))
    if multiline:       # one array of bids, or one bid, per file
        parsed = F.coalesce(F.try_parse_json("value").isNotNull(), F.lit(False))
        array = F.from_json("value", T.ArrayType(BID))
        rows = raw.select("__file", F.explode_outer(F.when(parsed, array)).alias("bid"),
                          F.when(~parsed, F.col("value")).alias(CORRUPT))
    else:
        schema = T.StructType(BID.fields + [T.StructField(CORRUPT, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        rows = raw.select("__file", F.from_json("value", schema, options).alias("bid"))
        rows = rows.withColumn(CORRUPT, F.col(f"bid.{CORRUPT}"))
    file = F.col("__file").alias("file")
    return _identified(rows.select(*[F.col(f"bid.{f.name}").alias(f.name) for f in BID.fields],
                                   CORRUPT, file, F.col("__file")))


def corrupt_records(chunks: DataFrame) -> DataFrame:
    """(file, _corrupt_record) of the records that do not parse."""
    return chunks.filter(F.col(CORRUPT).isNotNull()).select("file", CORRUPT)


def chunk_scan_report(chunks: DataFrame) -> DataFrame:
    """(status, n, n_items): parsed bids vs corrupt records, counted in one pass."""
    status = F.when(F.col(CORRUPT).isNull(), F.lit("ok")).otherwise(F.lit("corrupt"))
    return chunks.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.size(F.coalesce("items", F.array()))), F.lit(0)).cast("long").alias("n_items"))


BIDS_A_CHUNK = 50_000


def chunk_count(bids: DataFrame, least: int = 1) -> int:
    """Chunk files for ``bids``: ``least``, more where a chunk would hold over ``BIDS_A_CHUNK`` bids."""
    return max(least, -(-bids.count() // BIDS_A_CHUNK))


def stage_bids_json(bids: DataFrame, chunks: int | None = None, path: str | None = None) -> str:
    """Write nested bids as JSON Lines to a fresh folder under the shared checkpoint dir, in ``chunks`` files or more (``chunk_count``)."""
    out = path or scratch_path(bids.sparkSession, "bids-json")
    writer_df = bids.repartition(chunk_count(bids, chunks)) if chunks else bids
    writer_df.write.mode("errorifexists").json(out)
    return out


def stage_bid_arrays(bids: DataFrame, path: str | None = None) -> str:
    """Write nested bids as files of one JSON array each, a file a task, to a fresh folder."""
    out = path or scratch_path(bids.sparkSession, "bid-arrays")

    def arrays(batches):
        first = True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first else ",") + ",\n".join(lines)], pa.string())], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], names=["value"])

    bids.select(F.to_json(F.struct(*bids.columns)).alias("v")).mapInArrow(arrays, "value string").write.mode(
        "errorifexists").text(out)
    return out
