"""Two-pass external shuffle into shards (operator 7).

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash of the whole
record. Pass two reads one bucket at a time, puts it into a canonical order, shuffles it with a
seeded Fisher-Yates shuffle and writes it. The buckets one after the other are one random order
of all records; shard k is the k-th of ``shards`` equal runs of it, so the law is ``rows``: the
counts of any two shards differ by one at most, however long the texts are and however many are
equal. A record's slot is its place in its shard, from 0 without gaps.

Equal texts have different records, so a large group of copies spreads over all buckets. Records
that are equal in every column cannot be told apart, so of those (found by a count per record hash)
one is kept, reduced within each task first, and dealt out again as copies 0, 1, ... whose hashes
differ; runs of ``COPIES`` copies are spread over tasks before that. A record's bucket is thus a
function of the record and its copy number alone: counts and placement agree whatever the plans,
partitions or repeated tasks.

Defined cases: a null text counts as empty (size 1); an empty table gives empty shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skuflow.llm.common import staged, table
from skuflow.session import scratch_path

SHARDS = 16
BUCKET_BYTES = 16 << 20
COPIES = 4096


def shuffle_to_shards(df: DataFrame, path: str, text: str = "text", shards: int = SHARDS,
                      bucket_bytes: int = BUCKET_BYTES, seed: int = 17) -> DataFrame:
    """Write all records of ``df`` to ``path``/shard=k with their slot; returns the files read back.

    Columns of ``df`` named shard or slot are replaced. Row order within a file is the shuffled one.
    """
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    src = df.select(*columns)
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    total, n = src.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0)), F.count("*")).first()
    buckets = max(1, math.ceil(total / bucket_bytes), math.ceil(n / 200_000))

    hashed = src.withColumn("__llm_hash", F.xxhash64(F.lit(seed), *columns))
    repeated = staged(hashed.groupBy("__llm_hash").count().where("count > 1").select(
        "__llm_hash", F.col("count").alias("__llm_count")), "shard-repeats")

    def bucketed(records: DataFrame) -> DataFrame:
        """Records with a hash and a copy number, in their buckets."""
        return records.withColumn("__llm_hash", F.xxhash64(F.lit(seed + 1), "__llm_hash", "__llm_copy")).withColumn(
            "__llm_bucket", F.pmod("__llm_hash", F.lit(buckets)).cast("int")).drop("__llm_copy")

    def copies(records: DataFrame) -> DataFrame:
        """Each record of ``records`` __llm_count times, with its copy number."""
        last = F.col("__llm_count") - 1
        runs = records.withColumn("__llm_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / COPIES))))
        return runs.repartition("__llm_hash", "__llm_run").withColumn("__llm_copy", F.explode(F.sequence(
            F.col("__llm_run") * COPIES, F.least(last, F.col("__llm_run") * COPIES + (COPIES - 1))))).drop(
            "__llm_run", "__llm_count")

    numbers, dealt = hashed.select("__llm_hash"), hashed
    if repeated.isEmpty():
        numbers, dealt = (x.withColumn("__llm_copy", F.lit(0).cast("long")) for x in (numbers, dealt))
    else:
        known = repeated.select("__llm_hash")
        numbers, dealt = (x.join(known, "__llm_hash", "left_anti").withColumn("__llm_copy", F.lit(0).cast("long"))
                          for x in (numbers, dealt))
        kept = hashed.join(known, "__llm_hash", "left_semi").groupBy("__llm_hash").agg(
            F.first(F.struct(*columns)).alias("__llm_record")).join(repeated, "__llm_hash")
        again = copies(kept)
        numbers = numbers.unionByName(copies(repeated))
        dealt = dealt.unionByName(again.select(*[F.col("__llm_record")[c].alias(c) for c in columns], "__llm_hash", "__llm_copy"))
    numbers, dealt = bucketed(numbers), bucketed(dealt)
    # The place of each bucket's first record in the order of all records.
    before = Window.orderBy("__llm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbers.groupBy("__llm_bucket").count().select(
        "__llm_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__llm_offset"))

    starts = [-(-k * n // shards) for k in range(shards)]
    schema = T.StructType([*(src.schema[c] for c in columns), T.StructField("shard", T.IntegerType()),
                           T.StructField("slot", T.LongType())])

    def shuffled(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("__llm_hash")
        order = np.arange(bucket.num_rows)
        number = bucket["__llm_bucket"][0].as_py()
        np.random.default_rng([seed, number]).shuffle(order)    # Fisher-Yates
        place = bucket["__llm_offset"][0].as_py() + np.arange(bucket.num_rows)
        shard = np.searchsorted(np.array(starts), place, side="right") - 1
        out = bucket.select(columns).take(order)
        return (out.append_column("shard", pa.array(shard.astype(np.int32)))
                .append_column("slot", pa.array(place - np.array(starts)[shard])))

    placed = dealt.join(staged(offsets, "shard-offsets"), "__llm_bucket")
    (placed.groupBy("__llm_bucket").applyInArrow(shuffled, schema)
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
    return df.sparkSession.read.schema(schema).parquet(path)


def op7_shard_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = shuffle_to_shards(docs, scratch_path(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return shards.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_shard_external_shuffle": op7_shard_external_shuffle}
ORACLES: dict[str, str] = {}
