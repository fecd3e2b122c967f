"""WARC archives: writing with revisits, and boundary-chain verification when reading (operator 1).

Writing: each row is one record. Of rows with equal payloads (SHA-1), the one with the largest
id holds the payload (response); the others are revisit records that refer to it. Records are
built as column expressions and written by Spark's text writer whose line separator is the
record separator, so archives are committed like any other Spark output.

Reading: an archive is split at byte ranges, and a record's magic line may also stand inside a
payload. Tasks read the text between magics; every magic followed by a valid header is a
candidate and names its successor through its Content-Length. Inside a split, a task ties its
candidates into a forest (each points to its successor, the roots point out of the split) and
numbers it so that "x lies on the way from e" is an interval test. Across splits, pointer jumping
from each file's start over the (entry, exit) edges finds the one reachable entry of every split
in a logarithmic number of rounds. Only candidates on the way from a reachable entry are records;
magics inside payloads are never reached. Records whose payload holds a magic are put together
from their pieces in a second read of just those splits.

Defined cases: a null payload is empty; a null id is written empty and read as null, and counts
as smaller than any id; rows of one payload that share its largest id (repeated rows, or no ids)
are all responses; line breaks in a url are written as blanks. A chain that stops before the end
of its file yields the records up to there.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skuflow.llm.common import staged, table
from skuflow.session import scratch_path

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")
HEADERS = re.compile(rb"(?:[A-Za-z-]+: ?[^\r\n]*\r\n)+")
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(col):
    """Upper-case base32 SHA-1: 20 bits at a time, digits 0-V renamed to A-7."""
    digest = F.sha1(col)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(df: DataFrame, path: str, record_id: str = "page_id", url: str = "url",
                   payload: str = "html", min_revisit_bytes: int = 0) -> None:
    """One record per row of ``df`` in WARC files under ``path``."""
    body = F.coalesce(F.col(payload), F.lit(""))
    src = df.select(F.col(record_id).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                    body.alias("body"), F.octet_length(body).alias("bytes"),
                    base32_sha1(F.encode(body, "UTF-8")).alias("digest"))
    # One row per repeated payload; written, so that the planner knows its size when it joins.
    repeated = staged(src.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(
        F.max("id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeats")
    held = F.col("holder").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("holder")))

    def line(name: str, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def urn(col):
        return F.concat(F.lit("<urn:record:"), F.coalesce(col.cast("string"), F.lit("")), F.lit(">"))

    record = F.concat(
        F.lit(MAGIC.decode()), line("WARC-Type", F.when(held, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(held, line("WARC-Refers-To", urn(F.col("holder")))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(held, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"), F.when(held, "").otherwise(F.col("body")))
    src.join(repeated, "digest", "left").select(record.alias("value")).write.option("lineSep", END).text(path)


FOUND = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("split", T.LongType()),
    T.StructField("size", T.LongType()),            # bytes of the split's pieces, on its last row
    T.StructField("at", T.LongType()), T.StructField("next", T.LongType()), T.StructField("out", T.LongType()),
    T.StructField("number", T.LongType()), T.StructField("below", T.LongType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body_at", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("digest", T.StringType()), T.StructField("body", T.BinaryType())])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between magics, with the file and the start of the split they were read from."""
    return spark.read.option("lineSep", MAGIC.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"))


def parse(value: bytes) -> tuple[dict[str, str], int, int] | None:
    """(headers, offset of the body, Content-Length) if a valid header starts the piece."""
    end = value.find(b"\r\n\r\n")
    if end < 0 or not HEADERS.fullmatch(value, 0, end + 2):
        return None
    headers = {k.decode(): v.decode("utf-8", "replace") for k, v in HEADER.findall(value, 0, end + 2)}
    length = headers.get("Content-Length", "")
    if "WARC-Type" not in headers or not re.fullmatch("[0-9]{1,18}", length):
        return None
    return headers, end + 4, int(length)


def forest(at: list[int], following: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(exit, number, size of subtree) per candidate; x is on the way from e exactly if
    number[x] <= number[e] < number[x] + size[x]."""
    index = {a: i for i, a in enumerate(at)}
    up = [index.get(f, -1) for f in following]
    size = [1] * len(at)
    for i, u in enumerate(up):      # successors lie further on, so subtrees are complete here
        if u >= 0:
            size[u] += size[i]
    out, number, free = list(following), [0] * len(at), [0] * len(at)
    roots = 0
    for i in range(len(at) - 1, -1, -1):
        u = up[i]
        if u < 0:
            number[i] = roots
            roots += size[i]
        else:
            out[i] = out[u]
            number[i] = free[u]
            free[u] += size[i]
        free[i] = number[i] + 1
    return out, number, size


def candidates(spark: SparkSession, path: str, with_body: bool) -> DataFrame:
    """All candidates of all splits, offsets relative to the start of the split's first piece."""
    d = len(MAGIC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, place = None, [], 0

        def split_rows() -> pa.RecordBatch:
            out, number, size = forest([r[0] for r in rows], [r[1] for r in rows])
            n = len(rows)
            cols = [[key[0]] * (n + 1), [key[1]] * (n + 1), [None] * n + [place],
                    [r[0] for r in rows] + [None], [r[1] for r in rows] + [None], out + [None],
                    number + [None], size + [None], [list(r[2].items()) for r in rows] + [None],
                    [r[3] for r in rows] + [None], [r[4] for r in rows] + [None],
                    [r[5] for r in rows] + [None], [r[6] for r in rows] + [None]]
            types = [pa.string(), *[pa.int64()] * 7, pa.map_(pa.string(), pa.string()), pa.int64(), pa.int64(),
                     pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)],
                                              names=FOUND.names)

        for batch in batches:
            for file, split, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, split) != key:
                    if key:
                        yield split_rows()
                    key, rows, place = (file, split), [], 0
                got = parse(value) if split or place else None     # no magic before a file's first piece
                if got:
                    headers, start, length = got
                    whole = len(value) >= start + length
                    body = value[start:start + length] if whole else None
                    rows.append((place - d, place + start + length + 4, headers, start + d, length,
                                 base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else None,
                                 body if with_body else None))
                place += len(value) + d
        if key:
            yield split_rows()

    return pieces(spark, path).mapInArrow(run, FOUND)


def reachable_entries(edges: DataFrame) -> DataFrame:
    """Offsets reachable from offset 0 of their file over (file, at, out); pointer jumping."""
    reached = edges.where("at = 0").select("file", "at")
    jump = edges.join(edges.select("file", F.col("at").alias("out")), ["file", "out"], "left_semi").select(
        "file", "at", "out")
    jump = staged(jump, "warc-jump")
    while not jump.isEmpty():
        # After k rounds reached holds the first 2**k entries and jump leads 2**k entries on.
        reached = staged(reached.unionByName(reached.join(jump, ["file", "at"]).select(
            "file", F.col("out").alias("at"))), "warc-reached")
        jump = staged(jump.join(jump.select("file", F.col("at").alias("out"), F.col("out").alias("far")),
                                ["file", "out"]).select("file", "at", F.col("far").alias("out")), "warc-jump")
    return reached


def read_records(spark: SparkSession, path: str, with_body: bool = True) -> DataFrame:
    """file, at (offset), headers, length, digest and (with_body) body of every verified record."""
    found = staged(candidates(spark, path, with_body), "warc-candidates")
    by_file = Window.partitionBy("file").orderBy("split")
    bases = staged(found.where("size IS NOT NULL").select(
        "file", "split", "size", (F.sum("size").over(by_file) - F.col("size")).alias("base")), "warc-splits")
    placed = found.where("size IS NULL").drop("size").join(bases.drop("size"), ["file", "split"]).withColumns(
        {c: F.col(c) + F.col("base") for c in ("at", "next", "out")})
    # Entries: a file's start, and where some split's way out leads.
    targets = placed.select("file", F.col("out").alias("at")).distinct()
    starts = placed.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    edges = staged(placed.select("file", "at", "out").join(targets.union(starts).distinct(), ["file", "at"]),
                   "warc-edges")
    entries = reachable_entries(edges).join(
        placed.select("file", "split", "at", F.col("number").alias("entry")), ["file", "at"]).select(
        "file", "split", "entry")
    entries = staged(entries, "warc-entries")
    records = placed.join(entries, ["file", "split"]).where(
        "number <= entry AND entry < number + below").select(
        "file", "at", "headers", "body_at", "length", "digest", "body")
    spread = staged(records.where("digest IS NULL").select("file", "at", "headers", "body_at", "length"),
                    "warc-spread")
    whole = records.where("digest IS NOT NULL").drop("body_at")
    if not spread.isEmpty():
        whole = whole.unionByName(_put_together(spark, path, spread, bases, with_body))
    return whole if with_body else whole.drop("body")


def _put_together(spark: SparkSession, path: str, spread: DataFrame, bases: DataFrame,
                  with_body: bool) -> DataFrame:
    """Records whose body holds magics, from the pieces of the splits that they reach over."""
    d = len(MAGIC)
    span = spread.withColumns({"lo": F.col("at") + F.col("body_at"),
                               "hi": F.col("at") + F.col("body_at") + F.col("length")})
    over = staged(span.join(bases, "file").where("base - {0} < hi AND base + size > at".format(d)).select(
        "file", "split", "base", "at", "lo", "hi"), "warc-over")
    # A piece is kept with the magic before it; split starts are ordered like their pieces.
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("split", T.LongType()),
                           T.StructField("place", T.LongType()), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place = None, 0
        for batch in batches:
            places, values = [], []
            for file, split, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, split) != key:
                    key, place = (file, split), 0
                values.append((MAGIC if split or place else b"") + value)
                places.append(place - d if split or place else 0)
                place += len(value) + d
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.int64()),
                                              pa.array(values, pa.binary())], names=schema.names)

    # The read itself keeps its order; only pieces of splits in question go on.
    parts = pieces(spark, path).mapInArrow(run, schema).join(over, ["file", "split"]).withColumn(
        "place", F.col("place") + F.col("base")).where(
        "place < hi AND place + octet_length(bytes) > lo").withColumn(
        "bytes", F.expr("substring(bytes, cast(greatest(lo - place, 0) + 1 AS int), "
                        "cast(least(hi, place + octet_length(bytes)) - greatest(lo, place) AS int))"))
    body = F.aggregate(F.array_sort("parts"), F.lit(b""), lambda acc, x: F.concat(acc, x["bytes"]))
    joined = parts.groupBy("file", "at").agg(F.collect_list(F.struct("place", "bytes")).alias("parts")).select(
        "file", "at", body.alias("body"))
    out = spread.drop("body_at").join(joined, ["file", "at"], "left").withColumn(
        "body", F.coalesce("body", F.lit(b""))).where(F.octet_length("body") == F.col("length"))
    return out.withColumn("digest", base32_sha1(F.col("body"))).select(
        "file", "at", "headers", "length", "digest", "body" if with_body else F.lit(None).cast("binary").alias("body"))


def op1_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_records(spark, path, with_body=False)
    header = F.col("headers")
    revisit = header["WARC-Type"] == "revisit"

    def number(name: str):
        return F.regexp_extract(header[name], "<urn:record:(-?[0-9]+)>", 1).try_cast("long")

    return records.select(
        number("WARC-Record-ID").alias("page_id"),
        F.when(revisit, header["WARC-Payload-Length"].cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(header["WARC-Payload-Digest"], "^sha1:", "")).otherwise(
            F.col("digest")).alias("payload_digest"),
        header["WARC-Type"].alias("record_type"),
        F.when(revisit, number("WARC-Refers-To")).alias("refers_to"))


QUERIES = {"op1_warc_boundary_chain": op1_warc_boundary_chain}
ORACLES = {"op1_warc_boundary_chain": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER)
      >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM d
"""}
