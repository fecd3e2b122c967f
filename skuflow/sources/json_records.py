"""Records of large JSON files, several tasks a file (S1): a top-level array, one object, or objects one after another.

A file is cut into byte ranges. Where a range starts (inside a string? how deep?) depends on all bytes
before it, so that is found in two passes. Pass one: each range reports what it does to the state, for
both possible starts: whether its quotes change inside/outside, and the sum of its brackets outside
strings. Whether a quote is escaped depends only on the backslashes just before it. The ranges of a file,
in order, then give every range its start state. Pass two: each range finds the borders of top-level
elements in its bytes and hands on the elements that begin in it, reading past its end for the last one.

A record's position, the byte where it begins, does not depend on how files are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuflow.sources import ranges
from skuflow.sources.log_files import path_of

SPLIT_BYTES = 32 << 20
HEAD_BYTES = 4096       # of a file, to tell an array
QUOTE, BACKSLASH, COMMA = 34, 92, 44
OPEN, CLOSE = (91, 123), (93, 125)      # [ { and ] }


def backslashes_before(uri: str, at: int) -> int:
    """Number of backslashes that end just before byte ``at``."""
    n, hi = 0, at
    while hi > 0:
        lo = max(0, hi - 4096)
        block = b"".join(ranges.blocks(uri, lo, hi))
        kept = len(block.rstrip(b"\\"))
        n += len(block) - kept
        if kept:
            break
        hi = lo
    return n


def marks(block: bytes, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(bytes, positions of unescaped quotes, of brackets and commas, backslashes at the end) of a block.

    ``run`` is the number of backslashes just before the block.
    """
    x = np.frombuffer(block, np.uint8)
    quotes = np.flatnonzero(x == QUOTE)
    plain = np.flatnonzero(x != BACKSLASH)
    # The last other byte before each quote tells how many backslashes stand before it.
    k = np.searchsorted(plain, quotes) - 1
    before = quotes - 1 - np.where(k >= 0, plain[np.maximum(k, 0)], -1 - run)
    quotes = quotes[before % 2 == 0]
    signs = np.flatnonzero((x == OPEN[0]) | (x == OPEN[1]) | (x == CLOSE[0]) | (x == CLOSE[1]) | (x == COMMA))
    end = len(x) - 1 - int(plain[-1]) if len(plain) else len(x) + run
    return x, quotes, signs, end


def steps(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """+1 for an opening bracket, -1 for a closing one, 0 for a comma."""
    c = x[signs]
    return np.isin(c, OPEN).astype(np.int64) - np.isin(c, CLOSE).astype(np.int64)


def effect(uri: str, lo: int, hi: int) -> tuple[int, int, int]:
    """(parity of quotes, depth gained from a start outside strings, from one inside) of a range."""
    run, parity, gained = backslashes_before(uri, lo), 0, [0, 0]
    for block in ranges.blocks(uri, lo, hi):
        x, quotes, signs, run = marks(block, run)
        inside = (np.searchsorted(quotes, signs) + parity) % 2
        step = steps(x, signs)
        gained[0] += int(step[inside == 0].sum())
        gained[1] += int(step[inside == 1].sum())
        parity = (parity + len(quotes)) % 2
    return parity, *gained


def is_array(uri: str) -> bool:
    for block in ranges.blocks(uri, 0, size=HEAD_BYTES):
        text = block.lstrip(b"\xef\xbb\xbf \t\r\n")
        if text:
            return text[:1] == b"["
    return False


def elements(uri: str, lo: int, hi: int, inside: int, depth: int, array: bool) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of the top-level elements that begin in lo to hi - 1.

    In an array an element follows the opening bracket or a comma at depth one; else it is an object at
    depth zero. An element that the file ends in is handed on as far as it goes.
    """
    run, at, began = backslashes_before(uri, lo), lo, None
    held = bytearray()
    # Blocks no larger than the range: what lies past its end is read only for the last element.
    for block in ranges.blocks(uri, lo, size=max(1, min(ranges.BLOCK, hi - lo))):
        x, quotes, signs, run = marks(block, run)
        signs = signs[(np.searchsorted(quotes, signs) + inside) % 2 == 0]
        inside = (inside + len(quotes)) % 2
        step = steps(x, signs)
        after = depth + np.cumsum(step)
        depth = int(after[-1]) if len(after) else depth
        opens, closes = (step == 1) & (after == 1), (step == -1) & (after == 0)
        borders = opens | closes | ((step == 0) & (after == 1) if array else False)
        done = 0        # bytes of the block that are in held or not wanted
        for place, starts, ends in zip(signs[borders].tolist(), (~closes if array else opens)[borders].tolist(),
                                       (~opens if array else closes)[borders].tolist()):
            if ends and began is not None:
                held += block[done:place + (not array)]
                yield began, bytes(held)
                began = None
                held.clear()
            if starts:
                if at + place >= hi:
                    return
                began, done = at + place + array, place + array
        if began is not None:
            held += block[done:]
        elif at + len(block) >= hi:
            return
        at += len(block)
    if began is not None:
        yield began, bytes(held)


def read_json_records(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, position, value): the JSON text of every record of the files at or under ``path``."""
    found = [(path_of(path, file), size) for file, size in ranges.listing(path) if size]
    files = spark.createDataFrame(found, "file string, size long")
    # Ranges may be small; a task takes as many as make up SPLIT_BYTES, if that leaves a task for every core.
    cut = sum(-(-size // split_bytes) for _, size in found)
    full = -(-sum(size for _, size in found) // max(split_bytes, SPLIT_BYTES))
    tasks = max(1, min(cut, max(full, spark.sparkContext.defaultParallelism)))
    parts = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes))).alias(
        "lo")).select("file", "lo", F.least(F.col("lo") + split_bytes, "size").alias("hi")).repartition(tasks, "file", "lo")

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [effect(r["file"], r["lo"], r["hi"]) for r in batch.to_pylist()]
            parity, outside, inside = (list(c) for c in zip(*got))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in (parity, outside, inside))],
                                             names=["file", "lo", "hi", "parity", "outside", "inside"])

    # The ranges of a file in order: a few numbers for each.
    changes = parts.mapInArrow(effects, "file string, lo long, hi long, parity long, outside long, inside long")
    before = Window.partitionBy("file").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    begun = changes.withColumn("within", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2).withColumn(
        "gained", F.when(F.col("within") == 0, F.col("outside")).otherwise(F.col("inside"))).select(
        "file", "lo", "hi", "within", F.coalesce(F.sum("gained").over(before), F.lit(0)).alias("depth")).repartition(
        tasks, "file", "lo")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                places, texts, size = [], [], 0

                def out() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(places), pa.string()), pa.array(places, pa.int64()),
                                                       pa.array(texts, pa.string())], names=["file", "position", "value"])

                array = is_array(r["file"])
                for place, text in elements(r["file"], r["lo"], r["hi"], r["within"], r["depth"], array):
                    bare = text.lstrip(b" \t\r\n")
                    if not bare:        # an empty array, or a comma too many
                        continue
                    places.append(place + len(text) - len(bare))
                    texts.append(bare.rstrip(b" \t\r\n").decode("utf-8", "replace"))
                    size += len(text)
                    if size > 4 << 20:
                        yield out()
                        places.clear()
                        texts.clear()
                        size = 0
                if places:
                    yield out()

    return begun.mapInArrow(records, "file string, position long, value string")
