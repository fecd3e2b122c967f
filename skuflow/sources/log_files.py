"""Log files read from their last positions (S10, ST1): one Python data source, batch and streaming.

A position is kept per file: the bytes read so far, always after a line break, and checksums of the
file's first 1, 2, 4, ... 1024 bytes. A file is read on from its position; it is read from its start
when it is shorter than the position (truncated) or when its first bytes are others (rotated, or
truncated and grown again). A line without its break yet waits for it. A file that is gone is
forgotten. In a stream the positions are the offsets of Spark's checkpoint, so a restarted query
continues where the last committed batch ended and a repeated batch reads the same bytes.

The driver looks at the first KB and the last line break of each file; tasks read byte ranges of at
most ``splitBytes``, so one large file is read by many tasks. Options: ``path`` (folders
``log_name=<name>/``), ``positions`` (batch: JSON of ``positions()`` to start from), ``splitBytes``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from skuflow.sources import ranges

SPLIT_BYTES = 64 << 20
HEAD_BYTES = 1024
ROWS = 8192
SCHEMA = "log_name string, line string, file string, position bigint"


def positions(root: str) -> dict:
    """{file: {"size": bytes up to the last line break, "head": checksums of its first bytes}} of now."""
    out = {}
    for path, size in ranges.listing(root):
        end = ranges.last_break(path_of(root, path), size)
        if end:
            first, n, sums = ranges.head(path_of(root, path), min(end, HEAD_BYTES)), 1, []
            while n <= len(first):
                sums.append(zlib.crc32(first[:n]))
                n *= 2
            out[path] = {"size": end, "head": sums}
    return out


def path_of(root: str, path: str) -> str:
    """A listed path with the scheme of ``root``."""
    scheme = re.match(r"[a-z0-9]+://", root)
    return scheme[0] + path if scheme and not root.startswith("file:") else path


def begin(old: dict | None, new: dict) -> int:
    """Where to read a file on, from its old position (None: not seen) and its new one."""
    if not old or new["size"] < old["size"]:
        return 0
    both = min(len(old["head"]), len(new["head"]))
    return old["size"] if old["head"][:both] == new["head"][:both] else 0


@dataclass
class Range(InputPartition):
    file: str
    lo: int
    hi: int


def changed(root: str, old: dict, new: dict, split: int) -> list[Range]:
    out = []
    for path, now in new.items():
        for lo in range(begin(old.get(path), now), now["size"], split):
            out.append(Range(path_of(root, path), lo, min(lo + split, now["size"])))
    return out


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    name = re.search(r"log_name=([^/]+)", part.file)
    schema = pa.schema([("log_name", pa.string()), ("line", pa.string()), ("file", pa.string()), ("position", pa.int64())])
    places: list[int] = []
    texts: list[str] = []

    def batch() -> pa.RecordBatch:
        n = len(places)
        return pa.RecordBatch.from_arrays([pa.array([name and name[1]] * n, pa.string()), pa.array(texts, pa.string()),
                                           pa.array([part.file] * n, pa.string()), pa.array(places, pa.int64())], schema=schema)

    for place, line in ranges.lines(part.file, part.lo, part.hi):
        places.append(place)
        texts.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
        if len(places) == ROWS:
            yield batch()
            places.clear()
            texts.clear()
    if places:
        yield batch()


class LogFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStream(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.old, self.new = (json.loads(options.get(k, "{}")) for k in ("positions", "upto"))

    def partitions(self) -> list[Range]:
        return changed(self.root, self.old, self.new or positions(self.root), self.split) or [Range(self.root, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return read_range(part) if part.hi else iter(())


class LogStream(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.root, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return positions(self.root)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return changed(self.root, start, end, self.split) or [Range(self.root, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return read_range(part) if part.hi else iter(())


def read_new_lines(spark: SparkSession, root: str, old: dict | None = None,
                   split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, dict]:
    """Lines written since the positions ``old`` (None: all), and the positions to go on from."""
    spark.dataSource.register(LogFiles)
    new = positions(root)
    return (spark.read.format("log_files").option("path", root).option("positions", json.dumps(old or {}))
            .option("upto", json.dumps(new)).option("splitBytes", split_bytes).load()), new


def stream_new_lines(spark: SparkSession, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """ST1: the same as a stream; positions are its offsets.

    Python sources do not plan ``availableNow`` themselves; Spark's wrapper gives such a run its last
    batch without data, in which closed windows are emitted.
    """
    spark.dataSource.register(LogFiles)
    spark.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", "true")
    return spark.readStream.format("log_files").option("path", root).option("splitBytes", split_bytes).load()
