"""A table whose rows are flagged and removed by appended id files.

A row's id never changes and is never used twice. Under ``root``, ``data/`` holds Parquet
folders of rows, ``flags/`` and ``removed/`` folders of ids, and ``manifest/`` one JSON line a
version that names the folders it consists of. No folder is ever rewritten: setting the flag of a
few rows writes their ids, and every version that still has a manifest can be read.

A commit writes its folders first and then claims the next version number; only one writer can
claim a number (a link on a local folder, else a rename, which must not replace a file: true of
HDFS, not of every object store). Without ``at``, appends, flags and removals are repeated on the newest version, as
their order does not matter. With ``at`` (the version whose rows the caller used), a change that
others committed since then raises ``Conflict``, except appended rows. ``compact`` and
``restore`` never repeat.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.session import delete_path, local_path

PARTS = ("data", "flags", "removed")


class Conflict(RuntimeError):
    """Another writer changed the table after the version that this change is based on."""


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def versions(spark: SparkSession, root: str) -> list[int]:
    """Version numbers that can be read, oldest first."""
    fs, folder = _fs(spark, f"{root}/manifest")
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[:-len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, root: str, version: int) -> dict:
    fs, path = _fs(spark, f"{root}/manifest/{version:010d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _claim(spark: SparkSession, root: str, version: int, content: dict) -> bool:
    """Put the manifest of ``version`` in place unless another writer has; true if it is ours."""
    target = f"{root}/manifest/{version:010d}.json"
    temp = f"{root}/manifest/.{uuid.uuid4().hex}"
    fs, jtemp = _fs(spark, temp)
    fs.mkdirs(jtemp.getParent())
    if fs.getScheme() == "file":    # a rename would replace the file, a link does not
        temp, target = local_path(temp), local_path(target)
        with open(temp, "w", encoding="utf-8") as f:
            f.write(json.dumps(content))
        try:
            os.link(temp, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(temp)
    out = fs.create(jtemp, True)
    out.write(bytearray(json.dumps(content), "utf-8"))
    out.close()
    try:
        return bool(fs.rename(jtemp, _fs(spark, target)[1]))    # false if the target exists
    finally:
        fs.delete(jtemp, False)


def _stage(rows: DataFrame, root: str, part: str) -> str:
    name = f"{part}/{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{name}")
    return name


def create(table: DataFrame, root: str) -> int:
    """Version 0: the rows of ``table``, which has columns ``id`` and ``processed``."""
    content = {"action": "create", "schema": table.schema.json(), "data": [_stage(table, root, "data")], "flags": [],
               "removed": []}
    if not _claim(table.sparkSession, root, 0, content):
        raise Conflict(f"{root} already holds a table")
    return 0


def _commit(spark: SparkSession, root: str, action: str, change, at: int | None, again: bool) -> int:
    """Claim the next version with ``change(newest manifest)`` and return its number."""
    base = at
    while True:
        newest = versions(spark, root)[-1]
        if base is not None:
            since = [manifest(spark, root, v)["action"] for v in range(base + 1, newest + 1)]
            if [a for a in since if not (again and a == "append")]:
                raise Conflict(f"version {base} of {root} was changed by {', '.join(since)}")
        elif not again:
            base = newest
        content = {**change(manifest(spark, root, newest)), "action": action}
        if _claim(spark, root, newest + 1, content):
            return newest + 1


def append(rows: DataFrame, root: str) -> int:
    """New rows with ids that the table has never had."""
    spark = rows.sparkSession
    schema = T.StructType.fromJson(json.loads(manifest(spark, root, versions(spark, root)[-1])["schema"]))
    part = _stage(rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]), root, "data")
    return _commit(spark, root, "append", lambda m: {**m, "data": [*m["data"], part]}, None, True)


def flag(ids: DataFrame, root: str, at: int | None = None) -> int:
    """Set ``processed`` of the rows with these ids; writes the ids only."""
    part = _stage(ids.select("id").distinct(), root, "flags")
    return _commit(ids.sparkSession, root, "flag", lambda m: {**m, "flags": [*m["flags"], part]}, at, True)


def remove(ids: DataFrame, root: str, at: int | None = None) -> int:
    """Take the rows with these ids out of the table; writes the ids only."""
    part = _stage(ids.select("id").distinct(), root, "removed")
    return _commit(ids.sparkSession, root, "remove", lambda m: {**m, "removed": [*m["removed"], part]}, at, True)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of ``version`` (the newest one by default).

    The id files are a lookup whose size AQE measures: broadcast while small, else a join on the id.
    """
    m = manifest(spark, root, versions(spark, root)[-1] if version is None else version)
    schema = T.StructType.fromJson(json.loads(m["schema"]))
    rows = spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in m["data"]])

    def ids(part: str) -> DataFrame:
        key = T.StructType([schema["id"]])
        return spark.read.schema(key).parquet(*[f"{root}/{p}" for p in m[part]]).distinct()

    if m["removed"]:
        rows = rows.join(ids("removed"), "id", "left_anti")
    if m["flags"]:
        done = ids("flags").select("id", F.lit(True).alias("__done"))
        rows = (rows.join(done, "id", "left")
                .withColumn("processed", F.coalesce("__done", F.lit(False)) | F.col("processed")))
    return rows.select(*schema.names)


def compact(spark: SparkSession, root: str) -> int:
    """The newest version as one data folder without id files; older versions stay readable."""
    at = versions(spark, root)[-1]
    part = _stage(read(spark, root, at), root, "data")
    return _commit(spark, root, "compact", lambda m: {**m, "data": [part], "flags": [], "removed": []}, at, False)


def restore(spark: SparkSession, root: str, version: int) -> int:
    """A new version with the rows and flags of an old one; no row is written."""
    old = manifest(spark, root, version)
    return _commit(spark, root, f"restore {version}", lambda m: {**old}, None, False)


def history(spark: SparkSession, root: str) -> DataFrame:
    """(version, action, rows, unprocessed) of every version that can be read."""
    parts = []
    for v in versions(spark, root):
        action = manifest(spark, root, v)["action"]
        parts.append(read(spark, root, v).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("processed")).alias(
            "unprocessed")).select(F.lit(v).alias("version"), F.lit(action).alias("action"), "rows", "unprocessed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prune(spark: SparkSession, root: str, keep: int = 10) -> list[int]:
    """Drop all but the ``keep`` newest versions and the folders that only they used.

    Folders of a commit that has no manifest yet are in none of the dropped ones, so they stay.
    """
    every = versions(spark, root)
    old, kept = every[:-keep], every[-keep:]
    used = {p for v in kept for part in PARTS for p in manifest(spark, root, v)[part]}
    gone = {p for v in old for part in PARTS for p in manifest(spark, root, v)[part]} - used
    for v in old:
        delete_path(spark, f"{root}/manifest/{v:010d}.json")
    for p in sorted(gone):
        delete_path(spark, f"{root}/{p}")
    return old
