"""Flagged tables by appended id files (J7, K14, W9): what is written, conflicts, old versions."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from skuflow.sinks import versions as vs


def _table(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").cast("string").alias("id"), F.lit("text " * 20).alias("description"),
                                      (F.col("id") % 10 == 0).alias("processed"))


def _ids(spark, *ids):
    return spark.createDataFrame([(str(i),) for i in ids], "id string")


def _size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def _done(spark, root, version=None):
    return {int(r["id"]) for r in vs.read(spark, root, version).filter("processed").collect()}


def test_flags_write_ids_only_and_old_versions_stay(spark, tmp):
    root = f"{tmp}/t"
    assert vs.create(_table(spark, 0, 5000), root) == 0
    data = _size(f"{root}/data")
    assert vs.flag(_ids(spark, 1, 2, 2, 99999), root, at=0) == 1
    assert _size(f"{root}/data") == data and _size(f"{root}/flags") < 0.05 * data + 4000
    tens = set(range(0, 5000, 10))
    assert _done(spark, root, 0) == tens and _done(spark, root) == tens | {1, 2}
    assert vs.flag(_ids(spark), root) == 2 and _done(spark, root) == tens | {1, 2}     # an empty set changes nothing
    assert vs.append(_table(spark, 5000, 5010), root) == 3 and vs.remove(_ids(spark, 1, 5001), root) == 4
    assert vs.read(spark, root).count() == 5008 and vs.read(spark, root, 3).count() == 5010
    before = sorted(map(tuple, vs.read(spark, root).collect()))
    assert vs.compact(spark, root) == 5 and sorted(map(tuple, vs.read(spark, root).collect())) == before
    assert vs.restore(spark, root, 1) == 6 and _done(spark, root) == tens | {1, 2}
    assert [r["rows"] for r in vs.history(spark, root).orderBy("version").collect()] == [5000, 5000, 5000, 5010, 5008, 5008, 5000]


def test_writers_conflict_or_repeat(spark, tmp):
    root = f"{tmp}/t"
    vs.create(_table(spark, 0, 100), root)
    with pytest.raises(vs.Conflict):
        vs.create(_table(spark, 0, 100), root)
    vs.append(_table(spark, 100, 110), root)
    assert vs.flag(_ids(spark, 1), root, at=0) == 2         # appended rows do not touch what version 0 showed
    with pytest.raises(vs.Conflict):
        vs.flag(_ids(spark, 1, 3), root, at=0)              # another run has consumed feedback since
    assert _done(spark, root) == {*range(0, 110, 10), 1}
    # Writers that state no version are all taken, one after another.
    with ThreadPoolExecutor(4) as pool:
        got = sorted(pool.map(lambda i: vs.flag(_ids(spark, i), root), (11, 12, 13, 14)))
    assert got == [3, 4, 5, 6] and {11, 12, 13, 14} <= _done(spark, root)
    # Of writers that start from the same version, one wins.
    def attempt(i):
        try:
            return vs.flag(_ids(spark, i), root, at=6)
        except vs.Conflict:
            return None
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(attempt, (21, 22, 23, 24)))
    assert sorted(x for x in got if x) == [7] and len(_done(spark, root) & {21, 22, 23, 24}) == 1


def test_prune_keeps_what_newer_versions_use(spark, tmp):
    root = f"{tmp}/t"
    vs.create(_table(spark, 0, 100), root)
    for i in (1, 2, 3):
        vs.flag(_ids(spark, i), root)
    staged = vs._stage(_ids(spark, 50), root, "flags")      # a commit under way
    assert vs.prune(spark, root, keep=2) == [0, 1] and vs.versions(spark, root) == [2, 3]
    assert _done(spark, root, 2) == {*range(0, 100, 10), 1, 2}
    vs.compact(spark, root)
    assert vs.prune(spark, root, keep=1) == [2, 3]
    assert len(os.listdir(f"{root}/data")) == 1 and os.listdir(f"{root}/flags") == [os.path.basename(staged)]
    assert _done(spark, root) == {*range(0, 100, 10), 1, 2, 3}


def test_empty_table(spark, tmp):
    root = f"{tmp}/t"
    vs.create(_table(spark, 0, 0), root)
    vs.flag(_ids(spark, 1), root)
    assert vs.read(spark, root).count() == 0
    vs.append(_table(spark, 0, 5), root)
    assert _done(spark, root) == {0, 1}
