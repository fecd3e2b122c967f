"""Stored profiles (A5/A6): merged sketches against exact counts."""

import os

import pytest
from pyspark.sql import functions as F

from skuflow.operators import profile as pf


def _rows(spark, lo, hi):
    return spark.range(lo, hi).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("SKU"),
                                      F.when(F.col("id") % 7 != 0, F.col("id") % 50).alias("maker"))


def _got(df):
    return {r["metric"]: (r["value"], r["bound"]) for r in df.collect()}


def test_unions_of_arrivals(spark, tmp):
    path = f"{tmp}/p"
    for i, (lo, hi) in enumerate([(0, 40_000), (30_000, 60_000), (60_000, 60_000)]):
        pf.store_profile(_rows(spark, lo, hi), path, f"a{i}", ("SKU", "maker", "model"))
    pf.store_profile(_rows(spark, 30_000, 60_000), path, "a1", ("SKU", "maker"))       # again: replaced
    for cond, rows, skus in ((None, 70_000, 60_000), (F.col("arrival") == "a1", 30_000, 30_000),
                             (F.col("arrival") == "a2", 0, 0), (F.col("arrival") == "none", 0, None)):
        got = _got(pf.stored_profile(spark, path, cond))
        assert got["rows"] == (rows, 0)
        if skus is None:
            assert set(got) == {"rows"}
            continue
        value, bound = got["distinct_SKU"]
        assert abs(value - skus) <= bound <= 0.03 * skus + 1 and got["distinct_maker"][0] == (50 if skus else 0)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)
    assert size < 200_000
    with pytest.raises(ValueError):
        pf.store_profile(_rows(spark, 0, 1), path, "../x")


def test_exact_where_the_bound_is_too_wide(spark, tmp):
    rows = _rows(spark, 0, 30_000)
    pf.store_profile(rows, f"{tmp}/p", "a", ("SKU", "maker"))
    got = _got(pf.stored_profile(spark, f"{tmp}/p", None, 5, rows))
    assert got == {"rows": (30_000, 0), "distinct_SKU": (30_000, 0), "distinct_maker": (50, 2)}
