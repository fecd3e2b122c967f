"""Class selection, deterministic splits and samples.

Randomness is replaced by ``md5(seed || '|' || id)`` so Spark and any SQL
engine produce the same split regardless of partitioning (``randomSplit`` and
``rand`` depend on partition layout).

The first ``k`` rows of a large group in hash order are found without ranking the group: the hash
space is cut into 65,536 buckets (first four hex digits of the md5), bucket counts are aggregated on
the map side, a cumulative sum over them finds the one bucket that holds the ``k``-th row, and only the
rows of that bucket are ranked, which gives the hash of the ``k``-th row. The split itself is a
comparison with that hash. The rows are read three times, and a class with a third of all rows is
ranked in one 65,536th of its rows.

Classes of at most ``RANKED`` rows, where nearly every row would be a bucket of its own, are ranked
as they are: their rows are shuffled once, and hashed only then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


HASH = "__h"
BUCKET = "__b"
_BUCKET_HEX = 4
RANKED = 50_000      # rows of a class that one task may rank


def hash_key(id_col: str, seed: int = 42) -> Column:
    """md5 of ``seed|id`` as a hex string; identical in Spark and DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def row_id(*cols: str) -> Column:
    """Deterministic row id: md5 of the '|'-joined fields (null as '')."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("|"))
        parts.append(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.md5(F.concat(*parts))


def select_frequent_classes(df: DataFrame, label: str = "referencia", min_examples: int = 10,
                            max_classes: int | None = 100) -> DataFrame:
    """Classes with at least ``min_examples`` rows, capped to the most frequent.

    Returns one row per selected class with its count ``n``. The cap is a
    global top-k (``TakeOrderedAndProject``); ties broken by label ascending.
    """
    counts = (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= min_examples))
    if max_classes is not None:
        counts = counts.orderBy(F.col("n").desc(), F.col(label).asc()).limit(max_classes)
    return counts


def keep_classes(df: DataFrame, classes: DataFrame, label: str = "referencia",
                 bounded_rows: int | None = None) -> DataFrame:
    """Keep rows whose class is in ``classes`` (left-semi join).

    A class list that its caller caps at ``bounded_rows`` (W3) is broadcast, limited to
    that many rows; otherwise AQE decides by the list's size.
    """
    keys = classes.select(label).distinct()
    keys = F.broadcast(keys.limit(bounded_rows)) if bounded_rows is not None else keys
    return df.join(keys, on=label, how="left_semi")


def min_examples_per_maker(df: DataFrame, maker: str = "maker", label: str = "referencia",
                           min_examples: int = 3, min_maker_rows: int = 100,
                           min_classes: int = 2) -> DataFrame:
    """Per-maker training rows.

    A maker needs ``min_maker_rows`` rows before filtering; within it a class
    needs ``min_examples`` rows; and at least ``min_classes`` classes must
    survive. Counts are group-bys (partial aggregation, skew-proof) joined back
    with a semi join on (maker, label), whose hash spreads a hot maker over
    many partitions (AQE splits a hot pair further).
    """
    pair = df.groupBy(maker, label).agg(F.count(F.lit(1)).alias("n"))
    per_maker = pair.groupBy(maker).agg(F.sum("n").alias("maker_rows"), F.count_if(F.col("n") >= min_examples).alias("classes"))
    ok_makers = per_maker.filter((F.col("maker_rows") >= min_maker_rows) & (F.col("classes") >= min_classes)).select(maker)
    keep = pair.filter(F.col("n") >= min_examples).join(ok_makers, maker, "left_semi").select(maker, label)
    return df.join(keep, [maker, label], "left_semi")


def _with_hash(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    h = hash_key(id_col, seed)
    return df.withColumn(HASH, h).withColumn(BUCKET, F.substring(F.col(HASH), 1, _BUCKET_HEX))


def _boundary(hashed: DataFrame, keys: list[str], take: Column) -> DataFrame:
    """One row per group: the bucket that holds its ``take``-th row and that row's place in it.

    Counts per (group, bucket) are aggregated on the map side; the cumulative sum runs over at
    most 65,536 rows per group. ``take`` is an expression over the group's row count ``__n``.
    """
    counts = hashed.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__bn"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (counts.withColumn("__n", F.sum("__bn").over(group))
              .withColumn("__before", F.sum("__bn").over(upto) - F.col("__bn")).withColumn("__k", take))
    return placed.filter((F.col("__before") < F.col("__k")) & (F.col("__k") <= F.col("__before") + F.col("__bn"))
                         ).select(*keys, BUCKET, (F.col("__k") - F.col("__before")).alias("__need"))


def _group_cuts(hashed: DataFrame, keys: list[str], take: Column) -> DataFrame:
    """One row per group: the hash of its ``take``-th row (groups that take none have no row)."""
    inside = hashed.select(*keys, BUCKET, HASH).join(_boundary(hashed, keys, take), [*keys, BUCKET])
    rank = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(HASH))
    return inside.withColumn("__rank", rank).filter(F.col("__rank") == F.col("__need")).select(
        *keys, F.col(HASH).alias("__cut"))


def _total_cut(hashed: DataFrame, take: Column) -> Column:
    """The hash of the ``take``-th row of all rows, as a scalar subquery (null if none is taken)."""
    bound = _boundary(hashed, [], take)
    inside = hashed.filter(F.col(BUCKET) == bound.select(BUCKET).scalar()).select(BUCKET, HASH)
    rank = F.row_number().over(Window.partitionBy(BUCKET).orderBy(HASH))
    return inside.withColumn("__rank", rank).filter(
        F.col("__rank") == bound.select("__need").scalar()).select(HASH).scalar()


def stratified_split(df: DataFrame, label: str = "referencia", id_col: str = "row_id",
                     test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds boolean ``is_test``; per class exactly ``round(test_fraction * n)`` test rows.

    A class with a single row therefore stays in train.
    """
    take = F.floor(F.col("__n") * F.lit(test_fraction) + F.lit(0.5))
    # At most rows / RANKED classes; asked for at once, as most inputs have none.
    large = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > RANKED).select(
        F.col(label).alias("__large"))
    if large.isEmpty():
        return _ranked_split(df, label, id_col, take, seed)
    is_large = F.col(label).eqNullSafe(F.col("__large"))
    return _ranked_split(df.join(F.broadcast(large), is_large, "left_anti"), label, id_col, take, seed).unionByName(
        _bucket_split(df.join(F.broadcast(large), is_large, "left_semi"), label, id_col, take, seed))


def _ranked_split(df: DataFrame, label: str, id_col: str, take: Column, seed: int) -> DataFrame:
    """``stratified_split`` of classes that a task can rank: one shuffle, of the rows without their hashes."""
    group = Window.partitionBy(label)
    ranked = df.repartition(F.col(label)).withColumn(HASH, hash_key(id_col, seed)).withColumn(
        "__n", F.count(F.lit(1)).over(group)).withColumn("__rank", F.row_number().over(group.orderBy(HASH)))
    cut = F.max(F.when(F.col("__rank") == take, F.col(HASH))).over(group)
    inside = F.coalesce(F.col(label).isNotNull() & (F.col(HASH) <= cut), F.lit(False))
    return ranked.select(*df.columns, inside.alias("is_test"))


def _bucket_split(df: DataFrame, label: str, id_col: str, take: Column, seed: int) -> DataFrame:
    """``stratified_split`` of classes of any size, none of them ranked whole."""
    cuts = _group_cuts(_with_hash(df, id_col, seed), [label], take)
    inside = F.coalesce(hash_key(id_col, seed) <= F.col("__cut"), F.lit(False))
    return df.join(cuts, label, "left").select(*df.columns, inside.alias("is_test"))


def plain_split(df: DataFrame, id_col: str = "row_id", test_fraction: float = 0.2,
                seed: int = 42) -> DataFrame:
    """Adds ``is_test``; exactly ``ceil(test_fraction * n)`` rows in md5 order are test."""
    hashed = _with_hash(df, id_col, seed)
    cut = _total_cut(hashed, F.ceil(F.col("__n") * F.lit(test_fraction)))
    return hashed.select(*df.columns, F.coalesce(F.col(HASH) <= cut, F.lit(False)).alias("is_test"))


def seeded_sample(df: DataFrame, n: int, id_col: str = "row_id", seed: int = 42,
                  fraction_cap: float | None = None) -> DataFrame:
    """The ``n`` rows first in md5 order (optionally ``min(n, fraction_cap * rows)``).

    A fixed ``n`` is a global top-k (per-partition heaps, no full sort). With a
    fraction cap the count depends on the data, so the bucketed cut is used.
    """
    if fraction_cap is None:
        return (df.withColumn(HASH, hash_key(id_col, seed)).orderBy(HASH).limit(n).drop(HASH))
    hashed = _with_hash(df, id_col, seed)
    take = F.least(F.lit(n), F.floor(F.col("__n") * F.lit(fraction_cap)))
    return hashed.filter(F.col(HASH) <= _total_cut(hashed, take)).select(*df.columns)


def class_weight_table(df: DataFrame, label: str = "referencia") -> DataFrame:
    """Balanced weight ``n / (k * n_c)`` per class (n rows, k classes, n_c class rows)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    # One row of totals, joined to the one row per class (the input is read once; the exchange is reused).
    total = counts.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"))
    return counts.join(F.broadcast(total)).select(
        label, (F.col("__n").cast("double") / (F.col("__k") * F.col("__nc"))).alias("weight"))
