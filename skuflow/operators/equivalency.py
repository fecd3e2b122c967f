"""Groups of interchangeable SKUs from pairs.

Catalogues state that one part number replaces or equals another; the groups are the connected
components of these pairs. Stars are formed in turn around larger and smaller neighbours, which halves
the length of a chain every round, so 1,000 links need about a dozen rounds. A round aggregates the least
neighbour per SKU (map-side combined) and joins it to the edges; no neighbourhood is ever gathered in
one row or task, so a SKU with very many partners is only a key that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.session import delete_path, scratch_path


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a written table: short lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour that is larger than the SKU is linked to the least of the SKU's neighbours and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour, and the SKU itself, is linked to the least one. Edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (linked.unionByName(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct())


def sku_groups(pairs: DataFrame, left: str = "sku_a", right: str = "sku_b") -> DataFrame:
    """(referencia, sku_group): every SKU that occurs in a pair with the least SKU of its component.

    A pair with a null is no link and adds no SKU; a pair of a SKU with itself gives a group of one.
    """
    known = pairs.select(F.col(left).alias("u"), F.col(right).alias("v")).dropna()
    known, given = _written(known, "sku-pairs")
    links = known.filter(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, path = _written(links, "sku-edges")
    used = [given]
    before = None
    while True:
        used.append(path)
        # Stars that no longer change are the components: same number of edges and same sum of hashes.
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        edges, path = _written(_small_star(_large_star(edges)), "sku-edges")
    # The last edges are stars around the least SKU; a SKU without an edge is its own group.
    skus = known.select(F.explode(F.array("u", "v")).alias("referencia")).distinct()
    stars = edges.select(F.col("u").alias("referencia"), F.col("v").alias("__least"))
    groups, _ = _written(skus.join(stars, "referencia", "left").select(
        "referencia", F.coalesce("__least", "referencia").alias("sku_group")), "sku-groups")
    for p in used:
        delete_path(edges.sparkSession, p)
    return groups


def extend_groups(groups: DataFrame, pairs: DataFrame, left: str = "sku_a", right: str = "sku_b") -> DataFrame:
    """Groups after more pairs have arrived; the same as ``sku_groups`` of all pairs so far.

    Only the groups that the new pairs touch take part in the search: a pair becomes a pair of group
    names, and the names' groups are then applied to the old members. Groups are (referencia, sku_group).
    """
    def named(column: str, out: str) -> DataFrame:
        return groups.select(F.col("referencia").alias(column), F.col("sku_group").alias(out))

    new = pairs.select(F.col(left).alias("__a"), F.col(right).alias("__b")).dropna()
    new = (new.join(named("__a", "__ga"), "__a", "left").join(named("__b", "__gb"), "__b", "left")
           .withColumn("__ga", F.coalesce("__ga", "__a")).withColumn("__gb", F.coalesce("__gb", "__b")))
    merged = sku_groups(new, "__ga", "__gb").select(F.col("referencia").alias("__name"), F.col("sku_group").alias("__to"))
    old = (groups.join(merged, groups["sku_group"] == merged["__name"], "left")
           .select("referencia", F.coalesce("__to", "sku_group").alias("sku_group")))
    # Names that the old groups do not have are SKUs seen for the first time.
    first_seen = (merged.join(groups.select(F.col("referencia").alias("__name")), "__name", "left_anti")
                  .select(F.col("__name").alias("referencia"), F.col("__to").alias("sku_group")))
    return old.unionByName(first_seen)
