"""Centroid clustering with Orchard's nearest-centroid search (operator 11).

Lloyd rounds over integer vectors. The centroids are few and bounded by a parameter; they and, for
each of them, the list of the others in order of their distance from it go to all tasks. A vector's
search walks the list of its current centroid: a centroid found closer is jumped to and its list is
walked from the start, a visited one is not computed again, and the walk stops where the list's
distance is strictly beyond twice the vector's (by the triangle inequality nothing behind can be as
close; equal distances are still reached, and the smaller number wins). Tasks walk the searches of a
slice of vectors in step, one list entry of each at a time.

A round reads the staged integer vectors once. Each task sums its vectors by centroid before anything
is shuffled, so a cluster, or a vector repeated in a third of all rows, costs one row a task and
component. Only the sums of the centroids reach the driver, which divides them exactly.

Defined cases: vectors that are null, of another length than ``dims``, or hold a null or non-finite
component take no part; fewer vectors than ``k`` give as many centroids as vectors; an empty table
gives no rows; rows without an id follow all others in the choice of the first centroids, rows
that share an id are ordered by their vectors; repeated rows each count and each are returned; other
columns are left out. Components whose squared distances could leave a long raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm.common import staged, table
from skuflow.llm.vectors import exact, finite, integers, limit_for, matrix

K, ROUNDS, DIMS, SEED = 40, 5, 64, 2
SLICE = 4096


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of the others by (distance, number), and their squared distances."""
    gaps = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    k = len(centroids)
    order = np.zeros((k, k - 1), np.int64)
    for c in range(k):
        near = np.lexsort((np.arange(k), gaps[c]))
        order[c] = near[near != c]
    return order, np.take_along_axis(gaps, order, axis=1)


def orchard(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, gaps: np.ndarray,
            counter: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row of ``x``; ties go to the smaller number.

    ``counter`` collects the number of distances computed in each step.
    """
    n, k = len(x), len(centroids)
    kind = exact(x, x.shape[1], centroids)
    x, centroids = x.astype(kind), centroids.astype(kind)
    current, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    dist = ((x - centroids[0]) ** 2).sum(axis=1).astype(np.int64)
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    live = np.arange(n) if k > 1 else np.zeros(0, np.int64)
    while len(live):
        c, p = current[live], at[live]
        on = (p < k - 1) & (gaps[c, np.minimum(p, k - 2)] <= 4 * dist[live])
        live, c, p = live[on], c[on], p[on]
        at[live] += 1
        there = order[c, p]
        new = ~visited[live, there]
        rows, there = live[new], there[new]
        visited[rows, there] = True
        found = x[rows] - centroids[there]
        found = np.einsum("ij,ij->i", found, found).astype(np.int64)
        if counter is not None:
            counter.append(len(rows))
        closer = (found < dist[rows]) | ((found == dist[rows]) & (there < current[rows]))
        rows = rows[closer]
        current[rows], dist[rows], at[rows] = there[closer], found[closer], 0
    return current, dist


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """Vectors with the smallest sha256 of ``seed:id``, in the order of the hash."""
    rows = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(),
                        "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def assign(kept: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    shared = kept.sparkSession.sparkContext.broadcast((centroids, *neighbour_lists(centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                cluster, dist = orchard(matrix(part.column(1), dims), *shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cluster.astype(np.int32)), pa.array(dist)],
                    names=["vec_id", "cluster", "distance"])

    id_type = kept.schema["vec_id"].dataType.simpleString()
    return kept.select("vec_id", "v").mapInArrow(run, f"vec_id {id_type}, cluster int, distance bigint")


def moved(kept: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The centroids after a round: exact floors of the means; empty clusters keep theirs."""
    shared = kept.sparkSession.sparkContext.broadcast((centroids, *neighbour_lists(centroids)))
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)    # the last column counts
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                x = matrix(batch.column(0).slice(lo, SLICE), dims)
                cluster, _ = orchard(x, *shared.value)
                by = np.argsort(cluster, kind="stable")
                own, starts, counts = np.unique(cluster[by], return_index=True, return_counts=True)
                total[own, :dims] += np.add.reduceat(x[by], starts, axis=0)
                total[own, dims] += counts
        own = np.flatnonzero(total[:, dims])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(own, dims + 1).astype(np.int32)),
             pa.array(np.tile(np.arange(dims + 1, dtype=np.int32), len(own))),
             pa.array(total[own].ravel())], names=["cluster", "component", "part"])

    sums = kept.select("v").mapInArrow(run, "cluster int, component int, part bigint").groupBy(
        "cluster", "component").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("whole")).collect()
    total = {(r.cluster, r.component): int(r.whole) for r in sums}
    out = centroids.copy()
    for c in {r.cluster for r in sums}:
        out[c] = [total[c, i] // total[c, dims] for i in range(dims)]
    return out


def cluster(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = K, rounds: int = ROUNDS,
            dims: int = DIMS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that takes part, final centroids)."""
    # 4 * dims * (2 * m) ** 2 must fit a long.
    ints = integers(df, vector, limit_for(16 * dims))
    kept = staged(df.where(finite(df[vector]) & (F.size(df[vector]) == dims)).select(
        df[vec_id].alias("vec_id"), ints.alias("v")), "centroid-vectors")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(kept, centroids, dims)
    return staged(assign(kept, centroids, dims), "centroid-assigned"), centroids


def op11_centroids_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    # One row a centroid; empty clusters have no vectors to return.
    own = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = spark.createDataFrame(
        [(c, s, sum(own.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
         for c, s in own.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Brute force: every vector against every centroid, rounds unrolled."""
    parts = [f"""kept AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {DIMS}
  AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {DIMS}),
comp AS (SELECT vec_id, unnest(range({DIMS})) AS i, unnest(v) AS x FROM kept),
c0 AS (SELECT rank - 1 AS c, i, x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) AS rank
  FROM kept) JOIN comp USING (vec_id) WHERE rank <= {K})"""]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS (SELECT vec_id, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (
  SELECT vec_id, c, sum((comp.x - c{r}.x) * (comp.x - c{r}.x)) AS d FROM comp JOIN c{r} USING (i) GROUP BY vec_id, c)
  GROUP BY vec_id)""")
        if r < ROUNDS:
            parts.append(f"""m{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM a{r} JOIN comp USING (vec_id) GROUP BY c, i),
c{r + 1} AS (SELECT c{r}.c, c{r}.i, CASE WHEN s IS NULL THEN c{r}.x
  ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c AND c{r}.i = m{r}.i)""")
    last = ROUNDS
    return f"""WITH {', '.join(parts)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c),
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, cluster_inertia,
  (SELECT CAST(sum(d) AS BIGINT) FROM a{last}) AS inertia, centroid_sha256
FROM a{last} JOIN t USING (c) JOIN h USING (c)"""


QUERIES = {"op11_centroids_orchard": op11_centroids_orchard}
ORACLES = {"op11_centroids_orchard": _oracle()}
