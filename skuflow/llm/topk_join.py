"""Exact top-k search by a Voronoi join (operator 12).

Pivots are a bounded sample of the rows. Every query and every data row belongs to the cell of its
nearest pivot. A summary of the queries, one row a pair of pivots, gives for each query cell i and
data cell j the largest inner product of a query of i with pivot j, the longest query of i, and the
least score that any query of i reaches for sure: its (k + 1)-th best among the pivots, which are rows
themselves (one of them may be the query). For a row s of cell j at distance e from its pivot

    <q, s> = <q, p_j> + <q, s - p_j> <= max <q, p_j> + |q| * e,

so s can matter to cell i only if e reaches (sure score - max <q, p_j>) / |q|. A row is replicated to
just those groups of query cells that it can matter to. Small query cells are merged into groups, large
ones cut into blocks of bounded size; data meet a block in chunks of bounded size, so a task never
holds more than one block and one chunk, whatever cell is hot or however often a vector is repeated.
Blocks and chunks are solved locally: inner products by matrix products, again only of rows within a
query cell's bound, in exact integer arithmetic. The k best of each chunk are then ranked per query.

The result does not depend on the pivots. Where the data has no structure (random directions) the bounds
exclude little and the work is that of all queries against all rows, in blocks.

Defined cases: vectors that are null or hold a null or non-finite component take no part; shorter
vectors count as padded with zeros; a row is identified as a row, so repeated rows are candidates of
each other; a null id is never a query and comes last in ties; no query or no other row gives no
result rows; other columns are left out. Scores that could leave a long raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuflow.llm.common import staged, table
from skuflow.llm.vectors import exact, finite, integers, limit_for, matrix

K = 5
QUERY_STEP = 50
LEAST_PIVOTS, MOST_PIVOTS = 16, 512
BLOCK_ITEMS = 1 << 16        # components of the queries of one block
CHUNK_ITEMS = 1 << 19        # components of the rows of one chunk
SLAB = 2048                  # rows of one matrix product


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact as int64 or as float64."""
    kind = exact(a, a.shape[1], b)
    return a.astype(kind) @ b.astype(kind).T


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest pivot, distance to it)."""
    square = (pivots.astype(np.float64) ** 2).sum(axis=1)
    j = np.argmin(square[None, :] - 2 * (x.astype(np.float64) @ pivots.T.astype(np.float64)), axis=1)
    return j, np.sqrt(((x - pivots[j]).astype(np.float64) ** 2).sum(axis=1))


def best(queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, data_rows: np.ndarray,
         k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, place in data) of the k best rows of each query but its own; ties to the smaller place."""
    n = len(queries)
    q = place = np.zeros(0, np.int64)
    score = np.zeros(0, np.int64)
    bar = np.full(n, -np.inf)
    for lo in range(0, len(data), SLAB):
        s = products(queries, data[lo:lo + SLAB])
        own = query_rows[:, None] == data_rows[None, lo:lo + SLAB]
        least = np.full(n, -np.inf)
        if s.shape[1] > k + 1:      # one of the k + 1 best may be the query itself
            least = np.partition(s, s.shape[1] - k - 1, axis=1)[:, -k - 1]
        # Rows come in the order of ties, so a later slab must beat the k-th best so far.
        take = (s >= least[:, None]) & (s > bar[:, None]) & ~own
        a, b = np.nonzero(take)
        q, place, score = (np.concatenate(x) for x in (
            (q, a), (place, b + lo), (score, s[a, b].astype(np.int64))))
        by = np.lexsort((place, -score, q))
        q, place, score = q[by], place[by], score[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        bar[q[rank == k - 1]] = score[rank == k - 1]
        q, place, score = q[rank < k], place[rank < k], score[rank < k]
    return q, score, place


def query_cells(queries: DataFrame, pivots: np.ndarray, rows: np.ndarray, dims: int, k: int) -> DataFrame:
    """``queries`` (row, vec_id, v) with their cell, length and sure score (null: none)."""
    shared = queries.sparkSession.sparkContext.broadcast((pivots, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, rows = shared.value
        for batch in batches:
            x = matrix(batch.column(2), dims)
            cell, _ = nearest(x, pivots)
            sure = pa.nulls(len(x), pa.int64())
            if len(rows) > k and len(x):
                s = products(x, rows)
                sure = pa.array(np.partition(s, s.shape[1] - k - 1, axis=1)[:, -k - 1].astype(np.int64))
            length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(cell.astype(np.int32)), sure,
                 pa.array(length)], names=["row", "vec_id", "v", "cell", "sure", "length"])

    return queries.mapInArrow(run, queries.select("row", "vec_id", "v").schema.simpleString()[7:-1]
                              + ", cell int, sure bigint, length double")


def summaries(queries: DataFrame, pivots: np.ndarray, dims: int) -> tuple[dict[int, int], np.ndarray]:
    """(queries of each cell, least distance from pivot j at which a row matters to cell i)."""
    shared = queries.sparkSession.sparkContext.broadcast(pivots)
    m = len(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column(0).to_numpy()
            s = products(matrix(batch.column(1), dims), shared.value).astype(np.int64)
            for i in np.unique(cells).tolist():
                here = s[cells == i].max(axis=0)
                top[i] = np.maximum(top[i], here) if i in top else here
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array([*top], np.int32), m)), pa.array(np.tile(np.arange(m, dtype=np.int32), len(top))),
             pa.array(np.concatenate([*top.values(), np.zeros(0, np.int64)]).astype(np.int64))], names=["cell", "pivot", "top"])

    # At most one row a pair of pivots.
    tops = queries.select("cell", "v").mapInArrow(run, "cell int, pivot int, top bigint").groupBy(
        "cell", "pivot").agg(F.max("top").alias("top")).collect()
    facts = queries.groupBy("cell").agg(F.count("*").alias("n"), F.min(F.coalesce("sure", F.lit(-2 ** 63))).alias("sure"),
                                        F.max("length").alias("length")).collect()
    top = np.zeros((m, m))
    for r in tops:
        top[r.cell, r.pivot] = r.top
    need = np.full((m, m), np.inf)          # cells without queries need nothing
    for r in facts:
        if r.sure == -2 ** 63 or r.length == 0:
            need[r.cell] = -np.inf
        else:
            need[r.cell] = (r.sure - top[r.cell]) / r.length
            need[r.cell] -= 1e-6 * (1 + np.abs(need[r.cell]))    # rounding never excludes a row
    return {r.cell: r.n for r in facts}, need


def grouped(counts: dict[int, int], block: int) -> tuple[dict[int, int], list[tuple[int, int, int]]]:
    """(group of each cell, [(group, first block, blocks)]): small cells share a group, large ones get several blocks."""
    group_of, groups, held, first = {}, [], 0, 0
    for cell in sorted(counts):
        if not groups or held + counts[cell] > block:
            groups.append([cell])
            held = 0
        else:
            groups[-1].append(cell)
        held += counts[cell]
        group_of[cell] = len(groups) - 1
    out = []
    for g, cells in enumerate(groups):
        blocks = math.ceil(sum(counts[c] for c in cells) / block)
        out.append((g, first, blocks))
        first += blocks
    return group_of, out


def replicated(rows: DataFrame, pivots: np.ndarray, need: np.ndarray, dims: int) -> DataFrame:
    """``rows`` with their pivot, the distance to it and the groups that they matter to (need by group)."""
    shared = rows.sparkSession.sparkContext.broadcast((pivots, need))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, need = shared.value
        for batch in batches:
            pivot, far = nearest(matrix(batch.column(2), dims), pivots)
            at, group = np.nonzero(far[:, None] >= need.T[pivot])
            offsets = np.searchsorted(at, np.arange(len(far) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(pivot.astype(np.int32)), pa.array(far),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(group.astype(np.int32)))],
                names=["row", "vec_id", "v", "pivot", "far", "groups"])

    return rows.mapInArrow(run, rows.select("row", "vec_id", "v").schema.simpleString()[7:-1]
                           + ", pivot int, far double, groups array<int>")


def top_k(df: DataFrame, is_query: Column, vector: str = "embedding", vec_id: str = "vec_id", k: int = K,
          pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product with each query row.

    ``is_query`` is a condition on ``df``; candidates are all rows but the query's own.
    """
    spark = df.sparkSession
    rows = staged(df.where(finite(df[vector])).select(
        F.monotonically_increasing_id().alias("row"), df[vec_id].alias("vec_id"),
        integers(df, vector, limit_for(4)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")), "topk-rows")
    id_type = rows.schema["vec_id"].dataType.simpleString()
    n, asking, dims = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not asking:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score bigint")
    dims = max(dims, 1)
    top = rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0] or 0
    if top > limit_for(dims):
        raise ValueError(f"scores of {dims} components up to {top} could leave a long")
    many = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(asking)))
    sample = rows.orderBy(F.xxhash64("row")).limit(many).select("v").collect()
    sample = np.array([[*r.v, *[0] * (dims - len(r.v))] for r in sample], np.int64)
    centres = np.unique(sample, axis=0)

    queries = staged(query_cells(rows.where("asks").select("row", "vec_id", "v"), centres, sample, dims, k), "topk-queries")
    counts, need = summaries(queries, centres, dims)
    group_of, groups = grouped(counts, max(1, BLOCK_ITEMS // dims))
    group_need = np.stack([need[[c for c in group_of if group_of[c] == g]].min(axis=0) for g, _, _ in groups])
    chunks = math.ceil(n / max(1, CHUNK_ITEMS // dims))

    by_cell = spark.createDataFrame([(c, *groups[g][1:]) for c, g in group_of.items()],
                                    "cell int, first long, blocks long")
    by_group = spark.createDataFrame(groups, "group int, first long, blocks long")
    asked = queries.join(F.broadcast(by_cell), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("row"), "blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "row", "vec_id", "v", "cell")
    data = replicated(rows.select("row", "vec_id", "v"), centres, group_need, dims)
    data = data.select("row", "vec_id", "v", "pivot", "far", F.explode("groups").alias("group")).join(
        F.broadcast(by_group), "group").select(
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), "row", "vec_id", "v", "pivot", "far")
    bounds = spark.sparkContext.broadcast(need)

    def solve(asked: pa.Table, data: pa.Table) -> pa.Table:
        data = data.sort_by([("vec_id", "ascending")])       # nulls come last
        x, y = matrix(asked["v"], dims), matrix(data["v"], dims)
        asked_rows, data_rows, cells = (t.to_numpy() for t in (asked["row"], data["row"], asked["cell"]))
        pivot, far = data["pivot"].to_numpy(), data["far"].to_numpy()
        at, of, scores = [], [], []
        for cell in np.unique(cells) if len(y) else ():
            inside = np.flatnonzero(far >= bounds.value[cell][pivot])
            own = np.flatnonzero(cells == cell)
            q, score, place = best(x[own], asked_rows[own], y[inside], data_rows[inside], k)
            at.append(own[q])
            of.append(inside[place])
            scores.append(score)
        at, of, scores = (np.concatenate([*part, np.zeros(0, np.int64)]).astype(np.int64) for part in (at, of, scores))
        return pa.table({"query_row": asked["row"].take(pa.array(at)), "query_id": asked["vec_id"].take(pa.array(at)),
                         "vec_id": data["vec_id"].take(pa.array(of)), "score": pa.array(scores)})

    found = asked.groupBy("block", "chunk").cogroup(data.groupBy("block", "chunk")).applyInArrow(
        solve, f"query_row bigint, query_id {id_type}, vec_id {id_type}, score bigint")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op12_topk_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors["vec_id"] % QUERY_STEP == 0)


QUERIES = {"op12_topk_voronoi": op12_topk_voronoi}
ORACLES = {"op12_topk_voronoi": f"""
WITH kept AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
comp AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM kept),
pairs AS (SELECT q.vec_id AS query_id, s.vec_id, CAST(sum(q.x * s.x) AS BIGINT) AS score
  FROM comp q JOIN comp s USING (i) WHERE q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> s.vec_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {K}"""}
