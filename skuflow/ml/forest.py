"""Random forests over many classes (M15): node statistics are kept sparse.

spark.ml's trees keep a dense class x feature x bin table for every node they split, so with
thousands of classes few nodes fit in a pass. Here a statistic exists only where a row has one:
(tree, node, feature, bin, class). The forest is the same: bootstrap rows, sqrt(features) drawn
for every node, at most 32 bins a feature, Gini, all trees to ``max_depth``.

* Rows of equal features, label and weight are one row with a count; a bag takes Poisson(count) copies
  of it, which is what the bags of the single rows hold together.
* A forest of at most ``LOCAL_ROWS`` such rows is grown by tasks of ``NODES_A_TASK`` trees, each of which
  gets the rows once and draws its trees' bags from them.
* In larger forests, nodes with more rows than that in their bag are split level by level: tasks count
  their rows, Spark sums the counts, and one group a node takes the best split. The rows of smaller nodes
  are shuffled to their (tree, node), and a task grows the rest of it.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skuflow.session import scratch_path

MAX_BINS = 32
LOCAL_ROWS, NODES_A_TASK = 500_000, 4
LARGE_LEAF, BLOCK = 16, 1 << 21      # classes of a leaf that is added as a whole; cells of a block of scores
TOP, CLOSE = 256, 1e-9               # classes tried first for the best one; sums of shares that are added up again in order
PIECES = "tree int, node int, y binary, n binary, w binary, cells binary, f binary, b binary"
WHOLE = "part int, id binary, y binary, w binary, n binary, cells binary, f binary, b binary"
COUNTS = "tree int, node int, f int, b int, y int, n double, w double"
NODES = "tree int, nodes array<int>, feature array<int>, cut array<double>, size array<int>, classes array<int>, shares array<double>"
SPLITS = "tree int, node int, feature int, bin int, n_left double, n_right double, classes array<int>, shares array<double>"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary(),
             "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


@lru_cache(maxsize=None)
def _poisson(bit: int) -> tuple[int, np.ndarray]:
    """(least k, running probabilities from it on) of a Poisson number of mean 2 ** bit; what is left out has less than 1e-20."""
    mean = float(1 << bit)
    k = np.arange(max(0, int(mean - 10 * mean ** 0.5)), int(mean + 12 * mean ** 0.5) + 15)
    return int(k[0]), np.cumsum(np.exp(k * math.log(mean) - mean - np.array([math.lgamma(x + 1.0) for x in k.tolist()])))


def copies(seed: int, tree: int, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Copies in the bag of ``tree`` of each id, which stands for ``rows`` equal rows, by a hash of the id.

    Poisson(1) a row: a count's binary digits are drawn one by one, for Poisson numbers add up.
    """
    out = np.zeros(len(ids))
    for bit in range(int(rows.max()).bit_length() if len(rows) else 0):
        use = np.flatnonzero(rows >> bit & 1)
        with np.errstate(over="ignore"):
            x = ids[use].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 1_000_003 + tree + 1 + (bit << 40)) * np.uint64(0xD1B54A32D192ED03)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            x ^= x >> np.uint64(31)
        least, upto = _poisson(bit)
        out[use] += least + np.searchsorted(upto, (x >> np.uint64(11)).astype(float) * 2.0 ** -53, side="right")
    return out


def draw(rng, nodes: int, n: int, m: int) -> np.ndarray:
    """``m`` of ``n`` features for each of ``nodes`` nodes, without repetition (Floyd)."""
    out = np.empty((nodes, m), np.int64)
    for i, j in enumerate(range(n - m, n)):
        t = rng.integers(0, j + 1, nodes)
        out[:, i] = np.where((out[:, :i] == t[:, None]).any(axis=1), j, t)
    return out


def summed(keys: np.ndarray, *values):
    """(sorted distinct keys, sums of the values)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(v[order], first) if len(keys) else v[:0] for v in values]


def running(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running sums within the runs of ``groups``."""
    total = np.cumsum(values)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    return total - np.repeat((total - values)[first], np.diff(np.r_[first, len(groups)]))


class Spec:
    """What all tasks of a fit know: sizes, limits and the bins' cuts."""

    def __init__(self, cuts: np.ndarray, n_classes: int, trees: int, max_depth: int, min_rows: int, seed: int):
        self.cuts, self.n_classes, self.trees, self.max_depth, self.min_rows, self.seed = cuts, n_classes, trees, max_depth, min_rows, seed
        self.n_features = len(cuts)
        self.m = int(np.ceil(np.sqrt(self.n_features)))
        self.zero = (cuts < 0).sum(axis=1)           # the bin of an absent value

    def drawn(self, rng, n: int) -> np.ndarray:
        return draw(rng, n, self.n_features, self.m)

    def bins(self, f: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(f), np.uint8)
        for i in range(0, len(f), 1 << 16):
            out[i:i + (1 << 16)] = (self.cuts[f[i:i + (1 << 16)]] < v[i:i + (1 << 16), None]).sum(axis=1)
        return out

    def right(self, split_f, split_b, node, row, f, b) -> np.ndarray:
        """Whether each row goes right at its node's split; ``row`` is the row of each present value."""
        mine = split_f[node]
        bins = self.zero[mine]
        hit = f == mine[row]
        bins[row[hit]] = b[hit]
        return bins > split_b[node]


def best_splits(spec: Spec, k: int, totals, counts):
    """The best split of ``k`` nodes: (feature or -1, bin: at most that goes left, rows left, rows right).

    ``totals``: (key node * classes + class, n, w), sorted; ``counts``: (node, f, b, class, n, w) of the drawn features.
    Bins are scanned from the outermost to the absent values' bin, which needs no counts of its own.
    """
    feature, cut, n_left, n_right = np.full(k, -1), np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
    C, node_key = spec.n_classes, totals[0] // spec.n_classes
    n_all, w_all = np.bincount(node_key, totals[1], k), np.bincount(node_key, totals[2], k)
    square = np.bincount(node_key, totals[2] ** 2, k)
    node, f, b, y, n, w = counts
    far = b.astype(np.int64) - spec.zero[f]
    use = far != 0
    node, f, far, y, n, w = node[use], f[use], far[use], y[use], n[use], w[use]
    if not len(node):
        return feature, cut, n_left, n_right
    slot = (node * spec.n_features + f) * 2 + (far > 0)
    key, n, w = summed((slot * C + y) * MAX_BINS + (MAX_BINS - 1 - np.abs(far)), n, w)
    of_class, bin_ = key // MAX_BINS, key % MAX_BINS
    before = running(of_class, w) - w
    slot, y = of_class // C, of_class % C
    of_node = totals[2][np.searchsorted(totals[0], slot // (2 * spec.n_features) * C + y)]
    key, d2, dot, n, w = summed(slot * MAX_BINS + bin_, (2 * before + w) * w, of_node * w, n, w)
    slot, far = key // MAX_BINS, MAX_BINS - 1 - key % MAX_BINS
    out2, dot, n, w = (running(slot, x) for x in (d2, dot, n, w))
    node = slot // (2 * spec.n_features)
    rest_n, rest_w = n_all[node] - n, w_all[node] - w
    ok = (n >= spec.min_rows) & (rest_n >= spec.min_rows) & (w > 0) & (rest_w > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = out2 / w + (square[node] - 2 * dot + out2) / rest_w
        ok &= score > square[node] / w_all[node] + 1e-9 * w_all[node]
    at = np.flatnonzero(ok)
    at = at[np.lexsort((at, -score[at], node[at]))]
    at = at[np.r_[True, node[at][1:] != node[at][:-1]]] if len(at) else at
    to, up = node[at], slot[at] % 2 == 1
    feature[to] = slot[at] // 2 % spec.n_features
    cut[to] = np.where(up, spec.zero[feature[to]] + far[at] - 1, spec.zero[feature[to]] - far[at])
    n_left[to], n_right[to] = np.where(up, rest_n[at], n[at]), np.where(up, n[at], rest_n[at])
    return feature, cut, n_left, n_right


def splittable(spec: Spec, k: int, totals, depth: int) -> np.ndarray:
    """Nodes that are neither pure nor too small nor at the last level."""
    node = totals[0] // spec.n_classes
    some = totals[2] > 0
    return (np.bincount(node[some], minlength=k) > 1) & (np.bincount(node, totals[1], k) >= 2 * spec.min_rows) & (depth < spec.max_depth)


def leaf_shares(spec: Spec, totals, leaf: np.ndarray):
    """(classes of each leaf, class, share) of the nodes marked in ``leaf``, node after node."""
    node = totals[0] // spec.n_classes
    w_all = np.bincount(node, totals[2], len(leaf))
    use = leaf[node] & ((totals[2] > 0) | (w_all[node] <= 0))
    node, y, w = node[use], totals[0][use] % spec.n_classes, totals[2][use]
    size = np.bincount(node, minlength=len(leaf))
    return size, y, np.where(w_all[node] > 0, w / np.where(w_all[node] > 0, w_all[node], 1.0), 1.0 / size[node])


def alike(cells: np.ndarray, f: np.ndarray, b: np.ndarray):
    """(unit of each row, unit of each present value, feature, bin): rows of the same bins are one unit, which no split parts."""
    start = np.cumsum(cells) - cells
    row = np.repeat(np.arange(len(cells)), cells)
    with np.errstate(over="ignore"):
        x = (f.astype(np.uint64) << np.uint64(8) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        sums = np.zeros(len(cells), np.uint64)
        some = cells > 0
        sums[some] = np.add.reduceat(x ^ (x >> np.uint64(32)), start[some]) if some.any() else 0
    _, first, unit = np.unique(sums, return_index=True, return_inverse=True)
    like = first[unit]
    own = start[like][row] + np.arange(len(f)) - start[row]
    if (cells[like] != cells).any() or (f[own] != f).any() or (b[own] != b).any():      # unequal rows of one hash
        first, unit = np.arange(len(cells)), np.arange(len(cells))
    held = np.zeros(len(cells), bool)
    held[first] = True
    use = held[row]
    return unit, unit[row[use]], f[use], b[use]


def grow(spec: Spec, tree: int, first: int, y, n, w, unit, of_cell, f, b) -> dict:
    """The tree below node ``first`` from all rows of it, level by level; ``of_cell``, ``f`` and ``b`` are the units' present values.

    Rows are kept in the order of their nodes and classes, so that their sums need no sort.
    """
    rng = np.random.default_rng([spec.seed, tree, first])
    ids, depth, C = np.array([first]), first.bit_length() - 1, spec.n_classes
    order = np.argsort(unit, kind="stable")
    in_units = (y[order], n[order], w[order])
    many = np.bincount(unit, minlength=int(max(unit.max(initial=-1), of_cell.max(initial=-1))) + 1)
    start, node_of = np.cumsum(many) - many, np.zeros(len(many), np.int64)
    order = np.argsort(y, kind="stable")
    y, n, w, unit, node = y[order], n[order], w[order], unit[order], np.zeros(len(y), np.int64)
    out = {c: [] for c in ("nodes", "feature", "cut", "size", "classes", "shares")}
    while len(ids):
        k = len(ids)
        key = node * C + y
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        totals = key[new], np.add.reduceat(n, new), np.add.reduceat(w, new)
        go = np.flatnonzero(splittable(spec, k, totals, depth))
        feature, cut = np.full(k, -1), np.zeros(k, np.int64)
        if len(go):
            drawn = np.zeros((k, spec.n_features), bool)
            drawn[go[:, None], spec.drawn(rng, len(go))] = True
            at = np.flatnonzero(drawn[node_of[of_cell], f])
            u = of_cell[at]
            rows = many[u]
            r = np.repeat(start[u] - (np.cumsum(rows) - rows), rows) + np.arange(rows.sum())
            feature, cut, _, _ = best_splits(spec, k, totals, (
                *[np.repeat(x, rows) for x in (node_of[u], f[at], b[at])], *[x[r] for x in in_units]))
        leaf = feature < 0
        size, classes, shares = leaf_shares(spec, totals, leaf)
        out["nodes"].append(ids), out["feature"].append(feature), out["size"].append(size)
        out["cut"].append(np.where(leaf, 0.0, spec.cuts[np.where(leaf, 0, feature), cut]))
        out["classes"].append(classes), out["shares"].append(shares)
        keep = ~leaf[node_of]
        place = np.cumsum(keep) - 1
        kept = keep[of_cell]
        of_cell, f, b = place[of_cell[kept]], f[kept], b[kept]
        many, start = many[keep], start[keep]
        rank = np.cumsum(~leaf) - 1
        node_of = node_of[keep]
        node_of = 2 * rank[node_of] + spec.right(feature, cut, node_of, of_cell, f, b)
        keep = np.flatnonzero(~leaf[node])
        unit = place[unit[keep]]
        node = node_of[unit]
        # Small integers are sorted by their digits.
        order = np.argsort(node.astype(np.uint16) if 2 * k <= 1 << 16 else node, kind="stable")
        node, unit, keep = node[order], unit[order], keep[order]
        y, n, w = y[keep], n[keep], w[keep]
        ids = np.repeat(2 * ids[~leaf], 2) + np.tile([0, 1], int((~leaf).sum()))
        depth += 1
    return {c: np.concatenate(x) for c, x in out.items()}


class Top:
    """The splits found so far for the nodes of the first levels; ``open`` nodes are still to be grown."""

    def __init__(self, trees: int, rows: float):
        self.splits: dict = {t: {} for t in range(trees)}
        self.open: dict = {(t, 1): rows for t in range(trees)}
        self.leaves: list = []

    def big(self) -> set:
        return {k for k, n in self.open.items() if n > LOCAL_ROWS}

    def nodes(self, spec: Spec, tree: int, row, f, b, n_rows: int) -> np.ndarray:
        node, splits = np.ones(n_rows, np.int64), self.splits[tree]
        if splits:
            size = max(splits) + 1
            split_f, split_b = np.full(size, -1), np.zeros(size, np.int64)
            for i, (sf, sb) in splits.items():
                split_f[i], split_b[i] = sf, sb
            for _ in range(size.bit_length()):
                at = np.minimum(node, size - 1)
                inner = (node < size) & (split_f[at] >= 0)
                if not inner.any():
                    break
                node = np.where(inner, 2 * node + spec.right(split_f, split_b, at, row, f, b), node)
        return node


def _cells(spec: Spec, batch):
    """(id, y, w, n, cells of each row, feature and bin of each cell) of a batch of rows."""
    f = batch.column("f").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    return (*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "y", "w", "n")], np.diff(batch.column("f").offsets.to_numpy()),
            f, spec.bins(f, batch.column("v").flatten().to_numpy(zero_copy_only=False)))


def _bags(spec: Spec, top: Top, batch, wanted: set):
    """(tree, node, rows, cells, ...) of the wanted nodes' bags in a batch of rows."""
    ids, y, w, rows, cells, f, b = _cells(spec, batch)
    row = np.repeat(np.arange(len(ids)), cells)
    for t in sorted({t for t, _ in wanted}):
        n = copies(spec.seed, t, ids, rows)
        node = top.nodes(spec, t, row, f, b, len(ids))
        node[n == 0] = 0
        order = np.argsort(node, kind="stable")
        found, start = np.unique(node[order], return_index=True)
        of_cell = node[row]
        cell_order = np.argsort(of_cell, kind="stable")
        cell_start = np.searchsorted(of_cell[cell_order], found)
        for i, mine, use in zip(found.tolist(), np.split(order, start[1:]), np.split(cell_order, cell_start[1:])):
            if (t, i) in wanted:
                yield t, i, y[mine], n[mine], n[mine] * w[mine], cells[mine], f[use], b[use]


def _joined(table: pa.Table, c: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)])


def _grown_trees(spec: Spec, parts: int, key, table: pa.Table) -> pa.Table:
    """The trees of a part, from all rows of the forest."""
    ids, y, w, rows = (_joined(table, c, k) for c, k in (("id", np.int64), ("y", np.int32), ("w", float), ("n", np.int64)))
    cells, f, b = (_joined(table, c, k) for c, k in (("cells", np.int32), ("f", np.int32), ("b", np.uint8)))
    y = y.astype(np.int64)
    unit, *values = alike(cells, f, b)
    out = {c: [] for c in ("tree", "nodes", "feature", "cut", "size", "classes", "shares")}
    for t in range(int(key[0].as_py()), spec.trees, parts):
        n = copies(spec.seed, t, ids, rows)
        bag = np.flatnonzero(n)
        if not len(bag):
            continue            # as without a piece: a tree without a root
        for c, x in {"tree": t, **grow(spec, t, 1, y[bag], n[bag], n[bag] * w[bag], unit[bag], *values)}.items():
            out[c].append(x)
    return pa.Table.from_pydict(out, schema=_arrow(NODES))


def _dealt(spec: Spec, parts: int, batches):
    """Every part gets all rows."""
    schema = _arrow(WHOLE)
    for batch in batches:
        if batch.num_rows:
            ids, y, w, n, cells, f, b = _cells(spec, batch)
            whole = [x.astype(k).tobytes() for x, k in ((ids, np.int64), (y, np.int32), (w, float), (n, np.int64), (cells, np.int32), (f, np.int32), (b, np.uint8))]
            for i in range(parts):
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip([i, *whole], schema)], schema=schema)


def _grown(spec: Spec, key, table: pa.Table) -> pa.Table:
    tree, node = (int(k.as_py()) for k in key)
    y, cells = _joined(table, "y", np.int32).astype(np.int64), _joined(table, "cells", np.int32)
    out = grow(spec, tree, node, y, _joined(table, "n", float), _joined(table, "w", float),
               *alike(cells, _joined(table, "f", np.int32), _joined(table, "b", np.uint8)))
    return pa.Table.from_pydict({"tree": [tree], **{c: [v] for c, v in out.items()}}, schema=_arrow(NODES))


def _chosen(spec: Spec, key, table: pa.Table) -> pa.Table:
    tree, node = (int(k.as_py()) for k in key)
    f, b, y, n, w = (table.column(c).to_numpy() for c in ("f", "b", "y", "n", "w"))
    own = f < 0
    totals = summed(y[own].astype(np.int64), n[own], w[own])
    feature = np.array([-1])
    cut, n_left, n_right = (np.zeros(1) for _ in range(3))
    if splittable(spec, 1, totals, node.bit_length() - 1)[0]:
        use = ~own
        feature, cut, n_left, n_right = best_splits(spec, 1, totals, (
            np.zeros(int(use.sum()), np.int64), f[use].astype(np.int64), b[use], y[use].astype(np.int64), n[use], w[use]))
    _, classes, shares = leaf_shares(spec, totals, feature < 0)
    return pa.Table.from_pydict({"tree": [tree], "node": [node], "feature": feature, "bin": cut.astype(int), "n_left": n_left,
                                 "n_right": n_right, "classes": [classes], "shares": [shares]}, schema=_arrow(SPLITS))


def _count(spec: Spec, top: Top, wanted: set, batches):
    schema = _arrow(COUNTS)
    for batch in batches:
        for t, i, y, n, w, cells, f, b in _bags(spec, top, batch, wanted):
            drawn = np.zeros(spec.n_features, bool)
            drawn[spec.drawn(np.random.default_rng([spec.seed, t, i]), 1)[0]] = i.bit_length() - 1 < spec.max_depth
            at = np.flatnonzero(drawn[f])
            r = np.repeat(np.arange(len(y)), cells)[at]
            # The totals of the node stand under feature -1.
            keys = np.r_[y.astype(np.int64), ((f[at] + 1).astype(np.int64) * MAX_BINS + b[at]) * spec.n_classes + y[r]]
            keys, n, w = summed(keys, np.r_[n, n[r]], np.r_[w, w[r]])
            fb = keys // spec.n_classes
            yield pa.RecordBatch.from_pydict({
                "tree": np.full(len(keys), t, np.int32), "node": np.full(len(keys), i, np.int32),
                "f": (fb // MAX_BINS - 1).astype(np.int32), "b": (fb % MAX_BINS).astype(np.int32),
                "y": (keys % spec.n_classes).astype(np.int32), "n": n, "w": w}, schema=schema)


def _pack(spec: Spec, top: Top, wanted: set, batches):
    schema = _arrow(PIECES)
    for batch in batches:
        for t, i, y, n, w, cells, f, b in _bags(spec, top, batch, wanted):
            # Values follow the batch's row order, as rows do: the sort by node is stable.
            yield pa.RecordBatch.from_pydict({"tree": [t], "node": [i], "y": [y.astype(np.int32).tobytes()], "n": [n.tobytes()], "w": [w.tobytes()],
                                              "cells": [cells.astype(np.int32).tobytes()], "f": [f.tobytes()], "b": [b.tobytes()]}, schema=schema)


def bin_cuts(rows: DataFrame, n_features: int) -> np.ndarray:
    """Ascending cuts of each feature, filled up with infinity: zero and quantiles of the present values."""
    cells = rows.select("n", F.explode(F.arrays_zip("f", "v")).alias("c")).select("n", "c.f", "c.v").filter("v <> 0")
    values = cells.groupBy("f", "v").agg(F.sum("n").alias("n"))
    of_feature, parts = Window.partitionBy("f"), MAX_BINS - 2
    values = values.withColumn("upto", F.sum("n").over(of_feature.orderBy("v"))).withColumn("total", F.sum("n").over(of_feature))
    # The first value, those in which another share of the rows is reached, and the last one.
    kept = values.filter(f"upto = n or upto = total or upto * {parts} div total > (upto - n) * {parts} div total")
    found = kept.groupBy("f").agg(F.collect_list("v").alias("q"), F.max("v").alias("top")).collect()
    cuts = np.full((n_features, MAX_BINS - 1), np.inf)
    for r in found:
        mine = sorted(x for x in {0.0, *r["q"]} if x < max(0.0, r["top"]))
        cuts[r["f"], :len(mine)] = mine
    return cuts


def _per_node(function, held):
    def run(key, table):
        return function(held.value[0], key, table)
    return run


def grow_forest(rows: DataFrame, spec: Spec) -> DataFrame:
    """Nodes of all trees from ``rows`` (id, y, w, n, f, v), which are read several times."""
    spark = rows.sparkSession
    count = rows.count()
    if count <= LOCAL_ROWS:
        parts = -(-spec.trees // NODES_A_TASK)
        held = spark.sparkContext.broadcast((spec, parts))
        whole = rows.mapInArrow(lambda it: _dealt(*held.value, it), WHOLE).repartition(parts, "part")
        return whole.groupBy("part").applyInArrow(lambda key, table: _grown_trees(*held.value, key, table), NODES)
    top = Top(spec.trees, count)
    while wanted := top.big():
        held = spark.sparkContext.broadcast((spec, top, wanted))
        counts = rows.mapInArrow(lambda it, held=held: _count(*held.value, it), COUNTS)
        counts = counts.groupBy("tree", "node", "f", "b", "y").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        best = counts.groupBy("tree", "node").applyInArrow(_per_node(_chosen, held), SPLITS).collect()
        for k in wanted:
            top.open.pop(k)
        for r in best:
            if r["feature"] < 0:
                top.leaves.append((r["tree"], r["node"], r["classes"], r["shares"]))
            else:
                top.splits[r["tree"]][r["node"]] = (r["feature"], r["bin"])
                top.open[r["tree"], 2 * r["node"]], top.open[r["tree"], 2 * r["node"] + 1] = r["n_left"], r["n_right"]
    held = spark.sparkContext.broadcast((spec, top, set(top.open)))
    pieces = rows.mapInArrow(lambda it: _pack(*held.value, it), PIECES)
    # A few nodes a task: by bytes alone, all trees of a small forest would be grown by one.
    pieces = pieces.repartition(-(-len(top.open) // NODES_A_TASK) or 1, "tree", "node")
    grown = pieces.groupBy("tree", "node").applyInArrow(_per_node(_grown, held), NODES)
    upper = [(t, [i], [sf], [float(spec.cuts[sf, sb])], [0], [], []) for t, s in top.splits.items() for i, (sf, sb) in s.items()]
    upper += [(t, [i], [-1], [0.0], [len(c)], c, s) for t, i, c, s in top.leaves]
    return grown.unionByName(spark.createDataFrame(upper, NODES)) if upper else grown


class Trees:
    """The fitted nodes as arrays, for scoring."""

    def __init__(self, table: pa.Table):
        def flat(c):
            return table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        per = np.diff(np.r_[0, np.cumsum([len(x) for x in table.column("nodes")])])
        key = np.repeat(table.column("tree").to_numpy().astype(np.int64), per) << 20 | flat("nodes")
        order = np.argsort(key)
        key, self.feature, self.cut, size = key[order], flat("feature")[order], flat("cut")[order], flat("size").astype(np.int64)
        start, self.size = (np.cumsum(size) - size)[order], size[order]
        # The leaves' classes and shares in the order of the nodes; a leaf's classes ascend.
        self.start = np.cumsum(self.size) - self.size
        cell = np.repeat(start - self.start, self.size) + np.arange(self.size.sum())
        self.classes, self.shares = flat("classes")[cell], flat("shares")[cell]
        self.main = None
        node = key & ((1 << 20) - 1)
        self.left = np.where(self.feature >= 0, np.searchsorted(key, key - node + 2 * node), 0)
        # A tree without a root had no row in its bag.
        self.roots = np.flatnonzero(node == 1)

    def leaves(self, f: list, v: list, n_features: int) -> np.ndarray:
        """Each row's leaf in each tree, from its present values."""
        n = len(f)
        x = np.zeros((n, n_features))
        x[np.repeat(np.arange(n), [len(a) for a in f]), np.concatenate(f) if n else []] = np.concatenate(v) if n else []
        at = np.tile(self.roots, (n, 1))
        rows = np.arange(n)[:, None]
        while True:
            f_at = self.feature[at]
            inner = f_at >= 0
            if not inner.any():
                return at
            at = np.where(inner, self.left[at] + (x[rows, f_at] > self.cut[at]), at)

    def score(self, f: list, v: list, n_features: int, n_classes: int):
        """The classes' shares, row by row of present values."""
        return self.shares_of(self.leaves(f, v, n_features), n_classes) / max(1, len(self.roots))

    def _prepare(self, n_classes: int):
        """Each tree's largest leaf, its shares by class, their sums over the trees, and the classes by falling sum."""
        tree = np.cumsum(np.isin(np.arange(len(self.feature)), self.roots)) - 1
        by_size = np.lexsort((self.size, tree))
        self.main = by_size[np.r_[tree[by_size][1:] != tree[by_size][:-1], True]] if len(tree) else by_size
        self.of_main = np.zeros((len(self.main), n_classes))
        for t, leaf in enumerate(self.main):
            cells = slice(self.start[leaf], self.start[leaf] + self.size[leaf])
            self.of_main[t, self.classes[cells]] = self.shares[cells]
        self.base = self.of_main.sum(axis=0)
        self.by_base = np.argsort(-self.base, kind="stable")
        self.place = np.empty(n_classes, np.int64)
        self.place[self.by_base] = np.arange(n_classes)

    def _share(self, leaf: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The share of class ``y`` in ``leaf``, by bisection of the leaf's classes."""
        lo, end = self.start[leaf], self.start[leaf] + self.size[leaf]
        hi = end
        for _ in range(int(self.size.max()).bit_length()):
            mid = (lo + hi) >> 1
            below = (mid < hi) & (self.classes[np.minimum(mid, len(self.classes) - 1)] < y)
            lo, hi = np.where(below, mid + 1, lo), np.where(below, hi, mid)
        at = np.minimum(lo, len(self.classes) - 1)
        return np.where((lo < end) & (self.classes[at] == y), self.shares[at], 0.0)

    def best(self, f: list, v: list, n_features: int, n_classes: int):
        """(class with the largest share, its share) of each row, as the largest of ``score``.

        Most rows lie in the largest leaf of most trees, which holds most classes. A class's sum over these
        leaves bounds what it can have in them, so only classes near the top of that order, and those of the
        row's other leaves, can be the best; their shares are then added up in the order of ``score``.
        """
        if not len(f) or not len(self.roots):
            return np.zeros(len(f), np.int64), np.zeros(len(f))
        if self.main is None:
            self._prepare(n_classes)
        at, back = np.unique(self.leaves(f, v, n_features), axis=0, return_inverse=True)
        found, top = np.empty(len(at), np.int64), np.empty(len(at))
        width = self.size[at].sum(axis=1, where=at != self.main)
        step = np.cumsum(width + TOP) // BLOCK
        for block in np.split(np.arange(len(at)), np.flatnonzero(np.diff(step)) + 1):
            todo, k = block, TOP
            while len(todo):
                k, left = min(k, n_classes), []
                for rows in np.array_split(todo, -(-len(todo) * k // BLOCK)):
                    best, share, sure = self._best_of(at[rows], k, n_classes)
                    found[rows], top[rows] = best, share
                    left.append(rows[~sure])
                todo, k = np.concatenate(left), k * 8
        return found[back.ravel()], top[back.ravel()]

    def _best_of(self, at: np.ndarray, k: int, n_classes: int):
        """(best class, its share, whether no class can have more) of rows' leaves, from the first ``k`` classes and those of the other leaves."""
        n, off = len(at), at != self.main
        first = self.by_base[:k]
        known = self.base[first] - off.astype(float) @ self.of_main[:, first]
        row, tree = np.nonzero(off)
        leaf = at[row, tree]
        many = self.size[leaf]
        cell = np.repeat(self.start[leaf] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        key, more = summed(np.repeat(row, many) * n_classes + self.classes[cell], self.shares[cell])
        own, y = key // n_classes, key % n_classes
        near = self.place[y] < k
        known[own[near], self.place[y[near]]] += more[near]
        least = known.max(axis=1)
        # A class of another leaf that is not among the first has at most its sum and what these leaves add.
        far = np.flatnonzero(~near & (self.base[y] + more > least[own] - CLOSE))
        exact = np.empty(len(far))
        for i in range(0, len(far), 1 << 14):
            part = far[i:i + (1 << 14)]
            exact[i:i + (1 << 14)] = self.base[y[part]] + more[part] - (off[own[part]] * self.of_main[:, y[part]].T).sum(axis=1)
        np.maximum.at(least, own[far], exact)
        r, c = np.nonzero(known > least[:, None] - CLOSE)
        use = exact > least[own[far]] - CLOSE
        r, c = np.r_[r, own[far][use]], np.r_[first[c], y[far][use]]
        total = np.zeros(len(r))
        leaves = at[r]
        few = self.size[leaves] <= LARGE_LEAF
        for turn in (few, ~few):
            for t in range(at.shape[1]):
                total += np.where(turn[:, t], self._share(leaves[:, t], c), 0.0)
        order = np.lexsort((c, -total, r))
        order = order[np.r_[True, r[order][1:] != r[order][:-1]]]
        sure = np.ones(n, bool) if k >= n_classes else self.base[self.by_base[k]] < least - CLOSE
        return c[order], np.minimum(total[order], len(self.roots)) / len(self.roots), sure

    def shares_of(self, leaves: np.ndarray, n_classes: int) -> np.ndarray:
        """Sums of the shares in each row's leaves. Large leaves are shared by many rows and added to all of them at once."""
        n, size = len(leaves), self.size[leaves]
        few = size <= LARGE_LEAF
        row = np.nonzero(few)[0]
        at, many = leaves[few], size[few]
        cell = np.repeat(self.start[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        out = np.bincount(np.repeat(row, many) * n_classes + self.classes[cell], self.shares[cell], n * n_classes).astype(float).reshape(n, n_classes)
        row = np.nonzero(~few)[0]
        at = leaves[~few]
        order = np.argsort(at, kind="stable")
        found, first = np.unique(at[order], return_index=True)
        for leaf, rows in zip(found, np.split(row[order], first[1:])):
            cells = slice(self.start[leaf], self.start[leaf] + self.size[leaf])
            whole = np.zeros(n_classes)
            whole[self.classes[cells]] = self.shares[cells]
            out[rows] += whole          # a row has one leaf a tree, so none stands twice
        return np.minimum(out, len(self.roots))


class SparseForestClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasWeightCol):
    """Random forest whose memory follows the rows, not classes x features x bins."""

    def __init__(self, n_features: int, n_classes: int, trees: int, max_depth: int, min_rows: int, seed: int,
                 features: str = "features", label: str = "label"):
        super().__init__()
        self.n_features, self.n_classes = n_features, n_classes
        self.limits = (trees, max_depth, min_rows, seed)
        self._set(featuresCol=features, labelCol=label)

    def _fit(self, dataset):
        spark = dataset.sparkSession
        f, v = present_values(self.getFeaturesCol())
        weight = F.col(self.getWeightCol()) if self.isDefined(self.weightCol) else F.lit(1.0)
        path = scratch_path(spark, "forest-rows")
        rows = dataset.select(F.col(self.getLabelCol()).cast("int").alias("y"), weight.cast("double").alias("w"), f.alias("f"), v.alias("v"))
        rows = rows.groupBy("y", "w", "f", "v").agg(F.count(F.lit(1)).alias("n"))
        rows.select(F.monotonically_increasing_id().alias("id"), "y", "w", "n", "f", "v").write.parquet(path)
        rows = spark.read.parquet(path)
        spec = Spec(bin_cuts(rows, self.n_features), self.n_classes, *self.limits)
        path = scratch_path(spark, "forest")
        grow_forest(rows, spec).write.parquet(path)
        return SparseForestModel(path, self.n_features, self.n_classes, self.getFeaturesCol())


def present_values(features: str):
    """The vector's indices and values; a dense vector has all indices."""
    u = F.unwrap_udt(features)
    return (F.when(u["type"] == 0, u["indices"]).otherwise(F.sequence(F.lit(0), F.size(u["values"]) - 1)).alias("f"), u["values"].alias("v"))


class SparseForestModel(Model, HasFeaturesCol, MLWritable, MLReadable):
    """Adds ``prediction``, its ``confidence`` and ``class_shares``: the classes with a share in any tree's leaf, by class."""

    def __init__(self, path: str, n_features: int, n_classes: int, features: str = "features"):
        super().__init__()
        self.path, self.n_features, self.n_classes = path, n_features, n_classes
        self._set(featuresCol=features)
        self._trees = None

    def _transform(self, dataset):
        spark = dataset.sparkSession
        if self._trees is None:
            self._trees = spark.sparkContext.broadcast(Trees(spark.read.schema(NODES).parquet(self.path).toArrow()))
        trees, n_features, n_classes = self._trees, self.n_features, self.n_classes

        def blocks(f, v):
            # All shares of a block of rows.
            step = max(1, BLOCK // max(n_features, n_classes))
            for i in range(0, len(f), step):
                yield trees.value.score(*[[np.asarray(x.values) for x in c[i:i + step]] for c in (f, v)], n_features, n_classes)

        # Two functions: whoever needs the best class only is not sent all shares.
        @F.arrow_udf("struct<prediction double, confidence double>")
        def best(f: pa.Array, v: pa.Array) -> pa.Array:
            found = trees.value.best(*[[np.asarray(x.values) for x in c] for c in (f, v)], n_features, n_classes)
            return pa.StructArray.from_arrays([pa.array(c.astype(float)) for c in found], ["prediction", "confidence"])

        @F.arrow_udf("array<struct<i int, p double>>")
        def shares(f: pa.Array, v: pa.Array) -> pa.Array:
            found = [r for x in blocks(f, v) for r in x]
            at = [np.flatnonzero(r) for r in found]
            i, p = np.concatenate([np.zeros(0, int), *at]), np.concatenate([np.zeros(0), *[r[a] for r, a in zip(found, at)]])
            pairs = pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(p, pa.float64())], ["i", "p"])
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, at)]), pa.int32()), pairs)

        f, v = present_values(self.getFeaturesCol())
        return dataset.withColumn("__best", best(f, v)).withColumn("class_shares", shares(f, v)).select(
            *dataset.columns, "__best.prediction", "__best.confidence", "class_shares")

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        m, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata={"n_features": m.n_features, "n_classes": m.n_classes})
        spark.read.schema(NODES).parquet(m.path).write.parquet(f"{path}/nodes")


class _Reader(MLReader):
    def load(self, path):
        meta = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession())
        model = SparseForestModel(f"{path}/nodes", meta["n_features"], meta["n_classes"])
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
