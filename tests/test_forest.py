"""Forests with sparse node statistics: splits against brute force, both ways of growing, scoring, persistence."""

import os

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from skuflow.ml import forest as fo
from skuflow.ml import models as md


def _gini(w):
    return w.sum() - (w ** 2).sum() / w.sum() if w.sum() else 0.0


@pytest.mark.parametrize("values", [[0, 1, 2, 3], [-2, -1, 0, 1, 2], [-3, -1, 0]])
def test_best_split_equals_brute_force(values):
    rng = np.random.default_rng(7)
    cuts = np.full((3, fo.MAX_BINS - 1), np.inf)
    cuts[:, :len(values) - 1] = sorted(values)[:-1]
    spec = fo.Spec(cuts, 5, 1, 15, 2, 1)
    for _ in range(20):
        x, y, n = rng.choice(values, (40, 3)), rng.integers(0, 5, 40), rng.integers(1, 4, 40).astype(float)
        row, f = np.nonzero(x)
        b = spec.bins(f, x[row, f].astype(float))
        totals = fo.summed(y.astype(np.int64), n, n)
        feature, cut, left, right = (a[0] for a in fo.best_splits(spec, 1, totals, (np.zeros(len(f), np.int64), f, b, y[row], n[row], n[row])))
        tried = {}
        for j in range(3):
            for c in sorted(values)[:-1]:
                down = x[:, j] <= c
                if min(n[down].sum(), n[~down].sum()) >= 2:
                    tried[j, c] = sum(_gini(np.bincount(y[s], n[s], 5)) for s in (down, ~down))
        at = x[:, feature] <= cuts[feature, cut]
        assert tried[feature, cuts[feature, cut]] <= min(tried.values()) + 1e-9
        assert (left, right) == (n[at].sum(), n[~at].sum())


def _rows(spark, n, classes, features=40):
    rng = np.random.default_rng(3)
    parts = rng.integers(0, features, (classes, 4))
    y = rng.integers(0, classes, n)
    return spark.createDataFrame([(Vectors.sparse(features, {int(i): 1.0 for i in parts[c]}), float(c)) for c in y.tolist()],
                                 ["features", "label"]).repartition(3).cache()


@pytest.mark.parametrize("local", [100_000, 60])
def test_forest_of_both_ways_of_growing(spark, monkeypatch, local):
    monkeypatch.setattr(fo, "LOCAL_ROWS", local)
    rows = _rows(spark, 400, 8)
    model = fo.SparseForestClassifier(40, 8, 5, 6, 1, 42).fit(rows)
    nodes = [r.asDict() for r in spark.read.schema(fo.NODES).parquet(model.path).collect()]
    found = {}
    for r in nodes:
        at = 0
        for i, f, c, k in zip(r["nodes"], r["feature"], r["cut"], r["size"]):
            found[r["tree"], i] = f
            assert (k > 0) == (f < 0) and (not k or abs(sum(r["shares"][at:at + k]) - 1) < 1e-9)
            at += k
    assert len(found) == sum(len(r["nodes"]) for r in nodes) and {t for t, _ in found} == set(range(5))
    for (t, i), f in found.items():         # every split has two children, every leaf none, none below depth 6
        assert ((t, 2 * i) in found) == ((t, 2 * i + 1) in found) == (f >= 0) and i.bit_length() <= 7
    scored = model.transform(rows).select("label", "prediction", "confidence", "class_shares").collect()
    assert np.mean([r.label == r.prediction for r in scored]) > 0.9
    for r in scored:
        p = {x.i: x.p for x in r.class_shares}
        assert abs(sum(p.values()) - 1) < 1e-9 and p[int(r.prediction)] == max(p.values()) == r.confidence


def test_large_leaves_are_added_as_the_small_ones(spark, monkeypatch):
    rows = _rows(spark, 300, 60)
    model = fo.SparseForestClassifier(40, 60, 4, 2, 1, 42).fit(rows)
    trees = fo.Trees(spark.read.schema(fo.NODES).parquet(model.path).toArrow())
    leaves = np.tile(np.flatnonzero(trees.feature < 0)[:4], (3, 1))
    assert trees.size[leaves].max() > fo.LARGE_LEAF
    want = trees.shares_of(leaves, 60)
    monkeypatch.setattr(fo, "LARGE_LEAF", 1000)
    assert np.allclose(want, trees.shares_of(leaves, 60))


def test_hierarchical_forests_take_thousands_of_classes(spark, tmp):
    """spark.ml's forests keep 2,000 classes x features x bins for every node of 100 trees of depth 15."""
    assert isinstance(md.estimator("rf_sku", 10, 2000), fo.SparseForestClassifier)
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("row_id"), F.concat(F.lit("R"), F.col("id") % 2000).alias("referencia"),
        F.concat(F.lit("pieza"), F.col("id") % 50, F.lit(" tipo"), (F.col("id") % 2000 / 50).cast("int")).alias("descripcion"))
    model = md.fit(rows, "descripcion", "rf_sku", md.TrainParams(vocab_size=800))
    assert model.meta["n_classes"] == 2000
    assert spark.read.parquet(model.pipeline.stages[-1].path).count() == 100
    best = md.predictions(model, rows, "row_id").collect()
    top = {r.row_id: r for r in md.score_flat(model, rows, "row_id", 3, 0.0).collect()}
    assert all(0 < r.confidence <= 1 for r in best) and sum(top[r.row_id].top_sku == r.predicted for r in best) > 3600
    loaded = md.load_model(spark, md.save_model(model, os.path.join(tmp, "m")))
    assert sorted(map(tuple, md.predictions(loaded, rows, "row_id").collect())) == sorted(map(tuple, best))


def test_makers_without_a_name_have_their_own_rows(spark):
    """Folders of makers hold empty names too, which a bare partition column turns into null."""
    rows = spark.range(40).select(
        F.col("id").cast("string").alias("row_id"), F.when(F.col("id") % 2 == 0, "").otherwise("M/1").alias("maker"),
        F.lit("s").alias("series"), F.lit("m").alias("model"), F.concat(F.lit("pieza"), F.col("id") % 4).alias("descripcion"),
        F.concat(F.lit("R"), F.col("id") % 4).alias("referencia"))
    _, models = md.train_hierarchical(rows, ["", "M/1"], "dt", "dt")
    assert (models[""].labels, models["M/1"].labels) == (["R0", "R2"], ["R1", "R3"])


def test_equal_rows_are_one_row_with_a_count(spark):
    """Bags draw Poisson(count) copies; a forest of repeated rows is grown from the distinct ones, with the cuts of all."""
    ids = np.arange(20_000)
    for rows in (1, 3, 40, 5000):
        n = fo.copies(7, 2, ids, np.full(len(ids), rows))
        assert abs(n.mean() - rows) < 6 * (rows / len(ids)) ** 0.5 and abs(n.var() / rows - 1) < 0.06
    assert (fo.copies(7, 2, ids, np.ones(len(ids), int)) != fo.copies(7, 3, ids, np.ones(len(ids), int))).any()
    data = spark.range(3000).select(F.when(F.col("id") % 100 < 3, F.col("id") % 10).otherwise(10).cast("double").alias("x"))
    cuts = fo.bin_cuts(data.groupBy("x").agg(F.count(F.lit(1)).alias("n")).select("n", F.array(F.lit(0)).alias("f"), F.array("x").alias("v")), 1)
    single = fo.bin_cuts(data.select(F.lit(1).alias("n"), F.array(F.lit(0)).alias("f"), F.array("x").alias("v")), 1)
    assert (cuts == single).all() and cuts[0, 0] == 0 and np.isfinite(cuts).sum() < 4
    rows = _rows(spark, 400, 8)
    model = fo.SparseForestClassifier(40, 8, 5, 6, 1, 42).fit(rows.unionByName(rows).unionByName(rows))
    shares = [s for r in spark.read.schema(fo.NODES).parquet(model.path).collect() for s in r["shares"]]
    assert len(shares) and all(0 < s <= 1 for s in shares)
    assert model.transform(rows).filter("label = prediction").count() > 360


def test_units_of_equal_bins_keep_hash_twins_apart(monkeypatch):
    cells, f, b = np.array([2, 0, 2, 1, 0]), np.array([1, 4, 1, 4, 1], np.int32), np.array([2, 3, 2, 3, 2], np.uint8)
    unit, of_cell, g, c = fo.alike(cells, f, b)
    assert unit[0] == unit[2] and unit[1] == unit[4] and len(set(unit)) == 3
    assert sorted(zip(of_cell, g, c)) == sorted([(unit[0], 1, 2), (unit[0], 4, 3), (unit[3], 1, 2)])
    unique = np.unique
    monkeypatch.setattr(fo.np, "unique", lambda x, **k: unique(np.zeros_like(x), **k))      # one hash for all
    unit, of_cell, g, c = fo.alike(cells, f, b)
    assert unit.tolist() == [0, 1, 2, 3, 4] and of_cell.tolist() == [0, 0, 2, 2, 3]


def test_forest_above_the_size_of_one_task_has_distinct_rows(spark, monkeypatch):
    """More distinct rows than ``LOCAL_ROWS``: nodes are split level by level, the rest by tasks."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(Vectors.dense(rng.normal(size=6) + 3 * (np.arange(6) == c)), float(c)) for c in rng.integers(0, 6, 500)],
                                 ["features", "label"]).cache()
    monkeypatch.setattr(fo, "LOCAL_ROWS", 100)
    model = fo.SparseForestClassifier(6, 6, 10, 8, 1, 42).fit(rows)
    nodes = spark.read.schema(fo.NODES).parquet(model.path).collect()
    assert len(nodes) > 10 and {r["tree"] for r in nodes} == set(range(10))
    assert model.transform(rows).filter("label = prediction").count() > 400


@pytest.mark.parametrize("top", [1, 3, 256])
def test_best_class_is_the_largest_of_all_shares(spark, monkeypatch, top):
    """The bounded search finds the class and share that adding up every class does, ties by class."""
    rng = np.random.default_rng(9)
    n, classes, features = 600, 200, 12
    x = (rng.random((n, features)) < 0.3).astype(float)
    rows = spark.createDataFrame([(Vectors.dense(v), float(c)) for v, c in zip(x, rng.integers(0, classes, n).tolist())], ["features", "label"])
    model = fo.SparseForestClassifier(features, classes, 7, 5, 1, 42).fit(rows)
    trees = fo.Trees(spark.read.schema(fo.NODES).parquet(model.path).toArrow())
    f, v = [np.arange(features)] * n, list(x)
    every = trees.score(f, v, features, classes)
    monkeypatch.setattr(fo, "TOP", top)
    best, share = trees.best(f, v, features, classes)
    assert (best == every.argmax(axis=1)).all() and (share == every.max(axis=1)).all()
    assert [len(a) for a in trees.best([], [], features, classes)] == [0, 0]
