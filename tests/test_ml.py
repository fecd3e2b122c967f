"""spark.ml stages against the relational twins; persistence; a trained model beats the majority class."""

import os

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from conftest import SF_SMALL
from skuflow.ml import features as ft
from skuflow.ml import models as md
from skuflow.operators import flatten as fl
from skuflow.operators import split as sp
from skuflow.sources.bases import Bases


def test_smoothed_tfidf_matches_relational(spark):
    docs = spark.createDataFrame([(1, "faro faro delantero"), (2, "faro trasero"), (3, "capó delantero roto"),
                                  (4, "espejo roto")], "doc_id long, text string")
    n = docs.count()
    terms = ft.doc_terms(docs, "text", ["doc_id"], bigrams=False)
    vocab = ft.tfidf_vocabulary(terms, min_df=1, max_df=1.0, max_features=5000)
    rel = {(r["doc_id"], r["term"]): r["weight"] for r in ft.tfidf_weights(terms, vocab, "doc_id").collect()}
    stages = ft.text_feature_stages("text", vocab_size=100, min_df=1.0, max_df=1.0, bigrams=False)
    model = Pipeline(stages=stages).fit(docs)
    out = model.transform(docs)
    cv = model.stages[1]
    for r in out.select("doc_id", "txt_features").collect():
        vec = r["txt_features"]
        for idx, val in zip(vec.indices, vec.values):
            assert abs(rel[(r["doc_id"], cv.vocabulary[idx])] - val) < 1e-9


def test_train_save_load_and_beat_majority(spark, tmp):
    rows = fl.training_rows(Bases(spark, SF_SMALL).bids())
    rows = rows.withColumn("full_description", F.concat_ws(" ", "maker", "descripcion"))
    sel = sp.select_frequent_classes(rows, "maker", 1, None)
    rows = rows.withColumn("referencia", F.col("maker"))   # predict maker: a learnable label
    model, test = md.train_flat(rows, "lr", md.TrainParams(vocab_size=500, max_iter=50))
    acc = md.holdout_accuracy(model, test)
    majority = test.groupBy("referencia").count().agg(F.max("count")).first()[0] / test.count()
    assert acc > majority
    path = md.save_model(model, os.path.join(tmp, "m"))
    loaded = md.load_model(spark, path)
    a = md.predictions(model, test, "row_id").collect()
    b = md.predictions(loaded, test, "row_id").collect()
    assert sorted((r["row_id"], r["predicted"]) for r in a) == sorted((r["row_id"], r["predicted"]) for r in b)
    assert sel.count() > 1


def test_onehot_unknown_is_zero(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("rare",)], "series string")
    model = Pipeline(stages=ft.categorical_stages(["series"])).fit(train)
    test = spark.createDataFrame([("a",), ("never_seen",), (None,), ("rare",)], "series string")
    vecs = [r[0] for r in model.transform(test).select("cat_series_vec").collect()]
    assert vecs[0].numNonzeros() == 1 and vecs[1].numNonzeros() == 0 and vecs[2].numNonzeros() == 0
    # A rare category has the same vector in training and at scoring: the shared last column.
    rare = model.transform(train.filter("series = 'rare'")).first()["cat_series_vec"]
    assert vecs[3] == rare and list(rare.indices) == [rare.size - 1] and rare.size == 3


def test_early_stopping_keeps_the_best_round(spark):
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("row_id"), (F.col("id") % 3).cast("string").alias("referencia"),
        F.concat(F.element_at(F.array(F.lit("faro"), F.lit("espejo"), F.lit("capot")), (F.col("id") % 3).cast("int") + 1),
                 F.lit(" "), (F.col("id") % 7).cast("string")).alias("descripcion"))
    p = md.TrainParams(vocab_size=50, round_iter=3, max_iter=60, patience=2)
    model = md.fit(rows, "descripcion", "mlp_retrain", p)
    curve, best = model.meta["validation_curve"], model.meta["best_round"]
    assert (model.meta["n_validation"], model.meta["n_train"]) == (40, 360)
    assert len(curve) == min(20, best + 3) and max(curve) <= curve[best] + p.min_gain
    held = sp.plain_split(rows, "row_id", 0.1, 43).filter("is_test")
    assert abs(md.holdout_accuracy(model, held) - curve[best]) < 1e-9


def test_hierarchical_scoring_reads_each_row_once(spark):
    rows = spark.range(300).select(
        F.col("id").cast("string").alias("row_id"), F.concat(F.lit("M/"), (F.col("id") % 3).cast("string")).alias("maker"),
        F.lit("s").alias("series"), F.lit("m").alias("model"),
        F.concat(F.lit("part"), (F.col("id") % 6).cast("string"), F.lit(" of maker"), (F.col("id") % 3).cast("string")).alias("descripcion"),
        F.concat(F.lit("R"), (F.col("id") % 6).cast("string")).alias("referencia"))
    maker_model, sku_models = md.train_hierarchical(rows, ["M/0", "M/1"], "dt", "dt")
    asked = rows.withColumn("provided_maker", F.when(F.col("row_id") == "0", "M/1").when(F.col("row_id") == "1", "none"))
    got = {r.row_id: r for r in md.predict_hierarchical(asked, maker_model, sku_models).collect()}
    assert len(got) == 300
    assert (got["0"].predicted_maker, got["0"].maker_confidence) == ("M/1", 1.0)
    assert got["1"].predicted_maker == "M/1" and got["1"].predicted_sku == "R1"
    for r in got.values():
        if r.predicted_maker == "M/2":       # no model of its own
            assert r.predicted_sku is None and r.overall_confidence == 0.0
        elif r.row_id != "0":
            assert r.predicted_sku == r.referencia


def test_balanced_rows_and_foreign_classifiers(spark):
    from pyspark.ml.classification import LinearSVC, NaiveBayes
    rows = spark.createDataFrame([(str(i), "faro delantero", "B" if i % 20 == 0 else "A") for i in range(200)],
                                 "row_id string, text string, referencia string")
    share = {}
    for balanced in (False, True):
        model = md.fit(rows, "text", "dt", md.TrainParams(min_df=1.0, max_df=1.0, balanced=balanced))
        share[balanced] = md.predictions(model, rows, "row_id").first()["confidence"]
    assert abs(share[False] - 0.95) < 1e-6 and abs(share[True] - 0.5) < 1e-6
    with pytest.raises(ValueError):
        md.fit(rows, "text", "mlp", md.TrainParams(min_df=1.0, max_df=1.0, balanced=True))
    for other in (NaiveBayes(), LinearSVC(maxIter=2)):
        model = md.fit(rows, "text", other, md.TrainParams(min_df=1.0, max_df=1.0))
        got = md.score_flat(model, rows, "row_id").first()      # one candidate without probabilities (M17)
        assert got["top_sku"] == "A" and len(got["top_skus"]) >= 1


@pytest.mark.parametrize("kind", ["mlp_retrain", "lr"])
def test_gradients_come_from_few_tasks(spark, monkeypatch, kind):
    """Whatever the partitions of the rows, each evaluation of the gradient runs in at most eleven tasks."""
    rows = spark.range(4000, numPartitions=60).select(
        F.col("id").cast("string").alias("row_id"), (F.col("id") % 2).cast("string").alias("referencia"),
        F.concat(F.lit("pieza"), (F.col("id") % 2).cast("string")).alias("descripcion"))
    seen, make = [], md.estimator

    def spied(*args, **more):
        est = make(*args, **more)
        fit = type(est).fit
        monkeypatch.setattr(type(est), "fit", lambda self, data, *a: seen.append(data.rdd.getNumPartitions()) or fit(self, data, *a))
        return est

    monkeypatch.setattr(md, "estimator", spied)
    md.fit(rows, "descripcion", kind, md.TrainParams(max_iter=2, round_iter=1, max_df=1.0))
    assert seen and max(seen) <= md.GRADIENT_TASKS
    assert md.training_tasks(10_000_000, kind) == 11 and md.training_tasks(10_000_000, "rf") == 200 and md.training_tasks(0, kind) == 1


def test_split_of_a_flat_model_is_read_from_files(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 2).cast("string").alias("referencia"),
                                  F.concat(F.lit("pieza"), (F.col("id") % 2).cast("string")).alias("full_description"))
    _, test = md.train_flat(rows, "dt", md.TrainParams(max_df=1.0))
    assert test.inputFiles() and test.count() == 12


def test_vocabulary_is_fitted_by_one_aggregation(spark):
    terms = spark.createDataFrame([("a a b",), ("a c",), ("b c d",), ("a",)], "text string").select(F.split("text", " ").alias("txt_uni"))
    stage = ft.text_feature_stages("text", min_df=2.0, max_df=0.7, bigrams=False)[1]
    assert isinstance(stage, ft.Vocabulary)       # the built-in estimator would hold all terms of all rows
    with pytest.raises(ValueError):
        ft.Vocabulary("txt_uni", "n", 10, 5.0, 1.0).fit(terms)
    assert stage.fit(terms).vocabulary == ["b", "c"]      # "a" stands in three of four texts, "d" in one


def test_vocabulary_is_computed_once_for_a_lookup(spark):
    terms = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "b"]), (3, ["z"])], "doc_id long, terms array<string>")
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        passes.add(1)
        yield from batches

    vocab = ft.tfidf_vocabulary(terms, 2, 1.0, 10).coalesce(1).mapInArrow(counted, "term string, df long, tf long, index int")
    assert sorted(map(tuple, ft.in_vocabulary_counts(terms, vocab, "doc_id").collect())) == [(1, 3, 2), (2, 2, 2)]
    assert passes.value == 1
    assert ft.in_vocabulary_counts(terms, vocab.filter("df > 5"), "doc_id").count() == 0


def test_holdout_accuracy_scores_rows_with_their_truth(spark, monkeypatch):
    """The truth comes with the scored rows: the holdout is not joined with itself; rows without a key do not count."""
    seen = []

    def guess(model, df, keys):
        seen.append(keys)
        return df.select(*keys, F.lit("A").alias("predicted"), F.lit(1.0).alias("confidence"))

    monkeypatch.setattr(md, "predictions", guess)
    test = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", None), ("4", "A"), (None, "A")], "row_id string, referencia string")
    assert md.holdout_accuracy(None, test) == 0.5 and seen == [["row_id", "referencia"]]
