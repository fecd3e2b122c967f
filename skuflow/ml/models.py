"""Classifiers, pipelines, scoring and persistence.

All training is spark.ml: the estimators run distributed over the cached
feature rows. A fitted ``SkuModel`` is a ``PipelineModel`` (features +
classifier, no label stage, so unlabeled rows can be scored) plus its sorted
label list. Scoring ranks the probability vector inside the row. The label
list is bounded by the number of classes.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.ml.features import feature_pipeline
from skuflow.ml.forest import SparseForestClassifier
from skuflow.functions import text as tx
from skuflow.operators import ranking as rk
from skuflow.operators.joins import lookup_join
from skuflow.operators.split import class_weight_table, plain_split, stratified_split
from skuflow.session import scratch_path


@dataclass
class TrainParams:
    """The parameter set the reference spreads over constants and config."""
    vocab_size: int = 5000
    min_df: float = 2.0
    max_df: float = 0.9
    bigrams: bool = True
    min_examples: int = 10
    max_classes: int | None = 100
    sample: int | None = None       # rows of a seeded sample to train on (None: all)
    split: str = "stratified"       # or "plain"
    hidden: tuple = (100, 50)
    max_iter: int = 200
    seed: int = 42
    test_fraction: float = 0.2
    fit_on: str = "all"       # Q23: vectoriser fitted on all rows ("all") or the train part ("train")
    categorical: tuple = ()
    accents: bool = False
    balanced: bool = False    # M20: rows weighted by rows / (classes * rows of their class)
    # Early stopping of ``mlp_retrain``: rounds of ``round_iter`` iterations until ``patience`` of them in a
    # row do not raise the accuracy on the validation part by ``min_gain``; ``max_iter`` iterations at most.
    # A round is a fresh L-BFGS start: ones of 5 iterations never left the first plateau here.
    validation_fraction: float = 0.1
    patience: int = 3
    round_iter: int = 20
    min_gain: float = 1e-4


# Every evaluation of a gradient sends as many weights as the model has from each task to a few tasks, and from
# those to the driver: eleven tasks are aggregated in two. Learners without gradients get more tasks with the rows.
GRADIENT_TASKS = 11
GRADIENT_KINDS = ("mlp", "mlp_retrain", "lr")
FIRST_ROWS, ROWS_A_TASK = 256, 50_000


def training_tasks(n: int, kind) -> int:
    """Tasks that ``n`` feature rows are dealt to while a classifier is fitted."""
    most = GRADIENT_TASKS if kind in GRADIENT_KINDS else max(GRADIENT_TASKS, -(-n // ROWS_A_TASK))
    return max(1, min(-(-n // FIRST_ROWS), most))


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once and read back: fits and scores read them many times."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass
class SkuModel:
    pipeline: PipelineModel
    labels: list[str]
    kind: str = "mlp"
    meta: dict = field(default_factory=dict)

    def label_array(self) -> Column:
        """All labels as one value: thousands of literals would weigh on every plan."""
        return F.from_json(F.lit(json.dumps(self.labels)), "array<string>")

    def label_of(self, index_col: str = "prediction") -> Column:
        return F.element_at(self.label_array(), F.col(index_col).cast("int") + 1)


def estimator(kind, n_features: int, n_classes: int, params: TrainParams | None = None,
              features: str = "features", label: str = "label"):
    """``mlp`` (100-50), ``mlp_retrain`` (256-128), ``rf`` / ``rf_maker`` / ``rf_sku`` (100 x depth 15),
    ``dt`` (depth 10), ``lr`` (multinomial). X3: any spark.ml classifier may be given instead.
    ``rf_maker`` and ``rf_sku`` are the hierarchical models' forests, whose classes may be thousands."""
    p = params or TrainParams()
    if not isinstance(kind, str):
        return kind.copy({kind.getParam("featuresCol"): features, kind.getParam("labelCol"): label})
    common = dict(featuresCol=features, labelCol=label)
    if kind in ("mlp", "mlp_retrain"):
        hidden = list(p.hidden) if kind == "mlp" else [256, 128]
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], maxIter=p.max_iter,
                                              seed=p.seed, tol=1e-4 if kind == "mlp" else 0.0, **common)
    # Tree learners keep per-node class x feature x bin statistics in each task;
    # maxMemoryInMB bounds how many nodes are split per pass (per-task memory).
    trees = dict(maxMemoryInMB=128, **common)
    if kind == "rf":
        return RandomForestClassifier(numTrees=100, maxDepth=15, minInstancesPerNode=2, seed=p.seed, **trees)
    if kind in ("rf_maker", "rf_sku"):
        return SparseForestClassifier(n_features, n_classes, 100, 15, 2 if kind == "rf_maker" else 1, p.seed, features, label)
    if kind == "dt":
        return DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=2, seed=p.seed, **trees)
    if kind == "lr":
        return LogisticRegression(family="multinomial", maxIter=p.max_iter, **common)
    raise ValueError(f"unknown model kind {kind}")


def fit(rows: DataFrame, text_col: str, kind: str = "mlp", params: TrainParams | None = None,
        label_col: str = "referencia", fit_rows: DataFrame | None = None) -> SkuModel:
    """Fit features (on ``fit_rows`` or ``rows``), the label encoder (M4) and a classifier."""
    p = params or TrainParams()
    indexer = StringIndexer(inputCol=label_col, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    feats = feature_pipeline(text_col, p.vocab_size, list(p.categorical) or None, p.accents, p.bigrams, p.min_df, p.max_df).fit(
        fit_rows if fit_rows is not None else rows)
    early = kind == "mlp_retrain"
    weight = []
    if p.balanced:
        # One row a class, as the label list itself.
        rows = lookup_join(rows, class_weight_table(rows, label_col).withColumnRenamed("weight", "__weight"), label_col, "left")
        weight = ["__weight"]
    data = feats.transform(indexer.transform(rows)).select(
        "features", "label", *(["row_id"] if early else []), *weight).repartition(training_tasks(rows.count(), kind)).cache()
    nf = data.first()["features"].size
    est = estimator(kind, nf, len(indexer.labels), p)
    if p.balanced:
        if not est.hasParam("weightCol"):
            raise ValueError(f"{type(est).__name__} takes no row weights")
        est = est.copy({est.getParam("weightCol"): "__weight"})
    clf, curve = fit_early_stopping(data, est, p) if early else (est.fit(data), {})
    data.unpersist()
    return SkuModel(PipelineModel(stages=feats.stages + [clf]), list(indexer.labels), kind,
                    {"n_features": nf, "n_classes": len(indexer.labels), **curve})


def fit_early_stopping(data: DataFrame, est: MultilayerPerceptronClassifier, p: TrainParams, key: str = "row_id"):
    """M8: (network with the best validation accuracy, facts with its curve).

    A part of the rows (W6 by ``key``) is held back. Each round continues from the weights of the round
    before; the weights of the best round are kept.
    """
    split = plain_split(data, key, p.validation_fraction, p.seed + 1).cache()
    train, held = split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test")
    curve: list[float] = []
    best = weights = None
    best_round = 0
    for n in range(max(1, p.max_iter // p.round_iter)):
        step = est.copy({est.maxIter: p.round_iter})
        if weights is not None:
            step.setInitialWeights(weights)
        model = step.fit(train)
        weights = model.weights
        score = model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()["a"]
        curve.append(float(score or 0.0))
        if best is None or curve[-1] > curve[best_round] + p.min_gain:
            best, best_round = model, n
        elif n - best_round >= p.patience:
            break
    facts = {"validation_curve": curve, "best_round": best_round, "n_validation": held.count(), "n_train": train.count()}
    split.unpersist()
    return best, facts


def predictions(model: SkuModel, df: DataFrame, keys) -> DataFrame:
    """(keys, predicted, confidence): argmax label and its probability (1.0 without probabilities)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    scored = model.pipeline.transform(df)
    conf = F.lit(1.0)
    if "class_shares" in scored.columns:
        conf = F.col("confidence")
    elif "probability" in scored.columns:
        conf = F.array_max(vector_to_array("probability"))
    return scored.select(*keys, model.label_of().alias("predicted"), conf.alias("confidence"))


def score_flat(model: SkuModel, df: DataFrame, keys, k: int = rk.TOP_K,
               min_confidence: float = rk.MIN_CONFIDENCE) -> DataFrame:
    """Top-k candidates per row; a model without probabilities gives one candidate.

    The probability vector is filtered, sorted (confidence down, then label) and cut inside the
    row, so scoring shuffles nothing.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    scored = model.pipeline.transform(df)
    if "class_shares" in scored.columns:
        pairs = F.transform("class_shares", lambda x: F.struct(
            (-x["p"]).alias("down"), F.get(F.col("__labels"), x["i"]).alias("sku")))
    elif "probability" in scored.columns:
        pairs = F.transform(vector_to_array("probability"), lambda p, i: F.struct(
            (-p).alias("down"), F.get(F.col("__labels"), i).alias("sku")))
    else:
        return rk.single_candidate(predictions(model, df, keys), keys, "predicted")
    best = F.slice(F.array_sort(F.filter(pairs, lambda x: x["down"] < -min_confidence)), 1, k)
    rows = scored.withColumn("__labels", model.label_array()).select(*keys, best.alias("__c"))
    first = F.get("__c", F.lit(0))
    return rows.select(*keys, first["sku"].alias("top_sku"), F.coalesce(-first["down"], F.lit(0.0)).alias("top_confidence"),
                       F.transform("__c", lambda x: F.struct(x["sku"].alias("sku"), (-x["down"]).alias("confidence")))
                       .alias("top_skus"))


def serve(model: SkuModel, requests: DataFrame, key: str, text_mode: str = "training", k: int = rk.TOP_K) -> DataFrame:
    """Scoring from raw request columns (key, description, maker, model_family, series, model_year).

    ``text_mode="training"`` builds the text the flat model was trained on (F2 then F8),
    ``"serving"`` the request context (F9) after full preprocessing (F7).
    """
    if text_mode == "training":
        text = tx.training_context(F.coalesce("maker", F.lit("")), tx.normalize_keep_punctuation("description"))
    elif text_mode == "serving":
        text = tx.preprocess_text(tx.serving_context("description", "maker", "model_family", "series", "model_year"))
    else:
        raise ValueError(f"unknown text mode {text_mode}")
    return score_flat(model, requests.select(key, text.alias("full_description")), key, k)


def majority_share(test: DataFrame, truth: str = "referencia") -> float:
    """Accuracy of always predicting the holdout's most frequent class."""
    counts = test.groupBy(truth).count()
    row = counts.agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    return float(row["most"] or 0) / float(row["n"] or 1)


def holdout_accuracy(model: SkuModel, test: DataFrame, key: str = "row_id", truth: str = "referencia") -> float:
    """A15 on a holdout: predicted label vs the truth column, which the scored rows carry."""
    pred = predictions(model, test.filter(F.col(key).isNotNull()), [key, truth])
    row = pred.agg(F.avg(F.coalesce((F.col("predicted") == F.col(truth)).cast("double"), F.lit(0.0)))
                   .alias("a")).first()
    return float(row["a"] or 0.0)


def train_flat(rows: DataFrame, kind: str = "mlp", params: TrainParams | None = None,
               text_col: str = "full_description") -> tuple[SkuModel, DataFrame]:
    """W5 split -> features (fitted on all rows by default, Q23) -> classifier; (model, test rows)."""
    p = params or TrainParams()
    split = plain_split(rows, "row_id", p.test_fraction, p.seed) if p.split == "plain" else stratified_split(
        rows, "referencia", "row_id", p.test_fraction, p.seed)
    split = staged(split, "flat-split")
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    return fit(train, text_col, kind, p, fit_rows=split if p.fit_on == "all" else train), test


def compare_models(rows: DataFrame, kinds=("lr", "dt", "rf", "mlp"), params: TrainParams | None = None,
                   text_col: str = "full_description") -> DataFrame:
    """Every model type fitted and scored on the same split; (model, accuracy, n_test)."""
    p = params or TrainParams()
    split = staged(stratified_split(rows, "referencia", "row_id", p.test_fraction, p.seed), "compared-split")
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    n_test = test.count()
    out = [(k, holdout_accuracy(fit(train, text_col, k, p, fit_rows=split), test), n_test) for k in kinds]
    return rows.sparkSession.createDataFrame(out, "model string, accuracy double, n_test long")


def cross_validate(rows: DataFrame, kind: str = "lr", folds: int = 3, params: TrainParams | None = None,
                   text_col: str = "full_description") -> DataFrame:
    """K-fold accuracy with md5-assigned folds (independent of partitioning)."""
    p = params or TrainParams()
    fold = F.conv(F.substring(F.md5(F.concat(F.lit(f"{p.seed}|"), F.col("row_id"))), 1, 8), 16, 10)
    data = rows.withColumn("fold", (fold.cast("long") % folds).cast("int")).cache()
    out = []
    for f in range(folds):
        train, test = data.filter(F.col("fold") != f), data.filter(F.col("fold") == f)
        out.append((kind, f, holdout_accuracy(fit(train, text_col, kind, p), test), test.count()))
    data.unpersist()
    return rows.sparkSession.createDataFrame(out, "model string, fold int, accuracy double, n_test long")


def train_hierarchical(rows: DataFrame, makers: list[str], maker_kind: str = "rf_maker", sku_kind: str = "rf_sku",
                       seed: int = 42, parallelism: int = 4) -> tuple[SkuModel, dict[str, SkuModel]]:
    """One maker classifier plus one SKU classifier per eligible maker (W4 applied by the caller).

    Text is accent-stripped (``strip_accents``); the maker model uses 1000
    text features, SKU models 800 plus one-hot series/model. Per-maker fits
    are independent distributed jobs submitted from a small driver thread
    pool over rows written once, a folder a maker, so that each fit reads its own rows only.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "maker-rows")
    rows.withColumn("__of", F.concat(F.lit("maker "), "maker")).write.partitionBy("__of").parquet(path)
    kept = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("__of", T.StringType())])).parquet(path)
    mp = TrainParams(vocab_size=1000, seed=seed, accents=True)
    maker_model = fit(kept.drop("__of"), "descripcion", maker_kind, mp, label_col="maker")
    sp = TrainParams(vocab_size=800, seed=seed, accents=True, categorical=("series", "model"))

    def fit_one(m: str):
        return m, fit(kept.filter(F.col("__of") == f"maker {m}").drop("__of"), "descripcion", sku_kind, sp)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        sku_models = dict(pool.map(fit_one, makers))
    return maker_model, sku_models


def predict_hierarchical(df: DataFrame, maker_model: SkuModel, sku_models: dict[str, SkuModel],
                         key: str = "row_id", provided: str = "provided_maker") -> DataFrame:
    """M18 with fitted models: route (J8), then each maker's SKU model on its rows, united by name.

    The routed rows are written once, a folder a maker, so each row is scored by the maker model once and
    each SKU model reads its own rows only, however many makers there are.
    """
    spark = df.sparkSession
    pm = predictions(maker_model, df, key).withColumnRenamed("predicted", "__pm").withColumnRenamed(
        "confidence", "__pmc")
    have = list(sku_models)
    use_provided = F.col(provided).isin(have) if have else F.lit(False)
    routed = (df.join(pm, key, "left")
              .withColumn("predicted_maker", F.when(use_provided, F.col(provided)).otherwise(F.col("__pm")))
              .withColumn("maker_confidence", F.when(use_provided, F.lit(1.0)).otherwise(F.col("__pmc")))
              .drop("__pm", "__pmc"))
    path = scratch_path(spark, "routed")
    routed.withColumn("__to", F.col("predicted_maker")).write.partitionBy("__to").parquet(path)
    routed = spark.read.schema(T.StructType([*routed.schema.fields, T.StructField("__to", T.StringType())])).parquet(path)
    parts = [predictions(model, routed.filter(F.col("__to") == m), key)
             for m, model in sku_models.items()]
    if parts:
        skus = parts[0]
        for x in parts[1:]:
            skus = skus.unionByName(x)
    else:
        skus = spark.createDataFrame([], f"{key} string, predicted string, confidence double")
    skus = skus.select(key, F.col("predicted").alias("predicted_sku"), F.col("confidence").alias("sku_confidence"))
    out = routed.drop("__to").join(skus, key, "left").withColumn("sku_confidence", F.coalesce("sku_confidence", F.lit(0.0)))
    return out.withColumn("overall_confidence", rk.overall_confidence())


def save_model(model: SkuModel, path: str, extra: dict | None = None) -> str:
    """Spark.ml persistence plus one JSON metadata line (labels, type, sizes)."""
    model.pipeline.write().overwrite().save(f"{path}/model")
    meta = {"kind": model.kind, "labels": model.labels, **model.meta, **(extra or {})}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/metadata")
    return path


def load_model(spark: SparkSession, path: str) -> SkuModel:
    """Load a saved model with its metadata; a missing model raises ``FileNotFoundError``."""
    from skuflow.session import path_exists
    if not path_exists(spark, f"{path}/model"):
        raise FileNotFoundError(f"no model under {path}")
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    return SkuModel(PipelineModel.load(f"{path}/model"), list(meta["labels"]), meta.get("kind", ""), meta)


def challenger_decision(incumbent: SkuModel, challenger: SkuModel, holdout: DataFrame) -> DataFrame:
    """Both models scored on the same holdout; promote only if strictly better (Q17 fixed)."""
    a_old = holdout_accuracy(incumbent, holdout)
    a_new = holdout_accuracy(challenger, holdout)
    return holdout.sparkSession.createDataFrame(
        [(a_old, a_new, a_new > a_old)], "previous_accuracy double, new_accuracy double, promote boolean")
