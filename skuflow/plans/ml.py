"""Queries for features (relational twins) and spark.ml models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.functions import text as tx
from skuflow.ml import features as ft
from skuflow.ml import models as md
from skuflow.operators import evaluate as ev
from skuflow.operators import feedback as fb
from skuflow.operators import flatten as fl
from skuflow.operators import split as sp
from skuflow.plans import sqltext as q
from skuflow.plans.registry import query, with_bases
from skuflow.session import scratch_path
from skuflow.sinks import files as sinks
from skuflow.sources import files as src
from skuflow.sources.bases import Bases

R = 6


def _docs(spark, sf_dir):
    return Bases(spark, sf_dir).documents()


def _vocab(spark, sf_dir, max_features):
    terms = ft.doc_terms(_docs(spark, sf_dir), "text", ["doc_id"], bigrams=True)
    return terms, ft.tfidf_vocabulary(terms, 2, 0.9, max_features)


_TERMS = f"""
, TK AS (SELECT doc_id, {q.tokens('text')} AS tk FROM documents)
, TT AS (SELECT doc_id, list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS terms FROM TK)
, DT AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM TT) u GROUP BY doc_id, term)
, ST AS (SELECT term, count(*) AS df, sum(tf) AS tf FROM DT GROUP BY term)
"""


def _vocab_sql(max_features: int) -> str:
    return f"""
, VK AS (SELECT * FROM ST WHERE df >= 2 AND df <= 0.9 * (SELECT count(*) FROM documents)
         ORDER BY tf DESC, term LIMIT {max_features})
, V AS (SELECT term, df, tf, row_number() OVER (ORDER BY term) - 1 AS index FROM VK)
"""


@query("M1_tfidf_vocabulary", "WITH dummy AS (SELECT 1)" + _TERMS + _vocab_sql(1000) +
       "SELECT term, CAST(df AS BIGINT) AS df, CAST(tf AS BIGINT) AS tf, CAST(index AS INTEGER) AS index FROM V")
def m1_vocabulary(spark, sf_dir):
    _, vocab = _vocab(spark, sf_dir, 1000)
    return vocab.select("term", "df", "tf", F.col("index").cast("int"))


@query("M2_tfidf_weights", "WITH dummy AS (SELECT 1)" + _TERMS + _vocab_sql(500) + """
, W AS (SELECT DT.doc_id, DT.term, DT.tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + V.df)) + 1.0) AS w
        FROM DT JOIN V USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM W
""")
def m2_weights(spark, sf_dir):
    terms, vocab = _vocab(spark, sf_dir, 500)
    w = ft.tfidf_weights(terms, vocab, "doc_id")
    return w.select("doc_id", "term", F.round("weight", R).alias("weight"))


@query("J9_vocabulary_lookup", "WITH dummy AS (SELECT 1)" + _TERMS + _vocab_sql(500) + """
SELECT DT.doc_id, CAST(sum(DT.tf) AS BIGINT) AS known_terms, CAST(count(*) AS BIGINT) AS known_distinct
FROM DT JOIN V USING (term) GROUP BY DT.doc_id
""")
def j9_lookup(spark, sf_dir):
    terms, vocab = _vocab(spark, sf_dir, 500)
    return ft.in_vocabulary_counts(terms, vocab, "doc_id")


@query("M3_onehot_category_mapping", with_bases("P11") + """
, CC AS (SELECT 'series' AS feature, series AS category, count(*) AS n FROM P11 GROUP BY series
         UNION ALL SELECT 'model', model, count(*) FROM P11 GROUP BY model)
, CG AS (SELECT DISTINCT feature, CASE WHEN n >= 2 THEN category ELSE '__infrequent__' END AS category FROM CC)
SELECT feature, category,
       CAST(row_number() OVER (PARTITION BY feature ORDER BY category = '__infrequent__', category) - 1 AS INTEGER) AS index
FROM CG
""")
def m3_onehot(spark, sf_dir):
    rows = fl.flatten_v3(Bases(spark, sf_dir).bids())
    return ft.category_mapping(rows, ["series", "model"], 2).select(
        "feature", "category", F.col("index").cast("int"))


_W3 = """SELECT referencia FROM P11 GROUP BY referencia HAVING count(*) >= 10 ORDER BY count(*) DESC, referencia LIMIT 100"""


@query("M4_label_encoding", with_bases("P11") + f"""
SELECT referencia, CAST(row_number() OVER (ORDER BY referencia) - 1 AS INTEGER) AS index FROM ({_W3}) w
""")
def m4_labels(spark, sf_dir):
    rows = fl.flatten_v3(Bases(spark, sf_dir).bids())
    sel = sp.select_frequent_classes(rows, "referencia", 10, 100)
    return ft.label_index(sel, "referencia").select("referencia", F.col("index").cast("int"))


@query("M6_encoder_refresh", with_bases("P11") + """
, OLD AS (SELECT referencia FROM P11 WHERE model < '1997' GROUP BY referencia HAVING count(*) >= 3)
, NEW AS (SELECT referencia FROM P11 GROUP BY referencia HAVING count(*) >= 3)
, D AS (SELECT count(*) AS n FROM NEW WHERE referencia NOT IN (SELECT referencia FROM OLD))
SELECT CAST(n AS BIGINT) AS new_skus, CASE WHEN n > 0 THEN 'refit' ELSE 'reuse' END AS action FROM D
""")
def m6_refresh(spark, sf_dir):
    rows = fl.flatten_v3(Bases(spark, sf_dir).bids())
    old = sp.select_frequent_classes(rows.filter(F.col("model") < "1997"), "referencia", 3, None)
    new = sp.select_frequent_classes(rows, "referencia", 3, None)
    diff = new.select("referencia").join(old.select("referencia"), "referencia", "left_anti")
    return diff.agg(F.count(F.lit(1)).alias("new_skus")).select(
        "new_skus", F.when(F.col("new_skus") > 0, F.lit("refit")).otherwise(F.lit("reuse")).alias("action"))


# ----------------------------------------------------------------------------- spark.ml
# The oracles cover what does not depend on the optimiser: class and holdout counts, row keys,
# orderings, and whether the model beats the holdout's majority class.
_CLASSES = """
, CL AS (SELECT referencia, count(*) AS n FROM T GROUP BY referencia HAVING count(*) >= 10
         ORDER BY n DESC, referencia LIMIT 100)
, SP AS (SELECT T.*, row_number() OVER (PARTITION BY T.referencia ORDER BY md5('42|' || row_id))
                       <= floor(CL.n * 0.2 + 0.5) AS is_test FROM T JOIN CL USING (referencia))
"""


def _metrics_sql(kind: str) -> str:
    return with_bases("T") + _CLASSES + f"""
SELECT '{kind}' AS model, CAST(count(*) AS INTEGER) AS n_classes, CAST(sum(floor(n * 0.2 + 0.5)) AS BIGINT) AS n_test,
       true AS beats_majority FROM CL
"""


@query("M5_assemble_features", with_bases("P11") + f"""
, D AS (SELECT row_number() OVER () AS doc_id, {q.tokens("strip_accents(descripcion)")} AS tk FROM P11)
, TT AS (SELECT doc_id, list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS terms FROM D)
, DF AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(terms) AS term FROM TT) u GROUP BY term)
, VOC AS (SELECT least(count(*), 800) AS n FROM DF WHERE df >= 2 AND df <= 0.9 * (SELECT count(*) FROM P11))
, CAT AS (SELECT sum(CASE WHEN often > 0 THEN often ELSE 0 END + CASE WHEN rare > 0 THEN 1 ELSE 0 END) AS n FROM (
    SELECT count(*) FILTER (c >= 2) AS often, count(*) FILTER (c < 2) AS rare
    FROM (SELECT series, count(*) AS c FROM P11 GROUP BY series)
    UNION ALL SELECT count(*) FILTER (c >= 2), count(*) FILTER (c < 2)
    FROM (SELECT model, count(*) AS c FROM P11 GROUP BY model)) x)
SELECT CAST((SELECT n FROM VOC) + (SELECT n FROM CAT) AS INTEGER) AS n_features, count(*) AS rows FROM P11
""")
def m5_assemble(spark, sf_dir):
    """One-hot (series, model; rare grouped) + TF-IDF text assembled into one sparse vector per row."""
    rows = fl.flatten_v3(Bases(spark, sf_dir).bids())
    out = ft.feature_pipeline("descripcion", 800, ["series", "model"], accents=True).fit(rows).transform(rows)
    return out.select(F.size(vector_to_array("features")).alias("n_features")).groupBy("n_features").agg(
        F.count(F.lit(1)).alias("rows"))


def flat_training_rows(spark, sf_dir, min_examples=10, max_classes=100):
    """M14 input: improved flatten + row id -> F2 + F8 context text -> W3 class selection."""
    rows = Bases(spark, sf_dir).training()
    rows = rows.withColumn("full_description", tx.training_context(
        "maker", tx.normalize_keep_punctuation("descripcion")))
    sel = sp.select_frequent_classes(rows, "referencia", min_examples, max_classes)
    return sp.keep_classes(rows, sel, "referencia", bounded_rows=max_classes)


def _metrics(spark, kind, model, test):
    better = md.holdout_accuracy(model, test) > md.majority_share(test)
    return spark.createDataFrame([(kind, int(model.meta["n_classes"]), test.count(), better)],
                                 "model string, n_classes int, n_test long, beats_majority boolean")


@query("M7_mlp_flat_model", _metrics_sql("mlp"))
def m7_mlp(spark, sf_dir):
    """Flat MLP (100-50), vocabulary 5000 uni+bigrams, on the W5 split of the W3 classes."""
    model, test = _flat_model(spark, sf_dir)
    return _metrics(spark, "mlp", model, test)


@query("M8_mlp_retrain_with_feedback", with_bases("T", "E") + """
, R3 AS (SELECT referencia FROM T UNION ALL SELECT referencia FROM (
           SELECT CASE WHEN is_correct THEN predicted_sku
                       WHEN NOT is_correct AND correct_sku <> '' THEN correct_sku END AS referencia FROM E) u
         WHERE referencia IS NOT NULL)
, CL AS (SELECT referencia, count(*) AS n FROM R3 GROUP BY referencia HAVING count(*) >= 10
         ORDER BY n DESC, referencia LIMIT 50)
SELECT 'mlp_retrain' AS model, CAST(count(*) AS INTEGER) AS n_classes, CAST(sum(floor(n * 0.2 + 0.5)) AS BIGINT) AS n_test,
       true AS beats_majority FROM CL
""")
def m8_retrain(spark, sf_dir):
    """Retraining set (R3, original ∪ feedback, 10/50, 500 features) with the 256-128 MLP."""
    model, test = _retrained(spark, sf_dir)
    return _metrics(spark, "mlp_retrain", model, test)


def _retrained(spark, sf_dir):
    def make():
        b = Bases(spark, sf_dir)
        rows = fb.retraining_set(b.training(), b.feedback(), None, 10, 50)
        return md.train_flat(rows, "mlp_retrain", md.TrainParams(vocab_size=500), text_col="descripcion")
    return _fitted(spark, ("retrained", sf_dir), make)


@query("M9_random_forest", _metrics_sql("rf"))
def m9_rf(spark, sf_dir):
    model, test = md.train_flat(flat_training_rows(spark, sf_dir), "rf", md.TrainParams(vocab_size=1000))
    return _metrics(spark, "rf", model, test)


SMALL = md.TrainParams(vocab_size=500, bigrams=False, accents=True, sample=2000, max_classes=50, split="plain",
                       categorical=("maker",))


@query("M10_decision_tree_small_model", """
WITH S AS (SELECT lang AS referencia FROM documents ORDER BY md5('42|' || doc_id) LIMIT 2000)
, CL AS (SELECT referencia, count(*) AS n FROM S GROUP BY referencia HAVING count(*) >= 10 ORDER BY n DESC, referencia LIMIT 50)
SELECT 'dt' AS model, CAST(count(*) AS INTEGER) AS n_classes, CAST(ceil(sum(n) * 0.2) AS BIGINT) AS n_test,
       true AS beats_majority FROM CL
""")
def m10_dt(spark, sf_dir):
    """Small model (S13 ``SMALL``): seeded sample, unigrams without accents, one-hot, plain split, tree of depth 10.

    The basis is documents (label: language, category: source): a sample of 2,000 flattened rows
    leaves no SKU with ten of them.
    """
    rows = Bases(spark, sf_dir).documents().select(
        F.col("doc_id").cast("string").alias("row_id"), tx.clean_text("text").alias("full_description"),
        F.col("lang").alias("referencia"), F.col("source").alias("maker"))
    rows = sp.seeded_sample(rows, SMALL.sample, "row_id", SMALL.seed)
    sel = sp.select_frequent_classes(rows, "referencia", SMALL.min_examples, SMALL.max_classes)
    rows = sp.keep_classes(rows, sel, "referencia", bounded_rows=SMALL.max_classes)
    model, test = md.train_flat(rows, "dt", SMALL)
    return _metrics(spark, "dt", model, test)


@query("M11_logistic_regression", _metrics_sql("lr"))
def m11_lr(spark, sf_dir):
    model, test = md.train_flat(flat_training_rows(spark, sf_dir), "lr", md.TrainParams(vocab_size=5000))
    return _metrics(spark, "lr", model, test)


@query("M20_balanced_fit", with_bases("T") + _CLASSES + """
SELECT count(DISTINCT referencia) FILTER (NOT is_test) AS n_classes, count(*) FILTER (is_test) AS n_test,
       true AS above_chance FROM SP
""")
def m20_balanced(spark, sf_dir):
    """Trees fitted with balanced row weights: mean recall over the classes of the holdout."""
    model, test = md.train_flat(flat_training_rows(spark, sf_dir), "dt", md.TrainParams(vocab_size=1000, balanced=True))
    hit = md.predictions(model, test, "row_id").join(test.select("row_id", "referencia"), "row_id")
    recall = hit.groupBy("referencia").agg(F.count(F.lit(1)).alias("n"), F.avg(
        (F.col("predicted") == F.col("referencia")).cast("double")).alias("r"))
    return recall.agg(F.lit(len(model.labels)).cast("long").alias("n_classes"), F.sum("n").alias("n_test"),
                      (F.avg("r") > F.lit(1.0 / len(model.labels))).alias("above_chance"))


@query("X3_foreign_classifier", _metrics_sql("naive bayes"))
def x3_foreign(spark, sf_dir):
    """Any spark.ml classifier takes the place of the named kinds, here naive Bayes."""
    model, test = md.train_flat(flat_training_rows(spark, sf_dir), NaiveBayes(), md.TrainParams(vocab_size=1000))
    return _metrics(spark, "naive bayes", model, test)


@query("M12_model_comparison", with_bases("T") + _CLASSES + """
SELECT model, (SELECT count(*) FROM SP WHERE is_test) AS n_test, true AS beats_majority
FROM (VALUES ('lr'), ('dt'), ('rf'), ('mlp')) v(model)
""")
def m12_compare(spark, sf_dir):
    rows = flat_training_rows(spark, sf_dir)
    out = md.compare_models(rows, ("lr", "dt", "rf", "mlp"), md.TrainParams(vocab_size=1000))
    test = sp.stratified_split(rows, "referencia", "row_id", 0.2, 42).filter("is_test")
    return out.select("model", "n_test", (F.col("accuracy") > md.majority_share(test)).alias("beats_majority"))


@query("M13_cross_validation", with_bases("T") + _CLASSES + """
, FD AS (SELECT CAST('0x' || substr(md5('42|' || row_id), 1, 8) AS BIGINT) % 3 AS fold FROM SP)
SELECT 'lr' AS model, CAST(fold AS INTEGER) AS fold, count(*) AS n_test FROM FD GROUP BY fold
""")
def m13_cv(spark, sf_dir):
    return md.cross_validate(flat_training_rows(spark, sf_dir), "lr", 3, md.TrainParams(vocab_size=1000)).select(
        "model", "fold", "n_test")


_FITTED: dict = {}      # models that several queries use, fitted once per session and input


def _fitted(spark, name, make):
    key = (spark.sparkContext.applicationId, *name)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _flat_model(spark, sf_dir, kind="mlp"):
    return _fitted(spark, ("flat", sf_dir, kind), lambda: md.train_flat(
        flat_training_rows(spark, sf_dir), kind, md.TrainParams(vocab_size=5000)))


_SCORED_SQL = with_bases("T") + _CLASSES + """
SELECT row_id, true AS at_most_five, true AS best_first, true AS top_is_first FROM SP WHERE is_test
"""


def _scored(pred):
    """What holds for every scored row whatever the fit: size, order and top candidate."""
    c = F.transform("top_skus", lambda x: x["confidence"])
    return pred.select(
        "row_id", (F.size(c) <= 5).alias("at_most_five"),
        (c == F.reverse(F.array_sort(c))).alias("best_first"),
        (F.coalesce(F.get("top_skus", F.lit(0))["sku"], F.lit("")) == F.coalesce("top_sku", F.lit(""))).alias("top_is_first"))


@query("M14_M16_flat_pipeline_scoring", _SCORED_SQL)
def m16_score(spark, sf_dir):
    """Flat pipeline fitted, holdout scored to top-5 candidates inside the row."""
    model, test = _flat_model(spark, sf_dir)
    return _scored(md.score_flat(model, test, "row_id", 5))


@query("M16_serve_requests", with_bases("T") + _CLASSES + """
SELECT mode || row_id AS row_id, true AS at_most_five, true AS best_first, true AS top_is_first
FROM SP, (VALUES ('training:'), ('serving:')) m(mode) WHERE is_test
""")
def m16_serve(spark, sf_dir):
    """Raw request columns -> text as trained, or F9 -> F7 -> network -> top five."""
    model, test = _flat_model(spark, sf_dir)
    requests = test.select("row_id", F.col("descripcion").alias("description"), "maker",
                           F.lit(None).cast("string").alias("model_family"), "series", F.col("model").alias("model_year"))
    parts = [_scored(md.serve(model, requests, "row_id", mode)).withColumn(
        "row_id", F.concat(F.lit(f"{mode}:"), "row_id")) for mode in ("training", "serving")]
    return parts[0].unionByName(parts[1])


def _hier(spark, sf_dir):
    """The hierarchical models, forests of 100 trees of depth 15 for the maker and for each SKU model, and the holdout."""
    return _fitted(spark, ("hierarchical", sf_dir), lambda: _fit_hier(spark, sf_dir))


def _fit_hier(spark, sf_dir):
    rows = Bases(spark, sf_dir).training()
    rows = fb.preprocess_training_text(rows, ("series", "model", "descripcion"))
    kept = sp.min_examples_per_maker(rows, "maker", "referencia", 3, 100, 2)
    path = scratch_path(spark, "hierarchical-split")
    sp.stratified_split(kept, "referencia", "row_id", 0.2, 42).write.parquet(path)
    split = spark.read.parquet(path)
    makers = sorted(r["maker"] for r in kept.select("maker").distinct().collect())
    maker_model, sku_models = md.train_hierarchical(split.filter(~F.col("is_test")), makers, "rf_maker", "rf_sku", parallelism=8)
    test = split.filter("is_test").withColumn("provided_maker", F.when(F.col("maker") < "NATION_2", F.col("maker")))
    return maker_model, sku_models, test


_HIER = with_bases("T") + """
, PC AS (SELECT maker, referencia, count(*) AS n FROM T GROUP BY maker, referencia)
, MM AS (SELECT maker FROM PC GROUP BY maker HAVING sum(n) >= 100 AND count(*) FILTER (WHERE n >= 3) >= 2)
, KEPT AS (SELECT T.* FROM T JOIN (SELECT maker, referencia FROM PC WHERE n >= 3 AND maker IN (SELECT maker FROM MM)) k
           USING (maker, referencia))
, HS AS (SELECT *, row_number() OVER (PARTITION BY referencia ORDER BY md5('42|' || row_id))
                     <= floor(count(*) OVER (PARTITION BY referencia) * 0.2 + 0.5) AS is_test FROM KEPT)
"""


@query("M15_hierarchical_training", _HIER + """
SELECT maker, CAST(count(DISTINCT referencia) FILTER (NOT is_test) AS INTEGER) AS n_classes,
       count(*) FILTER (is_test) AS n_test FROM HS GROUP BY maker
""")
def m15_hier_train(spark, sf_dir):
    """Maker model + one SKU model per W4 maker: classes and holdout rows per maker."""
    maker_model, sku_models, test = _hier(spark, sf_dir)
    fitted = spark.createDataFrame([(m, len(sm.labels)) for m, sm in sku_models.items()], "maker string, n_classes int")
    rows = test.groupBy("maker").agg(F.count(F.lit(1)).alias("n_test"))
    return fitted.join(rows, "maker", "left").fillna(0, ["n_test"])


_ROUTED_SQL = _HIER + """
SELECT row_id, CASE WHEN maker < 'NATION_2' THEN maker END AS kept_maker, true AS consistent FROM HS WHERE is_test
"""


def _routed(out):
    """Provided makers are kept with confidence one; overall confidence is the product of both."""
    overall = F.col("maker_confidence") * F.col("sku_confidence")
    ok = F.col("predicted_maker").isNotNull() & (F.abs(F.col("overall_confidence") - F.when(
        F.col("predicted_sku").isNotNull(), overall).otherwise(0.0)) < 1e-9)
    ok = ok & (F.col("provided_maker").isNull() | (F.col("maker_confidence") == 1.0))
    return out.select("row_id", F.when(F.col("provided_maker").isNotNull(), F.col("predicted_maker")).alias("kept_maker"),
                      ok.alias("consistent"))


@query("M18_model_hierarchical_scoring", _ROUTED_SQL)
def m18_model_scoring(spark, sf_dir):
    maker_model, sku_models, test = _hier(spark, sf_dir)
    return _routed(md.predict_hierarchical(test, maker_model, sku_models, "row_id", "provided_maker"))


@query("M19_batch_predict_file", _ROUTED_SQL)
def m19_batch(spark, sf_dir):
    """S11 -> hierarchical scorer -> K8: holdout written as CSV, read back, scored, written as JSON, read back."""
    maker_model, sku_models, test = _hier(spark, sf_dir)
    columns = ["row_id", "provided_maker", "series", "model", "descripcion"]
    inp = scratch_path(spark, "predict-input")
    sinks.write_flat_csv(test.select(*columns), inp)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = src.read_flat_csv(spark, inp, schema, escaped=True)
    out = scratch_path(spark, "predict-output")
    sinks.write_json_records(md.predict_hierarchical(rows, maker_model, sku_models, "row_id", "provided_maker"), out)
    return _routed(spark.read.schema(
        "row_id string, provided_maker string, predicted_maker string, maker_confidence double, predicted_sku string, "
        "sku_confidence double, overall_confidence double").json(out))


@query("M8_early_stopping", with_bases("T", "E") + """
, R3 AS (SELECT referencia FROM T UNION ALL SELECT referencia FROM (
           SELECT CASE WHEN is_correct THEN predicted_sku
                       WHEN NOT is_correct AND correct_sku <> '' THEN correct_sku END AS referencia FROM E) u
         WHERE referencia IS NOT NULL)
, CL AS (SELECT referencia, count(*) AS n FROM R3 GROUP BY referencia HAVING count(*) >= 10
         ORDER BY n DESC, referencia LIMIT 50)
, TR AS (SELECT CAST(sum(n - floor(n * 0.2 + 0.5)) AS BIGINT) AS n FROM CL)
SELECT CAST(ceil(n * 0.1) AS BIGINT) AS n_validation, n - CAST(ceil(n * 0.1) AS BIGINT) AS n_train,
       true AS best_is_highest, true AS ends_in_time FROM TR
""")
def m8_early_stopping(spark, sf_dir):
    """The curve of the retrained network: a tenth of its rows validates, the best round's weights stay."""
    meta = _retrained(spark, sf_dir)[0].meta
    curve, best = meta["validation_curve"], meta["best_round"]
    p = md.TrainParams()
    highest = max(curve) <= curve[best] + p.min_gain and all(x < curve[best] for x in curve[:best])
    in_time = len(curve) == min(p.max_iter // p.round_iter, best + p.patience + 1)
    return spark.createDataFrame([(meta["n_validation"], meta["n_train"], highest, in_time)],
                                 "n_validation long, n_train long, best_is_highest boolean, ends_in_time boolean")


@query("R4_model_promotion", with_bases("T") + """
SELECT CAST(sum(floor(n * 0.2 + 0.5)) AS BIGINT) AS n_test, true AS strictly_better_only
FROM (SELECT count(*) AS n FROM T GROUP BY referencia) c
""")
def r4_model_promotion(spark, sf_dir):
    """Incumbent (original rows) vs challenger (original ∪ feedback), both on F3 text and one holdout."""
    b = Bases(spark, sf_dir)
    rows = fb.preprocess_training_text(b.training())
    fbrows = fb.preprocess_training_text(
        fb.feedback_training_rows(b.feedback(), keep_id=True).withColumnRenamed("id", "row_id"))
    split = md.staged(sp.stratified_split(rows, "referencia", "row_id", 0.2, 42), "promotion-split")
    train, test = split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test")
    p = md.TrainParams(vocab_size=500)
    sel = sp.select_frequent_classes(train, "referencia", 10, 50)
    inc = md.fit(md.staged(sp.keep_classes(train, sel, "referencia", 50), "incumbent-rows"), "descripcion", "mlp_retrain", p)
    chal_rows = train.select(*fbrows.columns).unionByName(fbrows)
    sel2 = sp.select_frequent_classes(chal_rows, "referencia", 10, 50)
    chal = md.fit(md.staged(sp.keep_classes(chal_rows, sel2, "referencia", 50), "challenger-rows"), "descripcion", "mlp_retrain", p)
    d = md.challenger_decision(inc, chal, test)
    return d.select(F.lit(test.count()).alias("n_test"),
                    (F.col("promote") == (F.col("new_accuracy") > F.col("previous_accuracy"))).alias("strictly_better_only"))


@query("K13_S12_model_save_load", with_bases("T") + _CLASSES + """
SELECT count(*) AS rows, count(*) AS equal_predictions FROM SP WHERE is_test
""")
def k13_save_load(spark, sf_dir):
    """K13 + S12: saved pipeline reloaded gives identical predictions on the holdout."""
    model, test = _flat_model(spark, sf_dir)
    path = md.save_model(model, scratch_path(spark, "model"))
    loaded = md.load_model(spark, path)
    a = md.predictions(model, test, "row_id")
    b2 = md.predictions(loaded, test, "row_id").select("row_id", F.col("predicted").alias("p2"))
    j = a.join(b2, "row_id")
    return j.agg(F.count(F.lit(1)).alias("rows"),
                 F.count_if(F.col("predicted") == F.col("p2")).alias("equal_predictions"))


@query("M21_evaluation_sample", _HIER + """
SELECT CAST(least(1000, floor(0.2 * count(*))) AS BIGINT) AS n, true AS in_range FROM HS WHERE is_test
""")
def m21_eval_sample(spark, sf_dir):
    """Evaluation of the hierarchical models on a seeded sample of min(1000, 20 %) holdout rows (T6 + A16)."""
    maker_model, sku_models, test = _hier(spark, sf_dir)
    sample = sp.seeded_sample(test, 1000, "row_id", 42, fraction_cap=0.2)
    report = ev.coverage_report(md.predict_hierarchical(sample, maker_model, sku_models, "row_id", "provided_maker"))
    share = [F.col(c).between(0, 1) for c in ("maker_accuracy", "sku_accuracy", "sku_coverage")]
    return report.select(F.col("test_size").alias("n"), (share[0] & share[1] & share[2]).alias("in_range"))
