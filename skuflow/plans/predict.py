"""Queries for ranking, routing, hierarchical scoring and evaluation (basis P).

The test "models" are exact probability tables derived from the flattened
rows: the SKU model is P (SKU frequency per (maker, description)) and the maker
model is the maker frequency per description. Evaluation runs on the W5
holdout. A maker is *provided* for makers before 'NATION_2' only, and makers whose
name ends in '7' have no SKU model, so routing, prediction and the no-model
branch are all exercised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.operators import evaluate as ev
from skuflow.operators import flatten as fl
from skuflow.operators import ranking as rk
from skuflow.operators import split as sp
from skuflow.plans.registry import query, with_bases
from skuflow.sources.bases import Bases

R = 6  # decimals kept for floating metrics on both sides


def _rnd(c):
    return F.round(F.col(c), R).alias(c)


def sku_model(spark, sf_dir):
    return Bases(spark, sf_dir).probabilities()


def maker_model(spark, sf_dir):
    rows = Bases(spark, sf_dir).training()
    pair = rows.groupBy("descripcion", "maker").agg(F.count(F.lit(1)).alias("n"))
    tot = pair.groupBy("descripcion").agg(F.sum("n").alias("t"))
    return pair.join(tot, "descripcion").select(
        "descripcion", "maker", (F.col("n").cast("double") / F.col("t").cast("double")).alias("confidence"))


def model_makers(spark, sf_dir):
    rows = Bases(spark, sf_dir).training()
    kept = sp.min_examples_per_maker(rows, "maker", "referencia", 3, 100, 2)
    return kept.select("maker").distinct().filter(~F.col("maker").endswith("7"))


def holdout(spark, sf_dir):
    rows = Bases(spark, sf_dir).training()
    split = sp.stratified_split(rows, "referencia", "row_id", 0.2, 42)
    test = split.filter("is_test").drop("is_test")
    return test.withColumn("provided_maker", F.when(F.col("maker") < "NATION_2", F.col("maker")))


def flat_scored(spark, sf_dir):
    best = rk.argmax(sku_model(spark, sf_dir), ["maker", "descripcion"], "sku", "confidence",
                     out_label="predicted", out_conf="confidence")
    return ev.pair_predictions(holdout(spark, sf_dir), best, ["maker", "descripcion"])


def hier_scored(spark, sf_dir):
    mm = model_makers(spark, sf_dir)
    routed = ev.route_maker(holdout(spark, sf_dir), mm, maker_model(spark, sf_dir), "provided_maker",
                            "descripcion")
    return ev.score_hierarchical(routed, mm, sku_model(spark, sf_dir), "descripcion")


# ----------------------------------------------------------------------------- SQL twins
_SQL_BASE = with_bases("P", "T") + """
, PM AS (SELECT descripcion, maker, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY descripcion) AS DOUBLE) AS confidence
         FROM (SELECT descripcion, maker, count(*) AS n FROM P11 GROUP BY descripcion, maker) x)
, PC AS (SELECT maker, referencia, count(*) AS n FROM P11 GROUP BY maker, referencia)
, MM AS (SELECT maker FROM PC GROUP BY maker
         HAVING sum(n) >= 100 AND count(*) FILTER (WHERE n >= 3) >= 2 AND NOT maker LIKE '%7')
, SPLIT AS (SELECT *, row_number() OVER (PARTITION BY referencia ORDER BY md5('42|' || row_id))
                      <= floor(count(*) OVER (PARTITION BY referencia) * 0.2 + 0.5) AS is_test FROM T)
, HO AS (SELECT maker, series, model, descripcion, referencia, row_id,
                CASE WHEN maker < 'NATION_2' THEN maker END AS provided_maker FROM SPLIT WHERE is_test)
, BS AS (SELECT maker, descripcion, sku AS predicted, confidence FROM (
           SELECT *, row_number() OVER (PARTITION BY maker, descripcion ORDER BY confidence DESC, sku) AS rn FROM P) x
         WHERE rn = 1)
, BM AS (SELECT descripcion, maker AS pm, confidence AS pmc FROM (
           SELECT *, row_number() OVER (PARTITION BY descripcion ORDER BY confidence DESC, maker) AS rn FROM PM) x
         WHERE rn = 1)
, FS AS (SELECT HO.*, BS.predicted, BS.confidence FROM HO LEFT JOIN BS USING (maker, descripcion))
, RT AS (SELECT HO.*,
                CASE WHEN HO.provided_maker IN (SELECT maker FROM MM) THEN HO.provided_maker ELSE BM.pm END AS predicted_maker,
                CASE WHEN HO.provided_maker IN (SELECT maker FROM MM) THEN 1.0 ELSE BM.pmc END AS maker_confidence
         FROM HO LEFT JOIN BM USING (descripcion))
, HS AS (SELECT RT.*, BS.predicted AS predicted_sku, coalesce(BS.confidence, 0.0) AS sku_confidence,
                CASE WHEN BS.predicted IS NOT NULL THEN RT.maker_confidence * BS.confidence ELSE 0.0 END AS overall_confidence
         FROM RT LEFT JOIN (SELECT * FROM BS WHERE maker IN (SELECT maker FROM MM)) BS
           ON BS.maker = RT.predicted_maker AND BS.descripcion = RT.descripcion)
"""

_W1 = """
, RK AS (SELECT *, row_number() OVER (PARTITION BY maker, descripcion
                                      ORDER BY (confidence > 0.001) DESC, confidence DESC, sku) AS rn FROM P)
, W1 AS (SELECT maker, descripcion,
                list({'sku': sku, 'confidence': round(confidence, 6)} ORDER BY rn) FILTER (WHERE confidence > 0.001) AS top_skus,
                max(CASE WHEN rn = 1 AND confidence > 0.001 THEN sku END) AS top_sku,
                coalesce(max(CASE WHEN rn = 1 AND confidence > 0.001 THEN confidence END), 0.0) AS top_confidence
         FROM RK WHERE rn <= 5 GROUP BY maker, descripcion)
"""


def _long(df):
    """Candidate lists in long form (one row per key and rank) for order-free comparison."""
    return df.select("maker", "descripcion", "top_sku", _rnd("top_confidence"),
                     F.posexplode_outer("top_skus").alias("pos", "cand")).select(
        "maker", "descripcion", "top_sku", "top_confidence",
        (F.col("pos") + 1).cast("long").alias("rank"), F.col("cand.sku").alias("sku"),
        F.round("cand.confidence", R).alias("confidence"))


@query("W1_top5_candidates", _SQL_BASE + """
, RK AS (SELECT *, row_number() OVER (PARTITION BY maker, descripcion
                                      ORDER BY (confidence > 0.001) DESC, confidence DESC, sku) AS rn FROM P)
, TOP AS (SELECT maker, descripcion, sku AS top_sku, confidence AS top_confidence FROM RK WHERE rn = 1)
SELECT TOP.maker, TOP.descripcion,
       CASE WHEN TOP.top_confidence > 0.001 THEN TOP.top_sku END AS top_sku,
       round(CASE WHEN TOP.top_confidence > 0.001 THEN TOP.top_confidence ELSE 0.0 END, 6) AS top_confidence,
       RK.rn AS rank, RK.sku, round(RK.confidence, 6) AS confidence
FROM TOP LEFT JOIN RK ON RK.maker = TOP.maker AND RK.descripcion = TOP.descripcion
                      AND RK.rn <= 5 AND RK.confidence > 0.001
""")
def w1_top5(spark, sf_dir):
    return _long(rk.top_candidates(sku_model(spark, sf_dir), ["maker", "descripcion"]))


@query("W2_argmax", _SQL_BASE + "SELECT maker, descripcion, predicted, round(confidence, 6) AS confidence FROM BS")
def w2_argmax(spark, sf_dir):
    best = rk.argmax(sku_model(spark, sf_dir), ["maker", "descripcion"], "sku", "confidence")
    return best.select("maker", "descripcion", "predicted", _rnd("confidence"))


@query("P19_confidence_threshold", _SQL_BASE +
       "SELECT maker, descripcion, CAST(count(*) AS BIGINT) AS n_candidates FROM P "
       "WHERE confidence > 0.001 GROUP BY maker, descripcion")
def p19_threshold(spark, sf_dir):
    return (sku_model(spark, sf_dir).filter(F.col("confidence") > rk.MIN_CONFIDENCE)
            .groupBy("maker", "descripcion").agg(F.count(F.lit(1)).alias("n_candidates")))


@query("M17_score_without_probabilities", _SQL_BASE +
       "SELECT maker, descripcion, predicted AS top_sku, CAST(1.0 AS DOUBLE) AS top_confidence, "
       "CAST(1 AS BIGINT) AS rank, predicted AS sku, CAST(1.0 AS DOUBLE) AS confidence FROM BS")
def m17_single(spark, sf_dir):
    best = rk.argmax(sku_model(spark, sf_dir), ["maker", "descripcion"], "sku", "confidence")
    return _long(rk.single_candidate(best, ["maker", "descripcion"], "predicted"))


@query("F22_confidence_band", _SQL_BASE + _W1 + """
SELECT maker, descripcion, CAST(round(top_confidence * 100) AS INTEGER) AS confidence_pct,
       CASE WHEN round(top_confidence * 100) >= 70 THEN 'high'
            WHEN round(top_confidence * 100) >= 40 THEN 'medium' ELSE 'low' END AS band
FROM W1
""")
def f22_band(spark, sf_dir):
    w1 = rk.top_candidates(sku_model(spark, sf_dir), ["maker", "descripcion"])
    return w1.select("maker", "descripcion", rk.confidence_percent().alias("confidence_pct"),
                     rk.confidence_band().alias("band"))


@query("J6_prediction_truth_pairing", _SQL_BASE +
       "SELECT row_id, referencia, predicted FROM FS")
def j6_pairing(spark, sf_dir):
    return flat_scored(spark, sf_dir).select("row_id", "referencia", "predicted")


@query("J8_route_maker", _SQL_BASE +
       "SELECT row_id, predicted_maker, round(maker_confidence, 6) AS maker_confidence FROM RT")
def j8_route(spark, sf_dir):
    mm = model_makers(spark, sf_dir)
    routed = ev.route_maker(holdout(spark, sf_dir), mm, maker_model(spark, sf_dir))
    return routed.select("row_id", "predicted_maker", _rnd("maker_confidence"))


@query("M18_score_hierarchical", _SQL_BASE + """
SELECT row_id, predicted_maker, round(maker_confidence, 6) AS maker_confidence, predicted_sku,
       round(sku_confidence, 6) AS sku_confidence, round(overall_confidence, 6) AS overall_confidence FROM HS
""")
def m18_hierarchical(spark, sf_dir):
    s = hier_scored(spark, sf_dir)
    return s.select("row_id", "predicted_maker", _rnd("maker_confidence"), "predicted_sku",
                    _rnd("sku_confidence"), _rnd("overall_confidence"))


@query("F21_overall_confidence", _SQL_BASE +
       "SELECT row_id, round(overall_confidence, 6) AS overall_confidence FROM HS")
def f21_overall(spark, sf_dir):
    return hier_scored(spark, sf_dir).select("row_id", _rnd("overall_confidence"))


@query("A15_accuracy", _SQL_BASE +
       "SELECT round(coalesce(avg(coalesce(CAST(predicted = referencia AS DOUBLE), 0.0)), 0.0), 6) AS accuracy FROM FS")
def a15_accuracy(spark, sf_dir):
    return ev.accuracy(flat_scored(spark, sf_dir), "referencia", "predicted").select(_rnd("accuracy"))


@query("A16_coverage_report", _SQL_BASE + """
SELECT round(avg(CAST(predicted_maker = maker AS DOUBLE)), 6) AS maker_accuracy,
       round(coalesce(avg(CASE WHEN predicted_sku IS NOT NULL THEN CAST(predicted_sku = referencia AS DOUBLE) END), 0.0), 6) AS sku_accuracy,
       round(avg(CAST(predicted_sku IS NOT NULL AS DOUBLE)), 6) AS sku_coverage,
       CAST(count(*) AS BIGINT) AS test_size
FROM HS
""")
def a16_coverage(spark, sf_dir):
    r = ev.coverage_report(hier_scored(spark, sf_dir))
    return r.select(_rnd("maker_accuracy"), _rnd("sku_accuracy"), _rnd("sku_coverage"), "test_size")


def _report_sql(source: str, truth: str, pred: str) -> str:
    return f"""
, SUP AS (SELECT {truth} AS label, count(*) AS support FROM {source} GROUP BY 1)
, NP AS (SELECT {pred} AS label, count(*) AS n_pred FROM {source} WHERE {pred} IS NOT NULL GROUP BY 1)
, TP AS (SELECT {truth} AS label, count(*) AS tp FROM {source} WHERE {pred} = {truth} GROUP BY 1)
, PER AS (SELECT coalesce(SUP.label, NP.label, TP.label) AS label, coalesce(support, 0) AS support,
                 coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
          FROM SUP FULL JOIN NP ON SUP.label = NP.label FULL JOIN TP ON coalesce(SUP.label, NP.label) = TP.label)
, PR AS (SELECT label, support,
                CASE WHEN n_pred > 0 THEN CAST(tp AS DOUBLE) / n_pred ELSE 0.0 END AS precision,
                CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall FROM PER)
, F AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM PR)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, CAST(support AS BIGINT) AS support,
       round(f1, 6) AS f1 FROM F
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), CAST(sum(support) AS BIGINT), round(avg(f1), 6) FROM F
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT), round(sum(f1 * support) / sum(support), 6) FROM F
"""


def _report(df):
    return df.select("label", _rnd("precision"), _rnd("recall"), "support", _rnd("f1"))


@query("A17_classification_report", _SQL_BASE + _report_sql("HS", "maker", "predicted_maker"))
def a17_report(spark, sf_dir):
    return _report(ev.classification_report(hier_scored(spark, sf_dir), "maker", "predicted_maker"))


@query("M23_sku_precision_recall", _SQL_BASE + _report_sql("FS", "referencia", "predicted"))
def m23_sku_report(spark, sf_dir):
    return _report(ev.classification_report(flat_scored(spark, sf_dir), "referencia", "predicted"))


@query("A18_confusion_pairs", _SQL_BASE + """
SELECT referencia AS true_label, predicted AS predicted_label, CAST(count(*) AS BIGINT) AS count
FROM FS WHERE predicted IS NOT NULL AND predicted <> referencia GROUP BY 1, 2
""")
def a18_confusion(spark, sf_dir):
    return ev.confusion_pairs(flat_scored(spark, sf_dir), "referencia", "predicted")


@query("T4_top_maker_misclassifications", _SQL_BASE + """
SELECT maker AS true_label, predicted_maker AS predicted_label, CAST(count(*) AS BIGINT) AS count
FROM HS WHERE predicted_maker IS NOT NULL AND predicted_maker <> maker GROUP BY 1, 2
ORDER BY count DESC, true_label, predicted_label LIMIT 5
""")
def t4_top_confusions(spark, sf_dir):
    return ev.top_confusions(hier_scored(spark, sf_dir), "maker", "predicted_maker", 5)


@query("M22_maker_errors", _SQL_BASE + """
SELECT maker AS true_maker, predicted_maker, round(maker_confidence, 6) AS confidence, descripcion AS description
FROM HS WHERE predicted_maker <> maker
""")
def m22_maker_errors(spark, sf_dir):
    e = ev.maker_errors(hier_scored(spark, sf_dir))
    return e.select("true_maker", "predicted_maker", _rnd("confidence"), "description")


_SKU_ERR = """SELECT maker, referencia AS true_sku, predicted_sku, round(sku_confidence, 6) AS confidence,
       descripcion AS description FROM HS
WHERE predicted_maker = maker AND predicted_sku IS NOT NULL AND predicted_sku <> referencia"""


@query("M22_sku_errors", _SQL_BASE + _SKU_ERR)
def m22_sku_errors(spark, sf_dir):
    e = ev.sku_errors(hier_scored(spark, sf_dir))
    return e.select("maker", "true_sku", "predicted_sku", _rnd("confidence"), "description")


@query("A19_errors_per_maker", _SQL_BASE +
       f"SELECT maker, CAST(count(*) AS BIGINT) AS error_count FROM ({_SKU_ERR}) e GROUP BY maker")
def a19_errors_per_maker(spark, sf_dir):
    return ev.errors_per_maker(ev.sku_errors(hier_scored(spark, sf_dir)))


@query("A21_accuracy_per_maker", _SQL_BASE + """
SELECT maker, round(avg(coalesce(CAST(predicted = referencia AS DOUBLE), 0.0)), 6) AS accuracy,
       CAST(count(*) AS BIGINT) AS test_size FROM FS GROUP BY maker
""")
def a21_per_maker(spark, sf_dir):
    r = ev.accuracy_per_maker(flat_scored(spark, sf_dir), "referencia", "predicted")
    return r.select("maker", _rnd("accuracy"), "test_size")


@query("T7_first_examples", _SQL_BASE + """
SELECT descripcion, referencia AS true_sku, predicted AS predicted_sku FROM FS
ORDER BY md5('42|' || row_id) LIMIT 5
""")
def t7_examples(spark, sf_dir):
    s = flat_scored(spark, sf_dir).withColumn("__h", sp.hash_key("row_id", 42))
    return s.orderBy("__h").limit(5).select("descripcion", F.col("referencia").alias("true_sku"),
                                           F.col("predicted").alias("predicted_sku"))
