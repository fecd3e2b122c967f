"""Sink round trips and file scans (K1-K10, S3-S5, S11, U1, U3) and remaining scalar rows.

Each sink query writes to a fresh folder under the shared checkpoint dir and
reads the result back, so the check covers the written format, not only the
DataFrame that was handed to the writer.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.functions import text as tx
from skuflow.functions.similarity import indel_ratio
from skuflow.operators import evaluate as ev
from skuflow.operators import flatten as fl
from skuflow.operators import hierarchy as hy
from skuflow.operators import profile as pf
from skuflow.plans import predict as pr
from skuflow.plans import sqltext as q
from skuflow.plans.registry import query, with_bases
from skuflow.schemas import FLAT_COLUMNS, require_columns
from skuflow.session import scratch_path
from skuflow.sinks import files as sinks
from skuflow.sources import files as src
from skuflow.sources.bases import Bases

# Makers requested in mixed case: each file is read once whatever the spelling (Q8).
S5_MAKERS = ["nation_3", "NATION_7", "Nation_11", "NATION_7"]
_S5_SQL = "('nation_3', 'nation_7', 'nation_11')"


def _p11(spark, sf_dir):
    return fl.flatten_v3(Bases(spark, sf_dir).bids())


_P11 = "SELECT maker, series, model, descripcion, referencia FROM P11"


@query("K1_flat_csv_roundtrip", with_bases("P11") + _P11)
def k1_flat_csv(spark, sf_dir):
    path = sinks.write_flat_csv(_p11(spark, sf_dir), scratch_path(spark, "flat-csv"))
    return src.read_flat_csv(spark, path, blank_as_null=False, escaped=True)


@query("S3_flat_csv_scan", with_bases("P11") +
       "SELECT nullif(maker, '') AS maker, nullif(series, '') AS series, nullif(model, '') AS model, "
       "nullif(descripcion, '') AS descripcion, nullif(referencia, '') AS referencia FROM P11")
def s3_flat_scan(spark, sf_dir):
    path = sinks.write_flat_csv(_p11(spark, sf_dir), scratch_path(spark, "flat-csv"))
    return src.read_flat_csv(spark, path, escaped=True)


@query("S4_column_pruned_csv_scan", with_bases("P11") + "SELECT descripcion, referencia FROM P11")
def s4_pruned(spark, sf_dir):
    path = sinks.write_flat_csv(_p11(spark, sf_dir), scratch_path(spark, "flat-csv"))
    return src.read_flat_columns(spark, path, ["descripcion", "referencia"], escaped=True)


@query("P17_required_columns", with_bases("P11") + _P11)
def p17_required(spark, sf_dir):
    return require_columns(_p11(spark, sf_dir), FLAT_COLUMNS)


_P12_ALL = """SELECT maker, descripcion, referencia FROM B
WHERE has_item AND maker <> '' AND trim(referencia) <> '' AND coalesce(descripcion, '') <> ''"""
_P12_LISTED = f"{_P12_ALL} AND lower(maker) IN {_S5_SQL}"


def _per_maker(spark, sf_dir):
    rows = fl.flatten_detailed(Bases(spark, sf_dir).bids())
    return sinks.write_per_maker_csv(rows, scratch_path(spark, "per-maker"))


@query("K2_per_maker_csv", with_bases("B") + f"""
SELECT {q.clean_maker('maker')} AS maker_key, CAST(count(*) AS BIGINT) AS n FROM B
WHERE has_item AND maker <> '' AND trim(referencia) <> '' GROUP BY 1
""")
def k2_per_maker(spark, sf_dir):
    path = _per_maker(spark, sf_dir)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ["maker", "series", "model", "descripcion", "referencia", "precio", "cantidad",
                            "estado", "maker_key"]])
    back = spark.read.schema(schema).option("header", True).csv(path)
    return back.groupBy("maker_key").agg(F.count(F.lit(1)).alias("n"))


@query("S5_per_maker_scan", with_bases("B") + _P12_LISTED)
def s5_per_maker(spark, sf_dir):
    return src.read_makers(spark, _per_maker(spark, sf_dir), S5_MAKERS)


@query("U1_union_per_maker_tables", with_bases("B") + _P12_ALL)
def u1_union(spark, sf_dir):
    """The union of all per-maker tables: one scan over all partitions."""
    return src.read_makers(spark, _per_maker(spark, sf_dir))


@query("K3_sku_list_files", with_bases("B") + f"""
SELECT DISTINCT {q.clean_maker('maker')} AS maker_key, {q.strip_ws('referencia')} AS sku FROM B
WHERE has_item AND maker <> '' AND referencia IS NOT NULL AND {q.strip_ws('referencia')} <> ''
""")
def k3_sku_lists(spark, sf_dir):
    items = fl.explode_items(fl.loose_bids(Bases(spark, sf_dir).bids())).filter(fl.item_sku_only_predicate())
    skus = items.select("maker", tx.py_strip("referencia").alias("sku"))
    path = sinks.write_sku_lists(skus, scratch_path(spark, "sku-lists"))
    return spark.read.schema("value string, maker_key string").text(path).select(
        "maker_key", F.col("value").alias("sku"))


@query("K4_json_records", with_bases("B") + """
SELECT bid_id, CAST(count(*) AS BIGINT) AS n_items FROM B WHERE has_item GROUP BY bid_id
""")
def k4_json(spark, sf_dir):
    path = sinks.write_json_records(fl.non_empty_bids(Bases(spark, sf_dir).bids()),
                                    scratch_path(spark, "bids-records"))
    from skuflow.sources.bids import read_bids
    return read_bids(spark, path).select("bid_id", F.size("items").cast("long").alias("n_items"))


@query("K7_maker_summary", with_bases("B") + """
SELECT maker AS Maker, CAST(count(*) AS BIGINT) AS "Number of Items" FROM B
WHERE has_item AND maker <> '' AND trim(referencia) <> '' GROUP BY maker
""")
def k7_summary(spark, sf_dir):
    rows = fl.flatten_detailed(Bases(spark, sf_dir).bids())
    summary = pf.rows_per_maker(rows).select(F.col("maker").alias("Maker"), F.col("n").alias("Number of Items"))
    path = sinks.write_summary(summary, scratch_path(spark, "maker-summary"))
    return spark.read.schema("Maker string, `Number of Items` long").option("header", True).csv(path)


@query("K7_sku_summary_tab", with_bases("B") + f"""
SELECT maker AS Maker, CAST(count(DISTINCT {q.strip_ws('referencia')}) AS BIGINT) AS "Number of Unique SKUs" FROM B
WHERE has_item AND maker <> '' AND referencia IS NOT NULL AND {q.strip_ws('referencia')} <> '' GROUP BY maker
""")
def k7_sku_summary(spark, sf_dir):
    items = fl.explode_items(fl.loose_bids(Bases(spark, sf_dir).bids())).filter(fl.item_sku_only_predicate())
    s = pf.distinct_skus_per_maker(items).select(F.col("maker").alias("Maker"),
                                                 F.col("n").alias("Number of Unique SKUs"))
    path = sinks.write_summary(s, scratch_path(spark, "sku-summary"), sep="\t")
    return spark.read.schema("Maker string, `Number of Unique SKUs` long").option("header", True) \
        .option("sep", "\t").csv(path)


@query("K8_prediction_sink", pr._SQL_BASE + """
SELECT row_id, descripcion, predicted_maker, predicted_sku, round(overall_confidence, 6) AS overall_confidence FROM HS
""")
def k8_predictions(spark, sf_dir):
    scored = pr.hier_scored(spark, sf_dir).select("row_id", "descripcion", "predicted_maker", "predicted_sku",
                                                  "overall_confidence")
    path = sinks.write_json_records(scored, scratch_path(spark, "predictions"))
    back = spark.read.schema(scored.schema).json(path)
    return back.withColumn("overall_confidence", F.round("overall_confidence", 6))


@query("S11_batch_prediction_input", pr._SQL_BASE + "SELECT row_id, maker, descripcion FROM HO")
def s11_prediction_input(spark, sf_dir):
    path = sinks.write_flat_csv(pr.holdout(spark, sf_dir).select("row_id", "maker", "descripcion"),
                                scratch_path(spark, "predict-input"))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ["row_id", "maker", "descripcion"]])
    return src.read_flat_csv(spark, path, schema, blank_as_null=False, escaped=True)


_CORR = ("SELECT maker, series, model, referencia AS SKU, descripcion AS description FROM B "
         "WHERE has_item AND referencia IS NOT NULL AND descripcion IS NOT NULL")


@query("K9_profiling_report", with_bases("B") + f"""
, c AS ({_CORR})
SELECT metric, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'rows' AS metric, count(*) AS value FROM c
  UNION ALL SELECT 'distinct_SKU', count(DISTINCT SKU) FROM c
  UNION ALL SELECT 'distinct_description', count(DISTINCT description) FROM c
  UNION ALL SELECT 'distinct_maker', count(DISTINCT maker) FROM c
  UNION ALL SELECT 'distinct_series', count(DISTINCT series) FROM c
  UNION ALL SELECT 'distinct_model', count(DISTINCT model) FROM c) u
""")
def k9_report(spark, sf_dir):
    prof = pf.distinct_profile(fl.correlation_extract(Bases(spark, sf_dir).bids()))
    path = sinks.write_summary(prof.select("metric", F.col("value").cast("double")), scratch_path(spark, "profile"))
    return spark.read.schema("metric string, value double").option("header", True).csv(path)


@query("K10_evaluation_report", pr._SQL_BASE + """
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'maker_accuracy' AS metric, avg(CAST(predicted_maker = maker AS DOUBLE)) AS value FROM HS
  UNION ALL SELECT 'sku_accuracy', coalesce(avg(CASE WHEN predicted_sku IS NOT NULL THEN CAST(predicted_sku = referencia AS DOUBLE) END), 0.0) FROM HS
  UNION ALL SELECT 'sku_coverage', avg(CAST(predicted_sku IS NOT NULL AS DOUBLE)) FROM HS
  UNION ALL SELECT 'test_size', CAST(count(*) AS DOUBLE) FROM HS
  UNION ALL SELECT 'maker_errors', CAST(count(*) FILTER (predicted_maker <> maker) AS DOUBLE) FROM HS
  UNION ALL SELECT 'sku_errors', CAST(count(*) FILTER (predicted_maker = maker AND predicted_sku IS NOT NULL
                                                       AND predicted_sku <> referencia) AS DOUBLE) FROM HS) u
""")
def k10_report(spark, sf_dir):
    """The report, and both error tables as CSV files; their sizes come from the files read back."""
    path = scratch_path(spark, "scored")
    # Three tables come from the scored rows, so these are written once.
    pr.hier_scored(spark, sf_dir).write.parquet(path)
    scored = spark.read.parquet(path)
    r = ev.coverage_report(scored)
    errors = []
    for name, rows in (("maker_errors", ev.maker_errors(scored)), ("sku_errors", ev.sku_errors(scored))):
        path = sinks.write_flat_csv(rows, scratch_path(spark, name))
        errors.append(src.read_flat_csv(spark, path, rows.schema, blank_as_null=False, escaped=True).agg(
            F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "value"))
    long = r.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                       for c in ["maker_accuracy", "sku_accuracy", "sku_coverage", "test_size"]])))
    path = sinks.write_summary(long.unionByName(errors[0]).unionByName(errors[1]), scratch_path(spark, "evaluation"))
    back = spark.read.schema("metric string, value double").option("header", True).csv(path)
    return back.withColumn("value", F.round("value", 6))


@query("U3_distinct_models", with_bases("B") +
       "SELECT DISTINCT maker, coalesce(model, fabrication_year) AS model FROM B WHERE maker <> ''")
def u3_distinct(spark, sf_dir):
    bids = Bases(spark, sf_dir).bids().filter(tx.truthy("maker"))
    return bids.select("maker", fl.model_fallback().alias("model")).distinct()


@query("F14_token_sort_ratio", with_bases("B") + f"""
, d AS (SELECT DISTINCT descripcion FROM B WHERE has_item AND descripcion IS NOT NULL)
, s AS (SELECT descripcion, {q.token_sort(q.clean_text('descripcion'))} AS a, {q.token_sort('lower(descripcion)')} AS b FROM d)
SELECT descripcion, round(CASE WHEN length(a) + length(b) = 0 THEN 100.0
                               ELSE 200.0 * {q.lcs('a', 'b')} / (length(a) + length(b)) END, 6) AS ratio FROM s
""")
def f14_ratio(spark, sf_dir):
    """Similarity between each description's cleaned and raw lower-cased forms (per row, no pairs)."""
    from skuflow.functions.similarity import token_sort
    d = fl.explode_items(Bases(spark, sf_dir).bids()).filter(F.col("descripcion").isNotNull()) \
        .select("descripcion").distinct()
    s = d.select("descripcion", token_sort(tx.clean_text("descripcion")).alias("a"),
                 token_sort(F.lower("descripcion")).alias("b"))
    return s.select("descripcion", F.round(indel_ratio("a", "b"), 6).alias("ratio"))


@query("F26_maker_share_percent", with_bases("P11") +
       "SELECT maker, round(count(*) * 100.0 / (SELECT count(*) FROM P11), 6) AS pct FROM P11 GROUP BY maker")
def f26_percent(spark, sf_dir):
    counts = pf.rows_per_maker(_p11(spark, sf_dir))
    # One row of the total of the grouped counts; the rows are read once.
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("maker", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))


@query("P21_empty_request_guard", with_bases("B") + f"""
SELECT CASE WHEN descripcion IS NULL OR {q.strip_ws('descripcion')} = '' THEN 'rejected_empty' ELSE 'accepted' END AS status,
       CAST(count(*) AS BIGINT) AS n FROM B WHERE has_item GROUP BY 1
""")
def p21_guard(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    blank = F.col("descripcion").isNull() | (tx.py_strip("descripcion") == "")
    return items.groupBy(F.when(blank, F.lit("rejected_empty")).otherwise(F.lit("accepted")).alias("status")) \
        .agg(F.count(F.lit(1)).alias("n"))


@query("R5_record_on_promotion", with_bases("H") + """
SELECT CAST(count(*) FILTER (WHERE promote) AS BIGINT) AS recorded_runs, CAST(count(*) AS BIGINT) AS runs FROM (
  SELECT coalesce(new_accuracy > lag(new_accuracy) OVER (ORDER BY timestamp), true) AS promote FROM H) x
""")
def r5_recorded(spark, sf_dir):
    from skuflow.operators import feedback as fb
    h = fb.history_changes(Bases(spark, sf_dir).history())
    p = fb.promotion_decision(F.col("new_accuracy"), F.col("previous_accuracy"))
    return h.agg(F.count_if(p).cast("long").alias("recorded_runs"), F.count(F.lit(1)).alias("runs"))


_X2 = [(r"\bthe\b", "el"), (r"\bund\b", "y"), (r"\bet\b", "y")]


@query("X2_user_dictionary", "SELECT doc_id, " +
       q.replace_word(q.replace_word(q.replace_word(q.clean_text("text"), "the", "el"), "und", "y"), "et", "y") +
       " AS corrected FROM documents")
def x2_dictionary(spark, sf_dir):
    """A user-supplied ordered (pattern, replacement) dictionary applied after cleaning."""
    docs = Bases(spark, sf_dir).documents()
    return docs.select("doc_id", tx.apply_regex_dictionary(tx.clean_text("text"), _X2).alias("corrected"))


@query("X4_similarity_threshold_90", with_bases("G") + f"""
, p AS (SELECT a.maker, a.series AS series_a, b.series AS series_b, {q.token_sort('a.series')} AS s_a,
               {q.token_sort('b.series')} AS s_b FROM G a JOIN G b ON a.maker = b.maker AND a.series < b.series)
, r AS (SELECT maker, series_a, series_b, length(s_a) AS la, length(s_b) AS lb, {q.lcs('s_a', 's_b')} AS lcs FROM p)
SELECT maker, series_a, series_b FROM r WHERE 200.0 * lcs >= 90.0 * (la + lb)
""")
def x4_threshold(spark, sf_dir):
    return hy.fuzzy_pairs(Bases(spark, sf_dir).fuzzy_series(), 90.0).select("maker", "series_a", "series_b")
