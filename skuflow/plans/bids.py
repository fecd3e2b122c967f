"""Queries over the bid basis B: scans, flatten variants, rejection counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.operators import flatten as fl
from skuflow.operators import profile as pf
from skuflow.plans.registry import query, with_bases
from skuflow.sources.bases import Bases
from skuflow.sources import bids as bid_source

# Oracle for "the improved flatten": identical rule set written in SQL over B.
_P11 = "SELECT maker, series, model, descripcion, referencia FROM P11"


@query("S1_bid_scan", with_bases("B") + """
SELECT bid_id, maker, series, model, fabrication_year,
       CAST(count(*) FILTER (WHERE has_item) AS BIGINT) AS n_items
FROM B GROUP BY bid_id, maker, series, model, fabrication_year
""")
def s1_bid_scan(spark, sf_dir):
    """Bids in files of one JSON array each, cut into ranges that are smaller than a file, read with the schema."""
    path = bid_source.stage_bid_arrays(Bases(spark, sf_dir).bids())
    bids = bid_source.read_bids(spark, path, split_bytes=256 << 10)
    return bids.select(*fl.BID_FIELDS, F.size("items").cast("long").alias("n_items"))


@query("S2_chunked_bid_scan", with_bases("B") + """
SELECT 'ok' AS status, CAST(count(DISTINCT bid_id) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE has_item) AS BIGINT) AS n_items FROM B
UNION ALL SELECT 'corrupt', 2, 0
""")
def s2_chunked_scan(spark, sf_dir):
    """Bid chunks read by glob; corrupt records are separated and counted, not fatal."""
    path = bid_source.stage_bids_json(Bases(spark, sf_dir).bids(), chunks=4)
    broken = [('{"bid_id": "cut off", "items": [',), ("not a record",)]
    spark.createDataFrame(broken, "value string").coalesce(1).write.mode("append").text(path)
    return bid_source.chunk_scan_report(bid_source.read_bid_chunks(spark, path + "/part-*"))


@query("P1_explode_items", with_bases("B") + """
SELECT bid_id, maker, series, model, fabrication_year, referencia, descripcion, precio, cantidad, estado
FROM B WHERE has_item
""")
def p1_explode(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    return items.drop("item_pos")


@query("P2_model_fallback", with_bases("B") + """
SELECT DISTINCT bid_id, coalesce(model, fabrication_year) AS model FROM B
""")
def p2_model_fallback(spark, sf_dir):
    return Bases(spark, sf_dir).bids().select("bid_id", fl.model_fallback().alias("model"))


@query("P3_strict_bid_filter", with_bases("B") + """
SELECT bid_id FROM B
WHERE maker <> '' AND series <> '' AND coalesce(model, fabrication_year) <> ''
GROUP BY bid_id HAVING count(*) FILTER (WHERE has_item) > 0
""")
def p3_strict(spark, sf_dir):
    return fl.strict_bids(Bases(spark, sf_dir).bids()).select("bid_id")


@query("P4_loose_bid_filter", with_bases("B") + """
SELECT bid_id FROM B WHERE maker <> ''
GROUP BY bid_id HAVING count(*) FILTER (WHERE has_item) > 0
""")
def p4_loose(spark, sf_dir):
    return fl.loose_bids(Bases(spark, sf_dir).bids()).select("bid_id")


@query("P5_item_filter_basic", with_bases("B") + """
SELECT bid_id, referencia, descripcion FROM B
WHERE has_item AND referencia <> '' AND descripcion <> ''
""")
def p5_basic(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    return items.filter(fl.item_basic_predicate()).select("bid_id", "referencia", "descripcion")


@query("P6_item_filter_improved", with_bases("B") + """
SELECT bid_id, referencia, descripcion FROM B
WHERE has_item AND referencia <> '' AND descripcion <> '' AND trim(referencia) <> ''
""")
def p6_improved(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    return items.filter(fl.item_improved_predicate()).select("bid_id", "referencia", "descripcion")


@query("P7_item_filter_sku_only", with_bases("B") + """
SELECT bid_id, referencia, descripcion FROM B
WHERE has_item AND trim(referencia) <> ''
""")
def p7_sku_only(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    return items.filter(fl.item_sku_only_predicate()).select("bid_id", "referencia", "descripcion")


@query("P8_rejection_counts", with_bases("B") + """
, x AS (SELECT *, coalesce(maker <> '' AND series <> '' AND coalesce(model, fabrication_year) <> ''
                  AND max(CAST(has_item AS INT)) OVER (PARTITION BY bid_id) = 1, false) AS bid_ok
        FROM B)
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'skipped_entry' AS reason FROM x WHERE NOT bid_ok GROUP BY bid_id
  UNION ALL
  SELECT CASE WHEN referencia IS NULL OR trim(referencia) = '' THEN 'empty_sku'
              WHEN descripcion IS NULL OR descripcion = '' THEN 'skipped_item'
              ELSE 'kept' END AS reason
  FROM x WHERE bid_ok AND has_item
) r
GROUP BY reason
""")
def p8_rejections(spark, sf_dir):
    return fl.rejection_counts(Bases(spark, sf_dir).bids())


@query("P9_flatten_v1", with_bases("B") + """
SELECT maker, series, coalesce(model, fabrication_year) AS model, descripcion, referencia FROM B
WHERE has_item AND maker <> '' AND series <> '' AND coalesce(model, fabrication_year) <> ''
  AND referencia <> '' AND descripcion <> ''
""")
def p9_flatten_v1(spark, sf_dir):
    return fl.flatten_v1(Bases(spark, sf_dir).bids())


@query("P10_flatten_v2", with_bases("B") + """
SELECT maker, series, coalesce(model, fabrication_year) AS model, descripcion, referencia FROM B
WHERE has_item AND maker <> '' AND series <> '' AND coalesce(model, fabrication_year) <> ''
  AND referencia <> '' AND descripcion <> ''
""")
def p10_flatten_v2(spark, sf_dir):
    return fl.flatten_v2(Bases(spark, sf_dir).bids())


@query("P11_flatten_improved", with_bases("P11") + _P11)
def p11_flatten_v3(spark, sf_dir):
    return fl.flatten_v3(Bases(spark, sf_dir).bids())


@query("P12_flatten_detailed", with_bases("B") + """
SELECT maker, coalesce(series, '') AS series, coalesce(model, fabrication_year, '') AS model,
       coalesce(descripcion, '') AS descripcion, coalesce(referencia, '') AS referencia,
       coalesce(precio, '') AS precio, coalesce(cantidad, '') AS cantidad, coalesce(estado, '') AS estado
FROM B WHERE has_item AND maker <> '' AND trim(referencia) <> ''
""")
def p12_detailed(spark, sf_dir):
    return fl.flatten_detailed(Bases(spark, sf_dir).bids())


@query("P13_correlation_extract", with_bases("B") + """
SELECT maker, series, model, referencia AS SKU, descripcion AS description FROM B
WHERE has_item AND referencia IS NOT NULL AND descripcion IS NOT NULL
""")
def p13_correlation(spark, sf_dir):
    return fl.correlation_extract(Bases(spark, sf_dir).bids())


@query("P14_non_empty_bid_counts", with_bases("B") + """
SELECT CASE WHEN has_item = 1 THEN 'kept' ELSE 'empty_items' END AS reason,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT bid_id, max(CAST(has_item AS INT)) AS has_item FROM B GROUP BY bid_id) g
GROUP BY has_item
""")
def p14_non_empty(spark, sf_dir):
    return fl.non_empty_bid_counts(Bases(spark, sf_dir).bids())


@query("P15_dropna", with_bases("B") + """
SELECT maker, series, model, referencia AS SKU, descripcion AS description FROM B
WHERE has_item AND referencia IS NOT NULL AND descripcion IS NOT NULL
""")
def p15_dropna(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    return fl.drop_missing(items, ["descripcion", "referencia"]).select(
        "maker", "series", "model", F.col("referencia").alias("SKU"),
        F.col("descripcion").alias("description"))


@query("P16_fillna_text", with_bases("B") + """
SELECT coalesce(maker, '') AS maker, coalesce(series, '') AS series,
       coalesce(model, '') AS model, coalesce(descripcion, '') AS descripcion,
       coalesce(referencia, '') AS referencia
FROM B WHERE has_item
""")
def p16_fillna(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    return fl.fill_text(items.select("maker", "series", "model", "descripcion", "referencia"))


@query("P18_maker_filter_ci", with_bases("P11") + """
SELECT maker, series, model, descripcion, referencia FROM P11 WHERE lower(maker) = 'nation_3'
""")
def p18_maker_filter(spark, sf_dir):
    return fl.maker_filter(fl.flatten_v3(Bases(spark, sf_dir).bids()), "Nation_3")


@query("A10_blank_skus_remaining", with_bases("P11") + """
SELECT CAST(count(*) FILTER (WHERE trim(referencia) = '') AS BIGINT) AS blank_skus,
       CAST(count(*) AS BIGINT) AS rows FROM P11
""")
def a10_blank(spark, sf_dir):
    return fl.blank_sku_count(fl.flatten_v3(Bases(spark, sf_dir).bids()))


@query("A1_rows_per_maker", with_bases("P11") + """
SELECT maker, CAST(count(*) AS BIGINT) AS n FROM P11 GROUP BY maker
""")
def a1_rows_per_maker(spark, sf_dir):
    return pf.rows_per_maker(fl.flatten_v3(Bases(spark, sf_dir).bids()))


@query("T1_top_makers_by_rows", with_bases("P11") + """
SELECT maker, CAST(count(*) AS BIGINT) AS n FROM P11 GROUP BY maker ORDER BY n DESC, maker LIMIT 10
""")
def t1_top_makers(spark, sf_dir):
    return pf.top_makers(pf.rows_per_maker(fl.flatten_v3(Bases(spark, sf_dir).bids())), 10)
