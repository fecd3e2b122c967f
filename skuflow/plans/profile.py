"""Queries for profiling, class selection, splits and lookups over the bid basis."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.functions import text as tx
from skuflow.operators import equivalency as eq
from skuflow.operators import flatten as fl
from skuflow.operators import profile as pf
from skuflow.operators import split as sp
from skuflow.operators.joins import lookup_join
from skuflow.plans import sqltext as q
from skuflow.plans.registry import query, with_bases
from skuflow.session import scratch_path
from skuflow.sources.bases import Bases

_SKU_LIST_ROWS = f"""
SELECT maker, {q.strip_ws('referencia')} AS sku FROM B
WHERE has_item AND maker <> '' AND referencia IS NOT NULL AND {q.strip_ws('referencia')} <> ''
"""


def _p11(spark, sf_dir):
    return fl.flatten_v3(Bases(spark, sf_dir).bids())


def _training(spark, sf_dir):
    return fl.training_rows(Bases(spark, sf_dir).bids())


def _sku_list_rows(spark, sf_dir):
    items = fl.explode_items(fl.loose_bids(Bases(spark, sf_dir).bids()))
    return items.filter(fl.item_sku_only_predicate())


def _correlation_cleaned(spark, sf_dir):
    corr = fl.correlation_extract(Bases(spark, sf_dir).bids())
    return corr.withColumn("description_cleaned", tx.clean_text_keep_null("description"))


_CORR = "SELECT maker, series, model, referencia AS SKU, descripcion AS description FROM B " \
        "WHERE has_item AND referencia IS NOT NULL AND descripcion IS NOT NULL"
_CORR_CLEAN = f"SELECT *, {q.keep_null('description')} AS description_cleaned FROM ({_CORR}) c"
_PER_DESC = f"""SELECT description_cleaned, CAST(count(DISTINCT SKU) AS BIGINT) AS n_skus
FROM ({_CORR_CLEAN}) cc WHERE description_cleaned IS NOT NULL AND SKU IS NOT NULL
GROUP BY description_cleaned"""


@query("A2_distinct_skus_per_maker", with_bases("B") +
       f"SELECT maker, CAST(count(DISTINCT sku) AS BIGINT) AS n FROM ({_SKU_LIST_ROWS}) s GROUP BY maker")
def a2_distinct_skus(spark, sf_dir):
    return pf.distinct_skus_per_maker(_sku_list_rows(spark, sf_dir))


@query("T1_top_makers_by_skus", with_bases("B") +
       f"SELECT maker, CAST(count(DISTINCT sku) AS BIGINT) AS n FROM ({_SKU_LIST_ROWS}) s "
       "GROUP BY maker ORDER BY n DESC, maker LIMIT 10")
def t1_top_makers_skus(spark, sf_dir):
    return pf.top_makers(pf.distinct_skus_per_maker(_sku_list_rows(spark, sf_dir)), 10)


@query("T5_sorted_sku_list_per_maker", with_bases("B") +
       f"SELECT DISTINCT maker, sku FROM ({_SKU_LIST_ROWS}) s ORDER BY maker, sku")
def t5_sorted_skus(spark, sf_dir):
    """Distinct (maker, SKU) in code-point order: a distributed range-partitioned sort, not a
    per-maker array (a maker's SKU list is unbounded). K3 writes the per-maker files."""
    rows = _sku_list_rows(spark, sf_dir).select("maker", tx.py_strip("referencia").alias("sku"))
    return rows.distinct().orderBy("maker", "sku")


@query("A3_sku_counts", with_bases("P11") +
       "SELECT referencia, CAST(count(*) AS BIGINT) AS n FROM P11 GROUP BY referencia")
def a3_sku_counts(spark, sf_dir):
    return pf.sku_counts(_p11(spark, sf_dir))


@query("A4_frequency_buckets", with_bases("P11") + """
, c AS (SELECT referencia, count(*) AS n FROM P11 GROUP BY referencia)
, bk AS (SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS bucket,
               CAST(count(*) AS BIGINT) AS skus FROM c GROUP BY 1)
SELECT bucket, skus, round(skus * 100.0 / sum(skus) OVER (), 6) AS pct FROM bk
""")
def a4_buckets(spark, sf_dir):
    return pf.frequency_buckets(_p11(spark, sf_dir))


@query("A5_distinct_profile", with_bases("B") + f"""
, c AS ({_CORR})
SELECT metric, value FROM (
  SELECT 'rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM c
  UNION ALL SELECT 'distinct_SKU', CAST(count(DISTINCT SKU) AS BIGINT) FROM c
  UNION ALL SELECT 'distinct_description', CAST(count(DISTINCT description) AS BIGINT) FROM c
  UNION ALL SELECT 'distinct_maker', CAST(count(DISTINCT maker) AS BIGINT) FROM c
  UNION ALL SELECT 'distinct_series', CAST(count(DISTINCT series) AS BIGINT) FROM c
  UNION ALL SELECT 'distinct_model', CAST(count(DISTINCT model) AS BIGINT) FROM c) u
""")
def a5_profile(spark, sf_dir):
    return pf.distinct_profile(fl.correlation_extract(Bases(spark, sf_dir).bids()))


@query("A6_approx_profile", """
SELECT metric, true AS within_bound FROM (VALUES ('rows'), ('distinct_maker'), ('distinct_series'), ('distinct_model'),
  ('distinct_SKU'), ('distinct_description')) v(metric)
""")
def a6_approx_profile(spark, sf_dir):
    """Scale variant of A5 with HyperLogLog++: is each estimate within four standard errors of A5?"""
    rows = fl.correlation_extract(Bases(spark, sf_dir).bids())
    exact = pf.distinct_profile(rows).withColumnRenamed("value", "exact")
    near = F.abs(F.col("value") - F.col("exact")) <= F.greatest(F.lit(2.0), F.lit(4 * 0.05) * F.col("exact"))
    return pf.distinct_profile(rows, approx=True).join(exact, "metric").select("metric", near.alias("within_bound"))


_PROFILE_METRICS = """(VALUES ('rows'), ('distinct_maker'), ('distinct_series'), ('distinct_model'),
  ('distinct_SKU'), ('distinct_description')) v(metric)"""


@query("A6_stored_profile", f"""
SELECT part, metric, true AS within_bound FROM {_PROFILE_METRICS}, (VALUES ('all'), ('newer'), ('counted')) p(part)
""")
def a6_stored_profile(spark, sf_dir):
    """Sketches of three arrivals by model year, merged for all of them and for the two newer ones, against A5;
    ``counted`` has the columns with a bound above 10 counted again, so that no value is off by more."""
    rows = fl.correlation_extract(Bases(spark, sf_dir).bids())
    newer = F.coalesce(F.col("model") >= "1995", F.lit(False))
    last = F.coalesce(F.col("model") >= "1997", F.lit(False))
    path = scratch_path(spark, "profile")
    for arrival, part in (("1", ~newer), ("2", newer & ~last), ("3", last)):
        pf.store_profile(rows.filter(part), path, arrival)
    since = F.col("arrival") >= "2"
    exact = {"all": pf.distinct_profile(rows), "newer": pf.distinct_profile(rows.filter(newer))}
    found = {"all": pf.stored_profile(spark, path), "newer": pf.stored_profile(spark, path, since),
             "counted": pf.stored_profile(spark, path, None, 10, rows)}
    parts = []
    for name, got in found.items():
        want = exact.get(name, exact["all"]).withColumnRenamed("value", "exact")
        ok = F.abs(F.col("value") - F.col("exact")) <= F.greatest(F.col("bound"), F.lit(1))
        if name == "counted":
            ok = ok & (F.col("bound") <= 10)
        parts.append(got.join(want, "metric").select(F.lit(name).alias("part"), "metric", ok.alias("within_bound")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("A7_skus_per_description", with_bases("B") + _PER_DESC)
def a7_skus_per_description(spark, sf_dir):
    return pf.skus_per_description(_correlation_cleaned(spark, sf_dir))


@query("A8_ambiguity_summary", with_bases("B") + f"""
, d AS ({_PER_DESC})
SELECT CAST(count(*) AS BIGINT) AS descriptions,
       CAST(count(*) FILTER (WHERE n_skus = 1) AS BIGINT) AS one_sku,
       CAST(count(*) FILTER (WHERE n_skus > 1) AS BIGINT) AS multiple_skus,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE n_skus = 1) * 100.0 / count(*) ELSE 0.0 END, 6) AS pct_one_sku,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE n_skus > 1) * 100.0 / count(*) ELSE 0.0 END, 6) AS pct_multiple_skus,
       CAST(max(n_skus) AS BIGINT) AS max_skus, round(avg(n_skus), 6) AS mean_skus
FROM d
""")
def a8_ambiguity(spark, sf_dir):
    return pf.ambiguity_summary(pf.skus_per_description(_correlation_cleaned(spark, sf_dir)))


@query("T2_most_ambiguous_descriptions", with_bases("B") + f"""
, d AS ({_PER_DESC})
SELECT description_cleaned, n_skus FROM d WHERE n_skus > 1 ORDER BY n_skus DESC, description_cleaned LIMIT 5
""")
def t2_most_ambiguous(spark, sf_dir):
    return pf.most_ambiguous(pf.skus_per_description(_correlation_cleaned(spark, sf_dir)), 5)


@query("A9_distinct_before_after_cleaning", with_bases("B") + f"""
SELECT CAST(count(DISTINCT description) AS BIGINT) AS distinct_raw,
       CAST(count(DISTINCT description_cleaned) AS BIGINT) AS distinct_cleaned FROM ({_CORR_CLEAN}) cc
""")
def a9_before_after(spark, sf_dir):
    return pf.distinct_before_after(_correlation_cleaned(spark, sf_dir))


@query("A12_class_size_stats", with_bases("P11") + """
, c AS (SELECT referencia, count(*) AS n FROM P11 GROUP BY referencia)
SELECT CAST(count(*) AS BIGINT) AS classes, CAST(min(n) AS BIGINT) AS min_n, CAST(max(n) AS BIGINT) AS max_n,
       round(avg(n), 6) AS mean_n FROM c
""")
def a12_class_stats(spark, sf_dir):
    return pf.class_size_stats(_p11(spark, sf_dir))


@query("A13_maker_distribution", with_bases("P11") +
       f"SELECT {q.clean_text('maker')} AS maker, CAST(count(*) AS BIGINT) AS n FROM P11 GROUP BY 1")
def a13_maker_distribution(spark, sf_dir):
    rows = _p11(spark, sf_dir).select(tx.clean_text("maker").alias("maker"))
    return pf.rows_per_maker(rows)


# ----------------------------------------------------------------------------- selection / splits
_W3 = """SELECT referencia, CAST(count(*) AS BIGINT) AS n FROM P11 GROUP BY referencia
HAVING count(*) >= 10 ORDER BY n DESC, referencia LIMIT 100"""


@query("W3_frequent_classes", with_bases("P11") + _W3)
def w3_frequent(spark, sf_dir):
    return sp.select_frequent_classes(_p11(spark, sf_dir), "referencia", 10, 100)


@query("J3_keep_selected_skus", with_bases("P11") + f"""
SELECT maker, series, model, descripcion, referencia FROM P11
WHERE referencia IN (SELECT referencia FROM ({_W3}) w)
""")
def j3_keep_selected(spark, sf_dir):
    rows = _p11(spark, sf_dir)
    sel = sp.select_frequent_classes(rows, "referencia", 10, 100)
    return sp.keep_classes(rows, sel, "referencia", bounded_rows=100)


@query("W4_min_examples_per_maker", with_bases("P11") + """
, pc AS (SELECT maker, referencia, count(*) AS n FROM P11 GROUP BY maker, referencia)
, mk AS (SELECT maker FROM pc GROUP BY maker
         HAVING sum(n) >= 100 AND count(*) FILTER (WHERE n >= 3) >= 2)
SELECT maker, referencia, CAST(n AS BIGINT) AS n FROM pc WHERE n >= 3 AND maker IN (SELECT maker FROM mk)
""")
def w4_per_maker(spark, sf_dir):
    kept = sp.min_examples_per_maker(_p11(spark, sf_dir), "maker", "referencia", 3, 100, 2)
    return kept.groupBy("maker", "referencia").agg(F.count(F.lit(1)).alias("n"))


@query("W5_stratified_split", with_bases("T") + """
SELECT row_id, referencia,
       row_number() OVER (PARTITION BY referencia ORDER BY md5('42|' || row_id))
         <= floor(count(*) OVER (PARTITION BY referencia) * 0.2 + 0.5) AS is_test
FROM T
""")
def w5_stratified(spark, sf_dir):
    return sp.stratified_split(_training(spark, sf_dir), "referencia", "row_id", 0.2, 42).select(
        "row_id", "referencia", "is_test")


@query("W6_plain_split", with_bases("T") + """
SELECT row_id, row_number() OVER (ORDER BY md5('42|' || row_id)) <= ceil(count(*) OVER () * 0.2) AS is_test
FROM T
""")
def w6_plain(spark, sf_dir):
    return sp.plain_split(_training(spark, sf_dir), "row_id", 0.2, 42).select("row_id", "is_test")


@query("T6_seeded_sample", with_bases("T") + """
SELECT row_id, referencia FROM T ORDER BY md5('42|' || row_id) LIMIT 2000
""")
def t6_sample(spark, sf_dir):
    return sp.seeded_sample(_training(spark, sf_dir), 2000, "row_id", 42).select("row_id", "referencia")


@query("T6_evaluation_sample", with_bases("T") + """
SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5('42|' || row_id)) AS rn,
                           count(*) OVER () AS n FROM T) x
WHERE rn <= least(1000, floor(n * 0.2))
""")
def t6_eval_sample(spark, sf_dir):
    return sp.seeded_sample(_training(spark, sf_dir), 1000, "row_id", 42, fraction_cap=0.2).select("row_id")


@query("M20_class_weights", with_bases("P11") + """
, c AS (SELECT referencia, count(*) AS nc FROM P11 GROUP BY referencia)
SELECT referencia, round((SELECT sum(nc) FROM c) * 1.0 / ((SELECT count(*) FROM c) * nc), 6) AS weight FROM c
""")
def m20_weights(spark, sf_dir):
    w = sp.class_weight_table(_p11(spark, sf_dir), "referencia")
    return w.select("referencia", F.round("weight", 6).alias("weight"))


# ----------------------------------------------------------------------------- lookups / set ops
_SKU_GROUPS = """SELECT 'SKU-' || CAST(p_partkey AS VARCHAR) AS referencia,
       min('SKU-' || CAST(p_partkey AS VARCHAR)) OVER (PARTITION BY p_brand, p_name) AS sku_group FROM part"""


@query("J2_sku_equivalency", with_bases("P11") + f"""
, g AS ({_SKU_GROUPS})
SELECT DISTINCT p.referencia, coalesce(g.sku_group, p.referencia) AS sku_group
FROM P11 p LEFT JOIN g ON p.referencia = g.referencia
""")
def j2_sku_equivalency(spark, sf_dir):
    b = Bases(spark, sf_dir)
    part = b.table("part")
    sku = F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string"))
    groups = (part.select(sku.alias("referencia"), "p_brand", "p_name")
              .join(part.groupBy("p_brand", "p_name").agg(F.min(sku).alias("sku_group")),
                    ["p_brand", "p_name"])
              .select("referencia", "sku_group"))
    rows = fl.flatten_v3(b.bids()).select("referencia")
    return (lookup_join(rows, groups, "referencia", "left")
            .select("referencia", F.coalesce("sku_group", "referencia").alias("sku_group")).distinct())


# Interchangeable parts: each part and the next one of the same name and size, and of the same brand, type and size.
_SKU_PAIRS = """SELECT 'SKU-' || CAST(p_partkey AS STRING) AS sku_a, 'SKU-' || CAST(nxt AS STRING) AS sku_b, p_partkey FROM (
  SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_name, p_size ORDER BY p_partkey) AS nxt FROM {part}
  UNION ALL
  SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) FROM {part}) x"""


@query("J2_sku_closure", f"""
WITH RECURSIVE PR AS ({_SKU_PAIRS.replace("{part}", "part")})
, LINK AS (SELECT sku_a AS a, sku_b AS b FROM PR WHERE sku_b IS NOT NULL
           UNION SELECT sku_b, sku_a FROM PR WHERE sku_b IS NOT NULL)
, REACH AS (SELECT DISTINCT a, a AS b FROM LINK
            UNION SELECT REACH.a, LINK.b FROM REACH JOIN LINK ON LINK.a = REACH.b)
SELECT a AS referencia, min(b) AS sku_group FROM REACH GROUP BY a
""")
def j2_sku_closure(spark, sf_dir):
    """Groups of the pairs of even keys, then extended by the pairs of odd keys."""
    pairs = spark.sql(_SKU_PAIRS, part=Bases(spark, sf_dir).table("part"))
    even = F.col("p_partkey") % 2 == 0
    return eq.extend_groups(eq.sku_groups(pairs.filter(even)), pairs.filter(~even))


_OLD = """SELECT referencia FROM P11 WHERE model < '1997' GROUP BY referencia HAVING count(*) >= 3"""
_NEW = """SELECT referencia FROM P11 GROUP BY referencia HAVING count(*) >= 3"""


def _old_new(spark, sf_dir):
    rows = _p11(spark, sf_dir)
    old = sp.select_frequent_classes(rows.filter(F.col("model") < "1997"), "referencia", 3, None)
    new = sp.select_frequent_classes(rows, "referencia", 3, None)
    return old.select("referencia"), new.select("referencia")


@query("J5_new_skus", with_bases("P11") + f"""
SELECT referencia FROM ({_NEW}) n WHERE referencia NOT IN (SELECT referencia FROM ({_OLD}) o)
""")
def j5_new_skus(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return new.join(old, "referencia", "left_anti")


@query("U4_set_difference", with_bases("P11") + f"""
SELECT referencia FROM ({_NEW}) n EXCEPT SELECT referencia FROM ({_OLD}) o
""")
def u4_subtract(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return new.subtract(old)
