"""Queries for the vehicle hierarchy, equivalencies, fuzzy series matching and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.operators import hierarchy as hy
from skuflow.plans import sqltext as q
from skuflow.plans.registry import query, with_bases
from skuflow.session import scratch_path
from skuflow.sinks import files as sinks
from skuflow.sources import files as src
from skuflow.sources.bases import Bases

_A11 = f"""SELECT DISTINCT {q.title('maker')} AS maker, {q.title('series')} AS series, model FROM B
WHERE maker <> '' AND series <> '' AND model <> ''"""

# Equivalency table for the tests: for makers before 'Nation_2', household and
# furniture series share the canonical name 'Home'; everything else has no
# entry (so the default, the series itself, is exercised too).
_EQUIV = f"""SELECT maker, series, 'Home' AS canonical_series FROM ({_A11}) h
WHERE maker < 'Nation_2' AND series IN ('Household', 'Furniture') GROUP BY maker, series"""


def _hierarchy(spark, sf_dir):
    return hy.build_hierarchy(Bases(spark, sf_dir).bids())


def _equivalency(rows):
    return (rows.filter((F.col("maker") < "Nation_2") & F.col("series").isin("Household", "Furniture"))
            .select("maker", "series", F.lit("Home").alias("canonical_series")).distinct())


@query("A11_hierarchy_rows", with_bases("B") + _A11)
def a11_hierarchy(spark, sf_dir):
    return _hierarchy(spark, sf_dir)


@query("K5_hierarchy_json_roundtrip", with_bases("B") + f"""
SELECT maker, series, array_to_string(list_sort(list(model)), ',') AS models FROM ({_A11}) h GROUP BY maker, series
""")
def k5_hierarchy_json(spark, sf_dir):
    """K5 sink -> S7 scan: nested JSON written per maker, read back and regrouped."""
    path = sinks.write_hierarchy(hy.nest_hierarchy(_hierarchy(spark, sf_dir)),
                                 scratch_path(spark, "hierarchy-json"))
    raw = spark.read.schema(src.HIERARCHY_LINE).json(path)
    # Sorted model list rendered as text so the check compares plain values.
    return (raw.select("maker", F.explode("series").alias("series", "models"))
            .withColumn("models", F.array_join("models", ",")))


@query("S7_hierarchy_json_scan", with_bases("B") + _A11)
def s7_hierarchy_scan(spark, sf_dir):
    path = sinks.write_hierarchy(hy.nest_hierarchy(_hierarchy(spark, sf_dir)),
                                 scratch_path(spark, "hierarchy-json"))
    return src.read_hierarchy(spark, path)


@query("J1_apply_series_equivalency", with_bases("B") + f"""
, h AS ({_A11}), e AS ({_EQUIV})
SELECT h.maker, coalesce(e.canonical_series, h.series) AS series,
       array_to_string(list_sort(list(DISTINCT h.model)), ',') AS models
FROM h LEFT JOIN e ON h.maker = e.maker AND h.series = e.series
GROUP BY h.maker, coalesce(e.canonical_series, h.series)
""")
def j1_equivalency(spark, sf_dir):
    rows = _hierarchy(spark, sf_dir)
    mapped = hy.apply_series_equivalency(rows, _equivalency(rows))
    return mapped.groupBy("maker", "series").agg(
        F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))


@query("K6_series_flat_csv", with_bases("B") + f"""
SELECT '"' || maker || '";"' || series || '";"' || series || '"' AS line
FROM (SELECT DISTINCT maker, series FROM ({_A11}) h) d
""")
def k6_series_flat(spark, sf_dir):
    """K6 written, then read back as raw text lines (header lines removed)."""
    path = sinks.write_series_flat(hy.series_flat(_hierarchy(spark, sf_dir)),
                                   scratch_path(spark, "series-flat"))
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.filter(F.col("line") != '"maker";"series";"canonical_series"')


@query("S6_equivalency_csv_scan", with_bases("B") + f"""
SELECT DISTINCT maker, series, series AS canonical_series FROM ({_A11}) h
""")
def s6_equivalency_scan(spark, sf_dir):
    path = sinks.write_series_flat(hy.series_flat(_hierarchy(spark, sf_dir)),
                                   scratch_path(spark, "series-flat"))
    return src.read_equivalency_csv(spark, path)


_TS_A = q.token_sort("a.series")
_TS_B = q.token_sort("b.series")


@query("J4_fuzzy_series_pairs", with_bases("G") + f"""
, p AS (SELECT a.maker, a.series AS series_a, b.series AS series_b,
               {_TS_A} AS s_a, {_TS_B} AS s_b
        FROM G a JOIN G b ON a.maker = b.maker AND a.series < b.series)
, r AS (SELECT maker, series_a, series_b, length(s_a) AS la, length(s_b) AS lb,
               {q.lcs('s_a', 's_b')} AS lcs FROM p)
SELECT maker, series_a, series_b,
       round(CASE WHEN la + lb = 0 THEN 100.0 ELSE 200.0 * lcs / (la + lb) END, 6) AS ratio
FROM r WHERE 200.0 * lcs >= 85.0 * (la + lb)
""")
def j4_fuzzy_pairs(spark, sf_dir):
    pairs = hy.fuzzy_pairs(Bases(spark, sf_dir).fuzzy_series(), 85.0)
    return pairs.select("maker", "series_a", "series_b", F.round("ratio", 6).alias("ratio"))


# Oracle for W7: the sequential greedy loop itself, replayed by a recursive CTE
# (one step per series position, carrying the leaders found so far) over
# brute-force all-pairs similarity edges. Independent of the fixed-point plan.
_W7_ORACLE = "WITH RECURSIVE " + with_bases("G")[len("WITH "):] + f"""
, N AS (SELECT maker, series, CAST(row_number() OVER (PARTITION BY maker ORDER BY series) AS INTEGER) AS pos
        FROM (SELECT DISTINCT maker, series FROM G) d)
, PR AS (SELECT a.maker, a.pos AS pos_a, b.pos AS pos_b, {q.token_sort('a.series')} AS s_a,
                {q.token_sort('b.series')} AS s_b
         FROM N a JOIN N b ON a.maker = b.maker AND a.pos < b.pos)
, EDG AS (SELECT maker, pos_a, pos_b FROM PR WHERE 200.0 * {q.lcs('s_a', 's_b')} >= 85.0 * (length(s_a) + length(s_b)))
, ADJ AS (SELECT maker, pos_b, list(pos_a) AS earlier FROM EDG GROUP BY maker, pos_b)
, NA AS (SELECT N.maker, N.pos, coalesce(ADJ.earlier, []) AS earlier
         FROM N LEFT JOIN ADJ ON N.maker = ADJ.maker AND N.pos = ADJ.pos_b)
, WALK(maker, pos, leaders) AS (
    SELECT maker, 0, CAST([] AS INTEGER[]) FROM (SELECT DISTINCT maker FROM N) m
    UNION ALL
    SELECT WALK.maker, WALK.pos + 1,
           CASE WHEN len(list_filter(NA.earlier, lambda x: list_contains(WALK.leaders, x))) > 0 THEN WALK.leaders
                ELSE list_append(WALK.leaders, WALK.pos + 1) END
    FROM WALK JOIN NA ON NA.maker = WALK.maker AND NA.pos = WALK.pos + 1)
, LEAD AS (SELECT maker, leaders FROM (
             SELECT *, row_number() OVER (PARTITION BY maker ORDER BY pos DESC) AS rn FROM WALK) x WHERE rn = 1)
, ASG AS (SELECT NA.maker, NA.pos,
                 CASE WHEN list_contains(LEAD.leaders, NA.pos) THEN NA.pos
                      ELSE list_min(list_filter(NA.earlier, lambda x: list_contains(LEAD.leaders, x))) END AS leader
          FROM NA JOIN LEAD USING (maker))
SELECT ASG.maker, L.series AS canonical, S.series AS series
FROM ASG JOIN N S ON S.maker = ASG.maker AND S.pos = ASG.pos
         JOIN N L ON L.maker = ASG.maker AND L.pos = ASG.leader
"""


@query("W7_greedy_series_clusters", _W7_ORACLE)
def w7_clusters(spark, sf_dir):
    """Distributed fixed point over the J4 edges; the oracle replays the sequential loop."""
    return hy.greedy_clusters(Bases(spark, sf_dir).fuzzy_series(), 85.0)


@query("W10_series_choices", with_bases("C") + """
, s AS (SELECT DISTINCT maker, family, series FROM C)
, k AS (SELECT *, NOT (series = family OR series = upper(family) OR series = 'STANDARD') AS keep FROM s)
, cnt AS (SELECT maker, family, count(*) AS n_all, count(*) FILTER (WHERE keep) AS n_keep FROM k GROUP BY 1, 2)
SELECT k.maker, k.family, k.series,
       (CASE WHEN cnt.n_all = 1 OR cnt.n_keep = 0 THEN cnt.n_all ELSE cnt.n_keep END) = 1 AS auto_selected
FROM k JOIN cnt USING (maker, family)
WHERE cnt.n_all = 1 OR cnt.n_keep = 0 OR k.keep
""")
def w10_series_choices(spark, sf_dir):
    return hy.series_choices(Bases(spark, sf_dir).catalog())


@query("S8_catalog_scan", with_bases("C") + "SELECT maker, family, series, model_year FROM C")
def s8_catalog(spark, sf_dir):
    """Catalog nested to maker -> family -> series -> years, staged as JSON lines, read back."""
    cat = Bases(spark, sf_dir).catalog()
    years = cat.groupBy("maker", "family", "series").agg(F.sort_array(F.collect_set("model_year")).alias("y"))
    fams = years.groupBy("maker", "family").agg(
        F.map_from_entries(F.collect_list(F.struct("series", "y"))).alias("s"))
    makers = fams.groupBy("maker").agg(F.map_from_entries(F.collect_list(F.struct("family", "s"))).alias("families"))
    path = scratch_path(spark, "catalog-json")
    makers.write.json(path)
    return src.read_catalog(spark, path)
