"""Test bases: deterministic views over the driver's parquet tables.

The driver tables hold no bids, feedback or logs, so each basis maps a
TPC-H-like table onto the quotation data model. Each view is written once as
SQL that both Spark (``spark.sql`` with DataFrame arguments) and the DuckDB
oracle run, so both engines start from the same rows. ``||`` is used instead of
``concat`` because DuckDB's ``concat`` skips NULLs where Spark's returns NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.schemas import BID
from skuflow.session import scratch_path

# D: documents with each dictionary word placed in some of them.
D_TEXT = ("text || CASE doc_id % 6 WHEN 0 THEN ' Capot nuevo.' WHEN 1 THEN ' un PARAGOLP, roto' "
          "WHEN 2 THEN ' cofre' WHEN 3 THEN ' la Defensa' WHEN 4 THEN ' capotes y defensas' ELSE '' END")

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# B: flat bids. maker = nation, series = market segment, model = order year,
# SKU = 'SKU-<partkey>', description = dirty-cased part name + type; nulls,
# blanks and missing fields are placed deterministically to exercise every
# reject branch. One order = one bid; an order without lineitems is a bid with
# an empty item list.
B_SQL = """
SELECT CAST(o.o_orderkey AS STRING) AS bid_id,
       CASE WHEN o.o_orderkey % 23 = 0 THEN '' ELSE n.n_name END AS maker,
       CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE c.c_mktsegment END AS series,
       CASE WHEN o.o_orderkey % 31 = 0 THEN NULL ELSE CAST(year(o.o_orderdate) AS STRING) END AS model,
       CASE WHEN o.o_orderkey % 62 = 0 THEN NULL ELSE CAST(year(o.o_orderdate) AS STRING) END AS fabrication_year,
       (l.l_orderkey IS NOT NULL) AS has_item,
       l.l_linenumber AS item_pos,
       CASE WHEN l.l_partkey % 19 = 0 AND l.l_quantity > 25 THEN '   '
            WHEN l.l_partkey % 37 = 0 THEN NULL
            ELSE 'SKU-' || CAST(l.l_partkey AS STRING) END AS referencia,
       CASE WHEN l.l_suppkey % 41 = 0 THEN NULL
            ELSE '  ' || upper(p.p_name) || ', ' || lower(p.p_type) || '. ' END AS descripcion,
       CAST(l.l_extendedprice AS STRING) AS precio,
       CAST(l.l_quantity AS STRING) AS cantidad,
       l.l_linestatus AS estado
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
LEFT JOIN {part} p ON p.p_partkey = l.l_partkey
"""

# B in the order that shuffles least: parts meet the bare line items, and these, by order, the orders, where
# they are nested without another shuffle.
ITEMS_SQL = B_SQL.replace("SELECT CAST(o.o_orderkey", "SELECT o.o_orderkey AS order_key, CAST(o.o_orderkey").replace(
    """LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
LEFT JOIN {part} p ON p.p_partkey = l.l_partkey""",
    """LEFT JOIN ({lineitem} l LEFT JOIN {part} p ON p.p_partkey = l.l_partkey) ON l.l_orderkey = o.o_orderkey""")

# P11 over B: the improved flatten, written independently of the operator code.
P11_SQL = """
SELECT maker, series, coalesce(model, fabrication_year) AS model, descripcion, referencia
FROM ({B}) b
WHERE has_item AND maker <> '' AND series <> '' AND coalesce(model, fabrication_year) <> ''
  AND trim(referencia) <> '' AND descripcion <> ''
"""

# T: the P11 rows with a row id from the bid, the item's place in it and the item's content.
T_SQL = """
SELECT maker, series, coalesce(model, fabrication_year) AS model, descripcion, referencia,
       md5(coalesce(bid_id, '') || '|' || CAST(place AS STRING) || '|' || coalesce(referencia, '')
           || '|' || coalesce(descripcion, '') || '|' || coalesce(precio, '') || '|' || coalesce(cantidad, '')
           || '|' || coalesce(estado, '')) AS row_id
FROM (SELECT *, row_number() OVER (PARTITION BY bid_id ORDER BY item_pos, referencia NULLS FIRST,
             descripcion NULLS FIRST, precio NULLS FIRST, cantidad NULLS FIRST, estado NULLS FIRST) - 1 AS place
      FROM ({B}) b WHERE has_item) x
WHERE maker <> '' AND series <> '' AND coalesce(model, fabrication_year) <> ''
  AND trim(referencia) <> '' AND descripcion <> ''
"""

# E: feedback rows derived from events.
E_SQL = """
SELECT CAST(event_id AS STRING) AS id,
       ts AS timestamp,
       'text ' || CAST(event_id % 97 AS STRING) AS description,
       CASE user_id % 4 WHEN 0 THEN 'Renault' WHEN 1 THEN 'MAZDA' WHEN 2 THEN 'ford' ELSE 'Chevrolet' END AS maker,
       CAST(NULL AS STRING) AS series,
       CAST(year(ts) AS STRING) AS model_year,
       CAST(NULL AS STRING) AS model_family,
       'SKU-' || CAST(user_id AS STRING) AS predicted_sku,
       (event_type IN ('purchase', 'view', 'click')) AS is_correct,
       CASE WHEN event_type = 'error' THEN 'SKU-' || CAST(user_id + 1 AS STRING) END AS correct_sku,
       least(value / 1000, 1.0) AS confidence,
       (event_id % 3 = 0) AS processed
FROM {events}
"""

# L: log lines in three logs; 2% carry no timestamp.
L_SQL = """
SELECT CASE user_id % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'retraining' ELSE 'database' END AS log_name,
       event_id AS line_no,
       CASE WHEN event_id % 50 = 0 THEN '' ELSE substr(CAST(ts AS STRING), 1, 19) END
         || ' - app - ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' - ' || props AS line
FROM {events}
"""

# P: per-(maker, description) SKU relative frequency over P11, used as the
# class-probability table so ranking, routing and metrics have exact oracles.
P_SQL = """
SELECT maker, descripcion, referencia AS sku,
       CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY maker, descripcion) AS DOUBLE) AS confidence
FROM (SELECT maker, descripcion, referencia, count(*) AS n FROM ({P11}) p11
      GROUP BY maker, descripcion, referencia) g
"""

# C: 4-level catalog maker -> family -> series -> year.
C_SQL = """
SELECT DISTINCT r.r_name AS maker, n.n_name AS family,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'STANDARD' WHEN 1 THEN n.n_name ELSE c.c_mktsegment END AS series,
       CAST(year(o.o_orderdate) AS STRING) AS model_year
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
"""

# H: retraining history, one run per day of E.
H_SQL = """
SELECT date_trunc('day', ts) AS timestamp, count(*) AS feedback_count,
       avg(CASE WHEN event_type IN ('purchase', 'view', 'click') THEN CAST(1 AS DOUBLE)
                ELSE CAST(0 AS DOUBLE) END) AS new_accuracy
FROM {events} GROUP BY date_trunc('day', ts)
"""

# G: fuzzy-matching basis: distinct part names as series under a brand as maker.
G_SQL = """
SELECT DISTINCT p_brand AS maker, p_name AS series FROM {part}
"""


def _nested(template: str, **inner: str) -> str:
    return template.replace("{B}", inner.get("B", "{B}")).replace(
        "{P11}", inner.get("P11", "{P11}"))


def b_sql() -> str:
    return B_SQL


def p11_sql() -> str:
    return _nested(P11_SQL, B=B_SQL)


def p_sql() -> str:
    return _nested(P_SQL, P11=p11_sql())


def duck(template: str) -> str:
    """Render a base template for DuckDB, where tables are pre-registered views."""
    return template.format(**{t: t for t in TABLES})


# Derived bases written once per (application, sf_dir) to the shared checkpoint
# folder and re-read: later queries scan Parquet instead of re-running the
# 5-way join and the nesting shuffle.
_STAGED: dict[tuple, str] = {}


class Bases:
    """Per-(session, sf_dir) accessor for the raw tables and the derived bases."""

    def __init__(self, spark: SparkSession, sf_dir: str, stage: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.stage = stage

    def table(self, name: str) -> DataFrame:
        """Raw table. ``spark.skuflow.spread`` (unset by default) deals rows to that many tasks:
        for local runs over single-row-group files only, which one task would read."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        spread = self.spark.conf.get("spark.skuflow.spread", None)
        return df.repartition(int(spread)) if spread else df

    def _sql(self, template: str, **frames: DataFrame) -> DataFrame:
        used = [t for t in TABLES if "{" + t + "}" in template]
        return self.spark.sql(template, **{t: self.table(t) for t in used}, **frames)

    def _staged(self, name: str, build) -> DataFrame:
        if not self.stage:
            return build()
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        path = _STAGED.get(key)
        if path is None:
            path = scratch_path(self.spark, f"base-{name}")
            build().write.mode("errorifexists").option("compression", "zstd").parquet(path)
            _STAGED[key] = path
        return self.spark.read.parquet(path)

    def flat_bids(self) -> DataFrame:
        """B: one row per (bid, item); bids without items appear once with has_item false."""
        return self._staged("B", lambda: self._sql(b_sql()))

    def bids(self) -> DataFrame:
        """B nested to the bid data model: one row per bid with ``items`` array.

        ``collect_list`` skips the NULL produced for an item-less bid, so such
        bids get ``items = []``. Groups are single orders (a handful of items),
        so no group can grow with the data.
        """
        def build():
            flat = self._sql(ITEMS_SQL)
            item = F.struct(*[F.col(c) for c in ["referencia", "descripcion", "precio",
                                                  "cantidad", "estado"]])
            # The order key stands for bid_id one to one: the join's partitions serve the grouping.
            nested = (flat.groupBy("order_key", "bid_id", "maker", "series", "model", "fabrication_year")
                      .agg(F.sort_array(F.collect_list(
                          F.when(F.col("has_item"), F.struct(F.col("item_pos"), item.alias("it")))
                      )).alias("_items")))
            return nested.select("bid_id", "maker", "series", "model", "fabrication_year",
                                 F.transform("_items", lambda x: x["it"]).alias("items")
                                 ).select([F.col(f.name).cast(f.dataType) for f in BID.fields])
        return self._staged("bids", build)

    def training(self) -> DataFrame:
        """Flattened training rows (P11 + row_id) as the flatten job writes them.

        Scoring, evaluation and training read this written table, as the
        reference reads the flat file its flatten step produced, instead of
        re-exploding the bids in every branch of their plans.
        """
        from skuflow.operators.flatten import training_rows
        return self._staged("T", lambda: training_rows(self.bids()))

    def p11(self) -> DataFrame:
        return self.spark.sql(P11_SQL.replace("({B}) b", "{b} b"), b=self.flat_bids())

    def documents(self) -> DataFrame:
        return self.table("documents")

    def dictionary_documents(self) -> DataFrame:
        """D: (doc_id, text) where the texts hold the dictionaries' words."""
        return self.documents().select("doc_id", F.expr(D_TEXT).alias("text"))

    def feedback(self) -> DataFrame:
        return self._sql(E_SQL)

    def logs(self) -> DataFrame:
        return self._sql(L_SQL)

    def probabilities(self) -> DataFrame:
        # The training rows are the P11 rows.
        return self._staged("P", lambda: self.spark.sql(
            P_SQL.replace("({P11}) p11", "{p11} p11"), p11=self.training()))

    def catalog(self) -> DataFrame:
        return self._sql(C_SQL)

    def history(self) -> DataFrame:
        # date_trunc yields a session-zone timestamp; keep the wall-clock type of the source.
        h = self._sql(H_SQL)
        return h.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))

    def fuzzy_series(self) -> DataFrame:
        return self._sql(G_SQL)
