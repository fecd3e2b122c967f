"""Flatten and validate nested bids.

A bid is one row with an ``items`` array. Bid-level predicates are applied
*before* ``explode`` so rejected bids never generate item rows; all filters are
plain column predicates, so Catalyst pushes the ones on scan columns into the
Parquet/JSON reader. Nothing here shuffles: flattening is a narrow,
per-partition transformation that scales linearly with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skuflow.functions.text import py_strip, truthy
from skuflow.schemas import DETAILED_COLUMNS, FLAT_COLUMNS

BID_FIELDS = ["bid_id", "maker", "series", "model", "fabrication_year"]

# Rejection reasons (P8), in the order the improved rules test them.
KEPT = "kept"
SKIPPED_ENTRY = "skipped_entry"
EMPTY_SKU = "empty_sku"
SKIPPED_ITEM = "skipped_item"


def model_fallback() -> Column:
    """``model``, else ``fabrication_year``.

    A schema-typed column cannot tell an absent key from an explicit null, so
    both fall back (the one intended difference from a dict lookup).
    """
    return F.coalesce(F.col("model"), F.col("fabrication_year"))


def has_items() -> Column:
    """P14 predicate: item list present and non-empty."""
    return F.col("items").isNotNull() & (F.size("items") > 0)


def strict_bid_predicate() -> Column:
    """Maker, series and model (with fallback) truthy; items non-empty."""
    return truthy("maker") & truthy("series") & truthy(model_fallback()) & has_items()


def loose_bid_predicate() -> Column:
    """Maker truthy and items non-empty."""
    return truthy("maker") & has_items()


def sku_blank() -> Column:
    """SKU missing, empty or whitespace-only (a null SKU counts as empty, Q3)."""
    sku = F.col("referencia")
    return sku.isNull() | (py_strip(sku) == "")


def item_basic_predicate() -> Column:
    """P5: SKU and description truthy; a whitespace-only SKU is kept."""
    return truthy("referencia") & truthy("descripcion")


def item_improved_predicate() -> Column:
    """P5 and the SKU is not whitespace-only."""
    return item_basic_predicate() & ~sku_blank()


def item_sku_only_predicate() -> Column:
    """Only the SKU is required (description optional)."""
    return ~sku_blank()


def strict_bids(bids: DataFrame) -> DataFrame:
    """P3 as a DataFrame filter."""
    return bids.filter(strict_bid_predicate())


def loose_bids(bids: DataFrame) -> DataFrame:
    """P4 as a DataFrame filter."""
    return bids.filter(loose_bid_predicate())


def non_empty_bids(bids: DataFrame) -> DataFrame:
    """Keep bids whose item list is present and non-empty."""
    return bids.filter(has_items())


def non_empty_bid_counts(bids: DataFrame) -> DataFrame:
    """P14 counters: rows removed for null items, empty items, and rows kept (one pass)."""
    reason = (F.when(F.col("items").isNull(), F.lit("null_items"))
              .when(F.size("items") == 0, F.lit("empty_items"))
              .otherwise(F.lit("kept")))
    return bids.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def explode_items(bids: DataFrame, outer: bool = False) -> DataFrame:
    """One row per (bid, item) with the item struct flattened.

    ``item_pos`` keeps the item's position in its bid (0-based) so rows stay
    addressable after the explode.
    """
    gen = F.posexplode_outer if outer else F.posexplode
    keep = [c for c in bids.columns if c != "items"]
    exploded = bids.select(*keep, gen("items").alias("item_pos", "item"))
    return exploded.select(*keep, "item_pos", "item.*")


def _flat(rows: DataFrame, model: Column | None = None) -> DataFrame:
    return rows.select("maker", "series", (model if model is not None else model_fallback()).alias("model"),
                       "descripcion", "referencia")


def flatten_v1(bids: DataFrame) -> DataFrame:
    """Every item whose five fields are all truthy (single-chunk flatten)."""
    items = explode_items(bids.filter(truthy("maker") & truthy("series") & truthy(model_fallback())))
    return _flat(items.filter(item_basic_predicate()))


def flatten_v2(bids: DataFrame) -> DataFrame:
    """P10: strict bids, basic item rule (whitespace-only SKU kept)."""
    return _flat(explode_items(strict_bids(bids)).filter(item_basic_predicate()))


def flatten_v3(bids: DataFrame) -> DataFrame:
    """Strict bids, improved item rule (whitespace-only SKU dropped)."""
    return _flat(explode_items(strict_bids(bids)).filter(item_improved_predicate()))


def training_rows(bids: DataFrame) -> DataFrame:
    """P11 rows plus ``row_id``: md5 of bid id, place in the bid and item content.

    The id is what deterministic splits and samples hash. Bids without an id of
    their own get one where they are read (``sources.bids``), so ids are distinct.
    """
    items = explode_items(strict_bids(bids)).filter(item_improved_predicate())
    parts = []
    for i, c in enumerate(["bid_id", "item_pos", "referencia", "descripcion", "precio", "cantidad", "estado"]):
        if i:
            parts.append(F.lit("|"))
        parts.append(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return items.select("maker", "series", model_fallback().alias("model"), "descripcion",
                        "referencia", F.md5(F.concat(*parts)).alias("row_id"))


def flatten_detailed(bids: DataFrame) -> DataFrame:
    """Loose bids, SKU-only item rule, eight text columns, missing -> ''."""
    items = explode_items(loose_bids(bids)).filter(item_sku_only_predicate())
    model = F.coalesce(F.col("model"), F.col("fabrication_year"), F.lit(""))
    return items.select(
        "maker",
        F.coalesce("series", F.lit("")).alias("series"),
        model.alias("model"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in DETAILED_COLUMNS[3:]],
    ).select(*DETAILED_COLUMNS)


def correlation_extract(bids: DataFrame) -> DataFrame:
    """Maker, series, model (no fallback), SKU, description; null SKU/description dropped."""
    items = explode_items(bids)
    return (items.select("maker", "series", "model",
                         F.col("referencia").alias("SKU"), F.col("descripcion").alias("description"))
            .dropna(subset=["SKU", "description"]))


def rejection_reasons(bids: DataFrame) -> DataFrame:
    """P8 rows: every rejected bid once, every item of a kept bid once, with a reason.

    One scan, no shuffle: rejected bids are turned into a single null item via
    ``explode_outer`` so entry- and item-level counters come out of one pass.
    Precedence follows the improved rules: a blank SKU is ``empty_sku`` even if
    the description is also missing (Q4).
    """
    ok = strict_bid_predicate()
    rows = bids.select(*[c for c in bids.columns if c != "items"],
                       ok.alias("_bid_ok"),
                       F.explode_outer(F.when(ok, F.col("items"))).alias("item"))
    reason = (F.when(~F.col("_bid_ok"), F.lit(SKIPPED_ENTRY))
              .when(F.col("item.referencia").isNull() | (py_strip("item.referencia") == ""),
                    F.lit(EMPTY_SKU))
              .when(~truthy("item.descripcion"), F.lit(SKIPPED_ITEM))
              .otherwise(F.lit(KEPT)))
    return rows.withColumn("reason", reason)


def rejection_counts(bids: DataFrame) -> DataFrame:
    """(reason, n) for kept / skipped_entry / skipped_item / empty_sku."""
    return (rejection_reasons(bids).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("n")))


def drop_missing(df: DataFrame, columns=("descripcion", "referencia")) -> DataFrame:
    """``dropna(subset=...)``."""
    return df.dropna(subset=list(columns))


def fill_text(df: DataFrame, columns=tuple(FLAT_COLUMNS)) -> DataFrame:
    """``fillna('')`` + cast to string on the given text columns."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                       if c in columns else F.col(c) for c in df.columns])


def maker_filter(df: DataFrame, maker: str) -> DataFrame:
    """Case-insensitive maker filter."""
    return df.filter(F.lower(F.col("maker")) == maker.lower())


def blank_sku_count(df: DataFrame) -> DataFrame:
    """A10: rows whose SKU is blank after flattening (quality assertion, expect 0)."""
    return df.agg(F.count_if(sku_blank()).cast("long").alias("blank_skus"),
                  F.count(F.lit(1)).alias("rows"))
