"""Queries for the scalar text functions (F1-F17) over whole documents and bid texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skuflow.functions import text as tx
from skuflow.operators import flatten as fl
from skuflow.plans import sqltext as q
from skuflow.plans.registry import query, with_bases
from skuflow.sources.bases import D_TEXT, Bases


def _docs(spark, sf_dir):
    return Bases(spark, sf_dir).documents()


@query("F1_clean_text", f"SELECT doc_id, {q.clean_text('text')} AS cleaned FROM documents")
def f1_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.clean_text("text").alias("cleaned"))


@query("F2_normalize_keep_punctuation",
       f"SELECT doc_id, {q.keep_punct('text')} AS normalized FROM documents")
def f2_keep_punct(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.normalize_keep_punctuation("text").alias("normalized"))


@query("F3_clean_descriptions", with_bases("B") +
       f"SELECT DISTINCT descripcion, {q.clean_text('descripcion')} AS cleaned FROM B WHERE has_item")
def f3_clean_desc(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    return items.select("descripcion", tx.clean_text("descripcion").alias("cleaned")).distinct()


@query("F4_clean_keep_null", with_bases("B") +
       f"SELECT DISTINCT descripcion, {q.keep_null('descripcion')} AS cleaned FROM B WHERE has_item")
def f4_keep_null(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    return items.select("descripcion", tx.clean_text_keep_null("descripcion").alias("cleaned")).distinct()


@query("F5_spelling_correction",
       f"SELECT doc_id, {q.replace_word(q.replace_word(q.clean_text(D_TEXT), 'capot', 'capó'), 'paragolp', 'paragolpes')} AS corrected FROM documents")
def f5_spelling(spark, sf_dir):
    return Bases(spark, sf_dir).dictionary_documents().select("doc_id", tx.correct_spelling(tx.clean_text("text")).alias("corrected"))


@query("F6_term_standardization",
       f"SELECT doc_id, {q.replace_word(q.replace_word(q.clean_text(D_TEXT), 'cofre', 'capó'), 'defensa', 'paragolpes')} AS standardized FROM documents")
def f6_standardize(spark, sf_dir):
    return Bases(spark, sf_dir).dictionary_documents().select("doc_id", tx.standardize_terms(tx.clean_text("text")).alias("standardized"))


@query("F7_preprocess_text", f"SELECT doc_id, {q.preprocess(D_TEXT)} AS processed FROM documents")
def f7_preprocess(spark, sf_dir):
    return Bases(spark, sf_dir).dictionary_documents().select("doc_id", tx.preprocess_text("text").alias("processed"))


@query("F8_training_context", with_bases("P11") +
       f"SELECT DISTINCT maker || ' ' || {q.keep_punct('descripcion')} AS full_description FROM P11")
def f8_training_context(spark, sf_dir):
    rows = fl.flatten_v3(Bases(spark, sf_dir).bids())
    return rows.select(tx.training_context("maker", tx.normalize_keep_punctuation("descripcion"))
                       .alias("full_description")).distinct()


_F9_JOINED = q.strip_ws("coalesce(descripcion, '') || ' ' || coalesce(maker, '') || ' ' || '' || ' ' "
                        "|| coalesce(series, '') || ' ' || coalesce(model, '')")


@query("F9_serving_context", with_bases("B") + f"""
SELECT DISTINCT CASE WHEN maker IS NOT NULL AND maker <> '' THEN upper(maker) || ' ' || {_F9_JOINED}
                     ELSE {_F9_JOINED} END AS context
FROM B WHERE has_item
""")
def f9_serving_context(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    return items.select(tx.serving_context("descripcion", F.col("maker"), F.lit(""), F.col("series"),
                                           F.col("model")).alias("context")).distinct()


@query("F10_clean_maker_name", with_bases("B") +
       f"SELECT DISTINCT maker, {q.clean_maker('maker')} AS maker_key FROM B")
def f10_maker_key(spark, sf_dir):
    return (Bases(spark, sf_dir).bids().select("maker", tx.clean_maker_name("maker").alias("maker_key"))
            .distinct())


@query("F11_strip_sku", with_bases("B") +
       f"SELECT DISTINCT referencia, {q.strip_ws('referencia')} AS sku FROM B WHERE has_item")
def f11_strip(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    return items.select("referencia", tx.py_strip("referencia").alias("sku")).distinct()


@query("F12_title_case", with_bases("B") +
       f"SELECT DISTINCT descripcion, {q.title('descripcion')} AS titled FROM B WHERE has_item")
def f12_title(spark, sf_dir):
    items = fl.explode_items(Bases(spark, sf_dir).bids())
    return items.select("descripcion", tx.title_case("descripcion").alias("titled")).distinct()


@query("F13_model_year_text", with_bases("B") +
       "SELECT DISTINCT CAST(model AS VARCHAR) AS model FROM B WHERE model IS NOT NULL")
def f13_model_text(spark, sf_dir):
    bids = Bases(spark, sf_dir).bids()
    return bids.filter(F.col("model").isNotNull()).select(F.col("model").cast("string").alias("model")).distinct()


@query("F15_strip_accents", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def f15_strip_accents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.strip_accents("text").alias("folded"))


@query("F16_tokenize", f"""
SELECT doc_id, CAST(len({q.tokens('text')}) AS BIGINT) AS n_tokens,
       CAST(len(list_distinct({q.tokens('text')})) AS BIGINT) AS n_distinct
FROM documents
""")
def f16_tokenize(spark, sf_dir):
    toks = _docs(spark, sf_dir).select("doc_id", tx.tokenize("text").alias("tk"))
    return toks.select("doc_id", F.size("tk").cast("long").alias("n_tokens"),
                       F.size(F.array_distinct("tk")).cast("long").alias("n_distinct"))


@query("F17_unigrams_bigrams", f"""
WITH t AS (SELECT doc_id, {q.tokens('text')} AS tk FROM documents)
SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms, CAST(len(list_distinct(terms)) AS BIGINT) AS n_distinct
FROM (SELECT doc_id, list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) AS terms
      FROM t) x
""")
def f17_ngrams(spark, sf_dir):
    toks = _docs(spark, sf_dir).select("doc_id", tx.tokenize("text").alias("tk"))
    terms = toks.select("doc_id", tx.with_bigrams("tk").alias("terms"))
    return terms.select("doc_id", F.size("terms").cast("long").alias("n_terms"),
                        F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"))
