"""The test bases reach every branch that the SQL checks are meant to cover."""

from pyspark.sql import functions as F

from conftest import SF_MED
from skuflow.plans import QUERIES
from skuflow.plans import hierarchy as hp
from skuflow.plans import predict as pr
from skuflow.functions import text as tx
from skuflow.sources.bases import Bases


def test_routing_and_scoring_take_every_branch(spark):
    scored = pr.hier_scored(spark, SF_MED)
    given = F.col("provided_maker").isNotNull()
    n = scored.agg(
        F.count_if(given & (F.col("maker_confidence") == 1.0) & (F.col("predicted_maker") == F.col("provided_maker"))),
        F.count_if(given & (F.col("predicted_maker") != F.col("provided_maker"))),
        F.count_if(~given), F.count_if(F.col("predicted_sku").isNull()), F.count_if(F.col("predicted_sku").isNotNull()),
        F.count_if(F.col("predicted_maker") != F.col("maker"))).first()
    assert all(v > 0 for v in n), n


def test_equivalencies_map_some_series_and_leave_others(spark):
    rows = hp._hierarchy(spark, SF_MED)
    mapped = hp._equivalency(rows).count()
    assert 0 < mapped < rows.select("maker", "series").distinct().count()
    assert QUERIES["P18_maker_filter_ci"](spark, SF_MED).count() > 0


def test_dictionary_words_occur_and_are_replaced(spark):
    docs = Bases(spark, SF_MED).dictionary_documents().select(tx.clean_text("text").alias("t"))
    for word, _ in [*tx.SPELLING_CORRECTIONS, *tx.TERM_STANDARDIZATION]:
        hit = F.col("t").rlike("(?U)" + word)
        n = docs.agg(F.count_if(hit), F.count_if(~hit)).first()
        assert n[0] > 0 and n[1] > 0, word


def test_java_invalid_patterns_are_translated_or_skipped(spark):
    df = spark.createDataFrame([("capot rojo",)], "t string")
    named = tx.apply_regex_dictionary("t", [(r"(?P<w>capot)", "x"), (r"rojo(?#colour)", "y")])
    assert df.select(named).first()[0] == "x y"
    skipped = tx.apply_regex_dictionary("t", [("(unclosed", "x"), ("rojo", "z")])
    assert df.select(skipped).first()[0] == "capot z"
