"""Flatten rules (FIXTURES rejection table), split and ranking properties."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from skuflow.operators import flatten as fl
from skuflow.operators import ranking as rk
from skuflow.operators import split as sp
from skuflow.schemas import BID
from skuflow.sources import bids as bid_src
from skuflow.sources.bases import Bases


def _bid(maker, series, model, items, fab=None):
    return ("x", maker, series, model, fab, items)


def _item(sku, desc):
    return (sku, desc, None, None, None)


def test_rejection_golden(spark):
    rows = [
        _bid("Renault", "Logan", "2015", [_item("A1", "faro")]),
        _bid("", "Logan", "2015", [_item("A1", "faro")]),
        _bid("Renault", None, "2015", [_item("A1", "faro")]),
        _bid("Renault", "Logan", "2015", []),
        _bid("Renault", "Logan", "2015", None),
        _bid("Renault", "Logan", None, [_item("A1", "faro")], fab="2014"),
        _bid("Renault", "Logan", "2015", [_item("", "faro")]),
        _bid("Renault", "Logan", "2015", [_item("  ", "faro")]),
        _bid("Renault", "Logan", "2015", [_item("", "")]),
        _bid("Renault", "Logan", "2015", [_item("A1", "")]),
        _bid("Renault", "Logan", "2015", [_item(None, "faro")]),
    ]
    bids = spark.createDataFrame(rows, BID)
    got = [r["reason"] for r in fl.rejection_reasons(bids).collect()]
    assert got == ["kept", "skipped_entry", "skipped_entry", "skipped_entry", "skipped_entry", "kept",
                   "empty_sku", "empty_sku", "empty_sku", "skipped_item", "empty_sku"]
    v3 = fl.flatten_v3(bids).collect()
    assert [(r["model"], r["referencia"]) for r in v3] == [("2015", "A1"), ("2014", "A1")]
    # basic rules keep a whitespace-only SKU; detailed rules keep an item without description
    assert len(fl.flatten_v2(bids).collect()) == 3
    assert len(fl.flatten_detailed(bids).collect()) == 4


def test_rejection_reasons_partition_input(spark):
    bids = Bases(spark, SF_SMALL).bids()
    counts = {r["reason"]: r["n"] for r in fl.rejection_counts(bids).collect()}
    n_ok_bids = fl.strict_bids(bids).count()
    items_in_ok = fl.explode_items(fl.strict_bids(bids)).count()
    assert counts["skipped_entry"] == bids.count() - n_ok_bids
    assert sum(v for k, v in counts.items() if k != "skipped_entry") == items_in_ok
    assert counts["kept"] == fl.flatten_v3(bids).count()


def test_stratified_split_exact_and_disjoint(spark):
    rows = fl.training_rows(Bases(spark, SF_SMALL).bids())
    split = sp.stratified_split(rows, "referencia", "row_id", 0.2, 42)
    assert split.count() == rows.count()
    assert split.select("row_id").distinct().count() == rows.count()
    w = Window.partitionBy("referencia")
    ref = rows.withColumn("h", sp.hash_key("row_id", 42)).withColumn(
        "rn", F.row_number().over(w.orderBy("h"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn(
        "want", F.col("rn") <= F.floor(F.col("n") * 0.2 + 0.5))
    bad = ref.join(split, "row_id").filter(F.col("want") != F.col("is_test"))
    assert bad.count() == 0


def test_single_row_class_stays_in_train(spark):
    df = spark.createDataFrame([("r1", "A"), ("r2", "B"), ("r3", "B"), ("r4", "B"), ("r5", "B"), ("r6", "B")],
                               "row_id string, referencia string")
    out = {r["row_id"]: r["is_test"] for r in sp.stratified_split(df, "referencia", "row_id").collect()}
    assert out["r1"] is False and sum(out.values()) == 1


def test_plain_split_and_sample_sizes(spark):
    rows = fl.training_rows(Bases(spark, SF_SMALL).bids())
    n = rows.count()
    import math
    assert sp.plain_split(rows).filter("is_test").count() == math.ceil(0.2 * n)
    assert sp.seeded_sample(rows, 100).count() == 100
    assert sp.seeded_sample(rows, 1000, fraction_cap=0.2).count() == min(1000, math.floor(0.2 * n))


def test_top_candidates_properties(spark):
    long = spark.createDataFrame(
        [("d1", f"S{i}", c) for i, c in enumerate([0.3, 0.3, 0.2, 0.1, 0.05, 0.04, 0.0005])] +
        [("d2", "S9", 0.0009)], "k string, sku string, confidence double")
    out = {r["k"]: r for r in rk.top_candidates(long, "k").collect()}
    confs = [c["confidence"] for c in out["d1"]["top_skus"]]
    assert len(confs) == 5 and confs == sorted(confs, reverse=True)
    assert [c["sku"] for c in out["d1"]["top_skus"]][:2] == ["S0", "S1"]
    assert out["d2"]["top_sku"] is None and out["d2"]["top_confidence"] == 0.0 and out["d2"]["top_skus"] == []


def test_cuts_equal_ranking_whole_groups(spark):
    """The bucketed cut marks the same rows as ranking each group and the whole table by hash."""
    from pyspark.sql import Window
    rows = fl.training_rows(Bases(spark, SF_SMALL).bids()).cache()
    n = rows.count()
    h = sp.hash_key("row_id", 42)
    rank = F.row_number().over(Window.partitionBy("maker").orderBy(h))
    size = F.count(F.lit(1)).over(Window.partitionBy("maker"))
    want = {r["row_id"] for r in rows.withColumn("r", rank).withColumn("n", size).filter(
        F.col("r") <= F.floor(F.col("n") * 0.2 + 0.5)).collect()}
    got = sp.stratified_split(rows, "maker", "row_id", 0.2, 42)
    assert got.count() == n and {r["row_id"] for r in got.filter("is_test").collect()} == want
    order = [r["row_id"] for r in rows.orderBy(h).collect()]
    plain = sp.plain_split(rows, "row_id", 0.2, 42)
    assert {r["row_id"] for r in plain.filter("is_test").collect()} == set(order[:-(-n // 5)])
    assert {r["row_id"] for r in sp.seeded_sample(rows, 100, "row_id", 42, 0.01).collect()} == set(
        order[:min(100, n // 100)])
    assert plain.limit(0).count() == 0 and sp.plain_split(rows.limit(0), "row_id").count() == 0


def test_split_plans_read_the_input_three_times(spark):
    rows = Bases(spark, SF_SMALL).training()
    for df, most in ((sp.stratified_split(rows, "referencia"), 3), (sp.plain_split(rows), 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        initial = plan.split("== Initial Plan ==")[-1]
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert initial.count("FileScan parquet") <= most


def test_row_ids_are_distinct_without_bid_ids(spark, tmp):
    bids = ['{"maker": "Mazda", "series": "3", "model": "2019", "items": [{"referencia": "A", "descripcion": "faro"},'
            '{"referencia": "A", "descripcion": "faro"}]}'] * 2 + [
            '{"maker": "Renault", "series": "3", "model": "2019", "items": [{"referencia": "A", "descripcion": "faro"}]}']
    spark.createDataFrame([(b,) for b in bids], "value string").coalesce(1).write.text(f"{tmp}/bids")
    rows = fl.training_rows(bid_src.read_bids(spark, f"{tmp}/bids"))
    ids = [r["row_id"] for r in rows.collect()]
    assert len(ids) == 5 and len(set(ids)) == 5


def test_approx_profile_within_error_bound(spark):
    """A6 (HyperLogLog++) stays within a few standard errors of A5's exact distinct counts."""
    from conftest import SF_MED
    from skuflow.operators import profile as pf
    corr = fl.correlation_extract(Bases(spark, SF_MED).bids())
    exact = {r["metric"]: r["value"] for r in pf.distinct_profile(corr).collect()}
    approx = {r["metric"]: r["value"] for r in pf.distinct_profile(corr, approx=True, rsd=0.02).collect()}
    assert approx["rows"] == exact["rows"]
    for k, v in exact.items():
        assert abs(approx[k] - v) <= max(2, 0.08 * v), (k, v, approx[k])


def test_ranked_and_bucketed_classes_split_alike(spark, monkeypatch):
    """Small classes are ranked after one shuffle, large ones cut by buckets; repeated and null ids and null labels too."""
    rows = spark.range(600).select(
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise((F.col("id") / 2).cast("int").cast("string")).alias("row_id"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") < 400, "hot").otherwise(
            F.concat(F.lit("c"), F.col("id") % 30)).alias("referencia"), F.col("id").alias("n"))
    plan = sp.stratified_split(rows)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "md5" not in plan.split("Exchange")[1]
    ranked = sorted(map(str, sp.stratified_split(rows).collect()))
    for most in (0, 50):
        monkeypatch.setattr(sp, "RANKED", most)
        assert sorted(map(str, sp.stratified_split(rows).collect())) == ranked
    assert sum("is_test=True" in r for r in ranked) > 20
