"""Hierarchy, equivalency and series-choice golden cases (FIXTURES.md §2)."""

from pyspark.sql import functions as F

from skuflow.operators import hierarchy as hy
from skuflow.schemas import BID


def test_series_choices_golden(spark):
    rows = [("Renault", "Logan", "LOGAN", "2015"), ("Renault", "Logan", "STANDARD", "2015"),
            ("Renault", "Duster", "DUSTER", "2020"), ("Renault", "Duster", "DUSTER OROCH", "2020"),
            ("Renault", "Duster", "STANDARD", "2020"), ("Renault", "Kwid", "STANDARD", "2021")]
    cat = spark.createDataFrame(rows, "maker string, family string, series string, model_year string")
    got = {(r["family"], r["series"], r["auto_selected"]) for r in hy.series_choices(cat).collect()}
    assert got == {("Logan", "LOGAN", False), ("Logan", "STANDARD", False),
                   ("Duster", "DUSTER OROCH", True), ("Kwid", "STANDARD", True)}


def test_hierarchy_title_case_and_nesting(spark):
    bids = spark.createDataFrame([
        ("1", "mazda", "bt-50 x-line", "2019", None, []),
        ("2", "MAZDA ", "BT-50 X-LINE", "2020", None, []),
        ("3", "mazda", "bt-50 x-line", None, "2018", []),     # no model key value: not in the hierarchy
        ("4", "renault", "", "2015", None, []),
    ], BID)
    rows = hy.build_hierarchy(bids)
    assert sorted(map(tuple, rows.collect())) == [("Mazda", "Bt-50 X-Line", "2019"), ("Mazda", "Bt-50 X-Line", "2020")]
    nested = hy.nest_hierarchy(rows).collect()
    assert nested[0]["series"] == {"Bt-50 X-Line": ["2019", "2020"]}


def test_equivalency_defaults_to_own_series_and_unites_models(spark):
    rows = spark.createDataFrame([("Renault", "Logan", "2015"), ("Renault", "Logan II", "2016"),
                                  ("Renault", "Duster", "2020")], "maker string, series string, model string")
    eq = spark.createDataFrame([(" Renault ", "Logan II ", " Logan")], "maker string, series string, canonical_series string")
    out = hy.apply_series_equivalency(rows, eq)
    got = {(r["series"], tuple(r["models"])) for r in
           out.groupBy("series").agg(F.sort_array(F.collect_set("model")).alias("models")).collect()}
    assert got == {("Logan", ("2015", "2016")), ("Duster", ("2020",))}
