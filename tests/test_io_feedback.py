"""Sources/sinks round trips, feedback semantics and streaming twins."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from skuflow.operators import feedback as fb
from skuflow.operators import flatten as fl
from skuflow.schemas import BID, FEEDBACK
from skuflow.sinks import files as sinks
from skuflow.sources import bids as bid_src
from skuflow.sources import files as src
from skuflow.sources.bases import Bases
from skuflow.streaming import logs as sl


def test_flat_csv_and_per_maker_roundtrip(spark, tmp):
    rows = fl.flatten_v3(Bases(spark, SF_SMALL).bids())
    p1 = sinks.write_flat_csv(rows, os.path.join(tmp, "flat"))
    back = src.read_flat_csv(spark, p1, escaped=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    p2 = sinks.write_per_maker_csv(rows, os.path.join(tmp, "per_maker"))
    makers = [r["maker"] for r in rows.select("maker").distinct().limit(3).collect()]
    got = src.read_makers(spark, p2, [m.upper() for m in makers])
    assert got.count() == rows.filter(F.col("maker").isin(makers)).count()


def test_corrupt_chunk_is_reported_not_fatal(spark, tmp):
    bids = Bases(spark, SF_SMALL).bids()
    path = bid_src.stage_bids_json(bids, chunks=2, path=os.path.join(tmp, "chunks"))
    with open(os.path.join(path, "part-99999-bad.json"), "w") as f:
        f.write('{"bid_id": "1", "maker": \n')
    report = {r["status"]: r["n"] for r in bid_src.chunk_scan_report(
        bid_src.read_bid_chunks(spark, path + "/part-*")).collect()}
    assert report["ok"] == bids.count() and report["corrupt"] >= 1


def test_whole_file_json_array(spark, tmp):
    p = os.path.join(tmp, "bids.json")
    with open(p, "w") as f:
        f.write('[{"maker": "Renault", "series": "Logan", "fabrication_year": "2014", '
                '"items": [{"referencia": "A1", "descripcion": "faro"}]}, '
                '{"maker": "Mazda", "series": "3", "model": "2019", "items": []}]')
    bids = bid_src.read_bids(spark, p)
    assert [(r["maker"], r["model"]) for r in fl.flatten_v3(bids).collect()] == [("Renault", "2014")]


def test_hierarchy_object_layout(spark, tmp):
    p = os.path.join(tmp, "h.json")
    with open(p, "w") as f:
        f.write('{"Mazda": {"3": ["2019", "2020"]}, "Renault": {"Logan": ["2015"]}}')
    rows = sorted(map(tuple, src.read_hierarchy(spark, p, layout="object").collect()))
    assert rows == [("Mazda", "3", "2019"), ("Mazda", "3", "2020"), ("Renault", "Logan", "2015")]


def test_feedback_stats_empty_and_mark_noop(spark):
    empty = spark.createDataFrame([], FEEDBACK)
    s = fb.feedback_stats(empty).first()
    assert (s["total_count"], s["correct_count"], s["accuracy_rate"]) == (0, 0, 0.0)
    e = Bases(spark, SF_SMALL).feedback()
    none = spark.createDataFrame([], "id string")
    assert fb.mark_processed(e, none).filter("processed").count() == e.filter("processed").count()


def test_feedback_label_rules(spark):
    rows = [("1", True, "P", None), ("2", False, "P", "C"), ("3", False, "P", None), ("4", False, "P", "")]
    df = spark.createDataFrame(rows, "id string, is_correct boolean, predicted_sku string, correct_sku string")
    got = {r["id"]: r["l"] for r in df.select("id", fb.feedback_label().alias("l")).collect()}
    assert got == {"1": "P", "2": "C", "3": None, "4": None}


def test_validation_defaults_timestamp(spark):
    raw = spark.createDataFrame([("d", "P", True, None), (None, "P", True, "2024-01-01T00:00:00")],
                                "description string, predicted_sku string, is_correct boolean, timestamp string")
    v = fb.validate_feedback(raw).collect()
    assert v[0]["reject_reason"] is None and v[0]["timestamp"] is not None
    assert v[1]["reject_reason"] == "missing_description"


def test_log_monitor_is_incremental(spark, tmp):
    root, sink, ck = (os.path.join(tmp, x) for x in ("logs", "sink", "ck"))
    lines = Bases(spark, SF_SMALL).logs().select("log_name", F.col("line").alias("value"))
    lines.filter("log_name = 'app'").write.partitionBy("log_name").text(root)
    sl.run_error_monitor(spark, root, sink, ck, "2024-01-31 00:00:00", 24 * 365)
    first = spark.read.parquet(sink).count()
    lines.filter("log_name <> 'app'").write.mode("append").partitionBy("log_name").text(root)
    sl.run_error_monitor(spark, root, sink, ck, "2024-01-31 00:00:00", 24 * 365)
    total = spark.read.parquet(sink)
    from skuflow.functions.logs import is_error_line
    assert total.count() == Bases(spark, SF_SMALL).logs().filter(is_error_line("line")).count()
    assert total.count() > first > 0


def test_sku_list_files_sorted_per_maker(spark, tmp):
    import glob
    bids = Bases(spark, SF_SMALL).bids()
    items = fl.explode_items(fl.loose_bids(bids)).filter(fl.item_sku_only_predicate())
    from skuflow.functions.text import py_strip
    skus = items.select("maker", py_strip("referencia").alias("sku"))
    path = sinks.write_sku_lists(skus, os.path.join(tmp, "skus"))
    makers = glob.glob(os.path.join(path, "maker_key=*"))
    assert makers
    for d in makers:
        lines = []
        for f in sorted(glob.glob(os.path.join(d, "part-*"))):
            lines += [x.rstrip("\n") for x in open(f, encoding="utf-8")]
        assert lines == sorted(set(lines))


def test_foreign_csv_text_is_unchanged_and_own_files_round_trip(spark, tmp):
    hard = ["C:\\new part \\\\ 5", "a\\nb", "nul\x00here", "\\", "\\\\n", "tail\\\\", "plain"]
    schema = "maker string, series string, model string, descripcion string, referencia string"
    with open(f"{tmp}/foreign.csv", "w") as f:
        f.write("maker,series,model,descripcion,referencia\n" + "".join(f'M,s,1,"{t}",{i}\n' for i, t in enumerate(hard)))
    got = src.read_flat_csv(spark, f"{tmp}/foreign.csv").orderBy("referencia").collect()
    assert [r.descripcion for r in got] == hard
    rows = spark.createDataFrame([("M", "s", "1", t, str(i)) for i, t in enumerate([*hard, "x\ny\r\\n", "\r\n\\"])], schema)
    back = src.read_flat_csv(spark, sinks.write_flat_csv(rows, f"{tmp}/own"), escaped=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_chunks_grow_in_number_not_in_size(spark, tmp, monkeypatch):
    monkeypatch.setattr(bid_src, "BIDS_A_CHUNK", 100)
    bids = spark.createDataFrame([(str(i), "m", None, None, None, []) for i in range(950)], BID)
    path = bid_src.stage_bids_json(bids, chunks=4, path=os.path.join(tmp, "grown"))
    files = [n for n in os.listdir(path) if n.startswith("part-")]
    assert len(files) == 10 and spark.read.schema(BID).json(path).count() == 950
    assert bid_src.chunk_count(bids.limit(150), 4) == 4


def test_bids_are_nested_in_the_partitions_of_their_join(spark):
    from skuflow.sources import bases
    b = Bases(spark, SF_SMALL + "/.")
    flat = b._sql(bases.ITEMS_SQL)
    assert sorted(map(str, flat.drop("order_key").collect())) == sorted(map(str, b._sql(bases.B_SQL).collect()))
    assert b.bids().count() == flat.select("order_key").distinct().count() and b.probabilities().count() > 0
    assert not any(d == b.sf_dir and name == "B" for _, d, name in bases._STAGED)     # no table of flat bids between


def test_evaluation_report_scores_once(spark, monkeypatch):
    from skuflow.operators import evaluate as ev
    from skuflow.plans import io
    files = []
    for name in ("coverage_report", "maker_errors", "sku_errors"):
        make = getattr(ev, name)
        monkeypatch.setattr(ev, name, lambda scored, make=make: files.append(set(scored.inputFiles())) or make(scored))
    assert io.k10_report(spark, SF_SMALL).count() == 6
    assert len(files) == 3 and files[0] == files[1] == files[2] and all("/scored-" in f for f in files[0])
