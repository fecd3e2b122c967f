"""The same records however files are cut."""

import json
import os
import random

from skuflow.schemas import BID
from skuflow.sources import bids, json_records


def records(spark, path, **more):
    return sorted((r.position, r.value) for r in json_records.read_json_records(spark, path, **more).collect())


def made(rng, n):
    hard = ['"', "\\", '\\"', "[", "]", "{", "}", ",", "é", "日本", "\n", "\\\\", '","', "]}", " "]
    def text():
        return "".join(rng.choices([*hard, "a", "b"], k=rng.randint(0, 12)))
    return [{"bid_id": None, text(): text(), "items": [{"referencia": text(), "x": [text(), [1, -2.5, None, True]]} for _ in range(rng.randint(0, 3))]}
            for _ in range(n)]


def test_ranges_find_every_element(tmp):
    """All cuts of one file, without Spark: start states by a plain character loop."""
    rng = random.Random(4)
    rows = made(rng, 25)
    for indent, array in ((None, True), (1, True), (None, False)):
        text = json.dumps(rows, ensure_ascii=False, indent=indent) if array else "\n".join(
            json.dumps(r, ensure_ascii=False) for r in rows)
        data = text.encode()
        with open(f"{tmp}/f", "wb") as f:
            f.write(data)
        state, inside, depth, escaped = [], 0, 0, False
        for c in data.decode("latin-1"):
            state.append((inside, depth))
            if inside:
                inside, escaped = (inside, False) if escaped else (0 if c == '"' else 1, c == "\\")
            elif c == '"':
                inside = 1
            else:
                depth += (c in "[{") - (c in "]}")
        for step in (1, 3, 50, 1000, len(data)):
            got, inside, depth = [], 0, 0
            for lo in range(0, len(data), step):
                hi = min(lo + step, len(data))
                assert (inside, depth) == state[lo]
                got += json_records.elements(f"{tmp}/f", lo, hi, inside, depth, array)
                parity, *gained = json_records.effect(f"{tmp}/f", lo, hi)
                depth += gained[inside]
                inside = (inside + parity) % 2
            assert [json.loads(v) for _, v in got] == rows
            assert all(data[p:p + len(v)] == v for p, v in got)


def test_json_array_files_with_several_tasks(spark, tmp):
    rng = random.Random(5)
    rows = made(rng, 60)
    with open(f"{tmp}/a.json", "w") as f:
        json.dump(rows, f, indent=2, ensure_ascii=False)
    whole = records(spark, f"{tmp}/a.json")
    assert [json.loads(v) for _, v in whole] == rows
    for split in (100, 777, 5000):
        df = json_records.read_json_records(spark, f"{tmp}/a.json", split_bytes=split)
        assert sorted((r.position, r.value) for r in df.collect()) == whole
    for name, text, want in (("e", "[]", []), ("b", " \n", []), ("o", '{"a": "]"}', [{"a": "]"}]), ("s", '[1, "x", [2]]', [1, "x", [2]]),
                             ("bom", '﻿[{"a": 1}]', [{"a": 1}]), ("l", '{"a": 1}\n{"b": [2]}\n', [{"a": 1}, {"b": [2]}])):
        with open(f"{tmp}/{name}.json", "w") as f:
            f.write(text)
        for split in (1, 4, 1000):
            assert [json.loads(v) for _, v in records(spark, f"{tmp}/{name}.json", split_bytes=split)] == want, name


def test_bid_ids_do_not_depend_on_splits(spark, tmp):
    rows = [{"maker": f"M{i % 3}", "items": [{"referencia": str(i), "descripcion": "a, [b]"}]} for i in range(300)]
    rows[5]["bid_id"] = "own"
    with open(f"{tmp}/a.json", "w") as f:
        json.dump(rows, f)
    with open(f"{tmp}/l.json", "w") as f:
        f.write("\n".join(map(json.dumps, rows)))
    for name in ("a", "l"):
        ids = []
        for split in (500, 4000, 1 << 20):
            df = bids.read_bids(spark, f"{tmp}/{name}.json", split_bytes=split)
            assert df.columns == [f.name for f in BID.fields]
            ids.append(sorted((r.bid_id, r.maker, r["items"][0].referencia) for r in df.collect()))
        assert ids[0] == ids[1] == ids[2] and len({i for i, *_ in ids[0]}) == 300
        assert ("own", "M2", "5") in ids[0]


def test_records_that_do_not_parse_stay_visible(spark, tmp):
    with open(f"{tmp}/a.json", "w") as f:
        f.write('[{"bid_id": "ok"}, nonsense, {"bid_id": "cut", "items": [')
    got = bids.read_bid_records(spark, f"{tmp}/a.json").select("bid_id", bids.CORRUPT).collect()
    assert sorted((r.bid_id or "", r[bids.CORRUPT]) for r in got if r[bids.CORRUPT] is None) == [("ok", None)]
    assert sorted(r[bids.CORRUPT] for r in got if r[bids.CORRUPT]) == ["nonsense", '{"bid_id": "cut", "items": [']


def test_small_ranges_share_tasks_and_read_little_past_their_ends(spark, tmp, monkeypatch):
    with open(f"{tmp}/a.json", "w") as f:
        f.write("[" + ",\n".join(f'{{"a": "{"x" * 90}{i:05d}"}}' for i in range(20000)) + "]")
    size = os.path.getsize(f"{tmp}/a.json")
    df = json_records.read_json_records(spark, f"{tmp}/a.json", split_bytes=4096)
    assert df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = df.collect()
    assert len(got) == 20000 and len({r.position for r in got}) == 20000
    read, blocks = [], json_records.ranges.blocks

    def spied(*args, **more):
        for block in blocks(*args, **more):
            read.append(len(block))
            yield block

    monkeypatch.setattr(json_records.ranges, "blocks", spied)
    n = len(list(json_records.elements(f"{tmp}/a.json", 0, 4096, 0, 0, True)))
    assert n == sum(r.position < 4096 for r in got) and sum(read) <= 2 * 4096 < size
