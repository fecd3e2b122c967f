"""Operators 1, 4, 6, 7, 9, 10 and the pipeline against brute force, round trips and held-out rows."""

import base64
import hashlib
import html
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_MED, SF_SMALL
from skuflow.llm import chat_format, html_template, language_id, near_dedup, sharding, warc
from skuflow.llm.common import table
from skuflow.llm.queries import ORACLES, QUERIES


def compare(spark, name, sf_dir=SF_SMALL):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    rel = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    want = sorted(repr(tuple(r[rel.columns.index(c)] for c in cols)) for r in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name)


# --- operator 1 -----------------------------------------------------------------------------

EMBEDDED = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_warc_rejects_magic_inside_payloads(spark, tmp):
    bodies = [None, "", "", "plain", "plain", EMBEDDED, EMBEDDED * 3 + "tail", "WARC/1.0\r\n", "x WARC/1.0\r\n" * 50,
              "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\nshort", "é日本" * 500, "é日本" * 500,
              "\r\n\r\n", EMBEDDED + "y" * 3000 + EMBEDDED]
    bodies += [f"filler {i} " * 30 for i in range(30)] + [EMBEDDED + "z" * i for i in range(30)]
    rows = [(i, f"http://a.b/{i}\r\nInjected: 1", b, "extra") for i, b in enumerate(bodies)]
    rows += [(None, None, "without id", "x"), (None, None, "without id", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").coalesce(2)
    path = f"{tmp}/w"
    warc.write_archives(df, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "9000b", "1500b"):      # from one split a file to many splits a record
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b" if size != old else "4194304b")
            got = warc.read_records(spark, path).collect()
            assert len(got) == len(rows)
            full = defaultdict(list)
            for b in rows:
                full[b[2] or ""].append(b[0])
            seen = Counter()
            for r in got:
                ident = re.fullmatch("<urn:record:([0-9]*)>", r.headers["WARC-Record-ID"])[1]
                body = "without id" if ident == "" else bodies[int(ident)] or ""
                digest = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
                assert r.headers["WARC-Payload-Digest"] == f"sha1:{digest}"
                if r.headers["WARC-Type"] == "response":
                    assert bytes(r.body).decode() == body and r.digest == digest and r.length == len(body.encode())
                    assert ident == "" or int(ident) == max(full[body])
                else:
                    assert r.length == 0 and r.headers["WARC-Refers-To"] == f"<urn:record:{max(full[body])}>"
                seen[ident] += 1
            assert max(seen.values()) == 2 and seen[""] == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", "4194304b")


def test_warc_empty_table(spark, tmp):
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), f"{tmp}/w")
    assert warc.read_records(spark, f"{tmp}/w").count() == 0


def test_forest_intervals_are_ancestors():
    rng = random.Random(1)
    for _ in range(200):
        at = sorted(rng.sample(range(100), rng.randint(1, 20)))
        following = [rng.randint(a + 1, 110) for a in at]
        out, number, size = warc.forest(at, following)
        for i, a in enumerate(at):
            way, p = [], a
            while p in at:
                way.append(p)
                p = following[at.index(p)]
            assert out[i] == p
            assert {at[k] for k in range(len(at)) if number[k] <= number[i] < number[k] + size[k]} == set(way)


# --- operator 4 -----------------------------------------------------------------------------

def test_chat_layouts_and_round_trip(spark):
    hard = ["", "\\", "\\\\### Assistant: </turn> ok", "</turn>\n### user: x", "a: b", "### ", "<\\/turn>", "é\n\n"]
    records = [json.dumps(r) for r in (
        [{"messages": [{"role": "user", "content": h}, {"role": "assistant", "content": h + "!"}]} for h in hard]
        + [{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3},
           {"instruction": "do", "input": "it", "output": "done"}, {"instruction": "do", "output": "done"},
           {"prompt": "p", "completion": None}, {"system": "s", "prompt": "p", "response": "r", "meta": {"x": 1}},
           {"turns": [{"role": "gpt", "text": "kept"}]}, {"unknown": 1}, {"messages": []}])] + ["{broken", "", None]
    df = spark.createDataFrame(list(enumerate(records)), "id int, record string")
    made = chat_format.format_turns(chat_format.canonical(df))
    rows = made.select("*", chat_format.read_turns(F.col("formatted")).alias("back"),
                       chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).orderBy("id").collect()
    n = len(hard)
    for r in rows:
        assert [tuple(t) for t in r.back] == [tuple(t) for t in r.turns]
        assert list(r.loss) == [t.text for t in r.turns if t.role == "assistant"]
        for s, text in zip(r.loss_spans, r.loss):
            assert re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start:s.start + s.chars]) == text
    assert [tuple(t) for t in rows[1].turns] == [("user", "\\"), ("assistant", "\\!")]
    assert [r.layout for r in rows[n:]] == ["from_value", "instruction_input", "instruction", "prompt_completion",
                                            "system_prompt_response", "turns", None, None, None, None, None]
    assert [tuple(t) for t in rows[n].turns] == [("user", "q"), ("assistant", "a")]
    assert [tuple(t) for t in rows[n + 3].turns] == [("user", "p"), ("assistant", "")]
    assert rows[n + 5].turns[0].role == "gpt"


def test_chat_rows_with_nulls_ties_and_repeats(spark, tmp):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"),
            (None, None, "assistant", "n"), (2, None, "assistant", "first"), (2, 0, "user", "second")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{tmp}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op4_chat_fingerprint(spark, tmp).collect()}
    assert set(got) == {1, 2, None, -7}

    def sha(turns):
        return hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()

    assert got[1].turns_sha256 == sha([("user", ""), ("", "x"), ("assistant", "b"), ("assistant", "b")])
    assert got[2].turns_sha256 == sha([("assistant", "first"), ("user", "second")])
    assert (got[1].loss_chars, got[-7].loss_chars, got[None].n_turns) == (2, 26, 1)


def test_chat_very_long_turn(spark, tmp):
    df = spark.range(2).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.when(
        F.col("id") == 0, F.repeat(F.lit("abcdefg"), 3_000_000)).otherwise("yes").alias("text"))
    df.write.parquet(f"{tmp}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op4_chat_fingerprint(spark, tmp).collect()}
    assert (got[5].n_turns, got[5].loss_chars, got[5].formatted_chars) == (2, 3, 21_000_000 + 3 + 2 * 14 + 13)
    made = chat_format.canonical(chat_format.records_of_rows(df)).select("fingerprint", "layout").collect()
    short = spark.createDataFrame([('{"turns": [{"role": "a", "text": "b"}]}',)], "record string")
    assert made == chat_format.canonical(short).select("fingerprint", "layout").collect()
    with pytest.raises(Exception):
        chat_format.canonical(df.select(F.to_json(F.struct(F.array(F.struct("role", "text")).alias("turns"))).alias(
            "record"))).select("turns").collect()


# --- operator 6 -----------------------------------------------------------------------------

def article_of(page):
    """The article of the test pages, whose paragraphs are p elements that are not all closed."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    out = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
    return "\n".join(b for b in out if b)


def test_html_query_extracts_articles(spark):
    pages = {r.page_id: r.html for r in table(spark, SF_MED, "pages").collect()}
    rows = html_template.op6_html_template(spark, SF_MED).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_of(pages[r.page_id]) and r.n_chars == len(r.text)


def page(i, body, wrap="div id=\"content-{i}\""):
    w = wrap.format(i=i)
    return (f"<html><head><title>T{i}</title></head><body class=\"has-sidebar\"><div class=\"top-nav\"><ul><li>Home<li>About"
            f"</ul></div><{w}>{body}<p>Share this page with all of your friends</div>"
            f"<div class=\"sidebar\"><p>{'side words ' * 80}{i}</div><form>Search <input></form>"
            f"<section id=comments><p>{'I think so too ' * 60}{i}</section><div class=footer>c {i}</div></body></html>")


def test_html_template_without_article_element(spark):
    rng = random.Random(1)
    want = {i: [" ".join(f"w{rng.randint(0, 999)}" for _ in range(60)) for _ in range(3)] for i in range(12)}
    rows = [(i, f"https://u@Host.example:80/{i}", page(i, "".join(f"<p>{t} &amp; <i>so</i>&nbsp;on" for t in b)))
            for i, b in want.items()]
    rows += [(90, None, None), (91, "nonsense", ""), (92, "http://x.y", "just < text & more"),
             (93, "http://one.page/", page(1, "<p>only page</p>" + "<p>" + "long text " * 100)),
             (94, "http://z", "<p>a<script>var x='</p>'</script>b<!-- c --><br>d<li>e<td>f<" + "<b" * 5000)]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = defaultdict(list)
    for r in html_template.extract(df).collect():
        got[r.page_id].append(r.text)
    for i, b in want.items():
        assert got[i] == ["\n".join(f"{t} & so on" for t in b)] * (2 if i < 2 else 1)
    assert got[90] == [""] and got[91] == [""] and got[92] == ["just < text & more"]
    assert got[93][0].startswith("only page\nlong text") and "side" not in got[93][0]
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_template.extract(empty).count() == 0


def test_html_template_counts_distinct_pages(spark):
    article = "".join(f"<p>{'copied words ' * 20}{k}</p>" for k in range(3))
    shell = "<html><body><div>{}</div><div>Call us on Monday</div><p>seen {}</p></body></html>"
    rows = [(i, f"http://copies/{i}", f"<html><body><article>{article}</article></body></html>") for i in range(8)]
    rows += [(10 + i, f"http://versions/{i}",
              f"<html><body><article>{article}<p>version {i}</p></article></body></html>") for i in range(8)]
    rows += [(20 + i, "http://real/", shell.format(f"<p>{'own text ' * 30}{i}</p>", i)) for i in range(8)]
    rows += [(30, "http://real/", None), (31, "http://real/", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_template.extract(df).collect()}
    copied = "\n".join(f"{'copied words ' * 20}{k}" for k in range(3))
    assert all(got[i] == copied for i in range(8))
    assert all(got[10 + i] == f"{copied}\nversion {i}" for i in range(8))
    assert all(f"{'own text ' * 30}{i}" in got[20 + i] and "Call us" not in got[20 + i] for i in range(8))
    assert got[30] == got[31] == ""


def test_html_slot_without_article_keeps_all_blocks(spark):
    inner = ("<h1>Head {i}</h1><p>" + "text " * 60 + "{i}</p><h2>More {i}</h2><ul><li>first {i}<li>second {i}</ul>"
             "<blockquote>said {i}</blockquote><pre>code {i}</pre><table><tr><td>cell {i}</td></tr></table>")
    shells = ["<div class='content with-sidebar'>{}<div class=sidebar><p>side {i}</div></div>",
              "<article class='post related'>{}</article><div class=comments><p>so {i}</div>",
              "<div class=left>{}</div><div class=right><p>right {i}</p></div><div class=footer>c {i}</div>"]
    rows = [(100 * k + i, f"http://h{k}/" if i else None, ("<html><body>" + shell.replace("{}", inner) + "</body></html>").replace(
        "{i}", str(i))) for k, shell in enumerate(shells) for i in range(7)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for r in html_template.extract(df).collect():
        k, i = divmod(r.page_id, 100)
        want = [f"Head {i}", "text " * 60 + str(i), f"More {i}", f"first {i}", f"second {i}", f"said {i}", f"code {i}",
                f"cell {i}"] + [f"right {i}"] * (k == 2)
        assert r.text.split("\n") == want


# --- operator 7 -----------------------------------------------------------------------------

def test_shards_query(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF_MED, "documents").collect()}
    rows = sharding.op7_shard_external_shuffle(spark, SF_MED).collect()
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())
    slots = defaultdict(list)
    for r in rows:
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    ups = sum(a < b for a, b in zip(order, order[1:]))
    assert 0.4 < ups / len(order) < 0.6      # no trace of the input order


def test_shards_of_repeated_records_without_broadcasts(spark, tmp, monkeypatch):
    """Counts and placement are planned apart; with many repeated records they must still agree."""
    monkeypatch.setattr(sharding, "COPIES", 100)
    df = spark.range(6000).select((F.col("id") % 1700).alias("doc_id"), F.when(F.col("id") % 1700 > 0, F.concat(
        F.lit("t"), (F.col("id") % 1700).cast("string"))).alias("text")).unionByName(
        spark.range(3000).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("hot").alias("text"))).repartition(7)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for n, coalesce in enumerate(("true", "false")):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            got = sharding.shuffle_to_shards(df, f"{tmp}/{n}", bucket_bytes=5000).collect()
            assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in df.collect())
            slots = defaultdict(list)
            for r in got:
                slots[r.shard].append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
            assert len(slots) == 16 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
            hot = Counter(r.shard for r in got if r.doc_id == -1)
            assert len(hot) == 16 and max(hot.values()) < 2 * 3000 / 16
            if n:
                assert {(r.shard, r.slot, r.doc_id) for r in got} == before
            before = {(r.shard, r.slot, r.doc_id) for r in got}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_shards_with_hot_rows_and_small_buckets(spark, tmp):
    rows = [(7, "same")] * 3000 + [(None, None)] * 500 + [(i, "é" * (i % 40)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("slot", F.lit("clash"))
    path = f"{tmp}/s"
    got = sharding.shuffle_to_shards(df, path, shards=7, bucket_bytes=400)
    back = got.collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    n = Counter(r.shard for r in back)
    assert max(n.values()) - min(n.values()) <= 1
    assert len({(r.shard, r.slot) for r in back}) == len(rows)
    hot = Counter(r.shard for r in back if r.doc_id == 7)
    assert max(hot.values()) < 2 * min(hot.values())
    empty = sharding.shuffle_to_shards(df.limit(0), f"{tmp}/e")
    assert empty.count() == 0


# --- operator 9 -----------------------------------------------------------------------------

def shingle_set(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    """Components of Jaccard >= 0.8 over all pairs that share a shingle, and of equal texts."""
    first, parent = {}, list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets, holders, links = {}, defaultdict(list), 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        if t in first:
            parent[root(i)] = root(first[t])
            continue
        first[t], sets[i] = i, shingle_set(t)
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
                links += 1
                parent[root(i)] = root(j)
        for s in sets[i]:
            holders[s].append(i)
    out = defaultdict(set)
    for i in range(len(texts)):
        out[root(i)].add(i)
    return {frozenset(s) for s in out.values()}, links


def found_groups(rows):
    out = defaultdict(set)
    for k, (doc, cls) in enumerate(rows):
        out[("none", k) if cls is None else cls].add(doc)
    return {frozenset(s) for s in out.values()}


def test_near_dedup_query_equals_brute_force(spark):
    docs = table(spark, SF_MED, "documents").orderBy("doc_id").collect()
    rows = near_dedup.op9_near_dedup_probminhash(spark, SF_MED).collect()
    assert len(rows) == len(docs)
    index = {d.doc_id: i for i, d in enumerate(docs)}
    want, links = brute_groups([d.text for d in docs])
    assert links > 0
    assert found_groups([(index[r.doc_id], index[r.class_id]) for r in rows]) == want
    size = Counter(r.class_id for r in rows)
    assert all(r.class_size == size[r.class_id] and r.class_id <= r.doc_id for r in rows)


def edited(w, rng, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(w)


def test_near_dedup_prefix_pairs_lose_no_pair(spark):
    """The filter on texts that nearly all share passages: every pair of 0.8 or more, few others."""
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(500)]
    passages = [[rng.choice(vocab) for _ in range(70)] for _ in range(3)]
    texts = []
    for i in range(240):
        w = list(passages[i % 3]) + [rng.choice(vocab) for _ in range(rng.randint(12, 40))]
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1])):
            texts.append(edited(w, rng, rng.randint(1, 3)))
    texts += ["", "one two", "one two three four five"]
    sets = [shingle_set(t) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]
            and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert any(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.85 for i, j in want)
    df = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string")
    shingled = near_dedup.shingle_sets(df)
    nodes = df.select("node", F.col("node").alias("label"))
    pairs = near_dedup.prefix_pairs(nodes, shingled, 0.8)
    found = {(r.b, r.a) for r in pairs.collect()}
    assert want <= found and len(found) < len(want) + 0.05 * len(texts) ** 2 / 2
    assert {(r.b, r.a) for r in near_dedup.compare_sets(pairs, shingled, 0.8).where("ok").collect()} == want
    # Nodes of one label need no pair.
    halves = df.select("node", (F.col("node") % 2).alias("label"))
    found = {(r.b, r.a) for r in near_dedup.prefix_pairs(halves, shingled, 0.8).collect()}
    assert {(i, j) for i, j in want if (i - j) % 2} <= found and all((i - j) % 2 for i, j in found)


def test_near_dedup_large_groups_and_shared_passage(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    base, passage = text(150), text(60)
    texts = [" ".join(base)] * 150 + [edited(base, rng, 1) for _ in range(300)] + [
        " ".join(passage + text(25)) for _ in range(200)] + [" ".join(text(80)) for _ in range(100)]
    texts += [None, None, "", "", "!!!", "one two", "One, two!", "one", "a b c d e", "A b c d e."]
    chain = text(100)
    for _ in range(6):
        chain = edited(chain, rng, 1).split()
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("keys", F.lit("clash"))
    rows = near_dedup.groups(df.repartition(5)).collect()
    assert len(rows) == len(texts)
    want, _ = brute_groups(texts)
    assert found_groups([(r.doc_id, r.class_id) for r in rows]) == want
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect())
    assert got == sorted(min(g) for g in want)


def test_near_dedup_links_inside_hot_buckets(spark):
    rng = random.Random(21)
    text = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]

    def replaced(w, at):
        return [f"new{rng.randrange(10 ** 9)}" if i in at else x for i, x in enumerate(w)]

    texts, want = [], []
    for _ in range(100):    # L~A 0.97, A~B 0.82, L not ~B 0.79; nearly all that A and B share is in L
        first = text(300)
        other = replaced(first, {20 + 40 * k for k in range(7)})
        middle = [*first[:20], other[20], *first[21:]]
        want.append({len(texts) + k for k in range(3)})
        texts += [first, middle, other]
    passage = text(90)
    for _ in range(1500):
        texts.append(passage + text(20))
    for i in range(100):    # 0.81 between two of those that share the passage
        w = passage + text(20)
        want.append({len(texts), len(texts) + 1})
        texts += [w, w[:-11] + text(11)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    found = found_groups([(r.doc_id, r.class_id) for r in near_dedup.groups(df.repartition(5)).collect()])
    assert sum(len(g) > 1 for g in found) <= len(want)
    missed = [g for g in want if frozenset(g) not in found]
    assert not missed


def test_near_dedup_of_passages_repeated_a_different_number_of_times(spark):
    rng = random.Random(22)
    rows = []
    for k in range(60):
        menu, rest = ([f"w{rng.randrange(10 ** 6)}" for _ in range(54)] for _ in range(2))
        rows += [(2 * k, " ".join(menu + rest)), (2 * k + 1, " ".join(menu * 50 + rest))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = found_groups([(r.doc_id, r.class_id) for r in near_dedup.groups(df).collect()])
    assert found == {frozenset((2 * k, 2 * k + 1)) for k in range(60)}


def test_near_dedup_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f g")] * 3 + [(None, "a b c d e f g"), (None, None), (None, None), (None, "other text here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = near_dedup.deduplicate(df).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(
        [(1, "a b c d e f g"), (None, None), (None, None), (None, "other text here")])
    assert near_dedup.deduplicate(df.limit(0)).count() == 0
    assert near_dedup.groups(df.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    import numpy as np
    rng = np.random.default_rng(3)
    a = {int(x): float(w) for x, w in zip(rng.integers(1, 2 ** 62, 80), rng.uniform(1, 4, 80))}
    b = dict(list(a.items())[:60])
    b = {k: w * (2 if i % 3 else 1) for i, (k, w) in enumerate(b.items())} | {
        int(x): 2.0 for x in rng.integers(1, 2 ** 62, 20)}
    keys = set(a) | set(b)
    exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in keys) for d in set(a) & set(b))
    elements = np.array([*a, *b], np.uint64)
    weight = np.array([*a.values(), *b.values()])
    of = np.array([0] * len(a) + [1] * len(b))
    reg = near_dedup.registers(elements, weight, of, 2, 4000)
    assert abs((reg[0] == reg[1]).mean() - exact) < 0.03


def brute_kneser_ney(texts, least_share, order=4):
    """Direct interpolated Kneser-Ney over dictionaries: {lang: function of a text to its cross-entropy}."""
    def symbols(t):
        out = []
        for c in t.lower():
            c = min(c, "\uffff") if c.isalpha() else " "
            if c != " " or not out or out[-1] != " ":
                out.append(c)
        return out

    def windows(t):
        # As in the operator, a blank that begins a text stays; only runs of blanks are one.
        s = ["\x01"] * (order - 1) + symbols(t)
        return [tuple(s[i:i + order]) for i in range(len(s) - order + 1)]

    langs = sorted({x for _, x in texts})
    tables = {x: {order: Counter(w for t, y in texts if x == y for w in windows(t))} for x in langs}
    for x in langs:
        for k in range(order - 1, 0, -1):
            tables[x][k] = Counter(g[1:] for g in tables[x][k + 1])
    alphabet = len({g for x in langs for g in tables[x][1]}) + 1
    out = {}
    for x in langs:
        share, back = {}, {}
        for k, count in tables[x].items():
            kinds = Counter(count.values())
            d = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] else 0.5
            total, whole = Counter(), sum(count.values())
            for g, n in count.items():
                total[g[:-1]] += n
            for g, n in count.items():
                if n >= least_share * whole:
                    share[g] = (n - d) / total[g[:-1]]
                    back[k, g[:-1]] = back.get((k, g[:-1]), 1.0) - share[g]

        def p(g, share=share, back=back):
            lower = 1 / alphabet if len(g) == 1 else p(g[1:], share, back)
            return share.get(g, 0.0) + back.get((len(g), g[:-1]), 1.0) * lower

        out[x] = lambda t, p=p: -sum(math.log(p(g)) for g in windows(t)) / max(len(windows(t)), 1)
    return out


@pytest.mark.parametrize("least_share", [2.0 ** -18, 0.002])
def test_language_model_equals_brute_force(spark, least_share):
    docs = [r for r in table(spark, SF_SMALL, "documents").where("text IS NOT NULL AND lang IS NOT NULL").orderBy("doc_id").collect()]
    texts = [(r.text[:400], r.lang) for r in docs[:200]] + [("\U0001f600 \U00010400\U00010401 x", "en"), ("-- a", "de")]
    df = spark.createDataFrame(texts, "text string, lang string")
    model = language_id.train(df, least_share=least_share)
    want = brute_kneser_ney(texts, least_share)
    probes = [t for t, _ in texts] + ["zzz qqq", "", "12 34", "Ünï"]
    entropy, n, _ = model.cross_entropy([t.encode() for t in probes])
    for i, t in enumerate(probes):
        for k, x in enumerate(model.languages):
            assert entropy[i, k] == pytest.approx(want[x](t) if n[i] else 0.0, rel=1e-4, abs=1e-6)
    # Every context's probabilities sum to one over the alphabet.
    assert all((model.backoff[k].values < 1e-9).all() for k in range(1, 5))


# --- operator 10 ----------------------------------------------------------------------------

def test_language_query_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in table(spark, SF_MED, "documents").collect()}
    rows = language_id.op10_language_kneser_ney(spark, SF_MED).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == docs[r.doc_id].lang)
    assert len(right) > 100 and sum(right) / len(right) > 0.95


def test_language_probabilities_sum_to_one():
    import numpy as np
    texts = [b"abra cadabra", b"banana bandana", b"cab"]
    gram, _, _ = language_id.grams(texts)
    # Kneser-Ney by hand from all counts of one language.
    counts = {4: Counter(gram.tolist())}
    for order in (3, 2, 1):
        counts[order] = Counter(g & ((1 << 16 * order) - 1) for g in counts[order + 1])
    tables, contexts = {}, {}
    for order, c in counts.items():
        total, kinds = Counter(), Counter()
        for g, n in c.items():
            h = g >> 16 if order > 1 else 0
            total[h] += n
            kinds[h] += 1
        d = 0.5
        tables[order] = (np.zeros(len(c), int), np.array([*c], np.uint64),
                         np.array([(n - d) / total[g >> 16 if order > 1 else 0] for g, n in c.items()]))
        contexts[order] = (np.zeros(len(total), int), np.array([*total], np.uint64),
                           np.array([d * kinds[h] / total[h] for h in total]))
    letters = sorted({g & 0xFFFF for g in counts[1]})
    model = language_id.Model(["x"], tables, contexts, len(letters) + 1)
    for context in list(counts[4])[:8] + [0x41004200430044]:
        keys = np.array([((context << 16) & (2 ** 64 - 1)) | c for c in letters], np.uint64)
        p = np.exp(model.log_probability(4, keys)).sum()
        assert 0.85 < p <= 1.0001      # the rest is the floor of unseen characters


def test_language_odd_texts(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "le chat est sur la table", "fr"), (3, None, "en"), (4, "", "fr"),
            (5, "123 !!", "en"), (6, "The Mat", None), (7, "LA TABLE", None), (8, "\U00010400\U00010401", None),
            (9, "x" * 300_000, None), (6, "The Mat", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    got = language_id.identify(df, F.col("doc_id") > 0, keep=("doc_id",)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[k].lang_pred for k in (1, 2, 3, 4, 5, 6, 7)] == ["en", "fr", "und", "und", "und", "en", "fr"]
    assert by[8].lang_pred in ("en", "fr") and by[9].lang_pred in ("en", "fr") and by[3].score == 0
    none = language_id.identify(df, F.lit(False), keep=("doc_id",)).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(df.limit(0), F.lit(True)).count() == 0


# --- pipeline -------------------------------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark, tmp):
    docs = table(spark, SF_MED, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF_MED, "labels").collect()}
    out = {}
    current = docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, current, SF_MED)
        if name != "bpe":
            assert made.columns == docs.columns
        made.write.parquet(f"{tmp}/{name}")
        current = spark.read.parquet(f"{tmp}/{name}")
        out[name] = {r.doc_id: r for r in current.collect()}
    from test_llm_text_ops import brute_base, brute_scan, brute_spans
    kept = set(out["quality"])
    for i, t in text.items():
        base = brute_base(t)
        if base[0] < 50 or 100 * base[4] > 50 * base[0]:
            assert i not in kept
    good = [i for i, q in labels.items() if q == 1 and brute_base(text[i])[0] >= 50
            and 2 * brute_base(text[i])[4] <= brute_base(text[i])[0]]
    assert sum(i in kept for i in good) / len(good) > 0.98
    order = sorted(kept)
    groups, _ = brute_groups([text[i] for i in order])
    assert set(out["near_dedup"]) == {order[min(g)] for g in groups}
    items = [(r.item_id, r.text) for r in table(spark, SF_MED, "benchmark").collect()]
    sample = sorted(out["near_dedup"])[::8]
    for i in sample:
        assert (i in out["decontaminate"]) == (brute_scan(text[i], items)[1] == 0)
    for i, r in out["pii"].items():
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        if not brute_spans(text[i]):
            assert r.text == text[i] or "<" in r.text
    assert set(out["pii"]) == set(out["decontaminate"]) == set(out["bpe"])
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out["bpe"].values())


def test_pipeline_on_empty_odd_and_clashing_input(spark, tmp):
    for t in ("labels", "benchmark"):
        table(spark, SF_SMALL, t).write.parquet(f"{tmp}/{t}.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0),
            (2, "w " * 60, "en", "s", 120), (3, " ".join(f"word{i}" for i in range(90)), None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.withColumns({c: F.lit("x") for c in ("kept", "score", "n_words", "hit_words", "pii", "keys", "node", "a")})
    for source in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, source, tmp)
            assert made.columns == df.columns
            assert made.count() <= source.count()
            if name in ("near_dedup", "decontaminate", "pii"):
                assert {r.score for r in made.collect()} <= {"x"}
        assert corpus_pipeline.encode(spark, source, tmp).count() == source.count()


@pytest.mark.parametrize("name, page, chars", [
    ("open divs", "<div>x" * 160_000, 319_999), ("stray quotes", "<a '" * 250_000, 1_000_000),
    ("open values", "<a ='" * 200_000 + "'>", 0), ("unmatched closes", "<div>" * 60_000 + "</section>" * 70_000 + "end", 3),
    ("rows in divs", "<div>" * 80_000 + "<li>x" * 80_000, 159_999), ("hints", "<div class=sidebar>x" * 50_000, 49_999),
    ("open scripts", "</script" * 100_000 + "<script>" * 100_000, 800_000), ("comments", "<!--" * 250_000, 0),
    ("signs", "<" * 1_000_000, 1_000_000), ("references", "&" * 1_000_000, 1_000_000)])
def test_html_reader_is_linear(name, page, chars):
    import time
    start = time.time()
    text = html_template.main_text(page, None, frozenset())
    assert time.time() - start < 10, name
    if name != "open scripts":
        assert len(text) == chars


def test_html_stray_quotes_and_deep_pages_keep_their_text():
    read = html_template.main_text
    none = frozenset()
    assert read("<p it's>one</p><p>two</p>", None, none) == "one\ntwo"
    assert read("<p title='a > b' class=x>one</p>", None, none) == "one"
    assert read("<p title = \"it's > b\">one</p><p>isn't</p>", None, none) == "one\nisn't"
    deep = "<div>" * 3000 + "<article>" + "<section>" * 3000 + "text" + "</section>" * 10 + "more</article>menu"
    assert read(deep, None, none) == "text\nmore"
