"""Operators 11, 12 and 13 against brute force on their defined cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from skuflow.llm import centroids, divergence, topk_join
from skuflow.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, row string, v string, cluster string, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z", None) for i, v in rows], SCHEMA).repartition(3)


def floors(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def odd_rows(dims=64):
    one = [0.5] * dims
    return [(7, None), (8, []), (9, one[:-1]), (10, [*one, 0.5]), (11, [*one[:-1], None]), (12, [*one[:-1], float("nan")]),
            (13, [*one[:-1], float("inf")]), (14, [*one[:-1], -float("inf")])]


# --- operator 11 ----------------------------------------------------------------------------

def lloyd(rows, k, rounds):
    """Sequential brute force over (id, integer vector)."""
    first = sorted((i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in rows)
    cents = [list(v) for *_, v in first[:k]]

    def closest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in rows:
            own[closest(v)[1]].append(v)
        for n, vs in own.items():
            cents[n] = [sum(x) // len(vs) for x in zip(*vs)]
    return sorted((str(i), closest(v)[1], closest(v)[0]) for i, v in rows), cents


def test_orchard_equals_all_distances():
    rng = np.random.default_rng(3)
    for k, spread, n in ((1, 9, 50), (2, 1, 50), (13, 2, 300), (40, 400, 500), (40, 2 ** 26, 200)):
        c = rng.integers(-spread, spread + 1, (k, 6))
        c[k // 2] = c[0]                       # equal centroids
        x = np.concatenate([rng.integers(-spread, spread + 1, (n, 6)), c])
        steps: list = []
        own, dist = centroids.orchard(x, c, *centroids.neighbour_lists(c), counter=steps)
        full = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        assert (dist == full.min(axis=1)).all() and (own == full.argmin(axis=1)).all()
        assert sum(steps) <= len(x) * (k - 1)


def test_orchard_skips_far_centroids():
    c = np.arange(40)[:, None] * np.array([[1000, 0, 0]])
    x = np.repeat(c, 25, axis=0) + np.random.default_rng(1).integers(-50, 50, (1000, 3))
    steps: list = []
    centroids.orchard(x, c, *centroids.neighbour_lists(c), counter=steps)
    assert sum(steps) < 0.6 * len(x) * 39      # from centroid 0 a search jumps along the line


def test_clusters_with_odd_rows(spark):
    rng = random.Random(5)
    good = [(i, [rng.choice([-1.0, 0.0, 0.3, 1.0]) for _ in range(64)]) for i in range(120)]
    good += [(900 + i % 3, [0.25] * 64) for i in range(90)] + [(None, [0.1] * 64), (-5, [0.1] * 64), (5, good[0][1])]
    found, cents = centroids.cluster(vectors(spark, good + odd_rows()))
    want, final = lloyd([(i, tuple(floors(v))) for i, v in good], 40, 5)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want
    assert cents.tolist() == final


def test_clusters_of_few_and_no_vectors(spark, tmp):
    found, cents = centroids.cluster(vectors(spark, [(1, [1.0] * 64), (2, [1.0] * 64)]))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, 0), (2, 0, 0)] and len(cents) == 2
    vectors(spark, odd_rows()).write.parquet(f"{tmp}/a/embeddings.parquet")
    got = centroids.op11_centroids_orchard(spark, f"{tmp}/a")
    assert got.collect() == [] and "centroid_sha256" in got.columns
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(vectors(spark, [(1, [1e30] * 64)]))


# --- operator 12 ----------------------------------------------------------------------------

def all_scores(rows, k=5, step=50):
    """Brute force over (id, integer vector)."""
    out = []
    for n, (q, v) in enumerate(rows):
        if q is None or q % step:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for m, (i, w) in enumerate(rows) if m != n)
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(others[:k])]
    return sorted(out, key=str)


def answers(df, **more):
    return sorted((tuple(r) for r in topk_join.top_k(df, df["vec_id"] % 50 == 0, **more).collect()), key=str)


def test_topk_odd_rows_ties_and_repeats(spark):
    rng = random.Random(6)
    rows = [(rng.randint(-40, 40) * 25, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(8)]) for _ in range(150)]
    rows += [(50, [0.5] * 8)] * 40 + [(None, [0.5] * 8)] * 3 + [(100, []), (150, [1.0, 1.0]), (200, [0.0] * 8)]
    bad = [r for r in odd_rows(8) if r[1] != [] and r[0] not in (9, 10)]
    assert answers(vectors(spark, rows + bad)) == all_scores([(i, floors(v)) for i, v in rows])


def test_topk_bounds_leave_rows_out_and_lose_none(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.05).astype(np.float32).tolist()) for i in range(2400)]
    seen = []
    real = topk_join.replicated

    def counted(*args):
        out = real(*args)
        seen.append(out.selectExpr("sum(size(groups))").first()[0])
        return out

    monkeypatch.setattr(topk_join, "replicated", counted)
    monkeypatch.setattr(topk_join, "BLOCK_ITEMS", 16)          # a block a query: every hot cell is cut
    monkeypatch.setattr(topk_join, "CHUNK_ITEMS", 16 * 500)
    df = vectors(spark, rows)
    got = answers(df, pivots=48)
    x = np.array([floors(v) for _, v in rows])
    want = []
    for q in range(0, 2400, 50):
        s = x @ x[q]
        s[q] = -2 ** 60
        by = np.lexsort((np.arange(2400), -s))[:5]
        want += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(by)]
    assert got == sorted(want, key=str)
    assert seen[0] < 0.5 * 2400 * 12                            # of 12 or more groups


def test_topk_without_queries_or_others(spark):
    assert answers(vectors(spark, [(1, [1.0]), (2, [1.0])])) == []
    assert answers(vectors(spark, [])) == []
    assert answers(vectors(spark, [(50, [1.0])])) == []
    assert answers(vectors(spark, [(50, [1.0]), (3, [2.0])])) == [(50, 1, 3, 512 * 256)]


# --- operator 13 ----------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_audit(rows, least=30, listed=50):
    docs = [(low(t or ""), lang or "", s or "") for t, lang, s in rows]
    df, occ, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for t, lang, s in docs:
        found = TERM.findall(t)
        df.update((lang, w) for w in set(found))
        occ[lang, s].update(found)
        groups[lang].add(s)
    out = []
    for lang, sources in groups.items():
        kept = [w for (x, w), n in df.items() if x == lang and n >= least]

        def shares(count):
            n = sum(count[w] for w in kept)
            return {w: 1 + 10 ** 9 * (count[w] + 5) // (n + 5 * len(kept)) for w in kept}

        q = shares(sum((occ[lang, s] for s in sources), Counter()))
        p = {s: shares(occ[lang, s]) for s in sources}
        for s in sources:
            parts = {"pair": [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s],
                     "term": [(w, p[s][w] - q[w]) for w in kept if occ[lang, s][w] and p[s][w] > q[w]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, f, r + 1) for r, (w, f) in enumerate(items) if part == "pair" or r < listed]
    return sorted(out)


def made_docs(seed=4, n=400):
    rng = random.Random(seed)
    words = ["Alpha", "alpha,", "ALPHA.alpha", "beta", "Beta-gamma", "ÉTÉ", "été", "naïve", "x1y", "99", "--", "日本 語", "Ünï code",
             "İ", "tail\x00end", "a" * 300]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "ß", None, "s1", "s1"])
        ws = rng.choices(words, k=rng.randint(0, 25)) + [f"{source}only"] * rng.randint(0, 2)
        rows.append((rng.choice([" ", "\n", "\t ", "\r\n", "\x0b"]).join(ws), lang, source))
    return rows + [(None, "en", "s1"), ("", "xx", "lonely"), (None, None, None), ("few words here", "yy", "a"), ("none", "yy", "b")]


def audited(spark, rows, **more):
    df = spark.createDataFrame([(1, *r, "c", 5, "b") for r in rows],
                               "doc_id int, text string, lang string, source string, chunk string, n int, block string")
    return sorted(tuple(r) for r in divergence.audit(df.repartition(3), **more).collect())


def test_audit_equals_brute_force(spark):
    rows = made_docs()
    want = brute_audit(rows)
    assert len({r[2] for r in want}) == 2
    assert audited(spark, rows) == want


def test_audit_tiles_and_strips(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(divergence, "STRIP", 6)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 900)
    rows = made_docs(9, 300)
    # With least_docs=2 many terms lack in most sources.
    rows += [(f"rare{i} rare{i // 2}", "en", f"t{i % 7}") for i in range(40)]
    assert audited(spark, rows, least_docs=2, listed=3) == brute_audit(rows, 2, 3)


def test_audit_empty_table(spark):
    assert audited(spark, []) == []


def test_audit_share_is_exact_for_large_counts(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000_000, 9_000_000_000_000_000_001, 7)], "n long, t long, v long")
    got = df.select(divergence.share(F.col("n"), F.col("t"), F.col("v"))).first()[0]
    assert got == 1 + 10 ** 9 * (9_000_000_000_000_000_000 + 5) // (9_000_000_000_000_000_001 + 35)


def test_audit_tokenizes_each_chunk_once(spark):
    docs = table(spark, SF_SMALL, "documents").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = divergence.chunk_counts(docs, divergence.source_names(docs), 3)
    plain = docs.select(F.explode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("c")).where("c <> ''")
    assert counted.where("chunk <> ''").select(F.explode("n").alias("n")).agg(F.sum("n")).first()[0] == plain.count()
    assert counted.where("(docs IS NULL) <> (n_docs >= 3) OR size(docs) <> n_docs").isEmpty()
    assert counted.where("chunk <> ''").select("chunk").distinct().count() == plain.distinct().count()
