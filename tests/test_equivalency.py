"""J2 closure of interchangeability pairs against a union-find over the same pairs."""

import random

import pytest

from skuflow.operators import equivalency as eq

PAIRS = "sku_a string, sku_b string"


def _groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None:
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def _got(df):
    rows = df.collect()
    got = {r["referencia"]: r["sku_group"] for r in rows}
    assert len(got) == len(rows)
    return got


def _chain(n):
    order = list(range(n))
    random.Random(5).shuffle(order)
    return [(f"S{order[i]:05d}", f"S{order[i + 1]:05d}") for i in range(n - 1)]


def _random():
    rng = random.Random(9)
    return [(f"S{rng.randrange(300)}", f"S{rng.randrange(300)}") for _ in range(200)] + [("hub", f"S{i}") for i in range(0, 300, 7)]


@pytest.mark.parametrize("pairs", [
    _chain(1001), _random(), [], [("a", "a")], [("a", None), (None, "b"), (None, None)],
    [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("", "c")]], ids=["chain", "random", "empty", "self", "nulls", "repeated"])
def test_groups_equal_union_find(spark, pairs):
    assert _got(eq.sku_groups(spark.createDataFrame(pairs, PAIRS))) == _groups(pairs)


def test_arrivals_give_the_same_groups(spark):
    pairs = _random()
    groups = eq.sku_groups(spark.createDataFrame(pairs[:60], PAIRS))
    for lo, hi in ((60, 150), (150, 150), (150, len(pairs))):
        groups = eq.extend_groups(groups, spark.createDataFrame(pairs[lo:hi], PAIRS))
    assert _got(groups) == _groups(pairs)


def test_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    star = eq._small_star
    monkeypatch.setattr(eq, "_small_star", lambda e: rounds.append(1) or star(e))
    eq.sku_groups(spark.createDataFrame(_chain(1001), PAIRS))
    assert len(rounds) <= 16
