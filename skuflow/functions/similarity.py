"""Token-sort similarity (F14) as native Spark expressions.

``token_sort_ratio(a, b) = 100 * 2 * LCS(sa, sb) / (len(sa) + len(sb))`` where
``sa``/``sb`` are the whitespace tokens sorted and re-joined with one space
(the indel-normalised similarity of the public fuzzy-matching libraries).
LCS is the bit-parallel dynamic programme: a column of the table is a row of bits in
BIGINT words of 62 (two stay free for the carry), so one character of ``b`` advances
62 cells of ``a`` by a sum and a few bit operations. Written with ``aggregate``, it runs
in the JVM; memory is linear in the lengths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skuflow.functions.text import WHITESPACE_RUN, py_strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def token_sort(col) -> Column:
    """Whitespace tokens sorted (code-point order) and joined by one space."""
    stripped = py_strip(col)
    tokens = F.split(stripped, WHITESPACE_RUN)
    return F.when(stripped == "", F.lit("")).otherwise(F.array_join(F.array_sort(tokens), " "))


def chars(col) -> Column:
    """String as an array of its characters (code points)."""
    s = _c(col)
    return F.when(F.length(s) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, 1)))


WORD = 62
ONES = (1 << WORD) - 1


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's outer expressions are evaluated at every call."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def next_word(v: Column, m: Column, carry: Column) -> tuple[Column, Column]:
    """(new word, carry): ones of ``v`` under matches move up by the sum; ones elsewhere stay."""
    both = v.bitwiseAND(m)
    total = v + both + carry
    return total.bitwiseAND(F.lit(ONES)).bitwiseOR(v - both), F.shiftright(total, WORD)


def bits_of(part: Column, c: Column) -> Column:
    """Bits of the characters of ``part`` (at most a word) that are ``c``."""
    start = F.struct(F.lit(0).cast("long").alias("m"), F.lit(1).cast("long").alias("bit"))
    return F.aggregate(part, start, lambda s, x: F.struct(
        s["m"].bitwiseOR(F.when(x == c, s["bit"]).otherwise(F.lit(0).cast("long"))).alias("m"),
        F.shiftleft(s["bit"], 1).alias("bit")), lambda s: s["m"])


def lcs_length(a, b) -> Column:
    """Length of the longest common subsequence of two strings of any lengths."""
    a, b = _c(a), _c(b)
    zero = F.lit(0).cast("long")

    def short(ca: Column) -> Column:
        """One word: the state is a number."""
        masks = let(F.array_distinct(ca), lambda kinds: F.map_from_arrays(
            kinds, F.transform(kinds, lambda c: bits_of(ca, c))))
        start = F.struct(masks.alias("m"), F.lit(ONES).alias("v"))
        return F.aggregate(chars(b), start, lambda s, c: F.struct(s["m"].alias("m"), F.coalesce(
            next_word(s["v"], F.try_element_at(s["m"], c), zero)[0], s["v"]).alias("v")), lambda s: WORD - F.bit_count(s["v"]))

    def long(ca: Column) -> Column:
        """Several words, low to high; the carry of each sum goes to the next one."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ca) - 1) / WORD).cast("int")),
                            lambda w: F.slice(ca, w * WORD + 1, F.lit(WORD)))
        masks = let(F.array_distinct(ca), lambda kinds: let(parts, lambda p: F.map_from_arrays(
            kinds, F.transform(kinds, lambda c: F.transform(p, lambda x: bits_of(x, c))))))
        columns = let(masks, lambda m: F.transform(chars(b), lambda c: F.try_element_at(m, c)))
        empty = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("out"))

        def step(state: Column, m: Column) -> Column:
            def word(s: Column, x: Column) -> Column:
                new, carry = next_word(x["v"], x["m"], s["carry"])
                return F.struct(carry.alias("carry"), F.concat(s["out"], F.array(new)).alias("out"))
            pairs = F.zip_with(state, m, lambda v, k: F.struct(v.alias("v"), k.alias("m")))
            return F.when(m.isNull(), state).otherwise(F.aggregate(pairs, empty, word, lambda s: s["out"]))

        return F.aggregate(columns, F.transform(parts, lambda x: F.lit(ONES)), step, lambda v: F.size(v) * WORD - F.aggregate(
            v, F.lit(0), lambda n, x: n + F.bit_count(x)))

    return (F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).when(F.length(a) <= WORD, let(chars(a), short))
            .otherwise(let(chars(a), long))).cast("int")


def indel_ratio(a, b) -> Column:
    """0-100 similarity ``200 * LCS / (len(a) + len(b))``; two empty strings score 100."""
    a, b = _c(a), _c(b)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(
        F.lit(200.0) * lcs_length(a, b) / total)


def token_sort_ratio(a, b) -> Column:
    """similarity of the token-sorted strings."""
    return indel_ratio(token_sort(a), token_sort(b))


def ratio_at_least(lcs: Column, len_a: Column, len_b: Column, threshold: float) -> Column:
    """Exact test ``200*LCS/(la+lb) >= threshold`` without floating-point rounding."""
    return F.lit(200.0) * lcs >= F.lit(float(threshold)) * (len_a + len_b)
