"""Benchmark decontamination with one Aho-Corasick automaton (operator 5).

The test items are normalised to words (ASCII lower case; a word is a run of ASCII letters,
digits and non-ASCII characters) and cut into windows of ten consecutive words; an item of fewer
words is one window. All windows go into one automaton as strings framed by single spaces, so a
hit always starts and ends at word boundaries. Every document is normalised the same way and
scanned once; hits are mapped back through the word index to offsets of the original text.

The item set is a stated, bounded query set. Its windows are packed into blocks of at most
``BLOCK_CHARS`` pattern characters, so the broadcast is bounded whatever the set's size; each
block scans all documents, and what it hit is carried to the next block.

Defined cases: a null text has no words; an item without words matches nothing; an item without
an id still marks words but is not counted; repeated items share their windows.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skuflow.llm.common import staged, table, with_text_columns, words

WINDOW = 10
BLOCK_CHARS = 8 << 20       # pattern characters of one automaton
RAW_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def windows(text: bytes | None, size: int = WINDOW) -> list[str]:
    """Framed windows of an item, as Latin-1 strings of its normalised bytes."""
    w = words(text)
    parts = [w[i:i + size] for i in range(max(1, len(w) - size + 1))] if w else []
    return [" " + b" ".join(p).decode("latin-1") + " " for p in parts]


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text",
                size: int = WINDOW, block_chars: int = BLOCK_CHARS):
    """Blocks of {window: sorted item ids as strings}, read from the item table row by row."""
    block: dict[str, set[str]] = {}
    chars = 0
    rows = items.select(items[item_id].cast("string").alias("i"), items[text].cast("binary").alias("t"))
    for row in rows.toLocalIterator():
        for w in windows(bytes(row.t) if row.t is not None else None, size):
            if w not in block:
                if chars + len(w) > block_chars and block:
                    yield {k: sorted(v) for k, v in block.items()}
                    block, chars = {}, 0
                block[w] = set()
                chars += len(w)
            if row.i is not None:
                block[w].add(row.i)
    yield {k: sorted(v) for k, v in block.items()}


class Scanner:
    def __init__(self, block: dict[str, list[str]]) -> None:
        self.automaton = ahocorasick.Automaton() if block else None
        for w, ids in block.items():
            self.automaton.add_word(w, (w.count(" ") - 1, len(w), ids))
        if block:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(number of words, merged ranges of hit words, ids of the items that occur)."""
        w = words(text)
        ids: set[str] = set()
        if not w or self.automaton is None:
            return len(w), [], ids
        norm = " " + b" ".join(w).decode("latin-1") + " "
        hits = []
        starts = None
        for end, (n, length, of) in self.automaton.iter(norm):
            if starts is None:      # position of the space before each word
                starts = (np.cumsum([0] + [len(x) + 1 for x in w[:-1]])).tolist()
            first = bisect.bisect_left(starts, end - length + 1)
            hits.append((first, first + n))
            ids.update(of)
        return len(w), merged(hits), ids


def merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that touch or overlap, made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(hits):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


HIT = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])


def scan(docs: DataFrame, items: DataFrame, text: str = "text", size: int = WINDOW,
         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` plus n_words, hit_words (ranges of word numbers), hit_chars (the same ranges as
    code points of the original text) and item_ids (sorted, as strings)."""
    spark = docs.sparkSession
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(HIT)),
              T.StructField("hit_chars", T.ArrayType(HIT)),
              T.StructField("item_ids", T.ArrayType(T.StringType()))]
    out = docs
    columns = docs.columns
    for number, block in enumerate(item_blocks(items, size=size, block_chars=block_chars)):
        shared = spark.sparkContext.broadcast(block)
        found = _scan_block(out, text, shared, fields)
        if number:      # join this block's hits to those of the blocks before
            found = staged(found.withColumns({
                "hit_words": _merged("__llm_w", "hit_words"), "hit_chars": _merged("__llm_c", "hit_chars"),
                "item_ids": _ids("__llm_i")}).drop("__llm_w", "__llm_c", "__llm_i"), "decontaminate")
        out = found.withColumnsRenamed({"hit_words": "__llm_w", "hit_chars": "__llm_c",
                                        "item_ids": "__llm_i"})
    out = out.withColumnsRenamed({"__llm_w": "hit_words", "__llm_c": "hit_chars", "__llm_i": "item_ids"})
    names = {f.name for f in fields}
    return out.select(*[c for c in columns if c not in names], *[f.name for f in fields])


def _merged(old: str, new: str):
    from pyspark.sql import functions as F

    both = F.array_sort(F.concat(F.col(old), F.col(new)))
    empty = F.array().cast(T.ArrayType(HIT))
    return F.aggregate(both, empty, lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["first"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(acc, -1)["first"].alias("first"),
            F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x))))


def _ids(old: str):
    from pyspark.sql import functions as F

    return F.array_sort(F.array_union(F.col(old), F.col("item_ids")))


def _scan_block(docs: DataFrame, text: str, shared, fields: list[T.StructField]) -> DataFrame:
    def make():
        scanner = Scanner(shared.value)

        def run(texts):
            out: list[list] = [[], [], [], []]
            for t in texts:
                n, ranges, ids = scanner.scan(t)
                chars = []
                if ranges:
                    raw = [m.span() for m in RAW_WORD.finditer(t)]
                    for a, b in ranges:
                        lo = len(t[:raw[a][0]].decode())
                        chars.append({"first": lo, "end": lo + len(t[raw[a][0]:raw[b - 1][1]].decode())})
                out[0].append(n)
                out[1].append([{"first": a, "end": b} for a, b in ranges])
                out[2].append(chars)
                out[3].append(sorted(ids))
            return out
        return run

    return with_text_columns(docs, text, fields, make)


def op5_decontaminate_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("hit_words", F.lit(0), lambda acc, x: acc + x["end"] - x["first"])
    return found.select(
        "doc_id", "n_words", hits.cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"))


QUERIES = {"op5_decontaminate_aho_corasick": op5_decontaminate_aho_corasick}
ORACLES = {"op5_decontaminate_aho_corasick": r"""
WITH i AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_aggregate(w[s:s + 9], 'string_agg', ' ') AS k, len(w[s:s + 9]) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
p AS (
  SELECT r, s, n, list_aggregate(w[s:s + n - 1], 'string_agg', ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
h AS (SELECT r, s, win.n, item_id FROM p JOIN win ON p.k = win.k AND p.n = win.n),
hw AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""}
