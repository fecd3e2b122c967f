"""Near-duplicate groups by ProbMinHash over weighted shingles (operator 9).

A text is lower-cased and cut into words and shingles of five consecutive words (a text of fewer
words is one shingle); a shingle that occurs k times weighs 1 + ln(k). ProbMinHash gives every
shingle a Poisson process whose rate is its weight: arrivals fall into random registers, and a
register keeps the shingle that arrived first, so two texts agree in a register with their
probability Jaccard similarity. A shingle whose next arrival is later than the text's slowest
register cannot change anything and stops; with that early end long texts cost little more than
one arrival per shingle. Registers are cut into bands.

Texts that are equal are one node from the start, so copies never form pairs. A text with repeated
shingles also gets the bands of its plain shingle set (all weights 1, which are the only bands of a
text without repetitions), so that texts of similar sets meet however often their parts repeat.

Nodes that share a band meet in its bucket. A bucket never lists its pairs: each member is verified
against the bucket's leader, then, where the bucket still holds several components of the links found
so far, against further leaders drawn from all of its members. What is left, the members of buckets that
still hold several components, is compared by an exact prefix filter: shingles of one component only
come first, then the others, rarest first; in that order two texts of the wanted similarity share one of
their first n - ceil(s * n) + 1 shingles, and the places of the first shared one must leave room for the
overlap. A passage that many members share comes last, so it makes no pairs of its own.
Every pair of a bucket is thus verified, ruled out by the filter or already in one component.
Verification is exact: Jaccard similarity of the shingle sets of both whole texts, at least 0.8.
Groups are the connected components of the verified links, found by distributed label propagation
with pointer jumping.

Nodes are 64-bit hashes of texts: among n different texts about n * n / 2**65 pairs share one.

Defined cases: a null text is a group of its own, with class null if its id is null; equal texts
(empty ones too) are copies; a group's class is its smallest doc_id; rows that repeat an id stay
rows of their group, and ``deduplicate`` keeps one row per group even if its rows are identical.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skuflow.llm.common import bounded_batches, slices, staged, table, trim, words

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 64, 10
LEADERS = 8
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word, computed once while the word is kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(w: list[bytes], known: WordHashes, size: int = WORDS) -> np.ndarray:
    """Hashes of all shingles of a word list, with repetitions."""
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out * GOLD + h[k:k + n] + np.uint64(k + 1))
    return out


def registers(elements: np.ndarray, weight: np.ndarray, of: np.ndarray, texts: int, m: int) -> np.ndarray:
    """ProbMinHash registers (texts, m): the element that arrived first (its low 32 bits)."""
    reg = np.full(texts * m, FULL, np.uint64)
    seed = mix(elements + GOLD)
    clock = np.zeros(len(elements))
    active = np.arange(len(elements))
    step = 0
    while len(active):
        # Few elements left to fill many registers: take several arrivals of each at once.
        several = 16 if len(active) < 1 << 13 else 1
        turns = np.arange(step + 1, step + several + 1, dtype=np.uint64)
        draw = mix(seed[active][:, None] + turns[None, :] * GOLD)
        gap = -np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53))
        when = clock[active][:, None] + np.cumsum(gap / weight[active][:, None], axis=1)
        where = ((mix(draw + GOLD) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        value = (when.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (
            elements[active] & np.uint64(0xFFFFFFFF))[:, None]
        np.minimum.at(reg, (of[active][:, None] * m + where).ravel(), value.ravel())
        clock[active] = when[:, -1]
        step += several
        # The slowest register of a text ends all elements whose clock is past it.
        own = np.unique(of[active])
        last = (reg.reshape(texts, m)[own].max(axis=1) >> np.uint64(32)).astype(np.uint32)
        limit = np.zeros(texts)
        limit[own] = np.where(last == 0xFFFFFFFF, np.inf, last.view(np.float32))
        active = active[clock[active] < limit[of[active]]]
    return reg.reshape(texts, m) & np.uint64(0xFFFFFFFF)


def band_keys(texts: list[bytes | None], known: WordHashes, bands: int = BANDS, rows: int = ROWS) -> list:
    """Band keys of each text, None for a text without words; texts with repetitions have two sets of bands."""
    parts = [shingles(words(t), known) for t in texts]
    there = [i for i, p in enumerate(parts) if len(p)]
    out: list = [None] * len(texts)
    if not there:
        return out
    # Sorting (text, 48 bits of the shingle) groups the repetitions of a text's shingles.
    key = np.concatenate([(p >> np.uint64(16)) | np.uint64(k << 48) for k, p in enumerate(parts[i] for i in there)])
    key, times = np.unique(key, return_counts=True)
    of = (key >> np.uint64(48)).astype(np.int64)
    element = mix(key & np.uint64((1 << 48) - 1))

    def hashed(element: np.ndarray, weight: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        reg = registers(element, weight, of, n, bands * rows).reshape(n, bands, rows)
        h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), reg.shape[:2])
        for k in range(rows):
            h = mix(h * GOLD + reg[:, :, k])
        return h.view(np.int64)

    for i, keys in zip(there, hashed(element, 1 + np.log(times), of, len(there))):
        out[i] = keys
    again = np.unique(of[times > 1])
    if len(again):
        at = np.isin(of, again)
        plain = hashed(element[at], np.ones(at.sum()), np.searchsorted(again, of[at]), len(again))
        for k, keys in zip(again, plain):
            out[there[k]] = np.unique(np.concatenate([out[there[k]], keys]))
    return out


def sketches(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, node, keys); within a slice only the first of equal texts carries keys."""
    src = docs.select(F.col(doc_id).alias("doc_id"),
                      F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("node"),
                      F.col(text).cast("binary").alias("text"))
    bounded_batches(docs.sparkSession)
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, node bigint, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            nodes, body = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in slices([len(x or b"") + 1024 for x in body], 2 << 20):
                first = {n: i for i, n in reversed(list(enumerate(nodes[lo:hi]))) if n is not None}
                order = list(first.values())
                keys: list = [None] * (hi - lo)
                for i, k in zip(order, band_keys([body[lo + i] for i in order], known)):
                    keys[i] = k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "keys"])
                del keys
        known.clear()
        trim()

    return src.mapInArrow(run, schema)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct hashes."""
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return both / max(len(a) + len(b) - both, 1)


def compare(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ok) of candidate pairs, by the exact similarity of both whole texts."""
    # The leader of a large bucket is mostly a, so its text joins last, to a side that can be split.
    sides = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select(
        "a", "b", F.col("text_a").cast("binary"), F.col("text_b").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        kept: OrderedDict[int, np.ndarray] = OrderedDict()

        def hashes(node: int, text: bytes) -> np.ndarray:
            if node not in kept:
                kept[node] = np.unique(shingles(words(text), known))
                if len(kept) > 256:
                    kept.popitem(last=False)
            kept.move_to_end(node)
            return kept[node]

        for batch in batches:
            a, b, text_a, text_b = (batch.column(i) for i in range(4))
            ok = [jaccard(np.unique(shingles(words(y.as_py()), known)), hashes(k, x.as_py())) >= similarity
                  for k, x, y in zip(a.to_pylist(), text_a, text_b)]
            yield pa.RecordBatch.from_arrays([a, b, pa.array(ok, pa.bool_())], names=["a", "b", "ok"])
        known.clear()
        kept.clear()
        trim()

    return sides.mapInArrow(run, "a bigint, b bigint, ok boolean")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, keys): the distinct shingles of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column(1)).to_pylist(), 1 << 20):
                sets = [np.unique(shingles(words(t.as_py()), known)).view(np.int64) for t in batch.column(1).slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.list_(pa.int64()))],
                                                 names=["node", "keys"])

    return texts.select("node", F.col("text").cast("binary")).mapInArrow(run, "node bigint, keys array<bigint>")


def compare_sets(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ok) of candidate pairs, by the exact similarity of their sets of shingles."""
    both = pairs.join(sets.toDF("b", "keys_b"), "b").join(sets.toDF("a", "keys_a"), "a").select(
        "a", "b", (F.size("keys_a") + F.size("keys_b")).alias("n"), F.size(F.array_intersect("keys_a", "keys_b")).alias("shared"))
    return both.select("a", "b", (F.col("shared") / F.greatest(F.col("n") - F.col("shared"), F.lit(1)) >= similarity).alias("ok"))


def open_members(members: DataFrame, tested: DataFrame) -> DataFrame:
    """(key, node, leader, label) of the buckets that hold several components of the links found so far."""
    found = tested.where("ok").select("a", "b")
    known = members.select("key", "node", "leader")
    if found.isEmpty():
        return staged(known.withColumn("label", F.col("node")).distinct(), "dedup-open")
    labelled = known.join(components(found), "node", "left").select(
        "key", "node", "leader", F.coalesce("label", "node").alias("label"))
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return staged(labelled.join(several.select("key"), "key", "left_semi").distinct(), "dedup-open")


def leader_pairs(members: DataFrame) -> DataFrame:
    """Pairs of open members with up to LEADERS further leaders of their bucket, from other components."""
    leaders = members.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(LEADERS)).alias("slot")).agg(
        F.min(F.struct("node", "label")).alias("head")).select("key", "head")
    return members.join(leaders, "key").where("label <> head.label").select(
        F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()


def prefix_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of ``nodes`` (node, label) of different labels whose sets of shingles can have the similarity."""
    each = sets.join(nodes, "node").select("node", "label", F.size("keys").alias("size"), F.explode("keys").alias("key"))
    met = each.groupBy("key").agg(F.count("*").alias("held"), F.min("label").alias("lo"), F.max("label").alias("hi")).where(
        "lo < hi").select("key", "held")
    # Shingles of one label only cannot be shared by a pair of two; they take the first places.
    firsts = each.join(met, "key").groupBy("node", "label", "size").agg(
        F.array_sort(F.collect_list(F.struct("held", "key"))).alias("shared")).select(
        "node", "label", "size", (F.col("size") - F.size("shared")).alias("own"), "shared",
        (F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1).cast("int").alias("first"))
    held = staged(firsts.where("first > own").select(
        "node", "label", "size", "own", F.posexplode(F.slice("shared", F.lit(1), F.col("first") - F.col("own")))).select(
        "node", "label", "size", (F.col("own") + F.col("pos") + 1).alias("at"), F.col("col.key").alias("key")), "dedup-prefixes")
    x, y = (held.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "label", "size", "at")]) for k in "xy")
    room = 1 + F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
    return x.join(y, "key").where(
        (F.col("label_x") < F.col("label_y")) & (F.col("size_x") >= F.col("size_y") * (similarity - 1e-9))
        & (F.col("size_y") >= F.col("size_x") * (similarity - 1e-9))
        & (room >= (F.col("size_x") + F.col("size_y")) * (similarity / (1 + similarity)) - 1e-9)).select(
        F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def links(docs: DataFrame, sketched: DataFrame, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) between different texts."""
    members = sketched.where("keys IS NOT NULL").select(F.explode("keys").alias("key"), "node")
    # Most buckets hold one member and end here.
    leaders = members.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where(
        "leader < last").drop("last")
    members = staged(members.join(leaders, "key"), "dedup-members")
    # One text per node: copies are reduced to one within each task before they move on.
    texts = staged(docs.where(F.col(text).isNotNull()).select(
        F.xxhash64(F.col(text)).alias("node"), F.col(text).alias("text")).join(
        staged(members.select("node").distinct(), "dedup-wanted"), "node", "left_semi").groupBy("node").agg(
        F.first("text").alias("text")), "dedup-texts")
    first = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    tested = staged(compare(first, texts, similarity), "dedup-tested")
    members = open_members(members, tested)
    if not members.isEmpty():
        new = staged(leader_pairs(members).join(tested, ["a", "b"], "left_anti"), "dedup-pairs")
        tested = staged(tested.unionByName(compare(new, texts, similarity)), "dedup-tested")
        nodes = staged(open_members(members, tested).select("node", "label").distinct(), "dedup-left")
        sets = staged(shingle_sets(texts.join(nodes, "node", "left_semi")), "dedup-sets")
        new = staged(prefix_pairs(nodes, sets, similarity).join(tested, ["a", "b"], "left_anti"), "dedup-pairs")
        tested = tested.unionByName(compare_sets(new, sets, similarity))
    return staged(tested.where("ok").select("a", "b"), "dedup-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for nodes with an edge."""
    both = staged(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "dedup-edges")
    labels = staged(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "dedup-labels")
    while True:
        # The least label around each node, then the label of that label.
        near = both.join(labels.withColumnsRenamed({"node": "other"}), "other").groupBy("node").agg(
            F.min("label").alias("near"))
        hop = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        hop = staged(hop, "dedup-hop")
        jump = hop.join(hop.select(F.col("node").alias("next"), F.col("next").alias("far")), "next", "left")
        new = staged(jump.select("node", F.coalesce(F.least("next", "far"), "next").alias("label"),
                                 (F.coalesce(F.least("next", "far"), "next") < F.col("label")).alias("changed")),
                     "dedup-labels")
        changed = not new.where("changed").isEmpty()
        labels = new.drop("changed")
        if not changed:
            return labels


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
           similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, node, class_id, class_node and class_size.

    class_id is the smallest doc_id of the group, class_node the node of that row.
    """
    sketched = staged(sketches(docs, text, doc_id), "dedup-sketches")
    edges = links(docs, sketched, text, similarity)
    rows = sketched.select("doc_id", "node")
    labelled = rows if edges.isEmpty() else rows.join(components(edges), "node", "left")
    label = F.col("node") if edges.isEmpty() else F.coalesce("label", "node")
    labelled = staged(labelled.select("doc_id", "node", label.alias("label")), "dedup-rows")
    # Counted per (label, node) first: copies of one text reduce to a row per task.
    heads = labelled.where("label IS NOT NULL").groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("head"),
        F.count("*").alias("class_size"))
    known = labelled.where("label IS NOT NULL").join(heads, "label").select(
        "doc_id", "node", F.col("head.doc_id").alias("class_id"), F.col("head.node").alias("class_node"), "class_size")
    alone = labelled.where("label IS NULL").select(
        "doc_id", "node", F.col("doc_id").alias("class_id"), F.lit(None).cast("bigint").alias("class_node"),
        F.lit(1).cast("bigint").alias("class_size"))
    return known.unionByName(alone)


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs``: of each group one row with its smallest id; rows without a text all stay."""
    found = groups(docs, text, doc_id, similarity)
    keep = staged(found.where("class_node IS NOT NULL AND node = class_node AND doc_id <=> class_id").groupBy(
        "doc_id", "node").count(), "dedup-keep")
    marked = docs.withColumn("__llm_node", F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))))

    def rows_of(kept: DataFrame) -> DataFrame:
        k = kept.select(F.col("doc_id").alias("__llm_doc"), F.col("node").alias("__llm_kept"))
        return marked.join(k, (marked["__llm_node"] == k["__llm_kept"]) & marked[doc_id].eqNullSafe(k["__llm_doc"]),
                           "left_semi")

    out = rows_of(keep.where("count = 1")).unionByName(marked.where("__llm_node IS NULL"))
    repeated = keep.where("count > 1")
    if not repeated.isEmpty():
        out = out.unionByName(rows_of(repeated).dropDuplicates([doc_id, "__llm_node"]))
    return out.select(*docs.columns)


def op9_near_dedup_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs).select("doc_id", "class_id", "class_size")


QUERIES = {"op9_near_dedup_probminhash": op9_near_dedup_probminhash}
ORACLES: dict[str, str] = {}
