"""Source divergence audit by chunk factorization (operator 13).

A term is a run of ASCII letters and non-ASCII characters, so no term crosses ASCII white space, and
a text is a bag of white-space chunks. The work is factored over chunks:

1. Each task cuts whole texts into chunks and counts them per document. For a block of documents it
   passes on one row per distinct chunk and language: its documents and its occurrences by source.
2. Each globally distinct chunk is tokenized once, by native expressions.
3. The terms are joined back. A term is in at least as many documents as its most frequent chunk, and
   in at most as many as its chunks together, which decides for nearly all terms. For the others the
   document lists of their chunks are united, so that a document with several of them counts once.
   Such a chunk is in fewer documents than the threshold, so blocks list only the documents of chunks
   below it; longer lists can never be asked for.
4. Occurrences of a chunk times those of the term in it are summed by term and source.

A very frequent chunk is one row a block, and the join's other side has one row for each of its terms,
so AQE can split it; a source with a third of all rows costs no more rows than another. Distances of
sources are sums over terms of |p - q|: the sources of a term lie in one row, tiles of ``TILE`` sources
are worked on with matrices of a bounded number of terms, and a task passes on one sum a pair of sources.
Terms that a source does not have are not listed; their share follows from the number of kept terms.
Sources are numbered on the driver: the result holds every pair of them, so they are far fewer than its rows.

Defined cases: null text, lang and source are ''; repeated rows are documents of their own (ids are
not read); a language without kept terms has distances 0 and no term rows; an empty table gives no
rows; ties go to the smaller item in UTF-8 order; columns other than the three are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skuflow.llm.common import bounded_batches, discard, slices, staged, table, trim

# Fixed values of the audit.
LEAST_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TERMS_LISTED = 50
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

BLOCK_BYTES = 24 << 20       # text of one block of documents
TILE = 512                   # sources of one matrix
STRIP = 1 << 18              # entries of one matrix of terms


Names = dict[str, list[str]]     # languages and the sources of each, in UTF-8 order


def source_names(docs: DataFrame) -> Names:
    names: Names = {}
    for r in docs.select("lang", "source").distinct().collect():
        names.setdefault(r.lang, []).append(r.source)
    return {k: sorted(v, key=str.encode) for k, v in sorted(names.items())}


def chunk_counts(docs: DataFrame, names: Names, least_docs: int) -> DataFrame:
    """(chunk, lang, n_docs, block, docs, at, n): a row per chunk, language and block of documents.

    ``docs`` has text, lang and source, all strings. lang and at are numbers of the language and of its
    sources, n the occurrences in each of the sources at; docs lists numbers of documents within the
    block, null where ``least_docs`` documents of the block or more have the chunk.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({(x, s): (i, j) for i, (x, of) in enumerate(names.items()) for j, s in enumerate(of)})
    fields = [("chunk", pa.string()), ("lang", pa.int32()), ("n_docs", pa.int64()), ("block", pa.int64()),
              ("docs", pa.list_(pa.int32())), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]

    def of_block(batch: pa.RecordBatch, block: int) -> Iterator[pa.RecordBatch]:
        chunks = pc.ascii_split_whitespace(batch.column(0))
        sizes = pc.list_value_length(chunks).to_numpy()
        coded = chunks.flatten().dictionary_encode()
        if not len(coded):
            return
        words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        numbers = [shared.value[pair] for pair in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        lang, at = np.array(numbers, np.int64).T
        # Documents in the order of (language, source, place), so that one sort groups all.
        by = np.lexsort((at, lang))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        pair, times = np.unique(code * len(by) + np.repeat(rank, sizes), return_counts=True)
        chunk, doc = pair // len(by), by[pair % len(by)]
        new_chunk = np.diff(chunk, prepend=-1) != 0
        new_row = new_chunk | (np.diff(lang[doc], prepend=-1) != 0)
        new_source = new_row | (np.diff(at[doc], prepend=-1) != 0)
        rows, sources = np.flatnonzero(new_row), np.flatnonzero(new_source)
        many = np.diff(np.append(rows, len(doc)))
        listed = many < least_docs
        held = np.repeat(listed, many)
        offsets = np.append(0, np.cumsum(np.where(listed, many, 0))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(doc[held].astype(np.int32)))
        by_source = pa.array(np.searchsorted(sources, np.append(rows, len(doc))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [words.take(pa.array(chunk[rows])), pa.array(lang[doc[rows]].astype(np.int32)), pa.array(many),
             pa.array(np.full(len(rows), block)), pc.if_else(pa.array(listed), lists, pa.nulls(len(rows), lists.type)),
             pa.ListArray.from_arrays(by_source, pa.array(at[doc[sources]].astype(np.int32))),
             pa.ListArray.from_arrays(by_source, pa.array(np.add.reduceat(times, sources)))], schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column(0)).to_pylist(), BLOCK_BYTES):
                part = batch.slice(lo, hi - lo)
                n = pc.sum(pc.binary_length(part.column(0))).as_py() or 0
                if held and size + n > BLOCK_BYTES:
                    yield from of_block(pa.concat_batches(held), block)
                    trim()
                    block, held, size = block + 1, [], 0
                held.append(part)
                size += n
        if held:
            yield from of_block(pa.concat_batches(held), block)
        del held
        trim()

    bounded_batches(spark)
    return docs.select("text", "lang", "source").mapInArrow(
        run, "chunk string, lang int, n_docs bigint, block bigint, docs array<int>, at array<int>, n array<bigint>")


def terms_of(chunk: Column) -> Column:
    """Terms of a chunk, with repetitions: A-Z lower-cased, nothing else."""
    return F.regexp_extract_all(F.translate(chunk, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                F.lit(TERM), F.lit(0))


def small(df: DataFrame, most: int = 1 << 19) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows; else Spark joins it by its key."""
    return F.broadcast(df) if df.count() <= most else df


def term_counts(counted: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, sources array<struct<at, n>>) of each language's terms in at least ``least_docs`` documents."""
    key, whole = ["chunk", "lang"], ["lang", "term"]
    # Blocks have summed up; all rows of a chunk then meet once, for its sums and its only tokenization.
    chunks = counted.select(*key, "n_docs").repartition("chunk").groupBy(*key).agg(F.sum("n_docs").alias("n_docs")).groupBy(
        "chunk").agg(F.collect_list(F.struct("lang", "n_docs")).alias("langs"))
    chunks = staged(chunks.select("chunk", "langs", terms_of(F.col("chunk")).alias("terms")).where(F.size("terms") > 0),
                    "audit-tokens")
    once = F.array_distinct("terms")
    times = F.when(F.size("terms") == F.size(once), F.lit(1)).otherwise(
        F.size(F.filter("terms", lambda x: x == F.col("term"))))
    tokens = chunks.select("chunk", "langs", "terms", F.explode(once).alias("term")).select(
        "chunk", "langs", "term", times.alias("times"))
    tokens = tokens.select("chunk", "term", "times", F.inline("langs"))
    bounds = staged(tokens.groupBy(*whole).agg(F.sum("n_docs").alias("most"), F.max("n_docs").alias("least")).where(
        F.col("most") >= least_docs).select(*whole, (F.col("least") < least_docs).alias("open")), "audit-bounds")
    needed = staged(tokens.join(small(bounds), whole).select("chunk", *whole, "times", "open"), "audit-needed")
    counts = needed.where("open").select(*key, "term").join(counted.select(*key, "block", "docs"), key).select(
        *whole, "block", F.explode("docs").alias("doc")).distinct().groupBy(*whole).count().where(F.col("count") >= least_docs)
    kept = staged(bounds.where("NOT open").select(*whole).unionByName(counts.select(*whole)), "audit-kept")
    discard(chunks, bounds)
    terms = staged(needed.join(small(kept), whole, "left_semi").select(*key, "term", "times").join(
        counted.select(*key, F.arrays_zip("at", "n").alias("by")), key).select(
        *whole, "times", F.explode("by").alias("s")).groupBy(*whole, F.col("s.at").alias("at")).agg(
        F.sum(F.col("s.n") * F.col("times")).alias("n")).groupBy(*whole).agg(
        F.collect_list(F.struct("at", "n")).alias("sources")), "audit-terms")
    discard(needed, kept)
    return terms


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / (total + SMOOTHING * kept)), in whole numbers."""
    whole = "decimal(38,0)"
    top = (count.cast("decimal(19,0)") + SMOOTHING).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top.cast(whole), (total + kept * SMOOTHING).cast(whole))


def distances(shares: DataFrame, base: dict[int, list[int]]) -> DataFrame:
    """(lang, a, b, f): sums over the listed terms of |p_a - p_b| less that of two absent terms, for numbers a < b.

    ``shares`` has (lang, held array<struct<at int, p bigint>>), a row a term; ``base`` the share of an
    absent term by language and number of the source.
    """
    tiles = F.array_sort(F.array_distinct(F.transform("held", lambda x: F.floor(x["at"] / TILE).cast("int"))))
    lang_tiles = {lang: -(-len(p) // TILE) for lang, p in base.items()}
    shared = shares.sparkSession.sparkContext.broadcast(base)
    many = F.create_map(*[F.lit(x) for kv in lang_tiles.items() for x in kv])
    # A term concerns every pair of tiles of which one holds a source of it.
    paired = shares.select("lang", "held", F.explode(tiles).alias("tile"), tiles.alias("own")).select(
        "lang", "held", "tile", "own", F.explode(F.sequence(F.lit(0), many[F.col("lang")] - 1)).alias("other")).where(
        ~F.array_contains("own", F.col("other")) | (F.col("tile") <= F.col("other"))).select(
        "lang", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "held").sortWithinPartitions(
        "lang", "x", "y")

    class Sums:
        def __init__(self, lang: int, x: int, y: int) -> None:
            p = np.array(shared.value[lang], np.int64)
            self.key, self.x, self.y = (lang, x, y), x * TILE, y * TILE
            self.a, self.b = p[self.x:self.x + TILE], p[self.y:self.y + TILE]
            self.none = np.abs(self.a[:, None] - self.b[None, :])
            self.sums = np.zeros(self.none.shape, np.int64)

        def add(self, held: pa.Array) -> None:
            sizes = np.diff(held.offsets.to_numpy())
            flat = held.flatten()
            at, p = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            strip = max(1, STRIP // max(len(self.a), len(self.b)))
            for lo in range(0, len(sizes), strip):
                n = min(strip, len(sizes) - lo)
                sides = []
                for start, base in ((self.x, self.a), (self.y, self.b)):
                    m = np.repeat(base[:, None], n, axis=1)
                    pick = (row >= lo) & (row < lo + n) & (at >= start) & (at < start + len(base))
                    m[at[pick] - start, row[pick] - lo] = p[pick]
                    sides.append(m)
                for i, own in enumerate(sides[0]):
                    self.sums[i] += np.abs(sides[1] - own[None, :]).sum(axis=1) - n * self.none[i]

        def batch(self) -> pa.RecordBatch:
            a, b = np.indices(self.sums.shape)
            a, b, f = a.ravel() + self.x, b.ravel() + self.y, self.sums.ravel()
            keep = (a < b) & (f != 0)
            return pa.RecordBatch.from_arrays(
                [pa.array([self.key[0]] * int(keep.sum()), pa.int32()), pa.array(a[keep].astype(np.int32)),
                 pa.array(b[keep].astype(np.int32)), pa.array(f[keep])], names=["lang", "a", "b", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            lang, x, y = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            lo = 0
            while lo < len(lang):
                key, hi = (lang[lo], x[lo], y[lo]), lo
                while hi < len(lang) and (lang[hi], x[hi], y[hi]) == key:
                    hi += 1
                if sums is None or sums.key != key:
                    if sums is not None:
                        yield sums.batch()
                    sums = Sums(*key)
                sums.add(batch.column(3).slice(lo, hi - lo))
                lo = hi
        if sums is not None:
            yield sums.batch()

    return paired.mapInArrow(run, "lang int, a int, b int, f bigint").groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          least_docs: int = LEAST_DOCS, listed: int = TERMS_LISTED) -> DataFrame:
    """(lang, source, part, item, value, rank) for every source of every language.

    part ``pair``: the other sources of the language by distance; part ``term``: the terms that the
    source has more often than its language, the first ``listed`` of them.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(name)
                         for c, name in ((text, "text"), (lang, "lang"), (source, "source"))])
    names = source_names(docs)
    if not names:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value bigint, rank int")
    counted = staged(chunk_counts(docs, names, least_docs), "audit-chunks")
    terms = term_counts(counted, least_docs)
    discard(counted)
    kept = {r.lang: r.n for r in terms.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    totals = {(r.lang, r.at): r.n for r in terms.select("lang", F.explode("sources").alias("s")).groupBy(
        "lang", F.col("s.at").alias("at")).agg(F.sum("s.n").alias("n")).collect()}
    # One row a source: its total and the share of a term that it does not have.
    base, rows = {}, []
    for x, (lang_name, sources) in enumerate(names.items()):
        v = kept.get(x, 0)
        whole = sum(totals.get((x, i), 0) for i in range(len(sources)))
        base[x] = [1 + UNIT * SMOOTHING // (totals.get((x, i), 0) + SMOOTHING * v) if v else 0 for i in range(len(sources))]
        rows += [(x, i, lang_name, s, totals.get((x, i), 0), whole, v, base[x][i]) for i, s in enumerate(sources)]
    groups = staged(spark.createDataFrame(
        rows, "lang int, at int, lang_name string, source string, total long, whole long, kept long, absent long"), "audit-sources")

    whole = F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    listing = staged(terms.select("lang", "term", whole.alias("all"), F.explode("sources").alias("s")).select(
        "lang", "term", "all", "s.at", "s.n").join(groups, ["lang", "at"]).select(
        "lang", "at", "lang_name", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("all"), F.col("whole"), F.col("kept")).alias("q")), "audit-shares")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = listing.where("p > q").select(
        F.col("lang_name").alias("lang"), "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed)

    held = listing.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p")).alias("held"))
    sums = distances(held.select("lang", "held"), base)
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "f"))
    own, other = (groups.select("lang", "lang_name", F.col("source").alias(s), F.col("at").alias(a), "kept",
                                F.col("absent").alias(f"absent_{a}")) for s, a in (("source", "a"), ("item", "b")))
    # The result itself: every source with each other source of its language.
    pairs = own.join(other.drop("kept", "lang_name"), "lang").where("a <> b").join(both, ["lang", "a", "b"], "left").select(
        F.col("lang_name").alias("lang"), "source", F.lit("pair").alias("part"), "item",
        (F.coalesce("f", F.lit(0)) + F.col("kept") * F.abs(F.col("absent_a") - F.col("absent_b"))).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(of_terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {"op13_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
  coalesce(source, '') AS source FROM documents),
w AS (SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '{TERM}')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
v AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN v ON w.lang = v.lang AND w.term = v.term
  GROUP BY w.lang, w.source, w.term),
f AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v ON g.lang = v.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
t AS (SELECT lang, source, sum(n) AS total, count(*) AS kept FROM f GROUP BY lang, source),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + ({UNIT}::HUGEINT * (f.n + {SMOOTHING})) // (t.total + {SMOOTHING} * t.kept) AS p
  FROM f JOIN t ON f.lang = t.lang AND f.source = t.source),
l AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term),
lt AS (SELECT lang, sum(n) AS total, count(*) AS kept FROM l GROUP BY lang),
q AS (SELECT l.lang, l.term, 1 + ({UNIT}::HUGEINT * (l.n + {SMOOTHING})) // (lt.total + {SMOOTHING} * lt.kept) AS q
  FROM l JOIN lt ON l.lang = lt.lang),
pairs AS (SELECT x.lang, x.source, y.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
u AS (SELECT * FROM allpairs UNION ALL SELECT * FROM terms),
r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (
  PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= {TERMS_LISTED}"""}
