"""Vehicle hierarchy and series canonicalisation (A11, J1, J4, W7, W10, K5-K6 shapes).

The working form of the maker -> series -> models hierarchy is a flat
``(maker, series, model)`` DataFrame; the nested map is produced only at the
sink. Fuzzy series matching is an exact similarity join over a segment index rather
than an all-pairs self join, and greedy clustering is a distributed fixed-point
iteration over the similarity edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skuflow.functions.similarity import lcs_length, ratio_at_least, token_sort
from skuflow.functions.text import title_case, truthy
from skuflow.session import ensure_checkpoint_dir, scratch_path

DEFAULT_THRESHOLD = 85.0


def build_hierarchy(bids: DataFrame) -> DataFrame:
    """Distinct (maker, series, model) with title-cased, stripped maker and series.

    Only bids whose maker, series and model are all truthy contribute (the
    model key itself, without the fabrication-year fallback).
    """
    ok = bids.filter(truthy("maker") & truthy("series") & truthy("model"))
    return ok.select(title_case("maker").alias("maker"), title_case("series").alias("series"),
                     F.col("model").cast("string").alias("model")).distinct()


def nest_hierarchy(rows: DataFrame, key: str = "series", value: str = "model") -> DataFrame:
    """K5 shape: one row per maker with a sorted ``map<series, sorted array<model>>``.

    A maker row holds its distinct series only (bounded by the series
    vocabulary, not by the number of bids).
    """
    per_key = rows.groupBy("maker", key).agg(F.sort_array(F.collect_set(value)).alias("values"))
    return per_key.groupBy("maker").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "values")))).alias(key))


def apply_series_equivalency(rows: DataFrame, equivalency: DataFrame) -> DataFrame:
    """Series -> canonical series via a (maker, series) lookup, default = own series.

    Model sets are then united under the canonical name (distinct rows).
    """
    eq = equivalency.select(F.trim("maker").alias("maker"), F.trim("series").alias("series"),
                            F.trim("canonical_series").alias("canonical_series")
                            ).dropDuplicates(["maker", "series"])
    joined = rows.join(eq, ["maker", "series"], "left")
    return joined.select("maker", F.coalesce("canonical_series", "series").alias("series"),
                         "model").distinct()


def series_flat(rows: DataFrame) -> DataFrame:
    """K6 rows: (maker, series, canonical_series = series), one per distinct series."""
    return rows.select("maker", "series").distinct().withColumn("canonical_series", F.col("series"))


def _positions(series: DataFrame) -> DataFrame:
    """Distinct (maker, series) with their code-point order position within the maker."""
    d = series.select("maker", "series").distinct()
    # Ranking is over distinct series of one maker (bounded by the series
    # vocabulary), so a per-maker window is small even for a hot maker.
    return d.withColumn("pos", F.row_number().over(Window.partitionBy("maker").orderBy("series")))


def allowed_edits(len_a, len_b, threshold: float):
    """Most insertions and deletions that a pair of these lengths may need at this similarity.

    ``la + lb - 2 LCS`` has the parity of ``la + lb``, so an odd rest is taken off.
    """
    total = len_a + len_b
    most = F.floor(F.lit(1.0 - threshold / 100.0) * total + F.lit(1e-9)).cast("int")
    return most - F.abs(most - total) % 2


def by_segments(short, edits):
    """True where segments decide: one piece more than the edits, none of them empty."""
    return (edits == 0) | (edits < short)


def _pieces(row: DataFrame, length: str, edits: str) -> DataFrame:
    """One row per piece: a string of ``length`` cut into ``edits + 1`` pieces, the longer ones last."""
    n = F.col(edits) + 1
    size, longer = F.floor(F.col(length) / n).cast("int"), F.col(length) % n
    piece = F.col("piece")
    before = F.greatest(F.lit(0), piece - (n - longer))
    return (row.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col(edits))))
            .withColumn("start", piece * size + before)
            .withColumn("width", size + (piece >= n - longer).cast("int")))


def segment_candidates(nodes: DataFrame, threshold: float) -> DataFrame:
    """(maker, pos_a, pos_b, len_a, len_b): pairs with a piece in common, for lengths where pieces decide.

    The shorter string of a pair that may differ by d edits is cut into d + 1 pieces. Count the edits
    up to the end of each piece: the first piece i (from 0) with at most i of them is whole, has exactly
    i edits before it and at most d - i behind it. So it stands in the longer string at a shift of the
    parity of i, of at most i, and what is left of the length difference is at most d - i. The pieces
    of the shorter strings are the index; the longer ones look up their substrings at those shifts.
    """
    ratio = (200.0 - threshold) / threshold
    node = nodes.select("maker", "pos", "s", "len")
    # Longest partner: LCS <= the shorter length. The same pieces serve every partner length with the same d.
    index = (node.withColumn("other", F.explode(F.sequence(F.col("len"), F.floor(
        F.col("len") * F.lit(ratio) + F.lit(1e-9)).cast("int"))))
        .withColumn("edits", allowed_edits(F.col("len"), F.col("other"), threshold))
        .filter(by_segments(F.col("len"), F.col("edits"))).drop("other").distinct())
    index = _pieces(index, "len", "edits").select(
        "maker", F.col("len").alias("len_s"), "edits", "piece",
        F.expr("substring(s, start + 1, width)").alias("segment"), F.col("pos").alias("pos_s"))
    look = (node.withColumn("len_s", F.explode(F.sequence(F.ceil(
        F.col("len") / F.lit(ratio) - F.lit(1e-9)).cast("int"), F.col("len"))))
        .withColumn("edits", allowed_edits(F.col("len_s"), F.col("len"), threshold))
        .filter(by_segments(F.col("len_s"), F.col("edits"))))
    look = (_pieces(look, "len_s", "edits")
            .withColumn("shift", F.explode(F.sequence(-F.col("piece"), F.col("piece"), F.lit(2))))
            .filter((F.abs(F.col("len") - F.col("len_s") - F.col("shift")) <= F.col("edits") - F.col("piece"))
                    & (F.col("start") + F.col("shift") >= 0)
                    & (F.col("start") + F.col("shift") + F.col("width") <= F.col("len")))
            .select("maker", "len_s", "edits", "piece", F.expr("substring(s, start + shift + 1, width)").alias("segment"),
                    F.col("pos").alias("pos_l"), F.col("len").alias("len_l")))
    pairs = (look.join(index, ["maker", "len_s", "edits", "piece", "segment"])
             # Strings of one length are both shorter and longer: one order of them is enough.
             .filter((F.col("len_s") < F.col("len_l")) | (F.col("pos_s") < F.col("pos_l"))))
    first = F.col("pos_s") < F.col("pos_l")
    return pairs.select(
        "maker", F.least("pos_s", "pos_l").alias("pos_a"), F.greatest("pos_s", "pos_l").alias("pos_b"),
        F.when(first, F.col("len_s")).otherwise(F.col("len_l")).alias("len_a"),
        F.when(first, F.col("len_l")).otherwise(F.col("len_s")).alias("len_b")).distinct()


def character_candidates(nodes: DataFrame, threshold: float) -> DataFrame:
    """Candidates of the other lengths (low thresholds): pairs with a rare character in common.

    A qualifying string x shares at least ``ceil(t*lx/(2-t))`` characters with its partner, so under one
    global order of (character, occurrence) tokens, rarest first, the pair shares a token within the
    first ``lx - ceil(t*lx/(2-t)) + 1`` of each side.
    """
    t = threshold / 100.0
    longest = F.floor(F.col("len") * F.lit((2.0 - t) / t) + F.lit(1e-9)).cast("int")
    shortest = F.ceil(F.col("len") * F.lit(t / (2.0 - t)) - F.lit(1e-9)).cast("int")
    # Strings that can be part of such a pair, as the shorter or as the longer one.
    concerned = (F.exists(F.sequence(F.col("len"), longest), lambda x: ~by_segments(
        F.col("len"), allowed_edits(F.col("len"), x, threshold)))
        | F.exists(F.sequence(shortest, F.col("len")), lambda x: ~by_segments(x, allowed_edits(x, F.col("len"), threshold))))
    # (character, occurrence) tokens: the k-th 'o' of a string is token 'o#k'.
    toks = (nodes.filter(concerned).select("maker", "pos", "len", F.posexplode(F.split("s", "")).alias("i", "ch"))
            .filter(F.col("ch") != ""))
    toks = toks.withColumn("occ", F.row_number().over(
        Window.partitionBy("maker", "pos", "ch").orderBy("i")))
    toks = toks.withColumn("tok", F.concat_ws("#", "ch", F.col("occ").cast("string")))
    freq = toks.groupBy("maker", "tok").agg(F.count(F.lit(1)).alias("df"))
    toks = toks.join(freq, ["maker", "tok"], "inner")
    order = Window.partitionBy("maker", "pos").orderBy("df", "tok")
    alpha = F.ceil(F.lit(t) * F.col("len") / F.lit(2.0 - t) - F.lit(1e-9))
    prefix = (toks.withColumn("rk", F.row_number().over(order))
              .filter(F.col("rk") <= F.col("len") - alpha + 1)
              .select("maker", "tok", "pos", "len"))
    a, b = prefix.alias("a"), prefix.alias("b")
    short, long = F.least("a.len", "b.len"), F.greatest("a.len", "b.len")
    return (a.join(b, (F.col("a.maker") == F.col("b.maker")) & (F.col("a.tok") == F.col("b.tok"))
                   & (F.col("a.pos") < F.col("b.pos"))
                   # LCS <= min length, so the lengths already decide most pairs.
                   & (F.lit(200.0) * short >= F.lit(float(threshold)) * (short + long))
                   & ~by_segments(short, allowed_edits(short, long, threshold)))
            .select(F.col("a.maker").alias("maker"), F.col("a.pos").alias("pos_a"),
                    F.col("b.pos").alias("pos_b"), F.col("a.len").alias("len_a"),
                    F.col("b.len").alias("len_b"))
            .distinct())


def needs_characters(threshold: float) -> bool:
    """Can a pair have as many edits as the shorter string has characters? It is longest against a partner of
    ``l * (2 - t) / t``, where ``d <= 2 l (1 - t) / t``: below ``l`` from two thirds on."""
    return threshold * 3.0 <= 200.0


def fuzzy_candidates(nodes: DataFrame, threshold: float) -> DataFrame:
    """Every pair of ``nodes`` (maker, pos, s, len) that can reach the threshold, and few others."""
    found = segment_candidates(nodes, threshold)
    return found.unionByName(character_candidates(nodes, threshold)) if needs_characters(threshold) else found


def _nodes(series: DataFrame) -> DataFrame:
    return _positions(series).withColumn("s", token_sort("series")).withColumn("len", F.length("s"))


def fuzzy_pairs(series: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Pairs (maker, series_a < series_b) with token_sort_ratio >= threshold (above 0).

    An exact segment index gives the candidates instead of all pairs (``segment_candidates``); the LCS
    is computed for what the built-in edit distance leaves of them.
    """
    threshold = float(threshold)
    t = threshold / 100.0
    nodes = _nodes(series)
    cand = fuzzy_candidates(nodes, threshold)
    na = nodes.select("maker", F.col("pos").alias("pos_a"), F.col("series").alias("series_a"),
                      F.col("s").alias("s_a"))
    nb = nodes.select("maker", F.col("pos").alias("pos_b"), F.col("series").alias("series_b"),
                      F.col("s").alias("s_b"))
    pairs = cand.join(na, ["maker", "pos_a"]).join(nb, ["maker", "pos_b"])
    # la + lb - 2 LCS is the insert/delete distance, and the edit distance never exceeds it: the
    # built-in levenshtein rejects nearly all candidates before the LCS, without losing a pair.
    pairs = pairs.filter(F.levenshtein("s_a", "s_b") <= F.lit(1.0 - t) * (F.col("len_a") + F.col("len_b")) + F.lit(1e-9))
    pairs = pairs.withColumn("lcs", lcs_length("s_a", "s_b"))
    pairs = pairs.filter(ratio_at_least(F.col("lcs"), F.col("len_a"), F.col("len_b"), threshold))
    total = F.col("len_a") + F.col("len_b")
    return pairs.select("maker", "pos_a", "pos_b", "series_a", "series_b",
                        F.when(total == 0, F.lit(100.0))
                        .otherwise(F.lit(200.0) * F.col("lcs") / total).alias("ratio"))


def greedy_clusters(series: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                    checkpoint_every: int = 5) -> DataFrame:
    """Greedy leader clustering of similar series within each maker.

    Series are visited in sorted order; an unused series becomes a leader and
    takes every later unused series within the threshold. Equivalently, a
    series is a *leader* when no earlier neighbour is a leader, and otherwise
    belongs to its earliest leader neighbour. This is solved as a fixed point
    over the J4 edges: each round decides every series whose earlier
    neighbours are decided enough (one join + one aggregation over edges);
    rounds are bounded by the longest chain of dependent decisions. Lineage
    is cut with a reliable ``checkpoint`` every few rounds.

    Returns (maker, canonical, series): canonical is the cluster leader.
    """
    ensure_checkpoint_dir(series.sparkSession)
    nodes = _positions(series).checkpoint()
    edges = fuzzy_pairs(nodes, threshold).select("maker", "pos_a", "pos_b").checkpoint()
    # status: 0 unknown, 1 leader, 2 member
    state = nodes.select("maker", "pos", F.lit(0).alias("status"),
                         F.lit(None).cast("int").alias("leader"))
    rnd = 0
    while True:     # every round decides at least the first undecided series of each maker
        rnd += 1
        undecided = state.filter("status = 0")
        ev = (edges.join(state.select("maker", F.col("pos").alias("pos_a"),
                                      F.col("status").alias("st_a")), ["maker", "pos_a"])
              .join(undecided.select("maker", F.col("pos").alias("pos_b")), ["maker", "pos_b"]))
        agg = ev.groupBy("maker", "pos_b").agg(
            F.min(F.when(F.col("st_a") == 0, F.col("pos_a"))).alias("min_unknown"),
            F.min(F.when(F.col("st_a") == 1, F.col("pos_a"))).alias("min_leader"))
        upd = state.join(agg.withColumnRenamed("pos_b", "pos"), ["maker", "pos"], "left")
        is_member = (F.col("min_leader").isNotNull()
                     & (F.col("min_unknown").isNull() | (F.col("min_unknown") > F.col("min_leader"))))
        is_leader = F.col("min_leader").isNull() & F.col("min_unknown").isNull()
        new_status = (F.when(F.col("status") != 0, F.col("status"))
                      .when(is_member, F.lit(2)).when(is_leader, F.lit(1)).otherwise(F.lit(0)))
        new_leader = (F.when(F.col("status") != 0, F.col("leader"))
                      .when(is_member, F.col("min_leader")).when(is_leader, F.col("pos")))
        prev = state
        state = upd.select("maker", "pos", new_status.alias("status"), new_leader.alias("leader"))
        if rnd % checkpoint_every == 0:
            state = state.checkpoint()
        else:
            state = state.cache()
        done = state.filter("status = 0").limit(1).count() == 0
        prev.unpersist()
        if done:
            break
    names = nodes.select("maker", "pos", "series")
    leaders = nodes.select("maker", F.col("pos").alias("leader"), F.col("series").alias("canonical"))
    found = state.join(names, ["maker", "pos"]).join(leaders, ["maker", "leader"]).select("maker", "canonical", "series")
    path = scratch_path(series.sparkSession, "series-clusters")
    found.write.parquet(path)
    state.unpersist()
    return series.sparkSession.read.schema(found.schema).parquet(path)


def series_choices(catalog: DataFrame) -> DataFrame:
    """Series offered for a (maker, family).

    Series equal to the family, to the upper-cased family, or ``STANDARD`` are
    hidden unless the family has only one series, or nothing would be left.
    ``auto_selected`` is true when exactly one series is shown.
    """
    s = catalog.select("maker", "family", "series").distinct()
    redundant = ((F.col("series") == F.col("family")) | (F.col("series") == F.upper("family"))
                 | (F.col("series") == F.lit("STANDARD")))
    s = s.withColumn("_keep", ~redundant)
    counts = s.groupBy("maker", "family").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if("_keep").alias("n_keep"))
    j = s.join(counts, ["maker", "family"])
    shown = j.filter((F.col("n_all") == 1) | (F.col("n_keep") == 0) | F.col("_keep"))
    n_shown = F.when((F.col("n_all") == 1) | (F.col("n_keep") == 0), F.col("n_all")).otherwise(F.col("n_keep"))
    return shown.select("maker", "family", "series", (n_shown == 1).alias("auto_selected"))
