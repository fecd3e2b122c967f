"""Language identification by interpolated Kneser-Ney character models (operator 10).

Texts are lower-cased, everything that is not a letter becomes one blank, and characters are
predicted from the three before them. Counts of all four-character grams of all training texts
are made in one distributed aggregation; continuation counts of the shorter grams, the discounts
and the number of continuations of each context follow from it. The model keeps, per order, one
array of gram hashes sorted by hash with the log-probabilities of all languages beside it, and
one such array of contexts with their back-off weights. A text gets the language of the lowest
cross-entropy per character.

Rejection is calibrated on all training texts: a text whose cross-entropy is above the
``QUANTILE`` of the training texts that got the same language is rejected (``rejected``), and its
score falls in proportion.

The model is bounded by a rule on shares, which reads the same at every size: of an order, a language
keeps the grams that are at least ``LEAST_SHARE`` of its grams, so at most 1 / ``LEAST_SHARE`` of them.
Counts, discounts and context totals are taken over all grams before, and what the dropped grams of a
context had goes to its back-off weight, so that probabilities still sum to one. Characters above U+FFFF
count as one character.

Defined cases: null text or text without a letter: ``und``, score 0; without training texts every
text is ``und``; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.llm.common import slices, staged, table, with_text_columns

ORDER = 4                   # 16 bits per character: a gram of four fits 64 bits
LEAST_SHARE = 2.0 ** -18
QUANTILE = 0.995
SLICE_BYTES = 3 << 20
BLANK, START = 32, 1
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(four-character grams of all texts, row of each, number of letters per row).

    A text is preceded by three start marks; every other character ends one gram.
    """
    pad = ORDER - 1
    plain = [(t or b"").decode().lower() for t in texts]
    sizes = np.array([len(t) + pad for t in plain], np.int64)
    joined = np.frombuffer(("\x01" * pad + ("\x01" * pad).join(plain)).encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    row = np.repeat(np.arange(len(plain)), sizes)
    mark = np.zeros(len(joined), bool)
    for k in range(pad):
        mark[starts + k] = True
    letter = letters()[joined] & ~mark
    count = np.add.reduceat(letter, starts, dtype=np.int64) if len(plain) else np.zeros(0, np.int64)
    code = np.where(letter, np.minimum(joined, 0xFFFF), BLANK).astype(np.uint64)
    code[mark] = START
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != BLANK) | (code[:-1] != BLANK)
    code, row, mark = code[keep], row[keep], mark[keep]
    gram = code.copy()
    for k in range(1, ORDER):
        gram[k:] |= code[:-k] << np.uint64(16 * k)
    return gram[~mark], row[~mark], count


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class HashArray:
    """Keys sorted by hash, found through an index of the hashes' top bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        h = mix(keys)
        order = np.argsort(h)
        self.hash, self.values = h[order], np.ascontiguousarray(values[order])
        bits = max(1, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        marks = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(self.hash, marks).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 if absent."""
        at = np.full(len(keys), -1, np.int64)
        if not len(self.hash):
            return at
        h = mix(keys)
        spot = self.first[(h >> self.shift).astype(np.int64)]
        todo = None
        last = len(self.hash) - 1
        while True:
            there = self.hash[np.minimum(spot, last)]
            hit = (there == h) & (spot <= last)
            if todo is None:
                at[hit] = spot[hit]
                more = np.flatnonzero(~hit & (there < h) & (spot <= last))
                todo = more
            else:
                at[todo[hit]] = spot[hit]
                more = np.flatnonzero(~hit & (there < h) & (spot <= last))
                todo = todo[more]
            if not len(more):
                return at
            h, spot = h[more], spot[more] + 1


class Model:
    """Interpolated Kneser-Ney models of all languages side by side."""

    def __init__(self, languages: list[str], tables: dict[int, tuple], contexts: dict[int, tuple],
                 alphabet: int) -> None:
        """tables[order]: (language number, gram, discounted count / context total); contexts[order]:
        (language number, context, back-off weight)."""
        self.languages = languages
        self.floor = np.full(len(languages), -np.log(max(alphabet, 2)), np.float64)
        self.probability: dict[int, HashArray] = {}
        self.backoff: dict[int, HashArray] = {}
        for order in range(1, ORDER + 1):
            lang, context, weight = contexts[order]
            keys, at = np.unique(context, return_inverse=True)
            dense = np.zeros((len(keys), len(languages)))
            dense[at, lang] = np.log(np.maximum(weight, 1e-300))
            self.backoff[order] = HashArray(keys, dense)
            lang, gram, share = tables[order]
            keys, at = np.unique(gram, return_inverse=True)
            dense = np.zeros((len(keys), len(languages)))
            dense[at, lang] = share
            lower = np.exp(self._back(order, keys))
            self.probability[order] = HashArray(keys, np.log(np.maximum(dense + lower, 1e-300)).astype(np.float32))

    def _back(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Log of the back-off weight times the shorter gram's probability."""
        context = keys >> np.uint64(16) if order > 1 else np.zeros(len(keys), np.uint64)
        table = self.backoff[order]
        at = table.find(context)
        weight = np.zeros((len(keys), len(self.languages)))
        weight[at >= 0] = table.values[at[at >= 0]]
        if order == 1:
            return weight + self.floor
        return weight + self.log_probability(order - 1, keys & np.uint64((1 << 16 * (order - 1)) - 1))

    def log_probability(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Rows: log-probability of the gram's last character in each language."""
        if not len(keys):
            return np.zeros((0, len(self.languages)), np.float32)
        table = self.probability[order]
        at = table.find(keys)
        out = table.values[np.maximum(at, 0)] if len(table.hash) else np.zeros(
            (len(keys), len(self.languages)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            out[miss] = self._back(order, keys[miss])
        return out

    def cross_entropy(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per character and language, characters, letters) of each text."""
        gram, row, letter = grams(texts)
        total = np.zeros((len(texts), len(self.languages)))
        n = np.bincount(row, minlength=len(texts))
        if len(gram):
            there = np.flatnonzero(n)
            first = np.concatenate([[0], np.cumsum(n[there])[:-1]])
            for lo in range(0, len(gram), 1 << 20):     # bounded working memory
                hi = min(lo + (1 << 20), len(gram))
                values = self.log_probability(ORDER, gram[lo:hi])
                a = np.searchsorted(first, lo, side="right") - 1
                b = np.searchsorted(first, hi, side="left")
                cuts = np.maximum(first[a:b], lo) - lo
                for k in range(values.shape[1]):
                    total[there[a:b], k] += np.add.reduceat(values[:, k], cuts, dtype=np.float64)
        return -total / np.maximum(n, 1)[:, None], n, letter


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows of ``docs``."""
    src = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text"))
    schema = "lang string, gram bigint, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, body = (c.to_pylist() for c in batch.columns)
            for lo, hi in slices([len(x or b"") for x in body], SLICE_BYTES):
                part = names[lo:hi]
                known = sorted(set(part))
                number = np.array([known.index(x) for x in part], np.int64)
                gram, row, _ = grams(body[lo:hi])
                of = number[row]
                for k, name in enumerate(known):
                    value, n = np.unique(gram[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(value), pa.string()), pa.array(value.view(np.int64)),
                         pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return src.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", least_share: float = LEAST_SHARE) -> Model | None:
    """The models of all languages in ``docs`` (null languages are left out); None without rows."""
    counts = {ORDER: staged(count_grams(docs.where(F.col(lang).isNotNull()), text, lang), "language-grams")}
    for order in range(ORDER - 1, 0, -1):       # continuation counts: distinct characters before a gram
        counts[order] = staged(counts[order + 1].groupBy(
            "lang", F.col("gram").bitwiseAND((1 << 16 * order) - 1).alias("gram")).agg(
            F.count("*").alias("n")), "language-grams")
    languages = sorted(r.lang for r in counts[1].select("lang").distinct().collect())
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    alphabet = counts[1].select("gram").distinct().count() + 1
    tables, contexts = {}, {}
    for order, rows in counts.items():
        # Discount n1 / (n1 + 2 n2), and the least count that a gram is kept with: one row a language.
        discount, least = {}, {}
        for r in rows.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"),
                                          F.sum("n").alias("total")).collect():
            discount[r.lang] = r.ones / (r.ones + 2 * r.twos) if r.ones else 0.5
            least[r.lang] = least_share * r.total
        context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")
        heads = rows.groupBy("lang", context.alias("context")).agg(F.sum("n").alias("total"))
        cut = F.create_map(*[F.lit(v) for pair in least.items() for v in pair])
        rate = F.create_map(*[F.lit(v) for pair in discount.items() for v in pair])
        share = staged(rows.where(F.col("n") >= cut[F.col("lang")]).withColumn("context", context).join(
            heads, ["lang", "context"]).select("lang", "gram", "context", (
                (F.col("n") - rate[F.col("lang")]) / F.col("total")).alias("value")), "language-shares")
        used = share.groupBy("lang", "context").agg((1 - F.sum("value")).alias("value"))
        for target, frame, key in ((tables, share, "gram"), (contexts, used, "context")):
            found = frame.toPandas()
            target[order] = (found["lang"].map(number).to_numpy(np.int64),
                             found[key].to_numpy(np.int64).view(np.uint64), found["value"].to_numpy(np.float64))
    return Model(languages, tables, contexts, alphabet)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus lang_pred, cross_entropy and posterior (of the language among all)."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("cross_entropy", T.DoubleType()),
              T.StructField("posterior", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def run(texts):
            if own is None:
                return [["und"] * len(texts), [None] * len(texts), [0.0] * len(texts)]
            entropy, n, letter = own.cross_entropy(texts)
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(len(best)), best]
            weight = np.exp(-(entropy - least[:, None]) * np.minimum(n, 100)[:, None])
            posterior = 1 / weight.sum(axis=1)
            ok = letter > 0
            return [[own.languages[b] if k else "und" for b, k in zip(best, ok)],
                    [float(v) if k else None for v, k in zip(least, ok)],
                    [float(v) if k else 0.0 for v, k in zip(posterior, ok)]]
        return run

    return with_text_columns(docs, text, fields, make, slice_bytes=SLICE_BYTES, keep=keep)


def identify(docs: DataFrame, training, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",),
             least_share: float = LEAST_SHARE, quantile: float = QUANTILE) -> DataFrame:
    """Columns ``keep`` of every row plus lang_pred, score, cross_entropy and rejected.

    ``training`` is a condition on ``docs``; models and the calibration use only rows where it holds.
    """
    model = train(docs.where(training), text, lang, least_share)
    src = docs.withColumn("__llm_train", training & F.col(lang).isNotNull())
    found = staged(score(src, model, text, [*keep, "__llm_train"]), "language-scores")
    limits = found.where("__llm_train AND cross_entropy IS NOT NULL").groupBy("lang_pred").agg(
        F.percentile_approx("cross_entropy", quantile, 10_000).alias("limit"))
    # One row per language: the model's own languages bound this side.
    out = found.join(F.broadcast(limits), "lang_pred", "left")
    fit = F.least(F.lit(1.0), F.coalesce(F.col("limit") / F.greatest("cross_entropy", F.lit(1e-9)), F.lit(1.0)))
    return out.select(*keep, "lang_pred", (F.col("posterior") * fit).alias("score"), "cross_entropy",
                      F.coalesce(F.col("cross_entropy") > F.col("limit"), F.lit(True)).alias("rejected"))


def op10_language_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(4))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold == 2).alias("held_out"))
    return identify(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))


QUERIES = {"op10_language_kneser_ney": op10_language_kneser_ney}
ORACLES: dict[str, str] = {}
