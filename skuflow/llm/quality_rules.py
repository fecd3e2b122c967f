"""Quality rules: gradient-boosted trees over document statistics (operator 2).

Every document is reduced to a short vector of statistics in one pass over its whole text. Trees
are fitted by histogram gradient boosting on the logistic loss, with monotonic constraints on
chosen statistics (more symbols, more repeated lines or more repeated words can never raise the
score), then flattened into numpy arrays (feature, threshold, value per node) and applied to
whole batches of documents at once.

The fit uses a bounded sample of labelled documents: the ``SAMPLE`` labels with the smallest
hash of their id. Statistics and verdicts cover all documents. The verdict's threshold is
calibrated on folds that did not fit the trees, so that at most ``GOOD_LOSS`` of the good
documents fall below it.

Defined cases: a null text has no words; without labels of both classes the verdict is the base
rule alone; several labels of one id count as the lowest of them; a null label is ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuflow.llm.common import table, with_text_columns

SAMPLE = 16384
GOOD_LOSS = 0.005
BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistic -> sign of its allowed effect on the score (0: free).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_ratio": -1, "dup_line_ratio": -1,
    "repeat_ratio": -1, "distinct_ratio": 0, "upper_ratio": 0, "digit_ratio": 0,
    "bang_ratio": -1, "bar_ratio": -1, "stop_ratio": 0, "line_words": 0, "non_ascii_ratio": 0,
    "one_char_ratio": 0,
}
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = bytes(range(48, 58))
CONTINUATION = bytes(range(128, 192))


def _without(b: bytes, drop: bytes) -> int:
    return len(b) - len(b.translate(None, drop))


def repeated_words(w: list[bytes]) -> tuple[int, int]:
    """(words in 3-word windows that occur twice or more, distinct words)."""
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, len(w))
    m = len(ids)
    if len(w) < 4:
        return 0, m
    pair = a[:-1] * m + a[1:]
    if m > 2_000_000:           # keep the third factor within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * m + a[2:]
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0, m
    hit = np.flatnonzero(np.isin(key, twice))
    mark = np.zeros(len(w), bool)
    for k in range(3):
        mark[hit + k] = True
    return int(mark.sum()), m


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """Base statistics (BASE_FIELDS) and features (FEATURES) of one whole text."""
    b = text or b""
    w = b.split()               # ASCII white space only, on bytes
    n = len(w)
    points = len(b) - _without(b, CONTINUATION)
    chars = points - _without(b, SPACES)
    symbols = _without(b, SYMBOLS)
    lines = [x for x in b.split(b"\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat, distinct = repeated_words(w)
    upper, lower = _without(b, UPPER), _without(b, LOWER)
    per_char, per_word = 1 / max(chars, 1), 1 / max(n, 1)
    features = [
        np.log1p(n), chars * per_word, symbols * per_char, dup / max(len(lines), 1),
        repeat * per_word, distinct * per_word, upper / max(upper + lower, 1),
        _without(b, DIGIT) * per_char, b.count(b"!") * per_char, b.count(b"|") * per_char,
        sum(len(x) <= 3 for x in w) * per_word, n / max(len(lines), 1),
        (points - _without(b, bytes(range(128)))) * per_char if points else 0.0,
        sum(len(x) == 1 for x in w) * per_word,
    ]
    return [n, chars, symbols, dup, repeat], [float(x) for x in features]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


class Trees:
    """Boosted trees as node arrays in heap order: children of node i are 2i+1 and 2i+2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, bias: float,
                 depth: int, cut: float) -> None:
        self.feature, self.threshold, self.value = feature, threshold, value
        self.bias, self.depth, self.cut = bias, depth, cut

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
            at = 2 * at + 1 + right
        return self.bias + self.value[trees, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], signs: list[int],
          depth: int, rate: float, lam: float, least: float) -> tuple[np.ndarray, ...]:
    size = 2 ** (depth + 1) - 1
    feature, threshold = np.zeros(size, np.int64), np.full(size, np.inf)
    value = np.zeros(size)
    low, high = np.full(size, -np.inf), np.full(size, np.inf)
    rows: dict[int, np.ndarray] = {0: np.arange(len(g))}
    for node in range(size):
        if node not in rows:
            continue
        r = rows.pop(node)
        gs, hs = g[r].sum(), h[r].sum()
        value[node] = np.clip(-gs / (hs + lam), low[node], high[node])
        if 2 * node + 2 >= size:
            continue
        best = (1e-9, -1, 0, 0.0, 0.0)
        own = gs * value[node] + 0.5 * (hs + lam) * value[node] ** 2
        for f, e in enumerate(edges):
            if not len(e):
                continue
            gl = np.bincount(bins[r, f], g[r], len(e) + 1).cumsum()[:-1]
            hl = np.bincount(bins[r, f], h[r], len(e) + 1).cumsum()[:-1]
            gr, hr = gs - gl, hs - hl
            wl = np.clip(-gl / (hl + lam), low[node], high[node])
            wr = np.clip(-gr / (hr + lam), low[node], high[node])
            gain = own - gl * wl - 0.5 * (hl + lam) * wl ** 2 - gr * wr - 0.5 * (hr + lam) * wr ** 2
            gain[(hl < least) | (hr < least) | (signs[f] * (wr - wl) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k, wl[k], wr[k])
        _, f, k, wl, wr = best
        left, right = 2 * node + 1, 2 * node + 2
        if f < 0:                   # a leaf passes its rows on to the left, unchanged
            rows[left] = r
            low[left] = high[left] = value[node]
            continue
        feature[node], threshold[node] = f, edges[f][k]
        goes = bins[r, f] > k
        rows[left], rows[right] = r[~goes], r[goes]
        middle = (wl + wr) / 2
        low[left], high[left], low[right], high[right] = low[node], high[node], low[node], high[node]
        if signs[f] > 0:
            high[left] = low[right] = middle
        elif signs[f] < 0:
            low[left] = high[right] = middle
    return feature, threshold, rate * value


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3,
        rate: float = 0.15, bins: int = 32, lam: float = 1.0, least: float = 2.0) -> Trees:
    """Histogram gradient boosting with monotonic constraints (signs: -1, 0 or 1 per feature)."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    margin = np.full(len(y), bias := float(np.log(mean / (1 - mean))))
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        f, t, v = _grow(binned, p - y, p * (1 - p), edges, signs, depth, rate, lam, least)
        grown.append((f, t, v))
        margin += Trees(f[None], t[None], v[None], 0.0, depth, 0.0).margin(x)
    return Trees(*(np.stack(c) for c in zip(*grown)), bias, depth, 0.5)


def fit_calibrated(x: np.ndarray, y: np.ndarray, folds: int = 3, good_loss: float = GOOD_LOSS) -> Trees | None:
    """Trees on all rows; the cut comes from scores that each fold got from the other folds."""
    if len(y) == 0 or y.min() == y.max():
        return None
    signs = list(FEATURES.values())
    held = np.full(len(y), 1.0)
    for k in range(folds):
        out = np.arange(len(y)) % folds == k
        if out.any() and y[~out].size and y[~out].min() < y[~out].max():
            held[out] = fit(x[~out], y[~out], signs).score(x[out])
    model = fit(x, y, signs)
    model.cut = float(min(0.5, np.quantile(held[y == 1], good_loss)))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
                    text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled ids, those with the smallest hash."""
    chosen = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    picked = docs.select("doc_id", docs[text].alias("text")).join(F.broadcast(chosen), "doc_id")
    names = list(FEATURES)
    fields = [T.StructField(n, T.DoubleType()) for n in names]

    def make():
        return lambda texts: [list(c) for c in zip(*(statistics(t)[1] for t in texts))]

    rows = with_text_columns(picked, "text", fields, make, keep=["doc_id", "quality"])
    # One row per id, whatever the number of rows with that id: the sample stays bounded.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *names)).alias("r")).select("doc_id", "r.*")
    found = rows.toPandas().sort_values("doc_id")
    return found[names].to_numpy(np.float64), found["quality"].to_numpy(np.float64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    return fit_calibrated(*labelled_sample(docs, labels, sample))


def judge(docs: DataFrame, model: Trees | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus the base statistics, base_failed, score (null without a model) and kept."""
    fields = [T.StructField(n, T.LongType()) for n in BASE_FIELDS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()),
               T.StructField("kept", T.BooleanType())]

    def make():
        def run(texts):
            base, features = zip(*map(statistics, texts))
            failed = [base_failed(b[0], b[4]) for b in base]
            if model is None:
                score = [None] * len(base)
                kept = [not f for f in failed]
            else:
                s = model.score(np.array(features))
                score = s.tolist()
                kept = [not f and bool(v >= model.cut) for f, v in zip(failed, s)]
            return [*map(list, zip(*base)), failed, score, kept]
        return run

    return with_text_columns(docs, text, fields, make, keep=keep)


def op2_quality_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])


QUERIES = {"op2_quality_boosted_trees": op2_quality_boosted_trees}
ORACLES: dict[str, str] = {}
