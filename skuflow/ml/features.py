"""Feature engineering (M1-M6, J9): relational twins and spark.ml stages.

Relational twins compute exactly what the vectoriser computes, as joins and
aggregations, so they can be checked by SQL:

* vocabulary (M1): document frequency and corpus frequency per term with one
  ``groupBy``; ``min_df`` / ``max_df`` filters; the ``max_features`` most
  frequent terms (ties by term) as a bounded top-k.
* weights (M2): raw term counts x smoothed IDF ``ln((1+n)/(1+df)) + 1``,
  L2-normalised, all inside the document's row.

The spark.ml path uses ``RegexTokenizer`` -> ``NGram`` -> ``Vocabulary``
-> ``SmoothedIDF`` -> ``Normalizer`` and keeps vectors sparse throughout.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import (Bucketizer, CountVectorizerModel, ElementwiseProduct, IDF, NGram, Normalizer,
                                OneHotEncoder, RegexTokenizer, SQLTransformer, StringIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.functions.text import TOKEN_PATTERN, strip_accents, tokenize, with_bigrams

INFREQUENT = "__infrequent__"


# --------------------------------------------------------------------------- relational twins
def doc_terms(docs: DataFrame, text: str, keep=(), bigrams: bool = True, accents: bool = False) -> DataFrame:
    """Columns ``keep`` plus ``terms``, the row's uni- and optionally bigrams in order (no shuffle)."""
    src = strip_accents(text) if accents else F.col(text)
    toks = docs.select(*keep, tokenize(src).alias("__tk"))
    return toks.select(*keep, (with_bigrams("__tk") if bigrams else F.col("__tk")).alias("terms"))


def tfidf_vocabulary(terms: DataFrame, min_df: float = 2, max_df: float = 0.9,
                     max_features: int = 5000) -> DataFrame:
    """M1: (term, df, tf, index) of the kept vocabulary; index follows term order.

    ``min_df``/``max_df`` are absolute counts when >= 1 and proportions of the number of documents
    otherwise. A row's terms are sorted in the row, so the first of each run counts for the
    document frequency: one aggregation with map-side sums gives both frequencies, and no
    (document, term) pair is shuffled.
    """
    rows = terms.select(F.array_sort("terms").alias("t"))
    runs = F.transform("t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (x != F.get("t", i - 1))).alias("new")))
    stats = (rows.select(F.explode(runs).alias("x")).groupBy("x.term")
             .agg(F.count_if("x.new").alias("df"), F.count(F.lit(1)).alias("tf")))
    if min_df < 1 or max_df <= 1:
        n = terms.agg(F.count(F.lit(1))).scalar()
    lo = F.lit(min_df) if min_df >= 1 else F.lit(min_df) * n
    hi = F.lit(max_df) * n if max_df <= 1 else F.lit(max_df)
    kept = stats.filter((F.col("df") >= lo) & (F.col("df") <= hi))
    kept = kept.orderBy(F.col("tf").desc(), F.col("term").asc()).limit(max_features)
    from pyspark.sql import Window
    # At most max_features rows: a global ordered window is small.
    return kept.withColumn("index", F.row_number().over(Window.orderBy("term")) - 1)


def vocabulary_model(vocab: DataFrame) -> CountVectorizerModel | None:
    """Counts of the vocabulary's terms in ``terms``, in the row (None: no terms). The vocabulary is capped (M1) and computed once."""
    found = vocab.select("term", "index").collect()
    if not found:
        return None
    found.sort(key=lambda r: r["index"])
    return CountVectorizerModel.from_vocabulary([r["term"] for r in found], inputCol="terms", outputCol="__tf")


def tfidf_weights(terms: DataFrame, vocab: DataFrame, doc_id: str) -> DataFrame:
    """M2: (doc_id, term, weight) with smoothed IDF and per-document L2 norm; J9 lookup inside.

    Lookup, weighting and norm happen in the document's row; nothing is shuffled.
    """
    n = terms.count()
    found = vocab.select("term", "df", "index").orderBy("index").collect()
    if not found:
        return terms.select(doc_id, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    model = CountVectorizerModel.from_vocabulary([r["term"] for r in found], inputCol="terms", outputCol="__tf")
    scale = ElementwiseProduct(scalingVec=DenseVector(np.log((1.0 + n) / (1.0 + np.array(
        [r["df"] for r in found], float))) + 1.0), inputCol="__tf", outputCol="__w")
    rows = Normalizer(inputCol="__w", outputCol="__v", p=2.0).transform(scale.transform(model.transform(terms)))
    words = F.array(*[F.lit(r["term"]) for r in found])
    long = rows.select(doc_id, F.posexplode(vector_to_array("__v")).alias("__i", "weight")).filter("weight <> 0")
    return long.select(doc_id, F.get(words, F.col("__i")).alias("term"), "weight")


def in_vocabulary_counts(terms: DataFrame, vocab: DataFrame, doc_id: str) -> DataFrame:
    """Per document, how many term occurrences are in the vocabulary (unknown terms ignored)."""
    model = vocabulary_model(vocab)
    if model is None:
        return terms.select(doc_id, F.lit(0).cast("long").alias("known_terms"),
                            F.lit(0).cast("long").alias("known_distinct")).limit(0)
    counted = model.transform(terms).select(doc_id, vector_to_array("__tf").alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x)
    return counted.select(doc_id, total.cast("long").alias("known_terms"),
                          F.size(F.filter("c", lambda x: x > 0)).cast("long").alias("known_distinct")
                          ).filter("known_distinct > 0")


def label_index(labels: DataFrame, label: str = "referencia") -> DataFrame:
    """M4: (label, index) with labels in sorted order (index = rank - 1)."""
    from pyspark.sql import Window
    d = labels.select(label).distinct()
    # One row per class; the class set is bounded (it is the classifier's output layer).
    return d.withColumn("index", F.row_number().over(Window.orderBy(label)) - 1)


def category_mapping(df: DataFrame, columns, min_frequency: int = 2) -> DataFrame:
    """M3: (feature, category, index): frequent categories sorted, the infrequent bucket last."""
    from pyspark.sql import Window
    parts = []
    for c in columns:
        counts = df.groupBy(F.col(c).alias("category")).agg(F.count(F.lit(1)).alias("n"))
        cat = F.when(F.col("n") >= min_frequency, F.col("category")).otherwise(F.lit(INFREQUENT))
        cats = counts.select(cat.alias("category")).distinct()
        order = Window.orderBy((F.col("category") == INFREQUENT).asc(), F.col("category").asc())
        parts.append(cats.withColumn("index", F.row_number().over(order) - 1)
                     .withColumn("feature", F.lit(c)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("feature", "category", "index")


# --------------------------------------------------------------------------- spark.ml stages
class Vocabulary(Estimator):
    """M1 as a stage: the built-in count model of the most frequent terms, fitted by ``tfidf_vocabulary``.

    Spark's ``CountVectorizer`` keeps all terms of all rows in memory or on disk while it fits; this one
    streams them through one aggregation.
    """

    def __init__(self, input_col: str, output_col: str, size: int, min_df: float, max_df: float):
        super().__init__()
        self.input_col, self.output_col, self.size, self.min_df, self.max_df = input_col, output_col, size, min_df, max_df

    def _fit(self, dataset):
        terms = dataset.select(F.col(self.input_col).alias("terms"))
        found = tfidf_vocabulary(terms, self.min_df, self.max_df, self.size).select("term", "tf").collect()
        words = [r["term"] for r in sorted(found, key=lambda r: (-r["tf"], r["term"]))]
        if not words:
            raise ValueError("no term is in enough documents and in few enough")
        return CountVectorizerModel.from_vocabulary(words, inputCol=self.input_col, outputCol=self.output_col)


class SmoothedIDF(Estimator, HasInputCol, HasOutputCol):
    """Smoothed IDF ``ln((n+1)/(df+1)) + 1`` (the public vectoriser default).

    Spark's ``IDF`` omits the ``+ 1``; this estimator fits ``IDF`` and returns
    a built-in ``ElementwiseProduct`` with ``idf + 1`` as scaling vector, so
    the fitted pipeline stays a plain, persistable ``PipelineModel``.
    """

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        model = IDF(inputCol=self.getInputCol(), outputCol="__idf_tmp").fit(dataset)
        scale = DenseVector(np.asarray(model.idf.toArray()) + 1.0)
        return ElementwiseProduct(scalingVec=scale, inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def text_feature_stages(text_col: str, prefix: str = "txt", vocab_size: int = 5000,
                        min_df: float = 2.0, max_df: float = 0.9, bigrams: bool = True,
                        accents: bool = False) -> list:
    """Tokenise -> (uni+bi)grams -> counts -> smoothed TF-IDF -> L2 (M1/M2 inside a Pipeline)."""
    stages = []
    src = text_col
    if accents:
        stages.append(SQLTransformer(statement=(
            f"SELECT *, translate(`{text_col}`, '{_accent_from()}', '{_accent_to()}') AS {prefix}_plain "
            "FROM __THIS__")))
        src = f"{prefix}_plain"
    stages.append(RegexTokenizer(inputCol=src, outputCol=f"{prefix}_uni", pattern=TOKEN_PATTERN,
                                 gaps=False, toLowercase=True, minTokenLength=1))
    terms = f"{prefix}_uni"
    if bigrams:
        stages.append(NGram(n=2, inputCol=f"{prefix}_uni", outputCol=f"{prefix}_bi"))
        stages.append(SQLTransformer(statement=(
            f"SELECT *, concat({prefix}_uni, {prefix}_bi) AS {prefix}_terms FROM __THIS__")))
        terms = f"{prefix}_terms"
    stages.append(Vocabulary(terms, f"{prefix}_tf", vocab_size, min_df, max_df))
    stages.append(SmoothedIDF(inputCol=f"{prefix}_tf", outputCol=f"{prefix}_tfidf"))
    stages.append(Normalizer(inputCol=f"{prefix}_tfidf", outputCol=f"{prefix}_features", p=2.0))
    return stages


def _accent_from() -> str:
    from skuflow.functions.text import _ACCENTED
    return _ACCENTED


def _accent_to() -> str:
    from skuflow.functions.text import _FOLDED
    return _FOLDED


class CategoryEncoder(Estimator):
    """M3 as one fitted stage: one-hot vectors in which rare categories share a column.

    Categories are indexed by falling frequency, so those seen fewer than ``min_frequency`` times
    are the tail of the index range and one ``Bucketizer`` bucket; unseen and null values get a
    last bucket that the encoder drops, i.e. the all-zero vector. The fitted model consists of
    built-in stages, holds the grouping of the rows it was fitted on and is saved with the pipeline.
    """

    def __init__(self, columns, prefix: str = "cat", min_frequency: int = 2):
        super().__init__()
        self.columns, self.prefix, self.min_frequency = list(columns), prefix, min_frequency

    def _fit(self, dataset):
        stages = []
        for c in self.columns:
            name = f"{self.prefix}_{c}"
            index = StringIndexer(inputCol=c, outputCol=f"{name}_idx", handleInvalid="keep",
                                  stringOrderType="frequencyDesc").fit(dataset)
            often = dataset.filter(F.col(c).isNotNull()).groupBy(c).count().filter(
                F.col("count") >= self.min_frequency).count()
            n = len(index.labels)
            cuts = [float(i) for i in range(often + 1)] + ([float(n)] if n > often else []) + [float("inf")]
            if len(cuts) < 3:
                cuts = [-1.0, *cuts]
            bucket = Bucketizer(inputCol=f"{name}_idx", outputCol=f"{name}_bucket", splits=cuts)
            one_hot = OneHotEncoder(inputCol=f"{name}_bucket", outputCol=f"{name}_vec", dropLast=True)
            stages += [index, bucket, one_hot.fit(bucket.transform(index.transform(dataset.limit(0))))]
        return PipelineModel(stages=stages)


def categorical_stages(columns, prefix: str = "cat") -> list:
    """M3 for a Pipeline (columns ``<prefix>_<column>_vec``)."""
    return [CategoryEncoder(columns, prefix)]


def label_stage(label: str = "referencia", output: str = "label") -> StringIndexer:
    """M4: sorted label encoding (inverse with ``IndexToString``)."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc",
                         handleInvalid="error")


def feature_pipeline(text_col: str, vocab_size: int = 5000, categorical=None, accents: bool = False,
                     bigrams: bool = True, min_df: float = 2.0, max_df: float = 0.9) -> Pipeline:
    """Text (+ optional categorical) features assembled into ``features`` (M5)."""
    from pyspark.ml.feature import VectorAssembler
    stages = text_feature_stages(text_col, "txt", vocab_size, min_df, max_df, bigrams, accents)
    inputs = ["txt_features"]
    if categorical:
        stages += categorical_stages(categorical)
        inputs = [f"cat_{c}_vec" for c in categorical] + inputs
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages)
