"""Document features: long-form TF and TF-IDF, and vectors for MLlib."""

import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom.functions import text as T
from wordloom.functions.rows import explode_rows
from wordloom.operators.ranking import rank_by_frequency
from wordloom.operators.terms import looked_up, summed_terms
from wordloom.plans.storage import broadcast_if_small, drop_path, fits_broadcast, materialize, written

VOCABULARY_ROWS = 100_000  # of a broadcast vocabulary; its bytes are limited too


def _terms(max_n: int) -> Column:
    """All 1- to `max_n`-grams of the `_words` column."""
    return F.concat(*[T.ngrams(F.col("_words"), n) for n in range(1, max_n + 1)])


def term_counts(df: DataFrame, text: str = "text", id: str = "doc_id", max_n: int = 2) -> DataFrame:
    """(id, term, tf) over the 1- to `max_n`-grams of each document's words.

    The documents are partitioned by `id` first: their texts are shuffled once, (id, term) pairs are not.
    """
    words = df.select(id, text).repartition(id).select(id, T.word_terms(F.col(text)).alias("_words"))
    return explode_rows(words, _terms(max_n), "term", id).groupBy(id, "term").agg(F.count("*").alias("tf"))


def term_stats(df: DataFrame, text: str = "text", max_n: int = 2) -> DataFrame:
    """(term, doc_freq, total); a document gives its terms to `total` and its distinct terms to `doc_freq`."""
    return summed_terms(df, text, max_n).filter(F.col("term").isNotNull())


def fit_vocabulary(df: DataFrame, text: str = "text", id: str = "doc_id", max_n: int = 2, min_df: int = 2,
                   percent: float | None = 100.0, max_features: int | None = None) -> DataFrame:
    """(term, doc_freq, total, n_docs): the kept terms, written once so that transforms reuse them.

    The number of terms is `max_features`, or `percent` of the distinct single words but at least
    ten. The most frequent terms stay; among the terms as frequent as the last one, `rank_by_frequency` decides.
    """
    n_docs = df.agg(F.count("*").alias("n"))
    stats, path = written(summed_terms(df, text, max_n, min_df))
    kept = stats.filter(F.col("term").isNotNull())
    if max_features is None and percent is not None:
        single = stats.filter(F.col("term").isNull()).agg(F.sum("total")).first()[0] or 0
        max_features = max(10, int(single * (min(100.0, max(1.0, percent)) / 100.0)))
    if max_features is not None:
        above = F.coalesce(F.sum("terms").over(W.orderBy(F.desc("total")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        spectrum = kept.groupBy("total").agg(F.count("*").alias("terms")).withColumn("above", above)
        last = spectrum.filter(F.col("above") < max_features).orderBy("total").first()
        if last is None:
            kept = kept.limit(0)
        else:
            tied, room = kept.filter(F.col("total") == last["total"]), max_features - last["above"]
            if last["terms"] > room:
                tied = rank_by_frequency(tied, "term", "total").filter(F.col("rank") <= room).drop("rank")
            kept = kept.filter(F.col("total") > last["total"]).union(tied)
    vocabulary = materialize(kept.withColumn("n_docs", n_docs.scalar()))
    drop_path(df.sparkSession, path)
    return vocabulary


def tf_features(df: DataFrame, vocabulary: DataFrame, text: str = "text", id: str = "doc_id",
                max_n: int = 2) -> DataFrame:
    """(id, term, tf) over the fitted vocabulary, whose terms are unique."""
    terms = vocabulary.select("term")
    if not fits_broadcast(terms, VOCABULARY_ROWS):
        return looked_up(df, terms.withColumn("value", F.lit(0.0)), text, id, max_n).select(id, "term", "tf")
    return term_counts(df, text, id, max_n).join(F.broadcast(terms), "term").select(id, "term", "tf")


def tfidf_features(df: DataFrame, vocabulary: DataFrame, text: str = "text", id: str = "doc_id",
                   max_n: int = 2, sublinear: bool = False) -> DataFrame:
    """(id, term, weight): tf * (ln((1 + n) / (1 + df)) + 1), each document scaled to length 1."""
    idf = vocabulary.select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("doc_freq"))) + 1).alias("value"))
    tf = (1 + F.log("tf")) if sublinear else F.col("tf")
    if not fits_broadcast(idf, VOCABULARY_ROWS):
        raw = looked_up(df, idf, text, id, max_n, sublinear).withColumn("w", tf * F.col("value"))
        return raw.select(id, "term", F.round(F.col("w") / F.col("length"), 6).alias("weight"))
    raw = term_counts(df, text, id, max_n).join(F.broadcast(idf), "term").withColumn("w", tf * F.col("value"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(id)))
    return raw.select(id, "term", F.round(F.col("w") / length, 6).alias("weight"))


class TextVectors:
    """TF or TF-IDF vectors for MLlib, fitted on training rows.

    The vocabulary of a vector space sits in driver memory, as in every MLlib vectorizer, so it is
    bounded by `max_features`, or by `percent` of the number of distinct words (ten at least).
    """

    def __init__(self, tfidf: bool = True, max_n: int = 2, min_df: int = 2, max_features: int = 10_000,
                 text: str = "text", column: str = "features", percent: float | None = None):
        self.tfidf, self.max_n, self.min_df, self.percent = tfidf, max_n, min_df, percent
        self.max_features, self.text, self.column = max_features, text, column

    def _terms(self, df: DataFrame) -> DataFrame:
        with_words = df.withColumn("_words", T.word_terms(F.col(self.text)))
        return with_words.withColumn("_terms", _terms(self.max_n)).drop("_words")

    def fit(self, train: DataFrame) -> "TextVectors":
        size = self.max_features
        if self.percent is not None:
            words = explode_rows(train, T.word_terms(F.col(self.text)), "w").select("w").distinct().count()
            size = max(10, int(words * self.percent / 100))
        # one pass gives the vocabulary and, from its document frequencies, the idf
        kept = term_stats(train, self.text, self.max_n).filter(F.col("doc_freq") >= self.min_df)
        kept = kept.orderBy(F.desc("total"), "term").limit(size).select("term", "doc_freq").collect()
        if not kept:
            raise ValueError("the vocabulary is empty: lower min_df")
        self.counter = CountVectorizerModel.from_vocabulary([r.term for r in kept], inputCol="_terms", outputCol="_tf")
        if self.tfidf:
            n_docs = train.count()
            weights = [math.log((n_docs + 1.0) / (r.doc_freq + 1.0)) + 1.0 for r in kept]
            self.scale = ElementwiseProduct(scalingVec=weights, inputCol="_tf", outputCol="_w")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        counted = self.counter.transform(self._terms(df))
        if not self.tfidf:
            return counted.withColumnRenamed("_tf", self.column).drop("_terms")
        unit = Normalizer(p=2.0, inputCol="_w", outputCol=self.column)
        return unit.transform(self.scale.transform(counted)).drop("_terms", "_tf", "_w")

    @property
    def vocabulary_size(self) -> int:
        return len(self.counter.vocabulary)


class WordVectors:
    """Mean Word2Vec vector of a document's known tokens; zero where it has none.

    Training runs in `partitions` tasks, by default as many as the cluster runs at once. MLlib keeps the
    vocabulary of words seen `min_count` times on the driver.
    """

    def __init__(self, size: int = 100, window: int = 5, min_count: int = 2, epochs: int = 10, seed: int = 42,
                 partitions: int | None = None, text: str = "text", id: str = "doc_id", column: str = "features"):
        self.size, self.text, self.id, self.column, self.partitions = size, text, id, column, partitions
        self.estimator = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed,
                                  numPartitions=partitions or 1, inputCol="_tokens", outputCol="_v")

    def _tokens(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_tokens", T.space_tokens(F.col(self.text)))

    def fit(self, train: DataFrame) -> "WordVectors":
        if self.partitions is None:
            self.estimator.setNumPartitions(train.sparkSession.sparkContext.defaultParallelism)
        self.model = self.estimator.fit(self._tokens(train))
        self.vectors = materialize(self.model.getVectors().withColumnRenamed("word", "_token"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        tokens = explode_rows(self._tokens(df), F.col("_tokens"), "_token", self.id)
        known = tokens.join(broadcast_if_small(self.vectors, 50_000), "_token")
        means = known.groupBy(self.id).agg(Summarizer.mean(F.col("vector")).alias("_mean")).select(
            self.id, vector_to_array("_mean").alias("_mean"))
        zero = F.array_repeat(F.lit(0.0), self.size)
        joined = df.join(means, self.id, "left")
        return joined.withColumn(self.column, array_to_vector(F.coalesce("_mean", zero))).drop("_mean")

    @property
    def vocabulary_size(self) -> int:
        return self.vectors.count()


class Standardizer:
    """z-scores per dimension of a vector or array column, with the population deviation."""

    def __init__(self, column: str = "features"):
        self.column = column

    def _vector(self, df: DataFrame):
        is_array = dict(df.dtypes)[self.column].startswith("array")
        return array_to_vector(F.col(self.column).cast("array<double>")) if is_array else F.col(self.column)

    def fit(self, train: DataFrame) -> "Standardizer":
        moments = Summarizer.metrics("mean", "std", "count").summary(self._vector(train))
        row = train.select(moments.alias("m")).select("m.*").first()  # one vector per moment
        shrink = math.sqrt((row["count"] - 1) / row["count"]) if row["count"] > 0 else 1.0
        self.mean = [float(x) for x in row["mean"]]
        self.std = [float(x) * shrink or 1.0 for x in row["std"]]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        mean = F.array(*[F.lit(x) for x in self.mean])
        std = F.array(*[F.lit(x) for x in self.std])
        values = vector_to_array(self._vector(df))
        centered = F.zip_with(values, mean, lambda x, m: x - m)
        return df.withColumn(self.column, array_to_vector(F.zip_with(centered, std, lambda x, s: x / s)))


def standardize(train: DataFrame, df: DataFrame | None = None, column: str = "features") -> DataFrame:
    """Fit on `train` only; transform `df`, or `train` itself."""
    return Standardizer(column).fit(train).transform(train if df is None else df)


def vector_long(df: DataFrame, id: str, column: str = "features", name: str = "value") -> DataFrame:
    """(id, dim, value) rows of a vector column."""
    return df.select(id, F.posexplode(vector_to_array(F.col(column))).alias("dim", name)).withColumn(
        "dim", F.col("dim").cast("bigint"))
