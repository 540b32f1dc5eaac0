"""N-grams of content words; they never cross documents."""

from pyspark.sql import DataFrame, functions as F

from wordloom.functions import text as T
from wordloom.functions.rows import explode_rows
from wordloom.operators.corpus import filter_class


def _tokens(df: DataFrame, text: str, include_stopwords: bool, class_name: str, label: str | None) -> DataFrame:
    chosen = df if label is None else filter_class(df, class_name, label=label)
    return chosen.select(T.tokenize(F.col(text), include_stopwords).alias("tokens"))


def _counts(tokens: DataFrame, n: int) -> DataFrame:
    grams = explode_rows(tokens, T.ngrams(F.col("tokens"), n), "ngram")
    return grams.groupBy("ngram").agg(F.count("*").alias("frequency"))


def _order(n: int) -> int:
    return max(1, min(5, n))


def ngram_counts(df: DataFrame, n: int = 2, text: str = "text", include_stopwords: bool = False,
                 class_name: str = "all", label: str | None = None) -> DataFrame:
    """Every n-gram with its frequency."""
    return _counts(_tokens(df, text, include_stopwords, class_name, label), _order(n))


def ngrams(df: DataFrame, n: int = 2, top_n: int = 25, **options) -> DataFrame:
    """The most frequent n-grams."""
    counts = ngram_counts(df, n, **options)
    return counts.orderBy(F.desc("frequency"), "ngram").limit(max(1, top_n))


def ngram_summary(df: DataFrame, n: int = 2, text: str = "text", include_stopwords: bool = False,
                  class_name: str = "all", label: str | None = None) -> DataFrame:
    """Total and distinct n-grams, and documents with at least one token."""
    n = _order(n)
    tokens = _tokens(df, text, include_stopwords, class_name, label)
    documents = tokens.agg(F.count_if(F.size("tokens") > 0).alias("n_documents"))
    grams = _counts(tokens, n).agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_ngrams"),
                                   F.count("*").alias("unique_ngrams"))
    return grams.select(F.lit(n).cast("bigint").alias("n"), "total_ngrams", "unique_ngrams",
                        documents.scalar().alias("n_documents"))


def ngram_share(df: DataFrame, n: int = 2, top_n: int = 25, **options) -> DataFrame:
    """The most frequent n-grams with their share of all n-grams in %."""
    counts = ngram_counts(df, n, **options)
    total = counts.agg(F.sum("frequency").alias("total"))
    top = counts.orderBy(F.desc("frequency"), "ngram").limit(max(1, top_n))
    return top.select("ngram", "frequency", F.round(100.0 * F.col("frequency") / total.scalar(), 6).alias("share_pct"))
