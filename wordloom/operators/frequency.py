"""Word counts, Zipf ranks, vocabulary coverage and corpus overview.

Everything about ranks that does not name a word is computed from the frequency spectrum, the
number of words per frequency. Its size grows with the square root of the corpus, so ordering it in
one window is safe where ordering the vocabulary is not.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom.constants import LENGTH_BUCKETS
from wordloom.functions import text as T
from wordloom.functions.rows import explode_rows
from wordloom.operators.ranking import explode_range, rank_by_frequency, top_per_group
from wordloom.plans.storage import materialize


def _words(df: DataFrame, text: str, include_stopwords: bool, max_chars: int | None,
           max_tokens: int | None, *keep: str) -> DataFrame:
    body = F.col(text) if max_chars is None else T.truncate(F.col(text), max_chars)
    if max_tokens is not None:
        return explode_rows(df, T.tokenize(body, include_stopwords, max_tokens), "word", *keep)
    # Without a token cap the words are exploded first, so the filter joins the generated code.
    runs = F.regexp_extract_all(body, F.lit("[A-Za-z0-9]{3,}"), F.lit(0))
    words = explode_rows(df, runs, "word", *keep).withColumn("word", F.lower("word"))
    return words if include_stopwords else words.filter(~F.col("word").isin(sorted(T.STOPWORDS)))


def word_frequency(df: DataFrame, text: str = "text", include_stopwords: bool = False,
                   top_n: int | None = None, max_chars: int | None = None,
                   max_tokens: int | None = None) -> DataFrame:
    """(word, frequency). Whole texts and the whole vocabulary unless caps are passed."""
    counts = (_words(df, text, include_stopwords, max_chars, max_tokens)
              .groupBy("word").agg(F.count("*").alias("frequency")))
    return counts if top_n is None else counts.orderBy(F.desc("frequency"), "word").limit(top_n)


def word_frequency_by_class(df: DataFrame, label: str = "label", text: str = "text",
                            include_stopwords: bool = False, top_n: int | None = None) -> DataFrame:
    """(class_name, word, frequency) for every class and for `all`, from one scan."""
    labelled = df.withColumn(label, F.coalesce(F.col(label).cast("string"), F.lit("Unlabeled")))
    words = _words(labelled, text, include_stopwords, None, None, label)
    counts = (words.groupBy("word", label).agg(F.count("*").alias("n"))
              .groupingSets([["word", label], ["word"]], "word", label)
              .agg(F.sum("n").alias("frequency"), F.grouping(label).alias("_total")))
    named = counts.select(F.when(F.col("_total") == 1, "all").otherwise(F.col(label)).alias("class_name"),
                          "word", "frequency")
    if top_n is None:
        return named
    return top_per_group(named, ["class_name"], [F.desc("frequency"), F.col("word")], top_n)


def wordcloud_frequency(df: DataFrame, text: str = "text", include_stopwords: bool = False) -> DataFrame:
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    words = explode_rows(df, runs, "word")
    if not include_stopwords:
        words = words.filter(~F.col("word").isin(sorted(T.STOPWORDS)))
    return words.groupBy("word").agg(F.count("*").alias("frequency"))


def spectrum(freqs: DataFrame, frequency: str = "frequency") -> DataFrame:
    """Per distinct frequency: its words, and the words and tokens of all higher frequencies."""
    counts = freqs.groupBy(F.col(frequency).alias("frequency")).agg(F.count("*").alias("words"))
    higher = W.orderBy(F.desc("frequency")).rowsBetween(W.unboundedPreceding, -1)
    tokens = F.col("frequency") * F.col("words")
    return counts.select(
        "frequency", "words",
        F.coalesce(F.sum("words").over(higher), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum(tokens).over(higher), F.lit(0)).alias("tokens_before"),
        F.sum("words").over(W.partitionBy()).alias("vocabulary"),
        F.sum(tokens).over(W.partitionBy()).alias("tokens"))


def frequency_bands(freqs: DataFrame) -> DataFrame:
    """For each frequency in use, how many words reach it (the slider's stops)."""
    return spectrum(freqs).select(
        F.col("frequency").alias("min_frequency"), F.col("frequency").alias("max_frequency"),
        (F.col("words_before") + F.col("words")).alias("word_count"))


def zipf(df: DataFrame, text: str = "text", include_stopwords: bool = True,
         max_rank: int | None = None) -> DataFrame:
    """(rank, word, freq) by falling frequency."""
    freqs = materialize(word_frequency(df, text, include_stopwords, top_n=max_rank))  # ranking reads it three times
    return rank_by_frequency(freqs).select("rank", "word", F.col("frequency").alias("freq"))


def _ranks(runs: DataFrame, low: Column, high: Column) -> DataFrame:
    """One row per rank in [low, high] of a spectrum, with the tokens covered up to it."""
    first, last = F.col("words_before") + 1, F.col("words_before") + F.col("words")
    ranks = explode_range(runs, F.greatest(first, low), F.least(last, high), "rank", spread=True)
    seen = F.col("tokens_before") + F.col("frequency") * (F.col("rank") - F.col("words_before"))
    return ranks.withColumn("seen", seen)


def zipf_fit(freqs: DataFrame) -> DataFrame:
    """Least-squares line through log10(rank), log10(frequency) in the middle of the curve."""
    v = F.col("vocabulary")
    low = F.least(F.lit(50), F.greatest(F.lit(2), F.floor(v / 20 + 0.5)))
    high = F.least(F.lit(5000), v)
    points = _ranks(spectrum(freqs), low, high).select(
        F.log10(F.col("rank").cast("double")).alias("x"), F.log10(F.col("frequency").cast("double")).alias("y"),
        low.alias("low"), high.alias("high"))
    enough = F.count("*") >= 3
    return points.agg(
        F.max("low").cast("bigint").alias("fit_start_rank"), F.max("high").cast("bigint").alias("fit_end_rank"),
        F.count("*").alias("n_points"),
        F.when(enough, F.round(F.regr_slope("y", "x"), 6)).alias("slope"),
        F.when(enough, F.round(F.regr_intercept("y", "x"), 6)).alias("intercept"),
        F.when(enough, F.round(F.regr_r2("y", "x"), 6)).alias("r2"))


def hapax_stats(freqs: DataFrame) -> DataFrame:
    once = F.col("frequency") == 1
    return spectrum(freqs).agg(
        F.coalesce(F.sum(F.when(once, F.col("words"))), F.lit(0)).alias("hapax_count"),
        F.round(100.0 * F.coalesce(F.sum(F.when(once, F.col("words"))), F.lit(0)) / F.sum("words"), 6)
         .alias("hapax_pct_types"),
        F.min(F.when(once, F.col("words_before") + 1)).alias("first_hapax_rank"))


def coverage_milestones(freqs: DataFrame, steps: tuple[int, ...] = (50, 80, 90)) -> DataFrame:
    """The smallest rank at which the running share of tokens reaches each step (in %)."""
    runs = spectrum(freqs).withColumn("step", F.explode(F.array(*[F.lit(s).cast("bigint") for s in steps])))
    missing = F.col("step") * F.col("tokens") - 100 * F.col("tokens_before")
    per_word = 100 * F.col("frequency")
    words_needed = F.greatest(F.lit(1), F.floor((missing + per_word - 1) / per_word))
    reached = 100 * (F.col("tokens_before") + F.col("frequency") * F.col("words")) >= F.col("step") * F.col("tokens")
    return (runs.filter(reached).groupBy("step")
            .agg(F.min(F.col("words_before") + words_needed).cast("bigint").alias("rank")))


def coverage(freqs: DataFrame, min_rank: int = 1, max_rank: int | None = None) -> DataFrame:
    """(rank, coverage): share of all tokens covered by the ranks from `min_rank` on."""
    first = max(1, min_rank)
    skipped = F.col("frequency") * F.greatest(F.lit(0), F.least(F.col("words"), first - 1 - F.col("words_before")))
    runs = spectrum(freqs).withColumn("skipped", F.sum(skipped).over(W.partitionBy()))
    high = F.col("vocabulary") if max_rank is None else F.lit(max_rank)
    return _ranks(runs, F.lit(first), high).select(
        "rank", F.round((F.col("seen") - F.col("skipped")) / F.col("tokens"), 6).alias("coverage"))


def coverage_cumulative(freqs: DataFrame) -> DataFrame:
    """(rank, coverage_pct) over the whole vocabulary."""
    return _ranks(spectrum(freqs), F.lit(1), F.col("vocabulary")).select(
        "rank", F.round(F.col("seen") / F.col("tokens") * 100, 6).alias("coverage_pct"))


def corpus_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Tokens, distinct lower-cased tokens and type-token ratio, with its band."""
    words = (explode_rows(df, T.space_tokens(F.col(text)), "w")
             .groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.count("*").alias("unique_words"))
    ratio = F.when(F.col("total_words") > 0, F.col("unique_words") / F.col("total_words")).otherwise(F.lit(0.0))
    return (total.withColumn("ttr", ratio)
            .withColumn("diversity", F.when(F.col("ttr") >= 0.40, "Diverse")
                        .when(F.col("ttr") < 0.15, "Repetitive").otherwise("Moderate"))
            .withColumn("ttr", F.round("ttr", 6)))


def _length_counts(df: DataFrame, text: str) -> DataFrame:
    lengths = df.select(F.size(T.space_tokens(F.col(text))).cast("bigint").alias("n_words"))
    return lengths.filter("n_words > 0").groupBy("n_words").agg(F.count("*").alias("docs"))


def doc_length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Document lengths in words; the median is the upper one."""
    running = W.orderBy("n_words").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = (_length_counts(df, text)
              .withColumn("upto", F.sum("docs").over(running))
              .withColumn("total", F.sum("docs").over(W.partitionBy())))
    return counts.agg(
        F.sum("docs").alias("documents"), F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"),
        F.round(F.sum(F.col("n_words") * F.col("docs")) / F.sum("docs"), 6).alias("mean_words"),
        F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n_words"))).alias("median_words"))


def doc_length_histogram(df: DataFrame, text: str = "text", buckets: int = LENGTH_BUCKETS) -> DataFrame:
    """Equal-width bins over document lengths, empty ones included; one bin if all are equal."""
    whole = W.partitionBy()
    counts = (_length_counts(df, text)
              .withColumn("low", F.min("n_words").over(whole))
              .withColumn("high", F.max("n_words").over(whole)))
    width = (F.col("high") - F.col("low")) / buckets
    spread = F.col("high") > F.col("low")
    place = F.when(spread, F.least(F.lit(buckets - 1), F.floor((F.col("n_words") - F.col("low")) / width)))
    filled = (counts.withColumn("bin", F.coalesce(place, F.lit(0)).cast("int"))
              .groupBy("low", "high", "bin").agg(F.sum("docs").alias("docs")))
    # At most `buckets` entries: one row that knows every bin.
    by_bin = filled.groupBy("low", "high").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "docs"))).alias("by_bin"))
    last = F.when(spread, F.lit(buckets - 1)).otherwise(F.lit(0))
    bins = by_bin.withColumn("bin", F.explode(F.sequence(F.lit(0), last)))
    return bins.select(
        F.col("bin").cast("bigint").alias("bin"),
        F.round(F.col("low") + F.col("bin") * width, 6).alias("from_words"),
        F.round(F.when(spread, F.col("low") + (F.col("bin") + 1) * width)
                .otherwise(F.col("high").cast("double")), 6).alias("to_words"),
        F.coalesce(F.try_element_at("by_bin", "bin"), F.lit(0)).alias("docs"))
