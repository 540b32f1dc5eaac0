"""Lexicon sentiment. The lexicon is the caller's: (word, valence), valences from -5 to 5."""

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.functions import text as T
from wordloom.functions.rows import explode_rows, posexplode_rows
from wordloom.operators.phrases import AUTOMATON_PIECES, WORD, rewritten
from wordloom.plans.storage import broadcast_if_small

_NUMBERED = r"^\[(\d+)\]\s*(.*)"


def split_sentences(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, sentence_id, sentence), numbered from 1 inside each document."""
    return posexplode_rows(df, T.sentences(F.col(text)), "sentence_id", "sentence", id)


def labeled_sentences(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Sentences with the number of their `[n]` line where a document starts with one."""
    body = T.strip(F.col(text))
    numbered = body.rlike(r"^\[\d+\]")
    lines = F.filter(F.transform(F.split(body, r"\r\n|[\n\r\x0B\f\x85\u2028\u2029]"), lambda s: F.struct(
        F.regexp_extract(s, _NUMBERED, 1).try_cast("bigint").alias("label"),
        F.regexp_extract(s, _NUMBERED, 2).alias("body"))), lambda s: s["label"].isNotNull())
    whole = F.array(F.struct(F.lit(None).cast("bigint").alias("label"), F.col(text).alias("body")))
    parts = F.when(numbered, lines).otherwise(whole)
    found = F.flatten(F.transform(parts, lambda p: F.transform(T.sentences(p["body"]), lambda s: F.struct(
        p["label"].alias("label"), s.alias("sentence")))))
    return posexplode_rows(df, found, "sentence_id", "s", id).select(id, "sentence_id", "s.label", "s.sentence")


def _phrases(lexicon: DataFrame) -> DataFrame:
    """Multi-word entries as (key, gain): the valence beyond what is counted for the single words."""
    entries = lexicon.filter(F.col("word").rlike(r"[^\p{L}\p{N}_]"))
    parts = entries.select("word", "valence", F.explode_outer(T.keep_words(F.split("word", T.NON_WORD), None))
                           .alias("part"))
    singles = lexicon.select(F.col("word").alias("part"), F.col("valence").alias("single"))
    rows = parts.join(singles, "part", "left").groupBy("word", "valence").agg(F.coalesce(F.sum("single"), F.lit(0)).alias("single"))
    return rows.filter(F.col("word") == F.lower("word")).select(
        F.col("word").alias("key"), (F.col("valence") - F.col("single")).cast("bigint").alias("gain"))


def _phrase_score(parts: list[str], hits: list[tuple[int, dict]]) -> int:
    """Gains of all phrases; two places of one phrase do not overlap."""
    score, ends = 0, {}
    for start, hit in sorted(hits, key=lambda h: h[0]):
        own = (hit["key"], hit["gain"])
        if start >= ends.get(own, 0):
            score += hit["gain"]
            ends[own] = start + len(hit["pieces"])
    return score


def sentence_sentiment(df: DataFrame, lexicon: DataFrame, text: str = "text", id: str = "doc_id",
                       limit: int = AUTOMATON_PIECES) -> DataFrame:
    """(id, sentence_id, label, sentence, score, sentiment): the sum of the valences of its words."""
    rows = labeled_sentences(df, text, id)
    words = rows.select(id, "sentence_id", F.explode(F.split(F.lower("sentence"), T.NON_WORD)).alias("word"))
    sums = (words.join(broadcast_if_small(lexicon.select("word", "valence")), "word")
            .groupBy(F.col(id).alias("_of"), F.col("sentence_id").alias("_place")).agg(F.sum("valence").alias("_sum")))
    # the sentence itself is joined once and never rides on its words
    scored = rows.join(sums, F.col(id).eqNullSafe(F.col("_of")) & (F.col("sentence_id") == F.col("_place")), "left").select(
        id, "sentence_id", "label", "sentence", F.coalesce("_sum", F.lit(0)).alias("score"))
    if not lexicon.filter(F.col("word").rlike(r"[^\p{L}\p{N}_]")).isEmpty():
        scored = rewritten(scored, _phrases(lexicon), "sentence", WORD, _phrase_score, "bigint", limit).withColumn(
            "score", F.col("score") + F.coalesce("_out", F.lit(0))).drop("_out")
    mood = F.when(F.col("score") > 0, "Positive").when(F.col("score") < 0, "Negative").otherwise("Neutral")
    return scored.withColumn("score", F.col("score").cast("bigint")).withColumn("sentiment", mood)


def sentiment_distribution(sentiments: DataFrame, *by: str) -> DataFrame:
    """Sentences per sentiment, and per further columns such as the label."""
    return sentiments.groupBy(*by, "sentiment").agg(F.count("*").alias("sentences"))


def corpus_valence(df: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """Mean valence over the words the lexicon knows; within 0.05 of zero is neutral."""
    words = explode_rows(df, T.space_tokens(F.col(text)), "w").select(
        F.regexp_replace(F.lower("w"), "[^a-z']", "").alias("word")).filter("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    scored = counts.join(broadcast_if_small(lexicon.select("word", "valence")), "word")
    mean = F.sum(F.col("n") * F.col("valence")) / F.sum("n")
    return scored.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored_words"), F.round(mean, 6).alias("mean_valence"),
                      F.when(mean > 0.05, "Positive").when(mean < -0.05, "Negative")
                      .when(mean.isNotNull(), "Neutral").alias("sentiment"))
