"""Vocabulary shared between one class and all others."""

from pyspark.sql import DataFrame, functions as F

from wordloom.functions import text as T
from wordloom.functions.rows import explode_rows
from wordloom.operators.ranking import top_per_group


def class_overlap(df: DataFrame, target: str, label: str = "label", text: str = "text",
                  min_frequency: int = 10) -> DataFrame:
    """(term, bucket, target, other, total) over lower-cased white-space tokens.

    A side counts only when the term reaches `min_frequency` on that side.
    """
    labelled = df.filter(F.col(label).isNotNull() & (F.col(label).cast("string") != "-1"))
    mine = (F.col(label).cast("string") == target).alias("mine")
    words = explode_rows(labelled, T.space_tokens(F.lower(text)), "term", mine)
    counts = words.groupBy("term").agg(
        F.count_if("mine").alias("target"), F.count_if(~F.col("mine")).alias("other"))
    mine, theirs = F.col("target") >= min_frequency, F.col("other") >= min_frequency
    kept = counts.filter(mine | theirs).select(
        "term",
        F.when(mine & theirs, "overlap").when(mine, "unique_target").otherwise("unique_other").alias("bucket"),
        F.when(mine, F.col("target")).otherwise(F.lit(0)).alias("target"),
        F.when(theirs, F.col("other")).otherwise(F.lit(0)).alias("other"))
    return kept.withColumn("total", F.col("target") + F.col("other"))


def class_overlap_summary(overlap: DataFrame) -> DataFrame:
    """Terms and occurrences per bucket."""
    return overlap.groupBy("bucket").agg(F.count("*").alias("terms"), F.sum("total").alias("occurrences"))


def class_overlap_top(overlap: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent terms of each bucket."""
    return top_per_group(overlap, ["bucket"], [F.desc("total"), F.col("term")], n)
