"""Cleaning, mixing and tokenizing a corpus, stage by stage."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordloom.llm import bpe, classifier, mixing, pii, simhash
from wordloom.llm.catalog import WORD_BPE
from wordloom.plans.storage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return classifier.classify(docs.select(COLUMNS)).filter("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles two or fewer bits link."""
    return simhash.keep_one(docs.select(COLUMNS), shingle=3, distance=2)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and revealing terms generalised."""
    return pii.sanitise(docs.select(COLUMNS)).withColumn("n_chars", F.char_length("text").cast("bigint")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes of each document, once for each pass over it."""
    rows, spans = mixing.mix(docs.select(COLUMNS))
    mixed = mixing.mixed_texts(docs.select(COLUMNS), spans)
    return mixed.withColumns({"text": F.col("mixed"), "n_chars": F.char_length("mixed").cast("bigint")}).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs, WORD_BPE).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("PII", personal_data),
          ("mixing sources", mixture), ("BPE encoding", tokens)]
ORACLE_SQL = None  # fitted models, hashes and tokenizers are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from `documents` on; each one's result is written and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = written(docs, f"stage{i + 1}")
    return docs
