"""Projections and filters over corpus rows."""

from pyspark.sql import DataFrame, functions as F

from wordloom.constants import TEXT_FIELDS
from wordloom.functions import text as T


def extract_text(df: DataFrame, fields: list[str] = TEXT_FIELDS, name: str = "text") -> DataFrame:
    """The first non-empty text-like column, as `name`; '' where there is none."""
    present = [F.nullif(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields if f in df.columns]
    nested = df.schema["data"].dataType if "data" in df.columns else None
    if hasattr(nested, "names") and "text" in nested.names:
        present.append(F.nullif(F.col("data.text").cast("string"), F.lit("")))
    return df.withColumn(name, F.coalesce(*present, F.lit("")))


def truncate_text(df: DataFrame, max_chars: int, text: str = "text") -> DataFrame:
    return df.withColumn(text, T.truncate(F.col(text), max_chars))


def filter_class(df: DataFrame, class_name: str | None, label: str = "label",
                 label_names: str | None = None) -> DataFrame:
    """Rows of one class. `all` keeps every row; a `label` prefix is dropped before comparing."""
    if class_name is None or class_name == "all":
        return df
    single = F.coalesce(F.col(label).cast("string"), F.lit("Unlabeled")) == class_name.removeprefix("label")
    if label_names is None:
        return df.filter(single)
    several = F.size(F.coalesce(F.col(label_names), F.array().cast("array<string>"))) > 0
    return df.filter(F.when(several, F.array_contains(label_names, class_name)).otherwise(single))


def drop_empty(df: DataFrame, text: str = "text", label: str | None = None) -> DataFrame:
    """Drop rows with blank text and, when a label column is named, rows without a label."""
    kept = df.filter(~T.is_blank(F.col(text)))
    return kept if label is None else kept.filter(~T.is_blank(F.col(label).cast("string")))


def sample_rows(df: DataFrame, n: int = 40, id: str = "doc_id") -> DataFrame:
    """The first rows, for a preview."""
    return df.orderBy(id).limit(n)


def corpus_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """16 hex digits that identify a corpus, whatever the order of its rows.

    The eight 32-bit words of each text's SHA-256 are summed over the corpus and the sums hashed
    again, so copies count, nothing is collected, and partial sums meet in one row.
    """
    digests = df.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"))
    sums = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0))
            .cast("decimal(38,0)").cast("string") for i in range(8)]
    return digests.agg(F.count("*").alias("n_documents"),
                       F.substring(F.sha2(F.concat_ws(",", *sums), 256), 1, 16).alias("fingerprint"))
