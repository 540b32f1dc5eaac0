"""Label shaping, counting and dictionaries."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom.functions import text as T
from wordloom.plans.storage import broadcast_if_small

LABELED_LINE = r"^\[([^\]]+)\]\s*(.*)$"


def _usable(label: Column) -> Column:
    text = label.cast("string")
    return text.isNotNull() & (text != "") & (text != "-1")


def parse_labeled_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """`[a+b] text` lines as (labels, text); other lines are dropped."""
    line = F.col(value)
    names = F.transform(F.split(F.regexp_extract(line, LABELED_LINE, 1), r"\+"), lambda s: F.trim(s))
    return lines.filter(line.rlike(LABELED_LINE)).withColumns(
        {"labels": names, "text": F.regexp_extract(line, LABELED_LINE, 2)}).drop(value)


def write_labeled_lines(df: DataFrame, labels: str = "labels", text: str = "text") -> DataFrame:
    """Rows as `[a+b] text` in a `value` column, ready for `write.text`."""
    names = F.when(F.size(labels) > 0, F.array_join(labels, "+")).otherwise("-1")
    return df.withColumn("value", F.concat(F.lit("["), names, F.lit("] "), F.col(text)))


def label_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """(label_name, label_id): alphabetical codes for names, numeric labels as they are.

    Codes begin above the largest whole number among the labels, so a name never gets the code of a
    numeric label. A label column has few distinct values; the window sees those only.
    """
    names = df.select(F.trim(F.col(label).cast("string")).alias("label_name")).filter("label_name <> ''").distinct()
    numeric = F.col("label_name").try_cast("double").isNotNull()
    whole = F.when(F.col("label_name").rlike("^[0-9]{1,15}$"), F.col("label_name").try_cast("bigint"))
    above = F.coalesce(F.max(whole).over(W.partitionBy()) + 1, F.lit(0))
    code = above + F.row_number().over(W.partitionBy(numeric).orderBy("label_name")) - 1
    return names.select("label_name", F.when(numeric, F.col("label_name")).otherwise(code.cast("string"))
                        .alias("label_id"))


def encode_labels(df: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """Replace label names by codes; rows without text or label are dropped."""
    trimmed = df.withColumn(label, F.trim(F.col(label).cast("string"))).withColumn(text, T.strip(F.col(text)))
    kept = trimmed.filter(F.col(label) != "").filter(F.col(text) != "")
    codes = broadcast_if_small(label_ids(kept, label).withColumnRenamed("label_name", label))
    return kept.join(codes, label).withColumnRenamed(label, "label_name")


def decode_labels(df: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    """Add `label_name` for a code or `labelN`; unknown codes keep their own name."""
    key = F.regexp_replace(F.col(label).cast("string"), "^label", "")
    dictionary = broadcast_if_small(names.select(F.col("label_id").cast("string").alias("_key"),
                                                 F.col("label_name").alias("_name")))
    joined = df.withColumn("_key", key).join(dictionary, "_key", "left")
    return joined.withColumn("label_name", F.coalesce("_name", F.col(label).cast("string"))).drop("_key", "_name")


def melt_multilabel(df: DataFrame, label_columns: list[str], text: str = "text") -> DataFrame:
    """One row per active label of a 0/1 table; a row without any gets label `-1`."""
    flags = [F.struct(F.lit(str(i)).alias("label"), F.lit(c).alias("label_name"),
                      (F.col(c).cast("string") == "1").alias("active")) for i, c in enumerate(label_columns)]
    active = F.filter(F.array(*flags), lambda f: f["active"])
    none = F.array(F.struct(F.lit("-1").alias("label"), F.lit(None).cast("string").alias("label_name"),
                            F.lit(True).alias("active")))
    rows = df.filter(~T.is_blank(F.col(text))).withColumn("_active", active)
    rows = rows.withColumn("is_multi_label", F.size("_active") > 1)
    rows = rows.withColumn("_one", F.explode(F.when(F.size("_active") > 0, F.col("_active")).otherwise(none)))
    return rows.withColumns({text: T.strip(F.col(text)), "label": F.col("_one.label"),
                             "label_name": F.col("_one.label_name")}).drop("_active", "_one", *label_columns)


def collapse_multilabel(melted: DataFrame, text: str = "text", label_name: str = "label_name",
                        keep_unlabeled: bool = False) -> DataFrame:
    """One row per text with all its labels. The set per text is bounded by the label dictionary."""
    rows = melted.withColumn(text, T.strip(F.col(text)))
    if not keep_unlabeled:
        rows = rows.filter(F.col(label_name).isNotNull())
    return rows.groupBy(text).agg(F.array_sort(F.collect_set(label_name)).alias("labels"))


def unique_labels(df: DataFrame, label: str = "label", label_names: str | None = None) -> DataFrame:
    """Distinct usable labels with their place in order: by number if all are numbers."""
    single = F.array(F.col(label).cast("string"))
    values = single if label_names is None else (
        F.when(F.size(F.coalesce(F.col(label_names), F.array().cast("array<string>"))) > 0, F.col(label_names))
        .otherwise(single))
    found = df.select(F.explode(values).alias("label")).filter(_usable(F.col("label"))).distinct()
    number = F.col("label").try_cast("double")
    all_numeric = F.bool_and(number.isNotNull()).over(W.partitionBy())
    key = found.withColumn("_key", F.when(all_numeric, number))
    place = F.row_number().over(W.orderBy(F.col("_key").asc_nulls_first(), "label"))
    return key.select("label", place.cast("bigint").alias("position"))


def has_labels(df: DataFrame, label: str = "label") -> DataFrame:
    usable = df.filter(_usable(F.col(label)))
    return usable.agg(F.countDistinct(F.col(label).cast("string")).alias("n_labels")).withColumn(
        "has_labels", F.col("n_labels") >= 2)


def dataset_type(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Classes, documents, mean documents per class and the kind of classification."""
    labelled = df.filter(F.size(labels) > 0)
    per_class = labelled.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    documents = labelled.agg(F.count("*").alias("documents"))
    kind = (F.when(F.col("classes") == 2, "Binary Classification")
            .when(F.col("classes") > 2, "Multi-class Classification").otherwise("Single Class"))
    return (per_class.agg(F.count("*").alias("classes"))
            .withColumn("documents", documents.scalar())
            .withColumn("docs_per_class", F.round(F.col("documents") / F.nullif("classes", F.lit(0)), 6))
            .withColumn("dataset_type", kind))


def label_distribution(lines: DataFrame, value: str = "value", split_multi: bool = False) -> DataFrame:
    """(label, documents) from `[label]` prefixes; `[a+b]` counts whole or for each label."""
    if not split_multi:
        prefix = F.regexp_extract(F.col(value), r"^\[(.+?)\]", 1)
        found = lines.select(prefix.alias("label")).filter("label <> ''")
    else:
        prefix = F.regexp_extract(F.col(value), r"^\[([^\]]+)\]", 1)
        found = (lines.select(prefix.alias("p")).filter("p <> ''")
                 .select(F.explode(F.transform(F.split("p", r"\+"), lambda s: F.trim(s))).alias("label")))
    return found.groupBy("label").agg(F.count("*").alias("documents"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(_usable(F.col(label))).groupBy(F.col(label).cast("string").alias("label")).agg(
        F.count("*").alias("documents"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Class counts with the ratio of the largest to the smallest and the verdict at 1.5."""
    whole = W.partitionBy()
    ratio = F.max("documents").over(whole) / F.min("documents").over(whole)
    n = F.count("*").over(whole)
    verdict = F.when(n < 2, "").when(ratio >= 1.5, "imbalanced").otherwise("balanced")
    return class_counts(df, label).select("label", "documents", F.round(ratio, 6).alias("ratio"),
                                          verdict.alias("verdict"))


def class_share(df: DataFrame, label: str = "label") -> DataFrame:
    share = 100.0 * F.col("documents") / F.sum("documents").over(W.partitionBy())
    return class_counts(df, label).withColumn("share_pct", F.round(share, 1))


def label_statistics(df: DataFrame, label_columns: list[str]) -> DataFrame:
    """Cardinality, density, and prevalence and positives of each 0/1 label column."""
    flags = [F.col(c).cast("bigint") for c in label_columns]
    active = sum(flags[1:], flags[0])
    totals = df.agg(F.avg(active).alias("cardinality"),
                    *[F.sum(f).alias(f"n_{i}") for i, f in enumerate(flags)],
                    *[F.avg(f).alias(f"p_{i}") for i, f in enumerate(flags)])
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"n_{i}").alias("positives"),
                              F.round(F.col(f"p_{i}"), 6).alias("prevalence"))
                     for i, c in enumerate(label_columns)])
    return totals.select(F.round("cardinality", 6).alias("cardinality"),
                         F.round(F.col("cardinality") / len(label_columns), 6).alias("density"),
                         F.inline(rows))


def labelset_counts(df: DataFrame, label_columns: list[str], top_n: int | None = None) -> DataFrame:
    """Combinations of 0/1 labels, the most frequent first; `top_n` of them if given."""
    combined = F.concat_ws(",", *[F.col(c).cast("string") for c in label_columns])
    counts = df.groupBy(combined.alias("labelset")).agg(F.count("*").alias("documents"))
    ranked = counts.orderBy(F.desc("documents"), "labelset")
    return ranked if top_n is None else ranked.limit(top_n)
