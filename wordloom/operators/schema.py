"""Column profiling and the choice of label and text columns."""

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.constants import LABEL_NAME_HINTS, TEXT_NAME_HINTS
from wordloom.functions import text as T


def _text_of(column: str) -> Column:
    return F.col(f"`{column}`").cast("string")


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: rows, distinct trimmed values, lengths and name hints, from one pass."""
    places = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), _text_of(c).alias("v"))
                       for i, c in enumerate(df.columns)])
    cells = df.select(F.inline(places)).withColumn("t", F.nullif(T.strip(F.col("v")), F.lit("")))
    # Distinct values meet by a 256-bit digest, so no text is shuffled.
    values = cells.groupBy("position", "column", F.sha2("t", 256).alias("t")).agg(
        F.count("*").alias("n"), F.max(F.length("v")).alias("longest_raw"), F.max(F.length("t")).alias("length"))
    name = F.lower(F.trim("column"))
    return values.groupBy("position", "column").agg(
        F.sum("n").alias("n_rows"),
        F.count("t").alias("n_distinct"),
        F.coalesce(F.max("length"), F.lit(0)).cast("bigint").alias("max_length"),
        F.coalesce(F.max("longest_raw") > 20, F.lit(False)).alias("is_long_text"),
    ).select(F.col("position").cast("bigint").alias("position"), "column", "n_rows", "n_distinct", "max_length",
             "is_long_text", name.isin(TEXT_NAME_HINTS).alias("hinted_text"),
             name.isin(LABEL_NAME_HINTS).alias("hinted_label"))


def _label_candidates(profile: DataFrame) -> DataFrame:
    ceiling = F.greatest(F.lit(2), F.least(F.lit(50), F.ceil(F.col("n_rows") * 0.2)))
    return profile.filter((F.col("max_length") <= 50) & F.col("n_distinct").between(F.lit(1), ceiling)
                          & (F.col("hinted_label") | ~F.col("hinted_text")))


def detect_label_column(profile: DataFrame) -> DataFrame:
    """The label column, if any: a named one first, else the one with fewest values."""
    rank = F.when(F.col("hinted_label"), F.lit(0)).otherwise(F.col("n_distinct"))
    return (_label_candidates(profile).orderBy(F.desc("hinted_label"), rank, "position").limit(1)
            .select(F.col("column").alias("label_column")))


def detect_text_column(profile: DataFrame) -> DataFrame:
    """The text column, if any: a named one, else a long one, else the only one left."""
    label = detect_label_column(profile)
    rest = profile.filter(~F.col("column").eqNullSafe(label.scalar()))
    grade = (F.when(F.col("hinted_text"), 0).when(F.col("is_long_text"), 1)
             .when(rest.agg(F.count("*").alias("n")).scalar() == 1, 2))
    return (rest.withColumn("grade", grade).filter("grade IS NOT NULL").orderBy("grade", "position").limit(1)
            .select(F.col("column").alias("text_column")))


def detect_binary_label_columns(df: DataFrame, anywhere: bool = False) -> DataFrame:
    """(position, column) of the 0/1 columns: the leading run, or any but the text column.

    Empty cells do not count against a column, so an empty column qualifies.
    """
    if anywhere:
        named = [c for c in df.columns if c.lower() in ("text", "sentence", "content")]
        text = named[0] if named else df.columns[-1]
        candidates = [c for c in df.columns if c != text]
    else:
        candidates = df.columns[:-1]
    tests = []
    for c in candidates:
        value = _text_of(c) if not anywhere else F.trim(_text_of(c))
        tests.append(F.coalesce(F.bool_and((F.coalesce(value, F.lit("")) == "") | value.isin("0", "1")), F.lit(True))
                     .alias(c))
    flags = df.agg(*tests)
    listed = flags.select(F.inline(F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column"), F.col(f"`{c}`").alias("binary"),
                 (F.lit(True) if anywhere else _all_of(candidates[:i + 1])).alias("leading"))
        for i, c in enumerate(candidates)])))
    return listed.filter("binary AND leading").select("position", "column")


def _all_of(columns: list[str]) -> Column:
    flag = F.lit(True)
    for c in columns:
        flag = flag & F.col(f"`{c}`")
    return flag
