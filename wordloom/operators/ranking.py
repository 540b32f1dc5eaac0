"""Exact ranks over tables too large for one window partition.

A window without partition keys, or with a hot one, sorts a whole group in one task. Here rows
spread over hash buckets first; only bucket sizes (a few thousand rows per group) are summed in
order, and each bucket is numbered on its own.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET_DIGITS = 3  # hex digits of md5: 4,096 buckets per group


def hash_order(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _number(df: DataFrame, groups: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """Number rows inside each group: rows in earlier buckets plus the position in the own one."""
    keys = [*groups, bucket]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size"))
    before = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return (df.join(offsets, keys).withColumn(name, (F.col("_before") + inside).cast("bigint"))
            .drop("_before", bucket))


def shuffled_position(df: DataFrame, groups: list[str], key: str, seed: int, name: str = "position") -> DataFrame:
    """Number the rows of each group from 1 in a seeded, reproducible hash order."""
    hashed = df.withColumns({
        "_group": F.to_json(F.struct(*groups)) if groups else F.lit(""),  # never null, so it joins
        "_hash": hash_order(seed, F.col(key))}).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    placed = _number(hashed, ["_group"], "_bucket", [F.col("_hash"), F.col(key)], name)
    return placed.select(*df.columns, name)


def rank_by_frequency(freqs: DataFrame, word: str = "word", frequency: str = "frequency",
                      name: str = "rank") -> DataFrame:
    """Rank words by falling frequency, from 1.

    Words of equal frequency follow the first digits of their md5 hash, then the alphabet, so the
    many words seen once spread over all buckets.
    """
    tied = freqs.withColumn("_bucket", F.substring(F.md5(F.col(word)), 1, BUCKET_DIGITS))
    above = W.orderBy(F.col(frequency).desc()).rowsBetween(W.unboundedPreceding, -1)
    spectrum = freqs.groupBy(frequency).agg(F.count("*").alias("_words")).select(
        frequency, F.coalesce(F.sum("_words").over(above), F.lit(0)).alias("_above"))
    numbered = _number(tied, [frequency], "_bucket", [F.col(word)], "_inside")
    return numbered.join(spectrum, frequency).select(
        *freqs.columns, (F.col("_above") + F.col("_inside")).cast("bigint").alias(name))


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first `n` rows of each group; Spark limits each group before the shuffle."""
    position = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return df.withColumn(name, position.cast("bigint")).filter(F.col(name) <= n)


def explode_range(df: DataFrame, low: Column, high: Column, name: str, chunk: int = 100_000,
                  spread: bool = False) -> DataFrame:
    """One row per integer in [low, high], in two steps so that no array grows with the data.

    With `spread` the chunks are dealt to all tasks in between, for tables that a window left in one.
    """
    start, stop = F.col("_start"), F.col("_stop")
    chunks = (df.withColumn("_low", low.cast("bigint")).withColumn("_stop", high.cast("bigint"))
              .filter(F.col("_low") <= stop)
              .withColumn("_start", F.explode(F.sequence("_low", "_stop", F.lit(chunk).cast("bigint")))))
    if spread:
        chunks = chunks.repartition(df.sparkSession.sparkContext.defaultParallelism, "_low", "_start")
    return (chunks.withColumn(name, F.explode(F.sequence(start, F.least(start + (chunk - 1), stop))))
            .drop("_low", "_start", "_stop"))
