"""Seeded samples, splits, folds and class balancing.

Order inside a class is `md5(seed:id)`, so every engine draws the same rows. Positions come from
`ranking.shuffled_position`, which no single large class can overload.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom.operators.ranking import explode_range, shuffled_position
from wordloom.plans.storage import broadcast_if_small


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def stratified_sample(df: DataFrame, n: int, label: str = "label", id: str = "doc_id", seed: int = 42) -> DataFrame:
    """Exactly `n` rows of each class; an error if a class has fewer."""
    short = class_sizes(df, label).filter(F.col("n") < n).limit(20).collect()
    if short:
        raise ValueError(f"classes with fewer than {n} rows: " + ", ".join(f"{r[label]!r} ({r.n})" for r in short))
    return shuffled_position(df, [label], id, seed).filter(F.col("position") <= n).drop("position")


def train_test_split(df: DataFrame, label: str | None = "label", id: str = "doc_id", test_size: float = 0.3,
                     seed: int = 42) -> DataFrame:
    """Add `split`, 'train' or 'test'. With a label, classes keep their shares.

    ceil(n * test_size) test rows are dealt to the classes by largest remainder.
    """
    rows = df if label is not None else df.withColumn("_one", F.lit(1))
    group = label or "_one"
    whole = W.partitionBy()  # one row per class
    total = F.sum("n").over(whole)
    tests = F.ceil(total * test_size)
    quota = class_sizes(rows, group).withColumns({
        "_base": F.floor(F.col("n") * tests / total), "_rest": F.col("n") * tests % total, "_tests": tests})
    left = F.col("_tests") - F.sum("_base").over(whole)
    turn = F.row_number().over(W.orderBy(F.desc("_rest"), group))
    quota = quota.select(F.col(group).alias("_group"), (F.col("_base") + F.when(turn <= left, 1).otherwise(0)).alias("_n_test"))
    placed = shuffled_position(rows, [group], id, seed, "_position").join(
        broadcast_if_small(quota), F.col(group).eqNullSafe(F.col("_group")))
    split = F.when(F.col("_position") <= F.col("_n_test"), "test").otherwise("train")
    return placed.withColumn("split", split).select(*df.columns, "split")


def stratified_kfold(df: DataFrame, k: int = 10, label: str = "label", id: str = "doc_id", seed: int = 42) -> DataFrame:
    """Add `fold` from 0 to k - 1, each class dealt round."""
    placed = shuffled_position(df, [label], id, seed, "_position")
    return placed.withColumn("fold", ((F.col("_position") - 1) % k).cast("bigint")).drop("_position")


def multilabel_kfold(df: DataFrame, label_columns: list[str], k: int = 10, id: str = "doc_id", seed: int = 42) -> DataFrame:
    """Add `fold`: rows are dealt round, one label combination after the other.

    Each combination goes on where the one before it stopped, so rare ones do not pile up in the
    first fold.
    """
    combined = F.concat_ws(",", *[F.col(c).cast("string") for c in label_columns])
    rows = df.withColumn("_set", combined)
    before = W.orderBy("_set").rowsBetween(W.unboundedPreceding, -1)
    starts = class_sizes(rows, "_set").select("_set", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    placed = shuffled_position(rows, ["_set"], id, seed, "_position").join(broadcast_if_small(starts), "_set")
    fold = ((F.col("_start") + F.col("_position") - 1) % k).cast("bigint")
    return placed.withColumn("fold", fold).select(*df.columns, "fold")


def fold_positives(folded: DataFrame, label_columns: list[str]) -> DataFrame:
    """(fold, documents, one column of positives per label)."""
    return folded.groupBy("fold").agg(F.count("*").alias("documents"),
                                      *[F.sum(c).cast("bigint").alias(c) for c in label_columns])


def random_index(seed: int, *parts: Column) -> Column:
    """A non-negative 60-bit number from a seeded hash."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _draws(sizes: DataFrame, label: str, seed: int) -> DataFrame:
    """One row per missing row of each class, with the position it is drawn from."""
    missing = sizes.withColumn("_missing", F.max("n").over(W.partitionBy()) - F.col("n"))
    draws = explode_range(missing, F.lit(1), F.col("_missing"), "draw", spread=True)
    return draws.withColumn("_position", random_index(seed, F.col(label), F.col("draw")) % F.col("n") + 1)


def random_oversample(df: DataFrame, label: str = "label", id: str = "doc_id", seed: int = 42) -> DataFrame:
    """Draw rows with replacement until every class is as large as the largest.

    `copy` is 0 for original rows. Draws of the same row meet before the join, so each row is
    matched once and repeated in place.
    """
    copies = _draws(class_sizes(df, label), label, seed).groupBy(label, "_position").agg(F.count("*").alias("_copies"))
    copies = copies.withColumnsRenamed({label: "_group", "_position": "_drawn"})
    placed = shuffled_position(df, [label], id, seed, "_position")
    drawn = placed.join(copies, F.col(label).eqNullSafe(F.col("_group")) & (F.col("_position") == F.col("_drawn")))
    repeated = explode_range(drawn, F.lit(1), F.col("_copies"), "copy")
    original = df.withColumn("copy", F.lit(0).cast("bigint"))
    return original.unionByName(repeated.select(*df.columns, "copy"))


def random_undersample(df: DataFrame, label: str = "label", id: str = "doc_id", seed: int = 42) -> DataFrame:
    """Keep as many rows of each class as the smallest has."""
    smallest = class_sizes(df, label).agg(F.min("n").alias("n"))
    return shuffled_position(df, [label], id, seed).filter(F.col("position") <= smallest.scalar()).drop("position")


def resampling_report(before: DataFrame, after: DataFrame, method: str, label: str = "label") -> DataFrame:
    """Class counts before and after; `no_op` marks a method that changed nothing."""
    old = class_sizes(before, label).select(label, F.col("n").alias("n_before"), F.lit(0).alias("n_after"))
    new = class_sizes(after, label).select(label, F.lit(0).alias("n_before"), F.col("n").alias("n_after"))
    sizes = old.union(new).groupBy(label).agg(F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"))
    whole = W.partitionBy()  # one row per class
    total = F.sum(F.col("n_after") - F.col("n_before")).over(whole)
    return (sizes.select(label, "n_before", "n_after", total.alias("n_synthetic"), (total == 0).alias("no_op"),
                         F.lit(method).alias("method")))


def leakage_check(split: DataFrame, id: str = "doc_id", text: str | None = None) -> DataFrame:
    """Training and test rows, and test rows whose id (or text) is in the training part too."""
    key = F.col(id) if text is None else F.sha2(text, 256)  # texts meet by their digest
    train = split.filter("split = 'train'").select(key.alias("_key")).distinct()
    test = split.filter("split = 'test'").select(key.alias("_key"))
    leaked = test.join(train, "_key", "left_semi").agg(F.count("*").alias("n"))
    return split.agg(F.count_if(F.col("split") == "train").alias("n_train"),
                     F.count_if(F.col("split") == "test").alias("n_test")).withColumn("n_leaked", leaked.scalar())


def split_preview(df: DataFrame, label: str = "label", test_percent: int = 20) -> DataFrame:
    """Train and test sizes, and whether the smallest class leaves fewer than ten test rows."""
    share = F.floor(F.col("n") * test_percent / 100 + 0.5).cast("bigint")
    sizes = class_sizes(df, label).agg(F.sum("n").alias("n"), F.min(share).alias("smallest_test_class"))
    return sizes.select((F.col("n") - share).alias("n_train"), share.alias("n_test"), "smallest_test_class",
                        (F.col("smallest_test_class") < 10).alias("warning"))
