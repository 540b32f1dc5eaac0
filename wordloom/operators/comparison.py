"""Paired comparison of configurations on a scores table
(dataset, model, feature, fold, metric, value). A configuration is `model+feature`."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom.functions.student import student_ppf, student_sf


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds."""
    return scores.groupBy("dataset", "model", "feature", "metric").agg(
        F.count("value").alias("folds"), F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_samp("value"), 6).alias("std"))


def _configurations(scores: DataFrame) -> DataFrame:
    # A baseline has no representation and goes by its model name.
    name = F.when(F.coalesce(F.col("feature"), F.lit("-")) == "-", F.col("model")).otherwise(
        F.concat_ws("+", "model", "feature"))
    return scores.withColumn("config", name)


def paired_differences(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """(dataset, metric, a, b, k, mean_a, mean_b, d_mean, d_var) of the fold-wise differences.

    `pairs` is (a, b). Scores of a few configurations and folds: small tables throughout.
    """
    named = _configurations(scores).select("dataset", "metric", "fold", "config", "value").filter("value IS NOT NULL")
    left = named.withColumnsRenamed({"config": "a", "value": "va"})
    right = named.withColumnsRenamed({"config": "b", "value": "vb"})
    both = left.join(pairs.select("a", "b"), "a").join(right, ["dataset", "metric", "fold", "b"])
    d = F.col("va") - F.col("vb")
    # Equal differences have no variance, whatever the rounding of their mean.
    variance = F.when(F.max(d) == F.min(d), F.lit(0.0)).otherwise(F.var_samp(d))
    return both.groupBy("dataset", "metric", "a", "b").agg(
        F.count("*").alias("k"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"),
        F.avg(d).alias("d_mean"), variance.alias("d_var"))


def _keys() -> list[str]:
    return ["dataset", "metric", "a", "b"]


def _two_sided(t: Column, df: Column) -> Column:
    return 2 * student_sf(F.abs(t), df.cast("double"))


def paired_ttest(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ordinary paired t-test; zero variance is reported, not left undefined."""
    diff = paired_differences(scores, pairs)
    flat, same = F.col("d_var") == 0, F.col("d_mean") == 0
    t = F.when(flat & same, F.lit(0.0)).when(flat, F.lit(float("inf"))).otherwise(
        F.col("d_mean") / F.sqrt(F.col("d_var") / F.col("k")))
    df = F.col("k") - 1
    tested = diff.withColumns({"t": t, "df": df})
    p = F.when(flat & same, F.lit(1.0)).when(flat, F.lit(0.0)).otherwise(_two_sided(F.col("t"), F.col("df")))
    return tested.select(*_keys(), F.round("t", 6).alias("t"), "df", F.round(p, 9).alias("p"))


def corrected_ttest(scores: DataFrame, pairs: DataFrame, n_train: int, n_test: int) -> DataFrame:
    """The resampled t-test with the variance of Nadeau and Bengio (2003)."""
    diff = paired_differences(scores, pairs)
    factor = 1 / F.col("k") + F.lit(n_test / n_train)
    flat = F.col("d_var") == 0
    t = F.when(flat, F.lit(0.0)).otherwise(F.col("d_mean") / F.sqrt(factor * F.col("d_var")))
    tested = diff.withColumns({"t": t, "df": F.col("k") - 1, "correction": factor})
    p = F.when(flat, F.lit(1.0)).otherwise(_two_sided(F.col("t"), F.col("df")))
    return tested.select(*_keys(), F.round("t", 6).alias("t"), "df", F.round("correction", 6).alias("correction"),
                         F.round("d_mean", 6).alias("mean_difference"), F.round(p, 9).alias("p"))


def tost(scores: DataFrame, pairs: DataFrame, margin: float, alpha: float = 0.05, n_train: int | None = None,
         n_test: int | None = None) -> DataFrame:
    """Two one-sided tests of equivalence within `margin`; corrected when fold sizes are given."""
    if (n_train is None) != (n_test is None):
        raise ValueError("the correction needs both n_train and n_test")
    diff = paired_differences(scores, pairs)
    factor = 1 / F.col("k") + (F.lit(n_test / n_train) if n_train else F.lit(0.0))
    mean, df = F.col("d_mean"), (F.col("k") - 1).cast("double")
    base = diff.withColumn("se", F.sqrt(factor * F.col("d_var"))).withColumn("df", df)
    flat = F.col("se") == 0
    inside = F.abs(mean) < margin
    step = F.when(flat, F.lit(None)).otherwise(F.col("se"))
    tested = base.withColumns({"t_lower": (mean + margin) / step, "t_upper": (mean - margin) / step})
    settled = F.when(inside, F.lit(0.0)).otherwise(F.lit(1.0))
    tested = tested.withColumns({
        "p_lower": F.when(flat, settled).otherwise(student_sf("t_lower", "df")),
        "p_upper": F.when(flat, settled).otherwise(student_sf(-F.col("t_upper"), F.col("df"))),
        "reach": F.when(flat, F.lit(0.0)).otherwise(student_ppf(F.lit(1 - alpha), F.col("df")) * F.col("se"))})
    p = F.greatest("p_lower", "p_upper")
    rounded = [F.round(c, 6).alias(c) for c in ("se", "t_lower", "t_upper", "p_lower", "p_upper")]
    return tested.select(*_keys(), F.round(mean, 6).alias("mean_difference"), *rounded, F.round(p, 6).alias("p_tost"),
                         F.when(flat, inside).otherwise(p < alpha).alias("equivalent"),
                         F.round(mean - F.col("reach"), 6).alias("ci_lower"),
                         F.round(mean + F.col("reach"), 6).alias("ci_upper"))


def cohens_dz(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean difference over its deviation, 0 where that is 0."""
    return paired_differences(scores, pairs).select(*_keys(), F.round(_dz(), 6).alias("dz"))


def _dz() -> Column:
    return F.when(F.col("d_var") == 0, F.lit(0.0)).otherwise(F.col("d_mean") / F.sqrt("d_var"))


def holm_bonferroni(tests: DataFrame, family: list[str], p: str = "p", order: list[str] | None = None,
                    alpha: float = 0.05) -> DataFrame:
    """Add `p_holm` and `reject`: step-down adjusted p-values within each family of tests."""
    by_p = W.partitionBy(*family).orderBy(p, *(order or []))
    ranked = tests.withColumn("_rank", F.row_number().over(by_p) - 1).withColumn(
        "_n", F.count("*").over(W.partitionBy(*family)))
    upto = by_p.rowsBetween(W.unboundedPreceding, W.currentRow)
    adjusted = F.least(F.lit(1.0), F.max((F.col("_n") - F.col("_rank")) * F.col(p)).over(upto))
    return ranked.withColumn("p_holm", F.round(adjusted, 6)).withColumn("reject", adjusted < alpha).drop("_rank", "_n")


def contrast_pairs(scores: DataFrame, baseline: str | None = None) -> DataFrame:
    """(family, a, b): tf against tfidf per model, model pairs per feature, each against a baseline."""
    named = _configurations(scores).select("model", "feature", "config").distinct()
    plain = named if baseline is None else named.filter(F.col("model") != baseline)
    a = plain.withColumnsRenamed({"config": "a", "model": "model_a", "feature": "feature_a"})
    b = plain.withColumnsRenamed({"config": "b", "model": "model_b", "feature": "feature_b"})
    representation = a.join(b, F.col("model_a") == F.col("model_b")).filter(
        (F.col("feature_a") == "tf") & (F.col("feature_b") == "tfidf")).select(F.lit("representation").alias("family"), "a", "b")
    algorithm = a.join(b, F.col("feature_a") == F.col("feature_b")).filter(
        F.col("model_a") < F.col("model_b")).select(F.lit("algorithm").alias("family"), "a", "b")
    pairs = representation.unionByName(algorithm)
    if baseline is not None:
        pairs = pairs.unionByName(plain.select(F.lit("baseline").alias("family"), F.col("config").alias("a"),
                                               F.lit(baseline).alias("b")))
    return pairs


def planned_contrasts(scores: DataFrame, n_train: int, n_test: int, metric: str = "f1_weighted",
                      baseline: str | None = None) -> DataFrame:
    """All planned contrasts on one metric: corrected t, effect size, p and Holm over all of them."""
    chosen = scores.filter(F.col("metric") == metric)
    pairs = contrast_pairs(chosen, baseline)
    tests = corrected_ttest(chosen, pairs, n_train, n_test)
    effects = cohens_dz(chosen, pairs)
    named = tests.join(effects, _keys()).join(pairs, ["a", "b"])
    return holm_bonferroni(named, ["dataset", "metric"], "p", ["a", "b"])
