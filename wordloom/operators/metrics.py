"""Evaluation of predictions (doc_id, y_true, y_pred[, score]) and of multi-label ones
(doc_id, label, y_true, y_pred)."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def pair_counts(predictions: DataFrame) -> DataFrame:
    """(y_true, y_pred, n): everything a report needs, at most classes squared rows."""
    return predictions.groupBy(F.col("y_true").cast("string").alias("y_true"),
                               F.col("y_pred").cast("string").alias("y_pred")).agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """(y_true, y_pred, n) over the full square of labels, zeros included."""
    counts = pair_counts(predictions)
    cells = counts.agg(F.array_sort(F.array_union(F.collect_set("y_true"), F.collect_set("y_pred"))).alias("labels"),
                       F.map_from_entries(F.collect_list(F.struct(F.struct("y_true", "y_pred"), "n"))).alias("found"))
    square = (cells.withColumn("y_true", F.explode("labels")).withColumn("y_pred", F.explode("labels")))
    return square.select("y_true", "y_pred", F.coalesce(
        F.try_element_at("found", F.struct("y_true", "y_pred")), F.lit(0)).cast("bigint").alias("n"))


def _per_class(counts: DataFrame) -> DataFrame:
    """(label, tp, predicted, support) from pair counts."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("y_true").alias("label"), hit.alias("tp"), zero.alias("predicted"), F.col("n").alias("support")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("tp"), F.col("n").alias("predicted"), zero.alias("support")))))
    return sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])


def _scores(tp: Column, predicted: Column, support: Column) -> tuple[Column, Column, Column]:
    return _ratio(tp, predicted), _ratio(tp, support), _ratio(2 * tp, predicted + support)


def classification_report(predictions: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class, with accuracy and both averages."""
    classes = _per_class(pair_counts(predictions))
    p, r, f = _scores(F.col("tp"), F.col("predicted"), F.col("support"))
    rows = classes.select("label", p.alias("precision"), r.alias("recall"), f.alias("f1"), "support", "tp")
    n = F.sum("support")
    macro = [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    weighted = [_ratio(F.sum(F.col(c) * F.col("support")), n).alias(c) for c in ("precision", "recall", "f1")]
    accuracy = _ratio(F.sum("tp"), n)
    summary = rows.agg(n.alias("support"), F.array(
        F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"), accuracy.alias("recall"),
                 accuracy.alias("f1")),
        F.struct(F.lit("macro avg").alias("label"), *macro),
        F.struct(F.lit("weighted avg").alias("label"), *weighted)).alias("rows"))
    rounded = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return rows.select("label", *rounded, "support").unionByName(
        summary.select("support", F.inline("rows")).select("label", *rounded, "support"))


def weighted_scores(predictions: DataFrame) -> DataFrame:
    """One row: accuracy and the support-weighted precision, recall and F1."""
    classes = _per_class(pair_counts(predictions))
    p, r, f = _scores(F.col("tp"), F.col("predicted"), F.col("support"))
    n, support = F.sum("support"), F.col("support")
    return classes.agg(_ratio(F.sum("tp"), n).alias("accuracy"), _ratio(F.sum(p * support), n).alias("precision_weighted"),
                       _ratio(F.sum(r * support), n).alias("recall_weighted"), _ratio(F.sum(f * support), n).alias("f1_weighted"))


def multilabel_report(predictions: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per label of a multi-label prediction."""
    both = F.sum(F.col("y_true") * F.col("y_pred"))
    p, r, f = _scores(both, F.sum("y_pred"), F.sum("y_true"))
    return predictions.groupBy("label").agg(
        F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"),
        F.sum("y_true").cast("bigint").alias("support"))


def multilabel_metrics(predictions: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row: Hamming loss, F1 macro and micro, subset accuracy."""
    return multilabel_metrics_by(predictions, [], id)


def multilabel_metrics_by(predictions: DataFrame, keys: list[str], id: str = "doc_id") -> DataFrame:
    """The same for each combination of `keys`."""
    wrong = (F.col("y_true") != F.col("y_pred")).cast("bigint")
    labels = predictions.groupBy(*keys, "label").agg(
        F.count("*").alias("n"), F.sum(wrong).alias("wrong"), F.sum(F.col("y_true") * F.col("y_pred")).alias("tp"),
        F.sum("y_pred").alias("predicted"), F.sum("y_true").alias("support"))
    f1 = _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    micro = _ratio(2 * F.sum("tp"), F.sum("predicted") + F.sum("support"))
    exact = predictions.groupBy(*keys, id).agg(F.max(wrong).alias("wrong")).groupBy(*keys).agg(
        F.round(F.avg(1 - F.col("wrong")), 6).alias("subset_accuracy"))
    scores = labels.groupBy(*keys).agg(F.round(F.sum("wrong") / F.sum("n"), 6).alias("hamming_loss"), F.round(F.avg(f1), 6).alias("f1_macro"),
                                       F.round(micro, 6).alias("f1_micro"))
    return scores.join(exact, keys) if keys else scores.withColumn("subset_accuracy", exact.scalar())


def binary_rates(predictions: DataFrame, positive: str = "1") -> DataFrame:
    """True and false positive rate."""
    actual = F.col("y_true").cast("string") == positive
    flagged = F.col("y_pred").cast("string") == positive
    return predictions.agg(
        F.round(_ratio(F.count_if(actual & flagged), F.count_if(actual)), 6).alias("tpr"),
        F.round(_ratio(F.count_if(~actual & flagged), F.count_if(~actual)), 6).alias("fpr"))


def misclassified(predictions: DataFrame, docs: DataFrame | None = None, id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Wrong predictions with their kind (a miss of class 1 is type II, all else type I) and text."""
    y, p = F.col("y_true").cast("string"), F.col("y_pred").cast("string")
    kind = F.when((y == "1") & (p == "0"), "type II").otherwise("type I")
    wrong = predictions.filter(~y.eqNullSafe(p)).withColumn("error", kind)
    return wrong if docs is None else wrong.join(docs.select(id, text), id)


def degenerate_probabilities(predictions: DataFrame, score: str = "score") -> DataFrame:
    """Whether every probability is 0 or 1 after rounding, which leaves no curve to draw."""
    return predictions.agg(F.coalesce(F.bool_and(F.round(score, 6).isin(0.0, 1.0)), F.lit(True)).alias("degenerate"))


def score_steps(predictions: DataFrame, score: str = "score", positive: str = "1", buckets: int = 256) -> DataFrame:
    """(score, pos, neg, tp, fp, positives, negatives): running counts by falling score, ties together.

    Quantiles cut the distinct scores into ranges of equal size; running sums inside a range add to
    the sum of the ranges above, so no window sees more than its range.
    """
    actual = F.col("y_true").cast("string") == positive
    steps = predictions.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(actual).alias("pos"), F.count_if(~actual).alias("neg"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = steps.agg(F.percentile_approx("score", shares, 10_000).alias("cuts"))
    placed = steps.withColumn("cuts", cuts.scalar()).withColumn(
        "range", F.size(F.filter("cuts", lambda c: c <= F.col("score")))).drop("cuts")
    above = W.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)  # at most `buckets` rows
    whole = W.partitionBy()
    ranges = placed.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        "range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("tp_above"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("fp_above"),
        F.sum("p").over(whole).alias("positives"), F.sum("n").over(whole).alias("negatives"))
    inside = W.partitionBy("range").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.join(F.broadcast(ranges), "range").select(
        "score", "pos", "neg", (F.col("tp_above") + F.sum("pos").over(inside)).alias("tp"),
        (F.col("fp_above") + F.sum("neg").over(inside)).alias("fp"), "positives", "negatives")


def roc_curve(predictions: DataFrame, score: str = "score", positive: str = "1") -> DataFrame:
    """(fpr, tpr) from the origin on; the diagonal when only one class occurs."""
    steps = score_steps(predictions, score, positive)
    two = (F.col("positives") > 0) & (F.col("negatives") > 0)
    points = steps.filter(two).select(F.round(F.col("fp") / F.col("negatives"), 6).alias("fpr"),
                                      F.round(F.col("tp") / F.col("positives"), 6).alias("tpr"))
    actual = F.col("y_true").cast("string") == positive
    ends = predictions.agg((F.count_if(actual) * F.count_if(~actual) > 0).alias("two")).select(F.explode(
        F.when(F.col("two"), F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))).alias("fpr"))
    return points.unionByName(ends.select("fpr", F.col("fpr").alias("tpr")))


def auc(predictions: DataFrame, score: str = "score", positive: str = "1") -> DataFrame:
    """Area under the ROC curve by trapezoids, within [0, 1]; 0.5 when only one class occurs."""
    steps = score_steps(predictions, score, positive)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    total = F.max("positives") * F.max("negatives")
    value = F.coalesce(area / F.nullif(total.cast("double"), F.lit(0.0)), F.lit(0.5))
    return steps.agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 6).alias("auc"))
