"""Metrics, curves and paired comparison."""

from pyspark.sql import functions as F

from catalog.common import (DIFFS, LANGUAGE_GUESS, ML_PREDICTIONS, PREDICTIONS, SCORES, documents, language_guess,
                            ml_predictions, predictions, scores)
from wordloom.operators import comparison as cp, metrics as mt

N_TRAIN, N_TEST = 900, 100


def _pairs(spark, sf):
    return cp.contrast_pairs(scores(spark, sf), "baseline")


def _p_values(spark, sf):
    """A family of tests per language, one test per source, with a p-value from the text lengths."""
    return documents(spark, sf).groupBy("lang", "source").agg(
        (F.avg((F.col("n_chars") % 97).cast("double")) / 970).alias("p"))


QUERIES = {
    "confusion_matrix": lambda s, d: mt.confusion_matrix(language_guess(s, d)),
    "classification_report": lambda s, d: mt.classification_report(language_guess(s, d)),
    "multilabel_metrics": lambda s, d: mt.multilabel_metrics(ml_predictions(s, d)),
    "multilabel_report": lambda s, d: mt.multilabel_report(ml_predictions(s, d)),
    "binary_rates": lambda s, d: mt.binary_rates(predictions(s, d)),
    "misclassified": lambda s, d: mt.misclassified(predictions(s, d), documents(s, d)).select("doc_id", "error", "text"),
    "degenerate_probs": lambda s, d: mt.degenerate_probabilities(predictions(s, d)),
    "roc_curve": lambda s, d: mt.roc_curve(predictions(s, d)),
    "auc": lambda s, d: mt.auc(predictions(s, d)),
    "cv_summary": lambda s, d: cp.cv_summary(scores(s, d)),
    "paired_ttest": lambda s, d: cp.paired_ttest(scores(s, d), _pairs(s, d)).select("a", "b", "t", "df"),
    "corrected_ttest": lambda s, d: cp.corrected_ttest(scores(s, d), _pairs(s, d), N_TRAIN, N_TEST).drop("p"),
    "tost": lambda s, d: cp.tost(scores(s, d), _pairs(s, d), 0.05, n_train=N_TRAIN, n_test=N_TEST),
    "cohens_dz": lambda s, d: cp.cohens_dz(scores(s, d), _pairs(s, d)),
    "holm_bonferroni": lambda s, d: cp.holm_bonferroni(_p_values(s, d), ["lang"], order=["source"]).select(
        "lang", "source", "p_holm", "reject"),
    "planned_contrasts": lambda s, d: cp.planned_contrasts(scores(s, d), N_TRAIN, N_TEST, baseline="baseline").select(
        "family", "a", "b", "t", "mean_difference", "dz"),
    "planned_contrasts_holm": lambda s, d: cp.planned_contrasts(scores(s, d), N_TRAIN, N_TEST, baseline="baseline"),
}

_CLASSES = f"""{LANGUAGE_GUESS}, names AS (SELECT DISTINCT y_true AS l FROM predictions UNION SELECT DISTINCT y_pred FROM predictions),
c AS (SELECT l, count(*) FILTER (y_true = l AND y_pred = l) AS tp, count(*) FILTER (y_pred = l) AS pr, count(*) FILTER (y_true = l) AS su
  FROM names JOIN predictions ON y_true = l OR y_pred = l GROUP BY l),
r AS (SELECT l AS label, coalesce(CAST(tp AS DOUBLE) / nullif(pr, 0), 0) AS p, coalesce(CAST(tp AS DOUBLE) / nullif(su, 0), 0) AS r,
  coalesce(CAST(2 * tp AS DOUBLE) / nullif(pr + su, 0), 0) AS f, su, tp FROM c)"""
_STEPS = f"""{PREDICTIONS}, g AS (SELECT score, count(*) FILTER (y_true = '1') AS p, count(*) FILTER (y_true <> '1') AS n FROM predictions GROUP BY score),
steps AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g
  WINDOW w AS (ORDER BY score DESC))"""
_T = "round(d_mean / sqrt({v}), 6)"
_FACTOR = f"(1 / CAST(k AS DOUBLE) + CAST({N_TEST} AS DOUBLE) / {N_TRAIN})"
_DZ = "round(CASE WHEN d_var = 0 THEN 0 ELSE d_mean / sqrt(d_var) END, 6) AS dz"

ORACLES = {
    "confusion_matrix": f"""WITH {_CLASSES} SELECT a.l AS y_true, b.l AS y_pred, count(p.doc_id) AS n FROM names a CROSS JOIN names b
        LEFT JOIN predictions p ON p.y_true = a.l AND p.y_pred = b.l GROUP BY ALL""",
    "classification_report": f"""WITH {_CLASSES} SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, su AS support FROM r
        UNION ALL SELECT 'accuracy', round(sum(tp) / sum(su), 6), round(sum(tp) / sum(su), 6), round(sum(tp) / sum(su), 6), CAST(sum(su) AS BIGINT) FROM r
        UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(su) AS BIGINT) FROM r
        UNION ALL SELECT 'weighted avg', round(sum(p * su) / sum(su), 6), round(sum(r * su) / sum(su), 6), round(sum(f * su) / sum(su), 6),
        CAST(sum(su) AS BIGINT) FROM r""",
    "multilabel_metrics": f"""WITH {ML_PREDICTIONS}, l AS (SELECT label, sum(y_true * y_pred) AS tp, sum(y_pred) AS pr, sum(y_true) AS su
        FROM ml_predictions GROUP BY label), d AS (SELECT doc_id, bool_and(y_true = y_pred) AS ok FROM ml_predictions GROUP BY doc_id)
        SELECT (SELECT round(avg(CAST(y_true <> y_pred AS DOUBLE)), 6) FROM ml_predictions) AS hamming_loss,
        round(avg(coalesce(CAST(2 * tp AS DOUBLE) / nullif(pr + su, 0), 0)), 6) AS f1_macro,
        round(CAST(2 * sum(tp) AS DOUBLE) / (sum(pr) + sum(su)), 6) AS f1_micro,
        (SELECT round(avg(CAST(ok AS DOUBLE)), 6) FROM d) AS subset_accuracy FROM l""",
    "multilabel_report": f"""WITH {ML_PREDICTIONS} SELECT label, round(coalesce(CAST(sum(y_true * y_pred) AS DOUBLE) / nullif(sum(y_pred), 0), 0), 6) AS precision,
        round(coalesce(CAST(sum(y_true * y_pred) AS DOUBLE) / nullif(sum(y_true), 0), 0), 6) AS recall,
        round(coalesce(CAST(2 * sum(y_true * y_pred) AS DOUBLE) / nullif(sum(y_true) + sum(y_pred), 0), 0), 6) AS f1,
        CAST(sum(y_true) AS BIGINT) AS support FROM ml_predictions GROUP BY label""",
    "binary_rates": f"""WITH {PREDICTIONS} SELECT round(CAST(count(*) FILTER (y_true = '1' AND y_pred = '1') AS DOUBLE) / count(*) FILTER (y_true = '1'), 6) AS tpr,
        round(CAST(count(*) FILTER (y_true = '0' AND y_pred = '1') AS DOUBLE) / count(*) FILTER (y_true = '0'), 6) AS fpr FROM predictions""",
    "misclassified": f"""WITH {PREDICTIONS} SELECT doc_id, CASE WHEN y_true = '1' AND y_pred = '0' THEN 'type II' ELSE 'type I' END AS error, text
        FROM predictions JOIN documents USING (doc_id) WHERE y_true <> y_pred""",
    "degenerate_probs": f"WITH {PREDICTIONS} SELECT bool_and(round(score, 6) IN (0, 1)) AS degenerate FROM predictions",
    "roc_curve": f"""WITH {_STEPS} SELECT round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr FROM steps UNION ALL
        SELECT CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)""",
    "auc": f"WITH {_STEPS} SELECT round(sum(n * (tp - p / 2)) / max(CAST(np AS DOUBLE) * nn), 6) AS auc FROM steps",
    "cv_summary": f"""WITH {SCORES} SELECT dataset, model, feature, metric, count(*) AS folds, round(avg(value), 6) AS mean,
        round(stddev_samp(value), 6) AS std FROM scores GROUP BY ALL""",
    "paired_ttest": f"WITH {DIFFS} SELECT a, b, {_T.format(v='d_var / k')} AS t, k - 1 AS df FROM diffs",
    "corrected_ttest": f"""WITH {DIFFS} SELECT dataset, metric, a, b, {_T.format(v=_FACTOR + ' * d_var')} AS t, k - 1 AS df,
        round({_FACTOR}, 6) AS correction, round(d_mean, 6) AS mean_difference FROM diffs""",
    "cohens_dz": f"WITH {DIFFS} SELECT dataset, metric, a, b, {_DZ} FROM diffs",
    "holm_bonferroni": """WITH t AS (SELECT lang, source, avg(CAST(n_chars % 97 AS DOUBLE)) / 970 AS p FROM documents GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p, source) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM t),
        h AS (SELECT lang, source, least(1, max((n - i) * p) OVER (PARTITION BY lang ORDER BY i)) AS a FROM r)
        SELECT lang, source, CAST(round(a, 6) AS DOUBLE) AS p_holm, a < 0.05 AS reject FROM h""",
    "planned_contrasts": f"""WITH {DIFFS} SELECT family, a, b, {_T.format(v=_FACTOR + ' * d_var')} AS t, round(d_mean, 6) AS mean_difference,
        {_DZ} FROM diffs""",
}
