"""Preprocessing, training and cross-validation put together.

The order prevents leakage: rows are split first, features are fitted on training rows only, and
only training rows are resampled.
"""

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from wordloom.operators import classifiers, metrics, resample, sampling
from wordloom.operators.features import Standardizer, TextVectors, WordVectors
from wordloom.operators.normalize import normalize_corpus
from wordloom.plans import folds
from wordloom.plans.storage import materialize


@dataclass
class Settings:
    """What to do with the texts before a model sees them."""

    feature: str | None = "tfidf"
    max_n: int = 2
    min_df: int = 2
    max_features: int = 10_000
    vector_size: int = 100
    stemming: bool = False
    remove_stopwords: bool = False
    resampling: str | None = None
    seed: int = 42
    epochs: int = 10
    percent: float | None = None  # of the distinct words, in place of max_features
    neighbors: int = 5  # of SMOTE


DEFAULT = Settings(max_n=1, min_df=1, max_features=1000)


class Preprocessor:
    """Normalization, one feature extractor and, for word vectors, scaling."""

    def __init__(self, settings: Settings, text: str = "text", id: str = "doc_id", lemmas: DataFrame | None = None):
        if settings.feature not in ("tf", "tfidf", "word2vec"):
            raise ValueError("no feature extraction selected: choose tf, tfidf or word2vec")
        self.s, self.text, self.id, self.lemmas = settings, text, id, lemmas

    def normalize(self, df: DataFrame) -> DataFrame:
        return normalize_corpus(df, self.text, self.id, self.s.stemming, self.lemmas, self.s.remove_stopwords)

    def fit(self, train: DataFrame) -> "Preprocessor":
        docs = self.normalize(train)
        if self.s.feature == "word2vec":
            self.vectors = WordVectors(self.s.vector_size, epochs=self.s.epochs, seed=self.s.seed, text=self.text,
                                       id=self.id).fit(docs)
            self.scaler = Standardizer().fit(self.vectors.transform(docs))
        else:
            self.vectors = TextVectors(self.s.feature == "tfidf", self.s.max_n, self.s.min_df, self.s.max_features,
                                       self.text, percent=self.s.percent).fit(docs)
            self.scaler = None
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.vectors.transform(self.normalize(df))
        return out if self.scaler is None else self.scaler.transform(out)


def resampled(train: DataFrame, method: str | None, label: str, id: str, vector: str = "features",
              seed: int = 42, k: int = 5) -> DataFrame:
    """Balanced training rows (id, label, vector); `k` neighbours for SMOTE."""
    rows = train.select(id, label, vector)
    if method is None:
        return rows
    if method == "smote":
        return resample.smote(rows, label, id, vector, k, seed).select(id, label, vector)
    if method == "oversample":
        return sampling.random_oversample(rows, label, id, seed).drop("copy")
    if method == "undersample":
        return sampling.random_undersample(rows, label, id, seed)
    raise ValueError(f"unknown resampling {method!r}")


def preprocess(df: DataFrame, settings: Settings, label: str = "label", id: str = "doc_id",
               text: str = "text", lemmas: DataFrame | None = None) -> DataFrame:
    """Summary rows (label, n_before, n_after, n_synthetic, no_op, method, applied, params, vocab_size, n_features)."""
    fitted = Preprocessor(settings, text, id, lemmas).fit(df)
    before = materialize(fitted.transform(df).select(id, label, "features"))
    after = resampled(before, settings.resampling, label, id, seed=settings.seed, k=settings.neighbors)
    size = fitted.vectors.vocabulary_size
    width = settings.vector_size if settings.feature == "word2vec" else size
    report = sampling.resampling_report(before, after, settings.resampling or "none", label)
    params = {"seed": settings.seed} | ({"k": settings.neighbors} if settings.resampling == "smote" else {})
    return report.withColumns({"applied": F.lit(settings.resampling is not None) & ~F.col("no_op"),
                               "params": F.lit(json.dumps(params)), "vocab_size": F.lit(size).cast("bigint"), "n_features": F.lit(width).cast("bigint")})


def train_and_predict(df: DataFrame, model: str, settings: Settings = DEFAULT, label: str = "label",
                      id: str = "doc_id", text: str = "text", test_size: float = 0.3,
                      lemmas: DataFrame | None = None) -> DataFrame:
    """(id, y_true, y_pred, probability) for the held-out rows of a stratified split."""
    classifiers.check_model_features(model, settings.feature)
    split = materialize(sampling.train_test_split(df, label, id, test_size, settings.seed))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    return fit_predict(train, test, model, settings, label, id, text, lemmas)


def fit_predict(train: DataFrame, test: DataFrame, model: str, settings: Settings, label: str = "label",
                id: str = "doc_id", text: str = "text", lemmas: DataFrame | None = None) -> DataFrame:
    fitted = Preprocessor(settings, text, id, lemmas).fit(train)
    x_train = materialize(fitted.transform(train).select(id, label, "features"))
    x_test = materialize(fitted.transform(test).select(id, label, "features"))
    x_train = resampled(x_train, settings.resampling, label, id, seed=settings.seed, k=settings.neighbors)
    return with_truth(classifiers.predict(model, x_train, x_test, label, id), x_test, label, id)


def with_truth(predictions: DataFrame, test: DataFrame, label: str, id: str) -> DataFrame:
    truth = test.select(id, F.col(label).cast("string").alias("y_true"))
    return truth.join(predictions.withColumnRenamed("prediction", "y_pred"), id)


SCORES = "dataset string, model string, feature string, fold int, metric string, value double"


def cross_validate(folded: DataFrame, models: list[str], features: list[str], label: str = "label", id: str = "doc_id",
                   text: str = "text", dataset: str = "corpus", positive: str | None = None,
                   settings: Settings = Settings(), variants: dict | None = None, counts: list | None = None,
                   lemmas: DataFrame | None = None) -> DataFrame:
    """Scores of every accepted model and feature on every fold of a `fold` column.

    All folds, features and models are trained together: counts of all but the held-out fold come from
    one table of counts by fold, and each step of logistic regression and SVMs is one pass for all of
    them. `variants` maps a further model name to (model, None or 'smote'). `counts` is a list that gets
    (fold, resampling, class, rows) of every training set. `positive` adds the area under the ROC curve
    of that class of two. Rows with a null label take no part.
    """
    spark = folded.sparkSession
    plans = {m: (m, None) for m in models if classifiers.MODEL_FEATURES[m].intersection(features)} | (variants or {})
    if not plans:
        return spark.createDataFrame([], SCORES)
    data = folds.Folds(folded, [label], id, text, settings, lemmas)
    found, rows = data.predictions(plans, classifiers.MODEL_FEATURES, features)
    scores = [(dataset, name, feature, held, metric, float(value)) for (name, feature, held), values in folds.pair_scores(found).items()
              for metric, value in values.items()]
    if positive is not None and positive in data.classes[0]:
        at = data.classes[0].index(positive)
        scored = found.filter("y >= 0").withColumns({"y_true": F.col("y").cast("string"), "score": F.col("score") if at == 1 else 1 - F.col("score")})
        scores += [(dataset, *key, "auc", float(metrics.auc(scored.filter((F.col("name") == key[0]) & (F.col("feature") == key[1]) & (
            F.col("held") == key[2])), positive=str(at)).first()["auc"])) for key in folds.pair_scores(found)]
    if counts is not None:
        sizes = rows.filter("part <> 'test' AND y[0] >= 0").groupBy("feature", "held", "part", F.col("y")[0].alias("y")).count().collect()
        kind = folded.schema[label].dataType
        own = {str(r[0]): r[0] for r in folded.select(label).distinct().collect()} if kind.simpleString() != "string" else {}  # classes
        for method in {m for _, m in plans.values()}:
            total: dict = {}
            for r in sizes:
                if r.feature == features[0] and (method or r.part == "train"):
                    total[r.held, r.y] = total.get((r.held, r.y), 0) + r["count"]
            counts += [(held, method, own.get(data.classes[0][y], data.classes[0][y]), n) for (held, y), n in sorted(total.items())]
    return spark.createDataFrame(sorted(scores), SCORES)


def cross_validate_multilabel(folded: DataFrame, models: list[str], features: list[str], label_columns: list[str],
                              id: str = "doc_id", text: str = "text", dataset: str = "corpus",
                              settings: Settings = Settings(), lemmas: DataFrame | None = None) -> DataFrame:
    """Multi-label scores per fold, with the constant baseline: labels, folds, features and models are trained together."""
    spark = folded.sparkSession
    data = folds.Folds(folded, label_columns, id, text, settings, lemmas)
    plans = {m: (m, None) for m in models if classifiers.MODEL_FEATURES[m].intersection(features)}
    at = lambda c: F.coalesce(*[F.when((F.col("target") == t) & (F.col(c) >= 0), F.get(F.array(*[F.lit(int(x)) for x in names]), F.col(c)))
                                for t, names in enumerate(data.classes)])
    shares = data.docs.select("fold", F.posexplode("y").alias("target", "y")).groupBy("fold", "target").agg(
        F.count("*").alias("n"), F.sum(at("y")).alias("positive")).collect()  # folds times labels
    total = {t: (sum(r.n for r in shares if r.target == t), sum(r.positive or 0 for r in shares if r.target == t)) for t in range(len(label_columns))}
    rules = {(r.fold, r.target): int(2 * (total[r.target][1] - (r.positive or 0)) > total[r.target][0] - r.n) for r in shares}
    rule = F.element_at(F.create_map(*[F.lit(v) for (f, t), x in rules.items() for v in (f"{f}:{t}", x)]), F.concat_ws(":", "fold", "target"))
    found = data.docs.select("row", "fold", F.posexplode("y").alias("target", "y")).select(
        F.lit("-").alias("feature"), F.col("fold").alias("held"), F.lit("baseline").alias("name"), "row", "target", at("y").alias("y_true"), rule.alias("y_pred"))
    if plans:
        predicted, _ = data.predictions(plans, classifiers.MODEL_FEATURES, features)
        found = found.union(predicted.select("feature", "held", "name", "row", "target", at("y").alias("y_true"), at("pred").alias("y_pred")))
    keys = ["name", "feature", "held"]
    wide = metrics.multilabel_metrics_by(found.filter("y_true IS NOT NULL").withColumnRenamed("target", "label"), keys, "row").collect()  # models times folds
    rows = [(dataset, r.name, r.feature, r.held, m, float(r[m])) for r in wide for m in ("hamming_loss", "f1_macro", "f1_micro", "subset_accuracy")]
    return spark.createDataFrame(sorted(rows), SCORES)


def smote_audit(folded: DataFrame, label: str = "label", id: str = "doc_id", text: str = "text",
                settings: Settings = Settings(), models: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Does SMOTE change anything? Returns (scores, class counts per fold before and after).

    Every model runs with and without SMOTE on the same folds, and naive Bayes also with its
    Gaussian form on the SMOTE rows, which separates the resampling from a change of classifier.
    """
    variants = models or {"nb_plain": ("nb", None), "nb_smote_multinomial": ("nb", "smote"),
                          "nb_smote_gaussian": ("gaussian_nb", "smote"), "lr_plain": ("lr", None),
                          "lr_smote": ("lr", "smote"), "knn_plain": ("knn", None), "knn_smote": ("knn", "smote")}
    seen: list[tuple] = []
    scores = cross_validate(folded, [], ["tfidf"], label, id, text, "smote_audit", None, settings, variants, seen)
    kind = folded.schema[label].dataType.simpleString()
    found = folded.sparkSession.createDataFrame(seen, f"fold int, method string, `{label}` {kind}, n bigint")
    before = found.filter("method IS NULL").select("fold", label, F.col("n").alias("n_before"))
    after = found.filter("method = 'smote'").select("fold", label, F.col("n").alias("n_after"))
    counts = before.join(after, ["fold", label]).withColumn("n_synthetic", F.col("n_after") - F.col("n_before"))
    return scores, counts


def audit_effects(scores: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Mean effect of resampling and of swapping the classifier, over folds."""
    wide = scores.filter(F.col("metric") == metric).groupBy("dataset", "fold").pivot(
        "model", ["nb_plain", "nb_smote_multinomial", "nb_smote_gaussian"]).agg(F.first("value"))
    return wide.groupBy("dataset").agg(
        F.round(F.avg(F.col("nb_smote_multinomial") - F.col("nb_plain")), 6).alias("resampling_effect"),
        F.round(F.avg(F.col("nb_smote_gaussian") - F.col("nb_smote_multinomial")), 6).alias("classifier_effect"))
