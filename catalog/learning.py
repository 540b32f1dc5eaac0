"""Features, sampling, resampling, models."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from catalog.common import documents, labelled, ngrams_sql, table, words_sql
from wordloom.operators import classifiers as cl, features as ft, metrics as mt, sampling as sp
from wordloom.operators.neighbors import knn_join, knn_predict
from wordloom.operators.resample import smote, smote_neighbors
from wordloom.plans import experiments as ex
from wordloom.plans.storage import materialize

FEATURES = ["tfidf", "tf", "word2vec"]


def _docs(spark, sf) -> DataFrame:
    return documents(spark, sf).select("doc_id", "text", F.col("lang").alias("label"))


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))


def _vector_split(spark, sf) -> tuple[DataFrame, DataFrame]:
    split = sp.train_test_split(_vectors(spark, sf), "label", "vec_id")
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


def _ml_vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    def dense(df):
        return df.withColumn("features", array_to_vector(F.col("features").cast("array<double>")))

    train, test = _vector_split(spark, sf)
    return dense(train), dense(test)


def _tf(spark, sf, weights=None, percent=100.0, max_n=2, **fit):
    docs = _docs(spark, sf)
    vocabulary = ft.fit_vocabulary(docs, percent=percent, max_n=max_n, **fit)
    return (weights or ft.tf_features)(docs, vocabulary, max_n=max_n)


def _sublinear(docs, vocabulary, max_n):
    return ft.tfidf_features(docs, vocabulary, max_n=max_n, sublinear=True)


def _naive_bayes(spark, sf):
    split = materialize(sp.train_test_split(_docs(spark, sf)))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    vocabulary = ft.fit_vocabulary(train, percent=None, max_n=1)
    model = cl.naive_bayes_fit(ft.tf_features(train, vocabulary, max_n=1), train, vocabulary)
    return cl.naive_bayes_predict(model, ft.tf_features(test, vocabulary, max_n=1), test)


def _report(model, settings=ex.Settings(), pick=_docs):
    """Weighted scores of one model on the held-out rows."""
    def run(spark, sf):
        return mt.classification_report(ex.train_and_predict(pick(spark, sf), model, settings))
    return run


def _dense_report(model):
    def run(spark, sf):
        train, test = (materialize(x) for x in _ml_vectors(spark, sf))
        found = cl.predict(model, train, test, "label", "vec_id")
        return mt.classification_report(ex.with_truth(found, test, "label", "vec_id"))
    return run


def _flags(spark, sf) -> DataFrame:
    return labelled(spark, sf).select("doc_id", "text", "quality", "toxic")


def _relevance(spark, sf) -> DataFrame:
    split = materialize(sp.train_test_split(_flags(spark, sf), None))
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    prepared = ex.Preprocessor(ex.Settings()).fit(train)
    return mt.multilabel_metrics(cl.binary_relevance("lr", prepared.transform(train), prepared.transform(test),
                                                     ["quality", "toxic"]))


def _baseline(spark, sf) -> DataFrame:
    split = sp.train_test_split(_flags(spark, sf), None)
    return cl.constant_baseline(split.filter("split = 'train'"), split.filter("split = 'test'"), ["quality", "toxic"])


def _word_vectors(spark, sf) -> DataFrame:
    docs = _docs(spark, sf)
    vectors = ft.WordVectors().fit(docs).transform(docs)
    return vectors.select("doc_id", F.round(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x), 6)
                          .alias("square_length"))


def _smote(spark, sf) -> DataFrame:
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return smote(_vectors(spark, sf), "label", "vec_id").select(
        "vec_id", "label", "draw", "neighbor_id", F.round("gap", 6).alias("gap"), F.round(total, 6).alias("total"))


def _resampling_report(method):
    def run(spark, sf):
        before = _docs(spark, sf)
        after = {"oversample": sp.random_oversample, "undersample": sp.random_undersample}[method](before)
        return sp.resampling_report(before, after, method)
    return run


def _cross_validate(spark, sf):
    return ex.cross_validate(sp.stratified_kfold(_docs(spark, sf)), list(cl.MODEL_FEATURES), FEATURES, dataset="documents")


def _cross_validate_multilabel(spark, sf):
    folded = sp.multilabel_kfold(_flags(spark, sf), ["quality", "toxic"])
    return ex.cross_validate_multilabel(folded, list(cl.MODEL_FEATURES), FEATURES, ["quality", "toxic"], dataset="labels")


def _accepted(spark, sf) -> DataFrame:
    """(model, feature, accepted, classes): what each model takes, beside the classes it would tell apart."""
    def taken(model, feature):
        try:
            cl.check_model_features(model, feature)
            return True
        except ValueError:
            return False

    rows = [(m, f, taken(m, f)) for m in cl.MODEL_FEATURES for f in ("tf", "tfidf", "word2vec")]
    classes = documents(spark, sf).agg(F.count_distinct("lang").alias("classes"))
    return spark.createDataFrame(rows, "model string, feature string, accepted boolean").withColumn("classes", classes.scalar())


def _audit(spark, sf):
    rows = labelled(spark, sf).select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    scores, counts = ex.smote_audit(materialize(sp.stratified_kfold(rows)))
    effects = ex.audit_effects(scores)
    return counts.groupBy().agg(F.sum("n_synthetic").alias("n_synthetic")).withColumns(
        {c: effects.select(c).scalar() for c in ("resampling_effect", "classifier_effect")})


QUERIES = {
    "tf_features": lambda s, d: _tf(s, d),
    "tfidf_features": lambda s, d: _tf(s, d, ft.tfidf_features),
    "tfidf_default": lambda s, d: _tf(s, d, ft.tfidf_features, max_n=1, min_df=1, max_features=1000),
    "tfidf_sublinear": lambda s, d: _tf(s, d, _sublinear, max_n=1),
    "word2vec_doc_vectors": _word_vectors,
    "standardize": lambda s, d: ft.vector_long(ft.standardize(_vectors(s, d)), "vec_id").withColumn(
        "value", F.round("value", 6)),
    "preprocess": lambda s, d: ex.preprocess(_docs(s, d), ex.Settings(resampling="oversample")),
    "stratified_sample": lambda s, d: sp.stratified_sample(_docs(s, d), 25).select("doc_id", "label"),
    "train_test_split": lambda s, d: sp.train_test_split(_docs(s, d)).select("doc_id", "label", "split"),
    "train_test_split_plain": lambda s, d: sp.train_test_split(_flags(s, d), None).select("doc_id", "split"),
    "stratified_kfold": lambda s, d: sp.stratified_kfold(_docs(s, d)).select("doc_id", "label", "fold"),
    "multilabel_kfold": lambda s, d: sp.multilabel_kfold(_flags(s, d), ["quality", "toxic"]).select("doc_id", "fold"),
    "fold_positives": lambda s, d: sp.fold_positives(sp.multilabel_kfold(_flags(s, d), ["quality", "toxic"]), ["quality", "toxic"]),
    "random_oversample": lambda s, d: sp.random_oversample(_docs(s, d)).select("doc_id", "label", "copy"),
    "random_undersample": lambda s, d: sp.random_undersample(_docs(s, d)).select("doc_id", "label"),
    "smote_neighbors": lambda s, d: smote_neighbors(_vectors(s, d), "label", "vec_id").withColumn("distance", F.round("distance", 6)),
    "smote": _smote,
    "resampling_report": _resampling_report("oversample"),
    "resampling_report_under": _resampling_report("undersample"),
    "leakage_check": lambda s, d: sp.leakage_check(sp.train_test_split(_docs(s, d))),
    "leakage_check_text": lambda s, d: sp.leakage_check(sp.train_test_split(_docs(s, d)), text="text"),
    "split_preview": lambda s, d: sp.split_preview(_docs(s, d)),
    "knn_join": lambda s, d: knn_join(*reversed(_vector_split(s, d)), 5, "vec_id").withColumn("distance", F.round("distance", 6)),
    "model_knn": lambda s, d: knn_predict(*_vector_split(s, d), 5, "label", "vec_id").select("vec_id", "prediction", "score"),
    "model_nb": _naive_bayes,
    "model_nb_tfidf": _report("nb"),
    "model_lr": _report("lr", ex.DEFAULT),
    "model_svm": _report("svm"),
    "model_knn_tfidf": _report("knn"),
    "model_gaussian_nb": _dense_report("gaussian_nb"),
    "model_gda": _dense_report("gda"),
    "binary_relevance": _relevance,
    "check_model_features": _accepted,
    "constant_baseline": _baseline,
    "cross_validate": _cross_validate,
    "cross_validate_multilabel": _cross_validate_multilabel,
    "smote_audit": _audit,
}


def _counts_sql(docs: str, max_n: int) -> str:
    grams = "w" if max_n == 1 else f"list_concat(w, {ngrams_sql('w', 2)})"
    return f"""counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({grams}) AS term FROM (
      SELECT doc_id, {words_sql('text')} AS w FROM {docs})) GROUP BY ALL)"""


def _vocab_sql(docs: str, max_n: int, min_df: int, size: str) -> str:
    return f"""{_counts_sql(docs, max_n)}, stats AS (SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY term),
    vocab AS (SELECT term, df FROM stats WHERE df >= {min_df} QUALIFY row_number() OVER (
      ORDER BY total DESC, substr(md5(term), 1, 3), term) <= {size})"""


_WHOLE = "(SELECT greatest(10, count(*)) FROM stats WHERE NOT contains(term, ' '))"


def _tfidf_sql(vocab: str, tf: str = "tf") -> str:
    return f"""WITH {vocab}, raw AS (SELECT doc_id, term, {tf} * (ln(CAST(1 + (SELECT count(*) FROM documents) AS DOUBLE) / (1 + df)) + 1) AS w
      FROM counts JOIN vocab USING (term)) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""


def _split_sql(source: str, id: str, label: str | None) -> str:
    part = f"PARTITION BY {label} " if label else ""
    group = label or "1"
    return f"""sizes AS (SELECT g, n, CAST(ceil(sum(n) OVER () * CAST(0.3 AS DOUBLE)) AS BIGINT) AS t, CAST(sum(n) OVER () AS BIGINT) AS a
      FROM (SELECT {group} AS g, count(*) AS n FROM {source} GROUP BY 1)),
    quota AS (SELECT g, n * t // a + CASE WHEN row_number() OVER (ORDER BY n * t % a DESC, g) <= t - sum(n * t // a) OVER ()
      THEN 1 ELSE 0 END AS q FROM sizes),
    placed AS (SELECT *, {group} AS g, row_number() OVER ({part}ORDER BY md5('42:' || {id}), {id}) AS i FROM {source}),
    split AS (SELECT placed.*, CASE WHEN i <= q THEN 'test' ELSE 'train' END AS split FROM placed JOIN quota USING (g))"""


_ROW = "row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id)"
_FLAGS = "flags AS (SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id))"
_MLFOLD = f"""{_FLAGS}, sets AS (SELECT *, quality || ',' || toxic AS s FROM flags),
starts AS (SELECT s, coalesce(sum(count(*)) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sets GROUP BY s),
folded AS (SELECT doc_id, quality, toxic, CAST((b + row_number() OVER (PARTITION BY s ORDER BY md5('42:' || doc_id), doc_id) - 1) % 10
  AS BIGINT) AS fold FROM sets JOIN starts USING (s))"""


def _random_sql(seed: int, *parts: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || " + " || ':' || ".join(parts) + "), 1, 15) AS BIGINT)"


def _knn_sql(queries: str, points: str, k: str, same: str = "true") -> str:
    return f"""near AS (SELECT q.vec_id, p.vec_id AS neighbor_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))
      AS distance, q.label, p.label AS p_label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]),
      CAST(p.embedding AS DOUBLE[])), p.vec_id) AS rank FROM {queries} q JOIN {points} p ON {same} QUALIFY rank <= {k})"""


_VSPLIT = f"""{_split_sql('embeddings', 'vec_id', 'label')}, tr AS (SELECT * FROM split WHERE split = 'train'),
te AS (SELECT * FROM split WHERE split = 'test')"""
_SMALL = """cls AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS top, min(count(*)) OVER () AS low FROM embeddings GROUP BY label),
small AS (SELECT e.* FROM embeddings e JOIN cls USING (label) WHERE n < top)"""
_SMOTE_NEAR = f"{_SMALL}, {_knn_sql('small', 'small', '(SELECT greatest(1, least(5, max(low) - 1)) FROM cls)', 'q.label = p.label AND q.vec_id <> p.vec_id')}"
_OVER = f"""cls AS (SELECT lang, count(*) AS n, max(count(*)) OVER () AS top FROM documents GROUP BY lang),
draws AS (SELECT lang, n, unnest(range(1, top - n + 1)) AS i FROM cls),
picks AS (SELECT lang, {_random_sql(42, 'lang', 'i')} % n + 1 AS p FROM draws),
placed AS (SELECT doc_id, lang, {_ROW} AS p FROM documents)"""

ORACLES = {
    "preprocess": f"""WITH {_counts_sql('documents', 2)}, stats AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
    sizes AS (SELECT lang AS label, count(*) AS n_before FROM documents GROUP BY ALL),
    after AS (SELECT *, max(n_before) OVER () AS n_after FROM sizes),
    grown AS (SELECT *, CAST(sum(n_after - n_before) OVER () AS BIGINT) AS n_synthetic FROM after),
    kept AS (SELECT least(10000, count(*)) AS v FROM stats WHERE df >= 2)
    SELECT grown.*, n_synthetic = 0 AS no_op, 'oversample' AS method, n_synthetic > 0 AS applied, '{{"seed": 42}}' AS params,
      v AS vocab_size, v AS n_features FROM grown, kept""",
    "check_model_features": """SELECT model, feature, NOT ((model = 'nb' AND feature = 'word2vec') OR (model = 'gda' AND feature <> 'word2vec'))
        AS accepted, (SELECT count(DISTINCT lang) FROM documents) AS classes FROM (VALUES ('nb'), ('gda'), ('lr'), ('svm'), ('knn')) m(model),
        (VALUES ('tf'), ('tfidf'), ('word2vec')) f(feature)""",
    "tf_features": f"WITH {_vocab_sql('documents', 2, 2, _WHOLE)} SELECT doc_id, term, tf FROM counts SEMI JOIN vocab USING (term)",
    "tfidf_features": _tfidf_sql(_vocab_sql("documents", 2, 2, _WHOLE)),
    "tfidf_default": _tfidf_sql(_vocab_sql("documents", 1, 1, "1000")),
    "tfidf_sublinear": _tfidf_sql(_vocab_sql("documents", 1, 2, _WHOLE), "(1 + ln(CAST(tf AS DOUBLE)))"),
    "standardize": """WITH x AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim,
        CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT vec_id, dim, round((v - avg(v) OVER (PARTITION BY dim))
        / stddev_pop(v) OVER (PARTITION BY dim), 6) AS value FROM x""",
    "stratified_sample": f"SELECT doc_id, lang AS label FROM documents QUALIFY {_ROW} <= 25",
    "train_test_split": f"WITH {_split_sql('documents', 'doc_id', 'lang')} SELECT doc_id, lang AS label, split FROM split",
    "train_test_split_plain": f"WITH {_FLAGS}, {_split_sql('flags', 'doc_id', None)} SELECT doc_id, split FROM split",
    "stratified_kfold": f"SELECT doc_id, lang AS label, ({_ROW} - 1) % 10 AS fold FROM documents",
    "multilabel_kfold": f"WITH {_MLFOLD} SELECT doc_id, fold FROM folded",
    "fold_positives": f"""WITH {_MLFOLD} SELECT fold, count(*) AS documents, CAST(sum(quality) AS BIGINT) AS quality,
        CAST(sum(toxic) AS BIGINT) AS toxic FROM folded GROUP BY fold""",
    "random_oversample": f"""WITH {_OVER} SELECT doc_id, lang AS label, CAST(0 AS BIGINT) AS copy FROM documents UNION ALL
        SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id) FROM picks JOIN placed USING (lang, p)""",
    "random_undersample": f"""SELECT doc_id, lang AS label FROM documents QUALIFY {_ROW} <=
        (SELECT min(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""",
    "smote_neighbors": f"WITH {_SMOTE_NEAR} SELECT vec_id, neighbor_id, rank, round(distance, 6) AS distance FROM near",
    "smote": f"""WITH {_SMOTE_NEAR}, draws AS (SELECT label, n, unnest(range(1, top - n + 1)) AS draw FROM cls),
        placed AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS p FROM embeddings),
        base AS (SELECT d.label, draw, vec_id, embedding AS x FROM draws d JOIN placed b ON b.label = d.label AND b.p =
          {_random_sql(42, 'd.label', 'draw')} % n + 1),
        cnt AS (SELECT vec_id, max(rank) AS m FROM near GROUP BY vec_id),
        picked AS (SELECT b.*, neighbor_id, {_random_sql(44, 'b.label', 'draw')} / CAST(1152921504606846976 AS DOUBLE) AS gap
          FROM base b JOIN cnt USING (vec_id) JOIN near ON near.vec_id = b.vec_id AND near.rank = {_random_sql(43, 'b.label', 'draw')} % m + 1),
        made AS (SELECT p.vec_id, p.label, draw, neighbor_id, gap, list_sum(list_transform(range(1, len(x) + 1), lambda i:
          CAST(x[i] AS DOUBLE) + gap * (CAST(e.embedding[i] AS DOUBLE) - CAST(x[i] AS DOUBLE)))) AS total
          FROM picked p JOIN embeddings e ON e.vec_id = neighbor_id)
        SELECT vec_id, label, CAST(0 AS BIGINT) AS draw, CAST(NULL AS BIGINT) AS neighbor_id, CAST(NULL AS DOUBLE) AS gap,
          round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings UNION ALL
        SELECT vec_id, label, draw, neighbor_id, round(gap, 6), round(total, 6) FROM made""",
    "resampling_report": """WITH c AS (SELECT lang AS label, count(*) AS n_before, max(count(*)) OVER () AS n_after FROM documents GROUP BY lang)
        SELECT label, n_before, n_after, CAST(sum(n_after - n_before) OVER () AS BIGINT) AS n_synthetic,
        sum(n_after - n_before) OVER () = 0 AS no_op, 'oversample' AS method FROM c""",
    "resampling_report_under": """WITH c AS (SELECT lang AS label, count(*) AS n_before, min(count(*)) OVER () AS n_after FROM documents GROUP BY lang)
        SELECT label, n_before, n_after, CAST(sum(n_after - n_before) OVER () AS BIGINT) AS n_synthetic,
        sum(n_after - n_before) OVER () = 0 AS no_op, 'undersample' AS method FROM c""",
    "leakage_check": f"""WITH {_split_sql('documents', 'doc_id', 'lang')} SELECT count(*) FILTER (split = 'train') AS n_train,
        count(*) FILTER (split = 'test') AS n_test, CAST(0 AS BIGINT) AS n_leaked FROM split""",
    "leakage_check_text": f"""WITH {_split_sql('documents', 'doc_id', 'lang')} SELECT count(*) FILTER (split = 'train') AS n_train,
        count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'test' AND text IN (SELECT text FROM split WHERE split = 'train'))
        AS n_leaked FROM split""",
    "split_preview": """SELECT CAST(a - t AS BIGINT) AS n_train, CAST(t AS BIGINT) AS n_test, CAST(m AS BIGINT) AS smallest_test_class,
        m < 10 AS warning FROM (SELECT sum(n) AS a, floor(sum(n) * 20 / 100 + 0.5) AS t, min(floor(n * 20 / 100 + 0.5)) AS m
        FROM (SELECT count(*) AS n FROM documents GROUP BY lang))""",
    "knn_join": f"WITH {_VSPLIT}, {_knn_sql('te', 'tr', '5')} SELECT vec_id, neighbor_id, rank, round(distance, 6) AS distance FROM near",
    "model_knn": f"""WITH {_VSPLIT}, {_knn_sql('te', 'tr', '5')}, v AS (SELECT vec_id, CAST(p_label AS VARCHAR) AS l, count(*) AS n FROM near GROUP BY ALL)
        SELECT vec_id, l AS prediction, n / CAST(5 AS DOUBLE) AS score FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, l) = 1""",
    "model_nb": f"""WITH {_split_sql('documents', 'doc_id', 'lang')}, train AS (SELECT * FROM split WHERE split = 'train'),
        test AS (SELECT * FROM split WHERE split = 'test'), {_counts_sql('split', 1)},
        vocab AS (SELECT term FROM counts SEMI JOIN train USING (doc_id) GROUP BY term HAVING count(*) >= 2),
        prior AS (SELECT lang, ln(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)) AS p FROM train GROUP BY lang),
        seen AS (SELECT lang, term, sum(tf) AS w FROM counts JOIN train USING (doc_id) SEMI JOIN vocab USING (term) GROUP BY ALL),
        mass AS (SELECT lang, sum(w) + (SELECT count(*) FROM vocab) AS m FROM seen GROUP BY lang),
        grid AS (SELECT c.doc_id, lang, tf, term FROM counts c SEMI JOIN test USING (doc_id) SEMI JOIN vocab USING (term) CROSS JOIN prior),
        score AS (SELECT doc_id, lang, sum(tf * ln((coalesce(w, 0) + 1) / CAST(m AS DOUBLE))) AS s FROM grid JOIN mass USING (lang)
          LEFT JOIN seen USING (lang, term) GROUP BY ALL),
        joint AS (SELECT t.doc_id, prior.lang, p + coalesce(s, 0) AS s FROM test t CROSS JOIN prior LEFT JOIN score
          ON score.doc_id = t.doc_id AND score.lang = prior.lang)
        SELECT doc_id, lang AS prediction, round(s, 6) AS log_score FROM joint
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, lang) = 1""",
    "constant_baseline": f"""WITH {_FLAGS}, {_split_sql('flags', 'doc_id', None)} SELECT doc_id, 'quality' AS label, quality AS y_true,
        CAST((SELECT avg(quality) > 0.5 FROM split WHERE split = 'train') AS INT) AS y_pred FROM split WHERE split = 'test' UNION ALL
        SELECT doc_id, 'toxic', toxic, CAST((SELECT avg(toxic) > 0.5 FROM split WHERE split = 'train') AS INT) FROM split WHERE split = 'test'""",
}
