"""Features, sampling, neighbours, resampling and models on small corpora."""

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wordloom.operators import classifiers as cl, features as ft, metrics as mt, neighbors as nb, sampling as sp, terms
from wordloom.operators.neighbors import knn_join, knn_predict
from wordloom.operators.ranking import rank_by_frequency
from wordloom.operators.resample import smote
from wordloom.plans import experiments as ex


def counts(df, label="label"):
    return {r[label]: r["count"] for r in df.groupBy(label).count().collect()}


@pytest.fixture(scope="module")
def points(spark):
    """Three clouds of very different size, with copies."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        c = "hot" if i < 300 else ("mid" if i < 380 else "few")
        center = {"hot": 0.0, "mid": 4.0, "few": -4.0}[c]
        x = [0.0, 0.0, 0.0] if i % 9 == 0 and c == "hot" else [float(v) for v in rng.normal(center, 1, 3)]
        rows.append((i, c, x))
    return spark.createDataFrame(rows, "doc_id bigint, label string, features array<double>").cache()


def brute(points, k, exclude_self, same_group=False):
    data = points.collect()
    out = set()
    for q in data:
        near = sorted((float(np.sqrt(((np.array(q.features) - np.array(p.features)) ** 2).sum())), p.doc_id) for p in data
                      if not (exclude_self and p.doc_id == q.doc_id) and (not same_group or p.label == q.label))
        out |= {(q.doc_id, p, i + 1, round(d, 9)) for i, (d, p) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("tile,pivots,group", [(4096, None, None), (32, 5, None), (16, 1, None), (32, 4, "label")])
def test_knn_is_exact(points, tile, pivots, group):
    got = {(r.doc_id, r.neighbor_id, r.rank, round(r.distance, 9)) for r in
           knn_join(points, points, 5, group=group, exclude_self=True, pivots=pivots, tile=tile).collect()}
    assert got == brute(points, 5, True, group is not None)


def test_knn_with_fewer_points_than_k(spark, points):
    two = points.filter("doc_id < 2")
    assert knn_join(two, two, 5).count() == 4
    assert knn_join(two, points.limit(0), 5).count() == 0


def test_knn_predict_votes(spark):
    train = spark.createDataFrame([(1, "a", [0.0]), (2, "a", [1.0]), (3, "b", [1.5]), (4, "b", [9.0])],
                                  "doc_id bigint, label string, features array<double>")
    test = spark.createDataFrame([(10, "?", [0.9]), (11, "?", [8.0])], train.schema)
    got = {r.doc_id: (r.prediction, r.score) for r in knn_predict(train, test, 2).collect()}
    assert got == {10: ("a", 0.5), 11: ("b", 1.0)}


def test_knn_on_sparse_vectors(spark, corpus):
    vectors = ft.TextVectors(min_df=1).fit(corpus).transform(corpus).select("doc_id", "label", "features")
    dense = vectors.withColumn("features", vector_to_array("features"))
    pick = lambda df: sorted((r.doc_id, r.rank, r.neighbor_id, round(r.distance, 6)) for r in knn_join(df, df, 3).collect())
    assert pick(vectors) == pick(dense)


def test_stratified_sample(spark, imbalanced):
    assert set(counts(sp.stratified_sample(imbalanced, 5)).values()) == {5}
    with pytest.raises(ValueError, match="food"):
        sp.stratified_sample(imbalanced, 6)


def test_split_and_folds(corpus):
    split = sp.train_test_split(corpus)
    assert counts(split, "split") == {"train": 70, "test": 30}
    assert sorted(counts(split.filter("split = 'test'")).values()) == [7, 7, 8, 8]
    assert sp.leakage_check(split).first().n_leaked == 0
    folded = sp.stratified_kfold(corpus, 5)
    assert set(counts(folded, "fold").values()) == {20}
    again = sp.stratified_kfold(corpus.repartition(7), 5)
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, again.collect()))


def test_null_labels_are_a_group_of_their_own(spark):
    df = spark.createDataFrame([(i, None if i < 4 else "a") for i in range(10)], "doc_id bigint, label string")
    assert sp.stratified_kfold(df, 2).count() == 10


def test_multilabel_folds_are_even(multilabel):
    folded = sp.multilabel_kfold(multilabel, ["sport", "money", "space", "food"], 8)
    assert set(counts(folded, "fold").values()) == {10}


def test_over_and_undersampling(imbalanced):
    over = sp.random_oversample(imbalanced)
    assert set(counts(over).values()) == {25} and over.filter("copy = 0").count() == imbalanced.count()
    assert set(counts(sp.random_undersample(imbalanced)).values()) == {5}
    report = sp.resampling_report(imbalanced, sp.random_undersample(imbalanced), "undersample").first()
    assert report.n_synthetic == -60 and not report.no_op


def test_smote(points):
    out = smote(points)
    assert set(counts(out).values()) == {300}
    x = {r.doc_id: np.array(r.features) for r in points.collect()}
    made = out.filter("draw > 0").collect()
    assert len(made) == 500
    for r in made:
        assert 0 <= r.gap < 1
        assert np.allclose(r.features, x[r.doc_id] + r.gap * (x[r.neighbor_id] - x[r.doc_id]))


def test_smote_leaves_balanced_rows_alone(corpus):
    vectors = ft.TextVectors(min_df=1).fit(corpus).transform(corpus).select("doc_id", "label", "features")
    assert smote(vectors).count() == 100


def test_tfidf_rows_have_length_one(corpus):
    long = ft.tfidf_features(corpus, ft.fit_vocabulary(corpus))
    lengths = long.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n"))
    assert lengths.filter("abs(n - 1) > 1e-4").count() == 0


def test_vector_and_long_tfidf_agree(corpus):
    fitted = ft.TextVectors(max_features=100_000).fit(corpus)
    names = fitted.counter.vocabulary
    vectors = {(r.doc_id, names[i]): v for r in fitted.transform(corpus).select("doc_id", "features").collect()
               for i, v in zip(r.features.indices, r.features.values)}
    vocabulary = ft.fit_vocabulary(corpus, percent=None)
    long = {(r.doc_id, r.term): r.weight for r in ft.tfidf_features(corpus, vocabulary).collect()}
    assert vectors.keys() == long.keys() and all(abs(long[k] - v) < 1e-6 for k, v in vectors.items())


def test_vocabulary_percentage(corpus):
    assert ft.fit_vocabulary(corpus, percent=50).count() == 14
    assert ft.fit_vocabulary(corpus, percent=1).count() == 10


def test_word_vectors_and_scaling(spark, corpus):
    unknown = corpus.limit(1).withColumn("text", F.lit("nothing known")).withColumn("doc_id", F.lit(999).cast("bigint"))
    vectors = ft.WordVectors(8, epochs=1).fit(corpus)
    zero = vectors.transform(unknown).select(vector_to_array("features").alias("x")).first().x
    assert zero == [0.0] * 8
    scaled = ft.vector_long(ft.standardize(vectors.transform(corpus)), "doc_id")
    moments = scaled.groupBy("dim").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    assert moments.filter("abs(m) > 1e-6 OR abs(s - 1) > 1e-6").count() == 0


@pytest.mark.parametrize("model", ["nb", "lr", "svm", "knn"])
def test_models_learn(corpus, model):
    found = ex.train_and_predict(corpus, model, ex.Settings(min_df=1))
    assert found.count() == 30
    assert found.filter("y_true = y_pred").count() >= 28
    total = found.select(F.aggregate(F.map_values("probability"), F.lit(0.0), lambda a, x: a + x).alias("p"))
    assert total.filter("abs(p - 1) > 1e-6").count() == 0


def test_gda_learns(points):
    dense = ft.standardize(points)
    found = cl.predict("gda", dense, dense)
    assert found.join(points, "doc_id").filter("prediction = label").count() > 380


def test_naive_bayes_in_long_form(corpus):
    vocabulary = ft.fit_vocabulary(corpus, percent=None, max_n=1)
    tf = ft.tf_features(corpus, vocabulary, max_n=1)
    found = cl.naive_bayes_predict(cl.naive_bayes_fit(tf, corpus, vocabulary), tf, corpus)
    assert found.join(corpus, "doc_id").filter("prediction = label").count() == 100


@pytest.mark.parametrize("model,feature", [("nb", "word2vec"), ("gda", "tf"), ("gda", "tfidf"), ("lr", None), ("tree", "tf")])
def test_unfit_features_are_refused(corpus, model, feature):
    with pytest.raises(ValueError):
        ex.train_and_predict(corpus, model, ex.Settings(feature=feature))


def test_no_extractor_is_an_error(corpus):
    with pytest.raises(ValueError):
        ex.preprocess(corpus, ex.Settings(feature=None))


@pytest.mark.parametrize("method", ["smote", "oversample", "undersample"])
def test_preprocess_balances(imbalanced, method):
    report = ex.preprocess(imbalanced, ex.Settings(min_df=1, resampling=method)).collect()
    assert len({r.n_after for r in report}) == 1 and report[0].n_features > 0 and not report[0].no_op


def test_binary_relevance(multilabel):
    names = ["sport", "money", "space", "food"]
    rows = multilabel.withColumn("never", F.lit(0))
    split = sp.train_test_split(rows, None)
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    prepared = ex.Preprocessor(ex.Settings(min_df=1)).fit(train)
    found = cl.binary_relevance("lr", prepared.transform(train), prepared.transform(test), names + ["never"])
    assert found.filter("label = 'never' AND y_pred <> 0").count() == 0
    learned = mt.multilabel_metrics(found.filter("label <> 'never'")).first()
    base = mt.multilabel_metrics(cl.constant_baseline(train, test, names)).first()
    assert learned.f1_macro > base.f1_macro + 0.3 and learned.hamming_loss < base.hamming_loss


def test_cross_validation(corpus):
    folded = sp.stratified_kfold(corpus, 2)
    scores = ex.cross_validate(folded, ["nb", "gda"], ["tf"], settings=ex.Settings(min_df=1))
    assert scores.count() == 2 * 4 and scores.filter("metric = 'accuracy' AND value < 0.9").count() == 0


def test_rows_of_all_folds_come_from_one_shuffle_of_counts(spark):
    """every held-out fold's own copy of the counts was shuffled by fold and row."""
    from wordloom.plans.folds import Folds

    texts = {1: "red red blue", 2: "blue green", 3: None, 4: "?!", 5: "red green green blue", 6: "rare red"}
    folded = spark.createDataFrame([(i, t, "ab"[i % 2], i % 2) for i, t in texts.items()], "doc_id bigint, text string, label string, fold int")
    data = Folds(folded, ["label"], "doc_id", "text", ex.Settings(max_n=1, min_df=1, max_features=2))
    plan_of = data.text_rows(["tf", "tfidf"])
    assert "hashpartitioning(held" not in plan_of._jdf.queryExecution().toString()
    found = plan_of.collect()
    assert len(found) == 2 * 2 * 6 and len({(r.feature, r.held, r.row) for r in found}) == 24
    kept, words = {}, {i: (t or "").split() for i, t in texts.items()}
    for held in (0, 1):
        counts = {}
        for i in texts:
            if i % 2 != held:
                for w in words[i]:
                    if w != "?!":
                        counts[w] = counts.get(w, 0) + 1
        kept[held] = sorted(counts, key=lambda w: (-counts[w], w))[:2]
    for r in found:
        i = int(r.row.split("|")[0])
        want = {kept[r.held].index(w): float(words[i].count(w)) for w in words[i] if w in kept[r.held]}
        assert list(r.idx) == sorted(want) and r.part == ("test" if i % 2 == r.held else "train")
        assert r.feature != "tf" or dict(zip(r.idx, r.val)) == want
        assert r.feature != "tfidf" or not want or abs(sum(v * v for v in r.val) - 1) < 1e-9


def test_smote_audit_without_imbalance(corpus):
    folded = sp.stratified_kfold(corpus.filter("label IN ('sport', 'money') AND doc_id < 80"), 2)
    variants = {"nb_plain": ("nb", None), "nb_smote_multinomial": ("nb", "smote"), "nb_smote_gaussian": ("gaussian_nb", "smote")}
    scores, counts_ = ex.smote_audit(folded, settings=ex.Settings(min_df=1), models=variants)
    assert counts_.filter("n_synthetic <> 0").count() == 0
    assert ex.audit_effects(scores).first().resampling_effect == 0.0


def test_knn_on_equal_vectors(spark):
    """Ties go to the least ids, and equal vectors are compared once."""
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.when(F.col("id") < 3, 0.0).otherwise(2.0)).alias("features"))
    found = knn_join(df, df, 4, exclude_self=True).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.rank)):
        by.setdefault(r.doc_id, []).append(r.neighbor_id)
    assert by[0] == [1, 2, 3, 4] and by[2] == [0, 1, 3, 4] and by[3] == [4, 5, 6, 7] and by[599] == [3, 4, 5, 6]


def test_settings_reach_the_pipeline(spark, imbalanced):
    lemmas = spark.createDataFrame([("goal", "match")], "token string, lemma string")
    half = ex.preprocess(imbalanced, ex.Settings(max_n=1, min_df=1, percent=50.0, resampling="smote", neighbors=2), lemmas=lemmas)
    rows = half.collect()
    assert {r.params for r in rows} == {'{"seed": 42, "k": 2}'} and all(r.applied for r in rows)
    words = imbalanced.selectExpr("explode(split(text, ' ')) AS w").distinct().count()
    assert {r.vocab_size for r in rows} == {(words - 1) // 2}  # "goal" became "match"
    assert len({r.n_after for r in rows}) == 1
    with pytest.raises(ValueError, match="label on every row"):
        smote(spark.createDataFrame([(1, None, [1.0]), (2, "a", [2.0])], "doc_id bigint, label string, features array<double>"))


def test_cross_validate_multilabel(multilabel):
    names = ["sport", "money", "space", "food"]
    folded = sp.multilabel_kfold(multilabel, names, 2)
    scores = ex.cross_validate_multilabel(folded, ["nb"], ["tf"], names, settings=ex.Settings(max_n=1, min_df=1)).collect()
    found = {(r.model, r.fold, r.metric): r.value for r in scores}
    metrics = {m for _, _, m in found}
    assert {(m, f) for m, f, _ in found} == {("baseline", 0), ("baseline", 1), ("nb", 0), ("nb", 1)}
    assert len(found) == 4 * len(metrics) and all(0 <= v <= 1 for v in found.values())
    assert all(found["nb", f, "hamming_loss"] < found["baseline", f, "hamming_loss"] for f in (0, 1))


def test_registered_validations_do_the_whole_job(spark, monkeypatch):
    """Ten folds, the default settings, all accepted models, features and variants."""
    from catalog import learning
    from conftest import SF

    seen = {}

    def whole(name, result):
        def run(folded, *args, **settings):
            seen[name] = (sorted(r.fold for r in folded.select("fold").distinct().collect()), args, settings)
            return result
        return run

    none = spark.createDataFrame([], ex.SCORES)
    counts = spark.createDataFrame([], "n_synthetic bigint")
    monkeypatch.setattr(ex, "cross_validate", whole("single", none))
    monkeypatch.setattr(ex, "cross_validate_multilabel", whole("multi", none))
    monkeypatch.setattr(ex, "smote_audit", whole("audit", (none, counts)))
    for query in ("cross_validate", "cross_validate_multilabel", "smote_audit"):
        learning.QUERIES[query](spark, SF)
    assert all(folds == list(range(10)) and not {"settings", "models", "variants"} & set(given) for folds, _, given in seen.values())
    assert all(set(seen[n][1][0]) == set(cl.MODEL_FEATURES) and set(seen[n][1][1]) == {"tf", "tfidf", "word2vec"} for n in ("single", "multi"))
    fitted = []
    monkeypatch.setattr(ex, "Preprocessor", lambda settings: fitted.append(settings) or (_ for _ in ()).throw(KeyError))
    with pytest.raises(KeyError):
        learning.QUERIES["binary_relevance"](spark, SF)
    assert fitted == [ex.Settings()]


def test_knn_sends_a_query_once_to_a_tile(spark, monkeypatch):
    """Cells share tiles: rows that travel do not grow with the number of pivots, and each query is stored once."""
    from wordloom.operators import neighbors as nb
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, str(i % 2), rng.normal(0, 1, 16).tolist()) for i in range(400)],
                               "doc_id bigint, label string, features array<double>")
    stored = []
    monkeypatch.setattr(nb, "materialize", lambda d: (stored.append(d.cache()), stored[-1])[1])
    got = {(r.doc_id, r.neighbor_id, r.rank, round(r.distance, 9)) for r in
           knn_join(df, df, 3, group="label", exclude_self=True, pivots=60, tile=100).collect()}
    assert got == brute(df, 3, True, True)
    visits = [d for d in stored if "tiles" in d.columns or ("cell" in d.columns and "reach" not in d.columns)][0]
    assert visits.count() == 400 and visits.agg(F.max(F.size("tiles"))).first()[0] <= 4


def test_knn_of_repeated_ids_keeps_k_others(spark):
    """Rows of the query's own id do not use up its reach."""
    rows = [(1, [0.0])] * 6 + [(2 + i, [10.0 + i]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, features array<double>")
    found = knn_join(df, df, 2, exclude_self=True, pivots=12, tile=4).filter("doc_id = 1").collect()
    assert {r.neighbor_id for r in found} <= {2, 3} and found


def test_text_vectors_keep_the_first_of_equal_terms(spark):
    """One aggregate gives vocabulary and idf; terms of equal frequency follow the alphabet."""
    words = ["w%02d" % i for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(reversed(words))) for i in range(4)] + [(9, "w39 rest")], "doc_id bigint, text string")
    fitted = ft.TextVectors(max_n=1, max_features=10).fit(df)
    assert fitted.counter.vocabulary == ["w39", *words[:9]]
    assert [round(w, 9) for w in fitted.scale.getScalingVec().toArray()[:2]] == [1.0, round(float(np.log(6 / 5)) + 1, 9)]
    with pytest.raises(ValueError, match="min_df"):
        ft.TextVectors(max_n=1, min_df=7).fit(df)


def test_term_counts_shuffle_texts_not_pairs(spark, corpus):
    plan = ft.term_counts(corpus)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "term" not in shuffles[0].split("ENSURE")[0].split("REPARTITION")[0]


def test_rare_columns_are_not_made_dense(monkeypatch):
    """Columns in few rows cost the pairs that share them, not a dense cell in every row; distances stay the same."""
    rng = np.random.default_rng(3)
    idx = [np.unique(np.concatenate([[0, 1], 2 + rng.choice(20_000, 40)])) for _ in range(900)]
    val = [rng.normal(size=len(i)) for i in idx]
    made, dense = [], nb._Rows.dense
    monkeypatch.setattr(nb, "_BLOCK_CELLS", 20_000)
    monkeypatch.setattr(nb._Rows, "dense", lambda self, *a: made.append(dense(self, *a)) or made[-1])
    left, right = nb._Rows(pd.Series(idx[:300]), pd.Series(val[:300])), nb._Rows(pd.Series(idx), pd.Series(val))
    found = np.concatenate([block for _, block in nb._distances(left, right)])
    assert sum(m.size for m in made) < 100 * (300 + 900)
    full = np.zeros((900, 20_002))
    for i, (c, v) in enumerate(zip(idx, val)):
        full[i, c] = v
    expected = np.sqrt(np.maximum((full[:300] ** 2).sum(1)[:, None] + (full ** 2).sum(1) - 2 * full[:300] @ full.T, 0))
    assert np.allclose(found, expected, atol=1e-6)


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_a_large_vocabulary_is_looked_up_without_shuffling_pairs(spark, monkeypatch, max_n):
    rows = [(1, "The cat sat on the mat, the cat"), (1, "cat sat again"), (None, "cat sat x yy"), (None, "the cat"), (2, None), (3, ""),
            (4, "a b c"), (5, "Ünï_wörd 12 the cat sat on"), (6, "the cat " * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(ft, "VOCABULARY_ROWS", 0)
    monkeypatch.setattr(terms, "PART_CHARS", 10)
    monkeypatch.setattr(terms, "BUCKET_CHARS", 10)
    counts, df, total = {}, {}, {}
    for id, text in rows:
        words = [w for w in re.split(r"\W+", (text or "").lower()) if len(w) > 1]
        grams = [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]
        for g in grams:
            counts[id, g] = counts.get((id, g), 0) + 1
            total[g] = total.get(g, 0) + 1
        for g in set(grams):
            df[g] = df.get(g, 0) + 1
    assert {r.term: (r.doc_freq, r.total) for r in ft.term_stats(docs, max_n=max_n).collect()} == {g: (df[g], total[g]) for g in df}
    vocabulary = ft.fit_vocabulary(docs, max_n=max_n, percent=None)
    kept = {r.term for r in vocabulary.collect()}
    assert kept == {g for g in df if df[g] > 1}
    tf = ft.tf_features(docs, vocabulary, max_n=max_n)
    assert sorted((str(r.doc_id), r.term, r.tf) for r in tf.collect()) == sorted((str(i), g, n) for (i, g), n in counts.items() if g in kept)
    for sublinear in (False, True):
        weight = {(i, g): (1 + math.log(n) if sublinear else n) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for (i, g), n in counts.items() if g in kept}
        long = ft.tfidf_features(docs, vocabulary, max_n=max_n, sublinear=sublinear)
        found = {(r.doc_id, r.term): r.weight for r in long.collect()}
        assert found.keys() == weight.keys()
        for (i, g), w in weight.items():
            assert found[i, g] == pytest.approx(w / math.sqrt(sum(v * v for (j, _), v in weight.items() if j == i)), abs=1e-6)
        for features in (tf, long):  # no pair is joined or regrouped
            plan = features._jdf.queryExecution().executedPlan().toString()
            assert "Window" not in plan and "Join" not in plan and "hashpartitioning(term" not in plan


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 9])
def test_a_vocabulary_is_cut_by_rank(spark, size):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa aa aa bb cc", "bb dd dd", "ee ff cc"])], "doc_id bigint, text string")
    stats = ft.term_stats(docs, max_n=1)
    ranked = rank_by_frequency(stats, "term", "total").filter(F.col("rank") <= size)
    kept = ft.fit_vocabulary(docs, max_n=1, min_df=1, max_features=size)
    assert {r.term for r in kept.collect()} == {r.term for r in ranked.collect()}
    assert kept.count() == min(size, 6) and {r.n_docs for r in kept.collect()} == {3}


def test_texts_are_counted_in_chunks(monkeypatch):
    """No row is lost or cut; a chunk has at most `CHUNK_WORDS` words or one row."""
    monkeypatch.setattr(terms, "CHUNK_WORDS", 4)
    rows = [["a"] * n if n is not None else None for n in (1, 3, 0, None, 9, 2, 1, 1, 1, 4, 0, 7)]
    batches = [pa.array(rows[:5], pa.list_(pa.string())), pa.array([], pa.list_(pa.string())), pa.array(rows[5:], pa.list_(pa.string()))]
    chunks = [c.to_pylist() for c in terms._chunks(iter(batches))]
    assert [r for c in chunks for r in c] == rows and len(chunks) > 4
    assert all(sum(len(r or []) for r in c) <= 4 or sum(bool(r) for r in c) == 1 for c in chunks)
