"""Small tables with literal results, edge cases, and independence from partitioning."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from wordloom.operators import (comparison as cp, cooccurrence as co, corpus as cr, entities as en, frequency as fq,
                                labels as lb, metrics as mt, ngrams as ng, normalize as nm, overlap as ov, ranking as rk,
                                schema as sc, sentiment as se, topics as tp)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def freqs(spark, **counts):
    return spark.createDataFrame(list(counts.items()), "word string, frequency bigint")


def test_frequency_and_caps(spark):
    df = spark.createDataFrame([(1, "apple apple pear", "a"), (2, "pear plum the", None)], "doc_id int, text string, label string")
    assert rows(fq.word_frequency(df), "word") == [("apple", 2), ("pear", 2), ("plum", 1)]
    assert rows(fq.word_frequency(df, max_tokens=1), "word") == [("apple", 1), ("pear", 1)]
    assert rows(fq.word_frequency(df, max_chars=5), "word") == [("apple", 1), ("pear", 1)]
    assert rows(fq.word_frequency(df, top_n=1)) == [("apple", 2)]
    by_class = rows(fq.word_frequency_by_class(df), "class_name", "word")
    assert by_class == [("Unlabeled", "pear", 1), ("Unlabeled", "plum", 1), ("a", "apple", 2), ("a", "pear", 1),
                        ("all", "apple", 2), ("all", "pear", 2), ("all", "plum", 1)]
    top = fq.word_frequency_by_class(df, top_n=1)
    assert rows(top.select("class_name", "word"), "class_name") == [("Unlabeled", "pear"), ("a", "apple"), ("all", "apple")]


def test_spectrum_reports(spark):
    f = freqs(spark, a=5, b=3, c=1, d=1)
    assert rows(fq.frequency_bands(f), "min_frequency") == [(1, 1, 4), (3, 3, 2), (5, 5, 1)]
    assert rows(fq.hapax_stats(f)) == [(2, 50.0, 3)]
    assert rows(fq.coverage_milestones(f), "step") == [(50, 1), (80, 2), (90, 3)]
    assert rows(fq.coverage(f, min_rank=2, max_rank=3), "rank") == [(2, 0.3), (3, 0.4)]
    assert rows(fq.coverage_cumulative(f), "rank")[-1] == (4, 100.0)
    assert rows(fq.zipf_fit(freqs(spark, a=1, b=1)))[0][3] is None


def test_ranks_are_a_permutation(spark):
    f = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("word"), (F.col("id") % 7 + 1).alias("frequency"))
    ranked = rows(rk.rank_by_frequency(f), "rank")
    assert [r[2] for r in ranked] == list(range(1, 3001))
    assert [r[1] for r in ranked] == sorted((r[1] for r in ranked), reverse=True)


def test_explode_range_in_chunks(spark):
    df = spark.createDataFrame([(1, 0), (1, 25)], "lo int, hi int")
    assert rows(rk.explode_range(df, F.col("lo"), F.col("hi"), "i", chunk=7).select("i"), "i") == [(i,) for i in range(1, 26)]


def test_lengths(spark):
    df = spark.createDataFrame([(" ".join("x" * n),) for n in (1, 2, 3, 13)] + [("  ",)], "text string")
    assert rows(fq.doc_length_stats(df)) == [(4, 1, 13, 4.75, 3)]
    histogram = rows(fq.doc_length_histogram(df), "bin")
    assert [h[3] for h in histogram] == [1, 1, 1] + [0] * 8 + [1]
    same = df.limit(0).unionByName(spark.createDataFrame([("a b",), ("c d",)], "text string"))
    assert rows(fq.doc_length_histogram(same)) == [(0, 2.0, 2.0, 2)]


def test_ngrams_bridge_gaps_but_not_documents(spark):
    df = spark.createDataFrame([(1, "cats of rome"), (2, "rome burns")], "doc_id int, text string")
    assert rows(ng.ngrams(df)) == [("cats rome", 1), ("rome burns", 1)]
    assert rows(ng.ngram_summary(df)) == [(2, 2, 2, 2)]
    assert rows(ng.ngram_share(df))[0][2] == 50.0


def test_overlap_counts_per_side(spark):
    df = spark.createDataFrame([("a", "x x y"), ("b", "x y y"), ("-1", "x x x")], "label string, text string")
    got = rows(ov.class_overlap(df, "a", min_frequency=2), "term")
    assert got == [("x", "unique_target", 2, 0, 2), ("y", "unique_other", 0, 2, 2)]


def test_cooccurrence(spark):
    df = spark.createDataFrame([("red blue red",), ("red blue green",), ("green the red",), ("solo",)], "text string")
    edges = co.cooccurrence(df, top_n=10)
    assert rows(edges, "source", "target") == [("blue", "green", 1), ("blue", "red", 2), ("green", "red", 2),
                                               ("green", "the", 1), ("red", "the", 1)]
    assert rows(co.cooccurrence_threshold(edges, 5)) == [(2, 2)]
    assert rows(co.cooccurrence_threshold(edges.filter("value = 1"), 5)) == [(1, 1)]
    net = co.cooccurrence_network(edges, top_n=10, min_cooccurrence=2)
    assert rows(net, "source") == [("blue", "red", 2), ("green", "red", 2)]
    assert rows(co.network_degree(net), "id") == [("blue", 1), ("green", 1), ("red", 2)]


def test_labels(spark):
    lines = spark.createDataFrame([("[a+b] one",), ("[a] two",), ("none",)], "value string")
    parsed = lb.parse_labeled_lines(lines)
    assert rows(parsed, "text") == [(["a", "b"], "one"), (["a"], "two")]
    assert rows(lb.write_labeled_lines(parsed).select("value"), "value") == [("[a+b] one",), ("[a] two",)]
    assert rows(lb.label_distribution(lines), "label") == [("a", 1), ("a+b", 1)]
    assert rows(lb.label_distribution(lines, split_multi=True), "label") == [("a", 2), ("b", 1)]
    wide = spark.createDataFrame([("t", 1, 1), ("u", 0, 0), ("t ", 0, 1), (" ", 1, 1)], "text string, x int, y int")
    melted = lb.melt_multilabel(wide, ["x", "y"])
    assert sorted(rows(melted.select("text", "label"))) == [("t", "0"), ("t", "1"), ("t", "1"), ("u", "-1")]
    assert rows(lb.collapse_multilabel(melted)) == [("t", ["x", "y"])]
    assert rows(lb.collapse_multilabel(melted, keep_unlabeled=True), "text") == [("t", ["x", "y"]), ("u", [])]
    mixed = spark.createDataFrame([("10",), ("9",), ("-1",), (None,), ("",)], "label string")
    assert rows(lb.unique_labels(mixed), "position") == [("9", 1), ("10", 2)]
    names = spark.createDataFrame([("0", "spam")], "label_id string, label_name string")
    coded = spark.createDataFrame([("label0",), ("0",), ("7",)], "label string")
    assert sorted(rows(lb.decode_labels(coded, names))) == [("0", "spam"), ("7", "7"), ("label0", "spam")]


def test_schema(spark):
    df = spark.createDataFrame([("spam", "win a prize now, really a big prize"), ("ham", "see you"), ("ham", "ok")] * 5,
                               "kind string, note string")
    profile = sc.profile_columns(df)
    assert rows(sc.detect_label_column(profile)) == [("kind",)] and rows(sc.detect_text_column(profile)) == [("note",)]
    binary = spark.createDataFrame([("1", "", "x", "0", "t"), ("0", "", "y", "1", "u")], "a string, b string, c string, d string, text string")
    assert [r[1] for r in rows(sc.detect_binary_label_columns(binary))] == ["a", "b"]
    assert [r[1] for r in rows(sc.detect_binary_label_columns(binary, anywhere=True))] == ["a", "b", "d"]


def test_extract_and_filter(spark):
    df = spark.createDataFrame([(None, "mail", ("deep",)), ("", None, ("deep",)), ("t", "m", (None,))],
                               "text string, email string, data struct<text: string>")
    assert sorted(rows(cr.extract_text(df).select("text"))) == [("deep",), ("mail",), ("t",)]
    labelled = spark.createDataFrame([("0", []), ("1", ["x"]), (None, None)], "label string, names array<string>")
    assert cr.filter_class(labelled, "label0").count() == 1
    assert cr.filter_class(labelled, "Unlabeled").count() == 1
    assert cr.filter_class(labelled, "x", label_names="names").count() == 1
    assert cr.filter_class(labelled, "all").count() == 3


def test_fingerprint_counts_copies_and_ignores_order(spark):
    a = spark.createDataFrame([("x",), ("y",), ("x",)], "text string")
    b = spark.createDataFrame([("y",), ("x",), ("x",)], "text string").repartition(3)
    c = spark.createDataFrame([("x",), ("y",)], "text string")
    prints = [cr.corpus_fingerprint(d).first().fingerprint for d in (a, b, c)]
    assert prints[0] == prints[1] != prints[2] and len(prints[0]) == 16


def test_sentiment(spark):
    lexicon = spark.createDataFrame([("good", 3), ("bad", -3), ("not good", -2), ("no", -1)], "word string, valence int")
    df = spark.createDataFrame([(1, "Good day. It is not good! Bad, bad no. Plain"), (2, "[4] good one. bad\nskip me\n[5] fine")],
                               "doc_id int, text string")
    got = rows(se.sentence_sentiment(df, lexicon).select("doc_id", "sentence_id", "label", "score", "sentiment"), "doc_id", "sentence_id")
    assert got == [(1, 1, None, 3, "Positive"), (1, 2, None, -2, "Negative"), (1, 3, None, -7, "Negative"),
                   (1, 4, None, 0, "Neutral"), (2, 1, 4, 3, "Positive"), (2, 2, 4, -3, "Negative"), (2, 3, 5, 0, "Neutral")]
    assert rows(se.corpus_valence(df.limit(1), lexicon)) == [(5, -0.2, "Negative")]


@pytest.mark.parametrize("inline_limit", [1000, 0])
def test_entities(spark, inline_limit):
    gazetteer = spark.createDataFrame([("new york", "GPE"), ("york", "PERSON"), ("acme", "ORG")], "phrase string, entity_type string")
    df = spark.createDataFrame([(1, "In New York, Acme and york."), (2, "ACME")], "doc_id int, text string")
    found = en.entities(df, gazetteer, inline_limit=inline_limit)
    assert rows(found.drop("source"), "doc_id", "start", "end") == [
        (1, "New York", "GPE", 3, 11), (1, "York", "PERSON", 7, 11), (1, "Acme", "ORG", 13, 17),
        (1, "york", "PERSON", 22, 26), (2, "ACME", "ORG", 0, 4)]
    assert rows(en.dedupe_entities(found).select("text"), "text") == [("Acme",), ("New York",), ("York",)]
    assert en.filter_person_noise(found).filter("entity_type = 'PERSON'").count() == 1
    assert rows(en.entity_type_groups(found), "entity_group", "value")[:2] == [("GPE", "New York", 1), ("ORG", "ACME", 1)]
    assert rows(en.join_entities(df, gazetteer).select("text"), "doc_id")[0] == ("In New_York, Acme and york.",) or \
        rows(en.join_entities(df, gazetteer).select("text"), "doc_id")[0] == ("In new_york, Acme and york.",)


def test_recognizer_offsets_reach_every_chunk(spark):
    text = "x" * 5200 + " Bob"

    def find_bob(batches):
        for b in batches:
            hits = b[b["chunk"].str.contains("Bob")]
            at = hits["chunk"].str.find("Bob")
            yield hits[["doc_id", "offset"]].assign(text="Bob", entity_type="PERSON", start=at, end=at + 3, source="mine")

    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert rows(en.recognize(df, find_bob).select("start", "end")) == [(5201, 5204)]


def test_normalize(spark):
    df = spark.createDataFrame([(1, "The cats, running!"), (2, "...")], "doc_id int, text string")
    assert rows(nm.normalize_corpus(df, stemming=True, remove_stopwords=True), "doc_id") == [(1, "cat run"), (2, "")]
    lemmas = spark.createDataFrame([("cats", "cat"), ("running", "the")], "token string, lemma string")
    assert rows(nm.normalize_corpus(df, lemmas=lemmas, stemming=True, remove_stopwords=True), "doc_id") == [(1, "cat"), (2, "")]


def test_topic_reports(spark):
    terms = spark.createDataFrame([(1, 1, "loan", 3.0), (1, 2, "goal_line", 2.0), (1, 3, "x2", 1.0), (2, 1, "zz", 1.0)],
                                  "topic bigint, position bigint, term string, weight double")
    assert rows(tp.topic_auto_label(terms), "topic") == [(1, "Loan • goal line"), (2, "Topic")]
    categories = spark.createDataFrame([(2, "Finance", "loan"), (1, "Sport", "goal_line"), (3, "Also", "Loan ")],
                                       "cat_order int, category string, word string")
    assert rows(tp.topic_label(terms, categories), "topic") == [(1, "Finance"), (2, "Topic")]
    assert rows(tp.topic_label(terms, categories, min_hits=2), "topic") == [(1, "Loan • goal line"), (2, "Topic")]
    doc_topics = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.2), (2, 3, 0.8)], "doc_id bigint, topic bigint, weight double")
    shares = rows(tp.topic_shares(doc_topics), "topic")
    assert shares == [(1, 35.0), (2, 25.0), (3, 40.0)]
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id bigint, text string")
    assert rows(tp.topic_mapping(doc_topics, docs), "doc_id") == [(1, 1, 50.0, "one"), (2, 3, 80.0, "two")]
    topics = spark.createDataFrame([(1, "Sport", 33.33), (2, "sport", 33.33), (3, " ", 33.33)], "topic bigint, label string, percent double")
    assert rows(tp.topic_rollup(topics), "label") == [("Sport", 66.67), ("Topic 3", 33.33)]
    assert [r[0] for r in rows(tp.relevant_topics(topics.withColumn("label", F.when(F.col("topic") == 2, "of it").otherwise(F.col("label")))))] == [1]


def test_topic_model_shape(spark, corpus):
    terms, shares = tp.topic_model(tp.topic_documents(corpus), iterations=2)
    assert terms.groupBy("topic").count().count() == 20
    total = shares.groupBy("doc_id").agg(F.sum("weight").alias("w"))
    assert total.count() == 100 and total.filter("abs(w - 1) > 1e-6").count() == 0


def test_topic_vocabulary_stores_no_words(spark, corpus, monkeypatch):
    """a share as the largest document frequency made MLlib keep the words of all texts."""
    made = []
    monkeypatch.setattr(tp, "CountVectorizer", lambda **given: made.append(given) or CountVectorizer(**given))
    everywhere = corpus.withColumn("text", F.concat(F.col("text"), F.when(F.col("doc_id") < 91, " often").otherwise(" seldom")))
    terms, _ = tp.topic_model(tp.topic_documents(everywhere), iterations=1)
    assert made[0]["maxDF"] == 90.0 and made[0]["minDF"] == 2  # 91 of 100 documents hold "often"
    found = {r.term for r in terms.select("term").distinct().collect()}
    assert "often" not in found and found <= {w for r in everywhere.select("text").collect() for w in r.text.split()}


def test_single_document_is_cut_into_windows(spark):
    df = spark.createDataFrame([(9, "word " * 1300)], "doc_id bigint, text string")
    assert tp.topic_documents(df, labeled=False).count() == 3
    assert tp.topic_documents(df, labeled=True).count() == 1


def test_metrics(spark):
    p = spark.createDataFrame([(1, "1", "1", 0.9), (2, "0", "1", 0.9), (3, "0", "0", 0.2), (4, "1", "0", 0.4)],
                              "doc_id int, y_true string, y_pred string, score double")
    assert rows(mt.confusion_matrix(p), "y_true", "y_pred") == [("0", "0", 1), ("0", "1", 1), ("1", "0", 1), ("1", "1", 1)]
    assert rows(mt.binary_rates(p)) == [(0.5, 0.5)]
    assert rows(mt.misclassified(p).select("doc_id", "error"), "doc_id") == [(2, "type I"), (4, "type II")]
    assert sorted(rows(mt.roc_curve(p))) == [(0.0, 0.0), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    assert rows(mt.auc(p)) == [(0.625,)]
    one = p.filter("y_true = '1'")
    assert sorted(rows(mt.roc_curve(one))) == [(0.0, 0.0), (1.0, 1.0)] and rows(mt.auc(one)) == [(0.5,)]
    assert rows(mt.degenerate_probabilities(p)) == [(False,)]
    assert rows(mt.degenerate_probabilities(p.withColumn("score", F.lit(1.0)))) == [(True,)]


def test_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    p = spark.range(5000).select("id", F.rand(3).alias("r")).select(
        (F.col("r") > 0.6).cast("int").cast("string").alias("y_true"), F.round(F.col("r") * 0.5 + F.rand(5) * 0.5, 3).alias("score"))
    ours = mt.auc(p).first().auc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0).evaluate(
        p.withColumn("y", F.col("y_true").cast("double")))
    assert abs(ours - theirs) < 1e-5


def test_comparison(spark):
    data = [("d", m, "tf", f, "f1", v) for m, vs in {"a": [0.8, 0.7, 0.9], "b": [0.7, 0.7, 0.7], "c": [0.7, 0.6, 0.8]}.items()
            for f, v in enumerate(vs)]
    s = spark.createDataFrame(data, "dataset string, model string, feature string, fold int, metric string, value double")
    pairs = spark.createDataFrame([("a+tf", "b+tf"), ("a+tf", "a+tf"), ("a+tf", "c+tf")], "a string, b string")
    t = {r.b: r for r in cp.paired_ttest(s, pairs).collect()}
    assert t["b+tf"].t == pytest.approx(1.732051) and t["b+tf"].p == pytest.approx(0.225403, abs=1e-6)
    assert (t["a+tf"].t, t["a+tf"].p) == (0.0, 1.0)
    corrected = {r.b: r for r in cp.corrected_ttest(s, pairs, 2, 1).collect()}
    assert corrected["b+tf"].t == pytest.approx(0.1 / (0.1 * (1 / 3 + 1 / 2) ** 0.5), abs=1e-6)
    equal = {r.b: r for r in cp.tost(s, pairs, 0.2).collect()}
    assert equal["a+tf"].equivalent and not equal["b+tf"].equivalent
    assert equal["b+tf"].ci_upper == pytest.approx(0.1 + 2.919986 * 0.1 / 3 ** 0.5, abs=1e-5)


def test_holm_is_monotone(spark):
    p = spark.createDataFrame([("x", "1", 0.01), ("x", "2", 0.04), ("x", "3", 0.03), ("y", "4", 0.04)], "f string, n string, p double")
    assert rows(cp.holm_bonferroni(p, ["f"]).select("n", "p_holm", "reject"), "n") == [
        ("1", 0.03, True), ("2", 0.06, False), ("3", 0.06, False), ("4", 0.04, True)]


def test_student():
    from wordloom.functions.student import t_ppf, t_sf

    assert t_sf(2.0, 10) == pytest.approx(0.0366939, abs=1e-6) and t_sf(-2.0, 10) == pytest.approx(1 - 0.0366939, abs=1e-6)
    assert t_ppf(0.95, 9) == pytest.approx(1.833113, abs=1e-6) and t_sf(0.0, 3) == 0.5


def test_empty_corpus(spark, empty):
    assert fq.word_frequency(empty).count() == 0
    assert fq.word_frequency_by_class(empty).count() == 0
    assert fq.coverage(fq.word_frequency(empty)).count() == 0
    assert fq.zipf(empty).count() == 0
    assert ng.ngrams(empty).count() == 0 and rows(ng.ngram_summary(empty)) == [(2, 0, 0, 0)]
    assert co.cooccurrence_network(co.cooccurrence(empty)).count() == 0
    assert rows(fq.corpus_stats(empty))[0][:2] == (0, 0)
    assert fq.doc_length_histogram(empty).count() == 0
    assert mt.classification_report(empty.select(F.col("label").alias("y_true"), F.col("label").alias("y_pred"))).filter("label = 'accuracy'").count() == 1


def test_only_stopwords(spark):
    df = spark.createDataFrame([(1, "the and of it", "a")], "doc_id bigint, text string, label string")
    assert fq.word_frequency(df).count() == 0 and ng.ngrams(df).count() == 0
    assert fq.zipf(df).count() == 2


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_partitioning_does_not_matter(spark, corpus, partitions):
    df = corpus.repartition(partitions)
    assert rows(fq.word_frequency(df), "word") == rows(fq.word_frequency(corpus), "word")
    assert rows(fq.zipf(df), "rank") == rows(fq.zipf(corpus), "rank")
    assert rows(co.cooccurrence(df, 5), "source", "target") == rows(co.cooccurrence(corpus, 5), "source", "target")


def test_counts_add_up(spark, corpus):
    tokens = corpus.select(F.sum(F.size(F.split("text", " "))).alias("n")).first().n
    assert fq.word_frequency(corpus).agg(F.sum("frequency")).first()[0] == tokens
    assert rows(fq.coverage_cumulative(fq.word_frequency(corpus)), "rank")[-1][1] == 100.0


def test_null_labels_stay_in_splits_and_grow(spark):
    from wordloom.operators import sampling as sp

    df = spark.createDataFrame([(i, None if i < 3 else "a") for i in range(10)], "doc_id bigint, label string")
    assert sp.train_test_split(df).count() == 10
    sizes = {r.label: r.n for r in sp.class_sizes(sp.random_oversample(df), "label").collect()}
    assert sizes == {None: 7, "a": 7}


def test_names_never_get_the_code_of_a_number(spark):
    from wordloom.operators import labels as lb

    df = spark.createDataFrame([(x,) for x in ("0", "cat", "1", "dog", "1e3")], "label string")
    assert rows(lb.label_ids(df).select("label_name", "label_id"), "label_name") == [
        ("0", "0"), ("1", "1"), ("1e3", "1e3"), ("cat", "2"), ("dog", "3")]


def test_shares_of_few_neighbours_add_up(spark):
    from wordloom.operators.classifiers import k_nearest

    train = spark.createDataFrame([(1, "a", [0.0]), (2, "b", [1.0]), (3, "b", [2.0])], "doc_id bigint, label string, features array<double>")
    found = k_nearest(train, train.limit(1), "label", "doc_id", "features", 3, k=5).first().probability
    assert abs(sum(found.values()) - 1) < 1e-9


def test_long_phrases_are_found(spark):
    from wordloom.operators import entities as en

    df = spark.createDataFrame([(1, "The Bank of New York City, in New York.")], "doc_id bigint, text string")
    gazetteer = spark.createDataFrame([("bank of new york city", "ORG"), ("new york", "GPE")], "phrase string, entity_type string")
    assert rows(en.entities(df, gazetteer).select("text"), "text") == [("Bank of New York City",), ("New York",), ("New York",)]


def test_one_long_sentence(spark):
    from wordloom.operators.sentiment import sentence_sentiment

    df = spark.createDataFrame([(1, "good " * 80_000), (2, ""), (None, "bad")], "doc_id bigint, text string")
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1)], "word string, valence int")
    assert {r.doc_id: r.score for r in sentence_sentiment(df, lexicon).collect()} == {1: 80_000, None: -1}


def test_ranges_are_made_by_many_tasks(spark):
    from wordloom.operators.ranking import explode_range

    one = spark.createDataFrame([(0,)], "x bigint").coalesce(1)
    df = explode_range(one, F.lit(1), F.lit(1_000_000), "i", spread=True)
    assert df.groupBy(F.spark_partition_id()).count().count() > 1 and df.agg(F.sum("i")).first()[0] == 500_000_500_000


def test_any_number_of_phrases_is_joined_like_by_expressions(spark):
    import re

    from wordloom.operators import entities as en

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["AT&T", "Inc.", "(x", "é"]
    phrases = sorted({" ".join(rng.choice(words) for _ in range(rng.choice([2, 2, 3, 4]))) for _ in range(2500)})
    texts = [" ".join(rng.choice(words).upper() if rng.random() < .2 else rng.choice(words) for _ in range(40)) + rng.choice(["", "."]) for _ in range(20)]
    wanted = []
    for t in texts:
        for p in sorted(phrases, key=lambda p: (-len(p), p)):
            t = re.sub(rf"(?i)(?<![A-Za-z0-9_]){re.escape(p)}(?![A-Za-z0-9_])", lambda m: re.sub(r"\s+", "_", p), t)
        wanted.append(t)
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id int, text string")
    got = en.join_entities(df, spark.createDataFrame([(p,) for p in phrases], "phrase string"))
    assert {r.doc_id: r.text for r in got.collect()} == dict([*enumerate(wanted), (99, None)])
    for limit in (20_000, 700):  # whole, and cut into parts
        got = en.join_entities(df, spark.createDataFrame([(p,) for p in phrases], "phrase string"), limit=limit)
        assert {r.doc_id: r.text for r in got.collect()} == dict([*enumerate(wanted), (99, None)])


@pytest.mark.parametrize("inline_limit", [10_000, 150, 7])
def test_entities_equal_a_search_for_every_phrase(spark, inline_limit):
    """A third of the phrases begin alike, phrases hold one another, texts repeat."""
    import re

    rng = random.Random(5)
    words = ["a", "b", "ab", "Ça", "x_1", "7"]
    phrases = {(" ".join(["a"] * (rng.random() < .3) + [rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 5]))]), rng.choice(["ORG", "GPE"]))
               for _ in range(120)} | {("a, b", "LAW"), ("b  7", "LAW"), ("ab inc.", "ORG"), ("", "ORG")}
    texts = ["".join(rng.choice(words).swapcase() + rng.choice([" ", " ", " ", "  ", ", ", "", "\n", " inc. "]) for _ in range(60)) for _ in range(12)]
    docs = [*enumerate(texts), (50, texts[0]), (50, texts[1]), (98, ""), (99, None), (None, "a b")]
    wanted = Counter((i, t[m.start():m.end()], kind, m.start(), m.end()) for i, t in docs if t for p, kind in {(p.lower(), k) for p, k in phrases if p}
                     for m in re.finditer(rf"(?i)(?<!\w)(?=({re.escape(p)})(?!\w))", t) for m in [re.compile(re.escape(p), re.I).match(t, m.start())])
    found = en.entities(spark.createDataFrame(docs, "doc_id int, text string"),
                        spark.createDataFrame(sorted(phrases), "phrase string, entity_type string"), inline_limit=inline_limit)
    assert Counter(tuple(r)[:5] for r in found.select("doc_id", "text", "entity_type", "start", "end").collect()) == wanted
    none = spark.createDataFrame([], "phrase string, entity_type string")
    assert en.entities(found, none, "text").count() == 0


def test_any_number_of_phrases_has_a_valence(spark):
    from wordloom.operators.sentiment import sentence_sentiment

    lexicon = spark.createDataFrame([("good", 2), ("not good", -3), *[(f"x{i} y{i}", 1) for i in range(600)]], "word string, valence int")
    df = spark.createDataFrame([(1, "Not good not good"), (2, "x5 y5 x599 Y599 x5 y6"), (3, None)], "doc_id int, text string")
    for limit in (200_000, 20):
        assert {r.doc_id: r.score for r in sentence_sentiment(df, lexicon, limit=limit).collect()} == {1: -6, 2: 2}


@pytest.mark.parametrize("tile", [3, 1024])
def test_tiles_hold_any_vocabulary(spark, tile):
    """Every pair of words of every document, counted by hand."""
    rng = random.Random(tile)
    texts = [" ".join(rng.choices([f"word{i:02d}" for i in range(20)], k=rng.randrange(0, 12))) for _ in range(60)] + [""]
    wanted = Counter(p for t in texts for p in itertools.combinations(sorted(set(t.split())), 2))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id bigint, text string").repartition(5)
    vocabulary = spark.createDataFrame([(f"word{i:02d}",) for i in range(20)], "word string")
    assert {(r.source, r.target): r.value for r in co.tiled_edges(df, vocabulary, tile=tile).collect()} == wanted
    if tile == 1024:
        assert {(r.source, r.target): r.value for r in co.cooccurrence(df, top_n=5000).collect()} == wanted
