import random

import corpus_pipeline
from pyspark.sql import functions as F
from wordloom.llm import catalog, classifier, simhash
from wordloom.plans.storage import written

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    """No label was shown to the labellers or the scorer."""
    judged = classifier.classify(catalog.table(spark, SF, "documents")).select("doc_id", "kept")
    rows = judged.join(catalog.table(spark, SF, "labels"), "doc_id").collect()
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.99 * sum(r.quality for r in rows)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.95 * sum(r.quality == 0 for r in rows)


def test_bounded_sample_judges_alike(spark):
    judged = classifier.classify(catalog.table(spark, SF, "documents"), fit_docs=300).select("doc_id", "kept")
    rows = judged.join(catalog.table(spark, SF, "labels"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


def test_shape():
    given = ("Hello", "HELLO!!", "über-9x", "a.b@c", "1,234")
    assert [classifier.shape(w.encode()).decode() for w in given] == ["Aa", "A!!", "a-0a", "a.a@a", "0,0"]


def test_nulls_repeats_long_and_empty(texts, spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["good", "plain", "words", "stand", "here", "again."]) + rng.choice("abcdefgh") for _ in range(n))
    junk = " ".join("$%#" + rng.choice("abc") + "|||" for _ in range(60))
    data = [(i, prose(60)) for i in range(60)] + [(100 + i, junk + str(i)) for i in range(8)]
    data += [(200, None), (201, ""), (202, " \n"), (None, prose(50)), (1, data[1][1]), (300, prose(200_000))]
    given = texts(data)
    found = classifier.classify(given)
    assert found.drop("p_good", "kept").columns == given.drop("kept").columns
    kept = sorted((r.doc_id or -1, r.kept) for r in found.select("doc_id", "kept").collect())
    assert kept == sorted((i or -1, not (100 <= (i or 0) < 108 or 200 <= (i or 0) < 203)) for i, _ in data)
    assert classifier.classify(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_pipeline_stages(spark):
    """Each stage against what it was given."""
    docs = catalog.table(spark, "/root/testdata/sf0.001", "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], "/root/testdata/sf0.001"))[0])
    given, good, single, clean, mixed, tokens = seen
    for df in seen[1:5]:
        assert df.columns == docs.columns
    assert [r.doc_id for r in good.join(given, docs.columns, "left_anti").collect()] == []
    groups = simhash.simhash_groups(good).groupBy("component_id").count().count()
    assert single.count() == single.select("doc_id").distinct().count() == groups and single.join(good, docs.columns, "left_anti").count() == 0
    assert clean.count() == groups
    assert clean.filter(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]")).count() == 0
    assert mixed.join(clean, "doc_id", "left_anti").count() == 0
    assert tokens.count() == mixed.count() and tokens.filter("n_tokens = 0").count() == 0
    again = catalog.pipeline(spark, "/root/testdata/sf0.001")
    assert sorted((r.doc_id, r.n_tokens) for r in again.collect()) == sorted((r.doc_id, r.n_tokens) for r in tokens.collect())
