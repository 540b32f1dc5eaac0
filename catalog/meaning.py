"""Lexicon sentiment, dictionary entities, topics."""

from pyspark.sql import functions as F

from catalog.common import (CATEGORIES, DOC_TOPICS, ENTITIES, LEXICON, NON_WORD, SPACE, TOPIC_TERMS, categories,
                            doc_topics, documents, gazetteer, lemmas, lexicon, space_tokens_sql, strip_sql, table,
                            topic_terms)
from wordloom.functions import text as T
from wordloom.operators import entities as en, normalize as nm, sentiment as se, topics as tp


def _sentiment(spark, sf):
    return se.sentence_sentiment(documents(spark, sf), lexicon(spark, sf))


def _entities(spark, sf):
    return en.entities(documents(spark, sf), gazetteer(spark, sf))


def _phrases(spark, sf):
    return gazetteer(spark, sf).filter("phrase LIKE '% %'")


def _topics(spark, sf):
    """Topics with a label and a share: per source."""
    shares = documents(spark, sf).groupBy("source").agg(F.sum("n_chars").alias("weight")).select(
        (F.regexp_extract("source", r"(\d+)$", 1).cast("bigint") + 1).alias("topic"), F.col("weight").cast("double"))
    labels = tp.topic_label(topic_terms(spark, sf), categories(spark, sf), min_hits=2)
    return tp.topic_shares(shares).join(labels, "topic")


def _model(spark, sf):
    return tp.topic_model(tp.topic_documents(documents(spark, sf)))


def _mapping(spark, sf):
    docs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat_ws(
        " ", F.transform("embedding", lambda x: F.round(x.cast("double"), 1).cast("string"))).alias("text"))
    return tp.topic_mapping(doc_topics(spark, sf), docs).select("doc_id", "topic", "confidence", F.length("snippet").alias("n"))


QUERIES = {
    "lemmatize": lambda s, d: nm.lemmatize(documents(s, d).select("doc_id", T.basic_clean(F.col("text")).alias("text")),
                                           lemmas(s, d)),
    "sentence_sentiment": lambda s, d: _sentiment(s, d).select("doc_id", "sentence_id", "sentence", "score", "sentiment"),
    "sentiment_distribution": lambda s, d: se.sentiment_distribution(
        _sentiment(s, d).join(documents(s, d).select("doc_id", "lang"), "doc_id"), "lang"),
    "corpus_valence": lambda s, d: se.corpus_valence(documents(s, d), lexicon(s, d)),
    "entities": _entities,
    "dedupe_entities": lambda s, d: en.dedupe_entities(_entities(s, d)),
    "dedupe_entities_by_text": lambda s, d: en.dedupe_entities(_entities(s, d), by_type=False),
    "filter_person_noise": lambda s, d: en.filter_person_noise(_entities(s, d)),
    "entity_type_groups": lambda s, d: en.entity_type_groups(_entities(s, d)),
    "join_entities": lambda s, d: en.join_entities(documents(s, d), _phrases(s, d)).select("doc_id", "text"),
    "topic_terms": lambda s, d: tp.topic_terms(topic_terms(s, d)),
    "topic_label": lambda s, d: tp.topic_label(topic_terms(s, d), categories(s, d), min_hits=2),
    "topic_auto_label": lambda s, d: tp.topic_auto_label(topic_terms(s, d)),
    "topic_shares": lambda s, d: tp.topic_shares(doc_topics(s, d)),
    "topic_mapping": _mapping,
    "topic_rollup": lambda s, d: tp.topic_rollup(_topics(s, d)),
    "relevant_topics": lambda s, d: tp.relevant_topics(_topics(s, d), 5.0),
    "topic_model": lambda s, d: _model(s, d)[0],
    "topic_model_mapping": lambda s, d: tp.topic_mapping(_model(s, d)[1], documents(s, d)),
}

_SENTENCES = f"""sents AS (SELECT doc_id, lang, CAST(generate_subscripts(s, 1) AS BIGINT) AS sentence_id, unnest(s) AS sentence FROM (
  SELECT doc_id, lang, list_filter(list_transform(regexp_split_to_array(text, '[.?!]{SPACE}+'), lambda x: {strip_sql('x')}),
  lambda x: x <> '') AS s FROM documents))"""
_SCORED = f"""{LEXICON}, {_SENTENCES}, scored AS (SELECT doc_id, lang, sentence_id, sentence,
    CAST(coalesce(sum(valence), 0) AS BIGINT) AS score FROM (SELECT *, unnest(regexp_split_to_array(lower(sentence), '{NON_WORD}'))
    AS word FROM sents) LEFT JOIN lexicon USING (word) GROUP BY ALL),
mood AS (SELECT *, CASE WHEN score > 0 THEN 'Positive' WHEN score < 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM scored)"""
_BEST = f"""{TOPIC_TERMS}, {CATEGORIES}, scores AS (SELECT topic, cat_order, category, count(*) AS hits, sum(weight) AS score
  FROM topic_terms JOIN categories ON lower(term) = word GROUP BY ALL),
best AS (SELECT topic, category, hits FROM scores QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, cat_order) = 1),
auto AS (SELECT topic, list(term ORDER BY position) FILTER (length(term) >= 3 AND NOT regexp_matches(term, '[0-9]'))[1:3] AS t
  FROM topic_terms GROUP BY topic),
auto_label AS (SELECT topic, CASE WHEN t IS NULL OR len(t) = 0 THEN 'Topic' ELSE upper(substr(array_to_string(t, ' • '), 1, 1))
  || substr(array_to_string(list_transform(t, lambda x: substr(x, 1, 20)), ' • '), 2) END AS label FROM auto),
labels_of AS (SELECT a.topic, CASE WHEN hits >= 2 THEN category ELSE label END AS label FROM auto_label a LEFT JOIN best USING (topic))"""


def _shares_sql(source: str) -> str:
    return f"""shares AS (SELECT topic, round(CASE WHEN row_number() OVER (ORDER BY p DESC, topic) = 1
      THEN p + round(100 - sum(p) OVER (), 2) ELSE p END, 2) AS percent FROM (SELECT topic, round(100 * w / sum(w) OVER (), 2) AS p
      FROM (SELECT topic, CAST(sum(weight) AS DOUBLE) AS w FROM {source} GROUP BY topic)))"""


_TOPICS = f"""{_BEST}, by_source AS (SELECT CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) + 1 AS topic, n_chars AS weight
  FROM documents), {_shares_sql('by_source')}, topics AS (SELECT topic, percent, label FROM shares JOIN labels_of USING (topic))"""
_GROUP = """CASE WHEN contains(t, 'ORG') THEN 'ORG' WHEN contains(t, 'PERSON') THEN 'PERSON' WHEN contains(t, 'GPE') THEN 'GPE'
  WHEN contains(t, 'DATE') THEN 'DATE' WHEN contains(t, 'MONEY') THEN 'CARDINAL_MONEY' WHEN contains(t, 'LOC') THEN 'LOC'
  WHEN contains(t, 'FAC') THEN 'FACILITY' WHEN contains(t, 'PRODUCT') THEN 'PRODUCT' WHEN contains(t, 'EVENT') THEN 'EVENT'
  ELSE 'OTHER' END"""

ORACLES = {
    "lemmatize": f"""SELECT doc_id, array_to_string(list_transform(string_split(trim(regexp_replace(lower(text), '{NON_WORD}', ' ', 'g')), ' '),
        lambda w: CASE WHEN regexp_full_match(w, '[a-z]{{4,}}s') THEN w[:-2] ELSE w END), ' ') AS text FROM documents""",
    "sentence_sentiment": f"WITH {_SCORED} SELECT doc_id, sentence_id, sentence, score, sentiment FROM mood",
    "sentiment_distribution": f"WITH {_SCORED} SELECT lang, sentiment, count(*) AS sentences FROM mood GROUP BY ALL",
    "corpus_valence": f"""WITH {LEXICON}, w AS (SELECT regexp_replace(lower(unnest({space_tokens_sql('text')})), '[^a-z'']', '', 'g') AS word
        FROM documents) SELECT count(*) AS scored_words, round(avg(CAST(valence AS DOUBLE)), 6) AS mean_valence,
        CASE WHEN avg(valence) > 0.05 THEN 'Positive' WHEN avg(valence) < -0.05 THEN 'Negative' ELSE 'Neutral' END AS sentiment
        FROM w JOIN lexicon USING (word)""",
    "entities": f"WITH {ENTITIES} SELECT * FROM entities",
    "dedupe_entities": f"""WITH {ENTITIES} SELECT * FROM entities QUALIFY row_number() OVER (
        PARTITION BY lower(text), entity_type ORDER BY doc_id, "start") = 1""",
    "dedupe_entities_by_text": f"""WITH {ENTITIES} SELECT * FROM entities QUALIFY row_number() OVER (
        PARTITION BY lower(text) ORDER BY doc_id, "start", "end", text, entity_type) = 1""",
    "filter_person_noise": f"""WITH {ENTITIES} SELECT * FROM entities WHERE NOT (entity_type = 'PERSON' AND NOT contains(text, ' ')
        AND substr(text, 1, 1) = lower(substr(text, 1, 1)) AND substr(text, 1, 1) <> upper(substr(text, 1, 1)))""",
    "entity_type_groups": f"""WITH {ENTITIES} SELECT {_GROUP} AS entity_group, text AS value, count(*) AS mentions
        FROM (SELECT text, entity_type AS t FROM entities) GROUP BY ALL""",
    "topic_terms": f"""WITH {TOPIC_TERMS} SELECT topic, list(term ORDER BY position) AS terms, sum(weight) AS weight
        FROM topic_terms GROUP BY topic""",
    "topic_label": f"WITH {_BEST} SELECT topic, label FROM labels_of",
    "topic_auto_label": f"WITH {_BEST} SELECT topic, label FROM auto_label",
    "topic_shares": f"WITH {DOC_TOPICS}, {_shares_sql('doc_topics')} SELECT * FROM shares",
    "topic_mapping": f"""WITH {DOC_TOPICS} SELECT doc_id, topic, round(weight * 100, 2) AS confidence, CAST(163 AS BIGINT) AS n FROM doc_topics
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic) = 1""",
    "topic_rollup": f"""WITH {_TOPICS}, m AS (SELECT min_by(label, topic) AS label, min(topic) AS t, sum(percent) AS p FROM topics
        GROUP BY lower(label)), r AS (SELECT label, t, round(p * (100 / sum(p) OVER ()), 2) AS p FROM m)
        SELECT label, round(CASE WHEN row_number() OVER (ORDER BY p DESC, t) = 1 THEN p + 100 - sum(p) OVER () ELSE p END, 2)
        AS percent FROM r""",
    "relevant_topics": f"WITH {_TOPICS} SELECT topic, percent, label FROM topics WHERE percent >= 5",
}
