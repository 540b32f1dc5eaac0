"""Tables, derived inputs and SQL fragments shared by the registered queries.

Dictionaries that a caller would bring (lexicon, gazetteer, lemmas, categories) and tables that a
model would produce (predictions, scores, document topics) are derived from the given tables, on
both sides by the same rule.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordloom.constants import STOPWORDS
from wordloom.functions import text as T
from wordloom.plans.storage import spread

STOP = "(" + ", ".join(f"'{w}'" for w in sorted(STOPWORDS)) + ")"
SPACE = r"[\s\x0B\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def labelled(spark, sf) -> DataFrame:
    """Documents with their quality and toxic flags."""
    return documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def space_tokens_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{SPACE}+'), lambda w: w <> '')"


def words_sql(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '{NON_WORD}'), lambda w: length(w) >= 2)"


def ngrams_sql(t: str, n: int) -> str:
    parts = " || ' ' || ".join(f"{t}[i + {k}]" if k else f"{t}[i]" for k in range(n))
    return f"list_transform(range(1, len({t}) - {n - 2}), lambda i: {parts})"


# Tokens of all documents, and word frequencies with and without stopwords.
TOKENS = """tokens AS (SELECT doc_id, lang, lower(t) AS word FROM
  (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[A-Za-z0-9]{3,}')) AS t FROM documents))"""
FREQS = f"""{TOKENS},
freqs AS (SELECT word, count(*) AS frequency FROM tokens WHERE word NOT IN {STOP} GROUP BY word)"""
ALL_FREQS = f"""{TOKENS},
freqs AS (SELECT word, count(*) AS frequency FROM tokens GROUP BY word)"""
RANKED = """ranked AS (SELECT word, frequency, row_number() OVER (
  ORDER BY frequency DESC, substr(md5(word), 1, 3), word) AS rank FROM freqs)"""
TOKEN_LISTS = f"""lists AS (SELECT doc_id, lang, list_filter(list_transform(
  regexp_extract_all(text, '[A-Za-z0-9]{{3,}}'), lambda x: lower(x)), lambda x: x NOT IN {STOP}) AS t FROM documents)"""


# Lexicon: the words of `benchmark`, each with a valence from its hash.
def lexicon(spark, sf) -> DataFrame:
    words = table(spark, sf, "benchmark").select(F.explode(T.word_terms(F.col("text"))).alias("word")).distinct()
    valence = F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("int") % 11 - 5
    return words.withColumn("valence", valence).filter("valence <> 0")


LEXICON = f"""lexicon AS (SELECT word, valence FROM (SELECT word,
  CAST(CAST('0x' || substr(md5(word), 1, 4) AS BIGINT) % 11 - 5 AS INT) AS valence FROM
  (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM benchmark)) WHERE valence <> 0)"""

TYPES = ["ORGANIZATION", "PERSON", "GPE", "DATE", "MONEY", "LOCATION", "FACILITY", "PRODUCT", "EVENT", "LAW"]


# Gazetteer: words of five and more letters and all word pairs of `benchmark`, typed by hash.
def gazetteer(spark, sf) -> DataFrame:
    words = table(spark, sf, "benchmark").select(T.word_terms(F.col("text")).alias("w"))
    long_words = F.filter("w", lambda x: F.length(x) >= 5)
    phrases = words.select(F.explode(F.concat(long_words, T.ngrams(F.col("w"), 2))).alias("phrase")).distinct()
    kind = F.conv(F.substring(F.md5("phrase"), 1, 4), 16, 10).cast("int") % len(TYPES)
    names = F.array(*[F.lit(t) for t in TYPES])
    return phrases.withColumn("entity_type", F.get(names, kind))


GAZETTEER = f"""gazetteer AS (SELECT phrase, ([{', '.join(f"'{t}'" for t in TYPES)}])[
    1 + CAST('0x' || substr(md5(phrase), 1, 4) AS BIGINT) % {len(TYPES)}] AS entity_type FROM (
  SELECT DISTINCT unnest(list_concat(list_filter(w, lambda x: length(x) >= 5), {ngrams_sql('w', 2)})) AS phrase
  FROM (SELECT {words_sql('text')} AS w FROM benchmark)))"""
ENTITIES = f"""{GAZETTEER},
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS p FROM documents)),
spans AS (SELECT doc_id, i, piece, lead(piece, 1) OVER w AS p2, lead(piece, 2) OVER w AS p3,
    sum(length(piece)) OVER w - length(piece) AS start FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT doc_id, start, piece AS text FROM spans UNION ALL
  SELECT doc_id, start, piece || p2 || p3 FROM spans WHERE p3 IS NOT NULL),
entities AS (SELECT doc_id, text, entity_type, CAST(start AS BIGINT) AS "start",
    CAST(start + length(text) AS BIGINT) AS "end", 'gazetteer' AS source
  FROM grams JOIN gazetteer ON lower(text) = phrase)"""


# Lemmas: a plain plural rule over the cleaned vocabulary.
def lemmas(spark, sf) -> DataFrame:
    clean = documents(spark, sf).select(F.explode(F.split(T.basic_clean(F.col("text")), " ")).alias("token")).distinct()
    return clean.filter(F.col("token").rlike("^[a-z]{4,}s$")).withColumn("lemma", F.regexp_replace("token", "s$", ""))


# Categories: words of `benchmark` by their first letter.
def categories(spark, sf) -> DataFrame:
    words = table(spark, sf, "benchmark").select(F.explode(T.word_terms(F.col("text"))).alias("word")).distinct()
    letter = F.substring("word", 1, 1)
    return words.filter(letter.rlike("[a-z]")).select(
        F.ascii(letter).alias("cat_order"), F.concat(F.lit("Letter "), F.upper(letter)).alias("category"), "word")


CATEGORIES = f"""categories AS (SELECT ascii(substr(word, 1, 1)) AS cat_order,
  'Letter ' || upper(substr(word, 1, 1)) AS category, word FROM
  (SELECT DISTINCT unnest({words_sql('text')}) AS word FROM benchmark) WHERE regexp_matches(substr(word, 1, 1), '[a-z]'))"""


# Topic terms: per source, its ten most frequent words, topics numbered by source name.
def topic_terms(spark, sf) -> DataFrame:
    from wordloom.operators.frequency import word_frequency_by_class

    top = word_frequency_by_class(documents(spark, sf), label="source", top_n=10).filter("class_name <> 'all'")
    topic = F.regexp_extract("class_name", r"(\d+)$", 1).cast("bigint") + 1
    return top.select(topic.alias("topic"), F.col("rank").alias("position"), F.col("word").alias("term"),
                      F.col("frequency").cast("double").alias("weight"))


TOPIC_TERMS = f"""topic_terms AS (SELECT CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) + 1 AS topic,
    row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS position, word AS term, CAST(n AS DOUBLE) AS weight
  FROM (SELECT source, word, count(*) AS n FROM (SELECT source, lower(t) AS word FROM
    (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z0-9]{{3,}}')) AS t FROM documents))
    WHERE word NOT IN {STOP} GROUP BY source, word)
  QUALIFY position <= 10)"""


# Document topics: the absolute embedding values of a vector, scaled to one.
def doc_topics(spark, sf) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", total.alias("t"), F.posexplode("v").alias("k", "x")).select(
        "doc_id", (F.col("k") + 1).cast("bigint").alias("topic"), (F.col("x") / F.col("t")).alias("weight"))


DOC_TOPICS = """doc_topics AS (SELECT doc_id, topic, x / sum(x) OVER (PARTITION BY doc_id) AS weight FROM (
  SELECT vec_id AS doc_id, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS topic,
    abs(CAST(unnest(embedding) AS DOUBLE)) AS x FROM embeddings))"""


# Predictions: quality told from the length, language told from common words.
def predictions(spark, sf) -> DataFrame:
    rows = labelled(spark, sf)
    return rows.select("doc_id", F.col("quality").cast("string").alias("y_true"),
                       (F.col("n_chars") > 700).cast("int").cast("string").alias("y_pred"),
                       ((F.col("n_chars") % 1000) / 1000).alias("score"))


PREDICTIONS = """predictions AS (SELECT doc_id, CAST(quality AS VARCHAR) AS y_true,
  CASE WHEN n_chars > 700 THEN '1' ELSE '0' END AS y_pred, CAST(n_chars % 1000 AS DOUBLE) / 1000 AS score
  FROM documents JOIN labels USING (doc_id))"""


def language_guess(spark, sf) -> DataFrame:
    t = F.col("text")
    guess = (F.when(F.contains(t, F.lit(" und ")), "de").when(F.contains(t, F.lit(" les ")), "fr")
             .when(F.contains(t, F.lit(" los ")), "es").otherwise("en"))
    return documents(spark, sf).select("doc_id", F.col("lang").alias("y_true"), guess.alias("y_pred"))


LANGUAGE_GUESS = """predictions AS (SELECT doc_id, lang AS y_true, CASE WHEN contains(text, ' und ') THEN 'de'
  WHEN contains(text, ' les ') THEN 'fr' WHEN contains(text, ' los ') THEN 'es' ELSE 'en' END AS y_pred FROM documents)"""


def ml_predictions(spark, sf) -> DataFrame:
    rows = labelled(spark, sf)
    flags = F.array(
        F.struct(F.lit("quality").alias("label"), F.col("quality").alias("y_true"),
                 (F.col("n_chars") > 700).cast("int").alias("y_pred")),
        F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("y_true"),
                 (F.col("n_chars") % 7 == 0).cast("int").alias("y_pred")))
    return rows.select("doc_id", F.inline(flags))


ML_PREDICTIONS = """ml_predictions AS (
  SELECT doc_id, 'quality' AS label, quality AS y_true, CAST(n_chars > 700 AS INT) AS y_pred
  FROM documents JOIN labels USING (doc_id) UNION ALL
  SELECT doc_id, 'toxic', toxic, CAST(n_chars % 7 = 0 AS INT) FROM documents JOIN labels USING (doc_id))"""

# Scores: ten folds by id; each configuration's value is a mean over the documents of a fold.
_CONFIGS = [("lr", "tf", 7), ("lr", "tfidf", 11), ("nb", "tf", 13), ("nb", "tfidf", 17), ("svm", "tf", 19),
            ("svm", "tfidf", 23), ("baseline", "-", 5)]


def scores(spark, sf) -> DataFrame:
    values = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("feature"), F.col(f"v{p}").alias("value"))
                       for m, f, p in _CONFIGS])
    folds = documents(spark, sf).groupBy((F.col("doc_id") % 10).cast("int").alias("fold")).agg(
        *[(F.avg((F.col("n_chars") % p).cast("double")) / p).alias(f"v{p}") for _, _, p in _CONFIGS])
    return folds.select("fold", F.inline(values)).withColumns(
        {"dataset": F.lit("documents"), "metric": F.lit("f1_weighted")})


SCORES = "scores AS (" + " UNION ALL ".join(
    f"SELECT 'documents' AS dataset, 'f1_weighted' AS metric, '{m}' AS model, '{f}' AS feature, "
    f"'{m}{'' if f == '-' else '+' + f}' AS config, CAST(doc_id % 10 AS INT) AS fold, "
    f"avg(CAST(n_chars % {p} AS DOUBLE)) / {p} AS value FROM documents GROUP BY ALL" for m, f, p in _CONFIGS) + ")"
PAIRS = """pairs AS (
  SELECT 'representation' AS family, a.config AS a, b.config AS b FROM c a JOIN c b ON a.model = b.model
    AND a.feature = 'tf' AND b.feature = 'tfidf' UNION ALL
  SELECT 'algorithm', a.config, b.config FROM c a JOIN c b ON a.feature = b.feature AND a.model < b.model
    WHERE a.model <> 'baseline' AND b.model <> 'baseline' UNION ALL
  SELECT 'baseline', config, 'baseline' FROM c WHERE model <> 'baseline')"""
DIFFS = f"""{SCORES}, c AS (SELECT DISTINCT model, feature, config FROM scores), {PAIRS},
diffs AS (SELECT s.dataset, s.metric, p.family, p.a, p.b, count(*) AS k, avg(s.value - t.value) AS d_mean,
    CASE WHEN max(s.value - t.value) = min(s.value - t.value) THEN 0 ELSE var_samp(s.value - t.value) END AS d_var
  FROM pairs p JOIN scores s ON s.config = p.a JOIN scores t ON t.config = p.b AND t.fold = s.fold
  GROUP BY ALL)"""


# Labeled lines: `[lang+source] first line of the text`.
def labeled_lines(spark, sf) -> DataFrame:
    flat = F.regexp_replace("text", r"[\r\n]+", " ")
    labels = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.concat_ws("+", "lang", "source"))
    return documents(spark, sf).select("doc_id", F.concat(F.lit("["), labels, F.lit("] "), flat).alias("value"))


LINES = """lines AS (SELECT doc_id, '[' || CASE WHEN doc_id % 3 = 0 THEN lang ELSE lang || '+' || source END || '] '
  || regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS value FROM documents)"""
