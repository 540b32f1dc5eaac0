"""Tokens, frequencies, ranks, n-grams, overlap, co-occurrence, overview."""

from pyspark.sql import functions as F

from catalog.common import (ALL_FREQS, FREQS, NON_WORD, RANKED, SPACE, STOP, TOKEN_LISTS, documents, ngrams_sql,
                            space_tokens_sql, strip_sql, table)
from wordloom.constants import NETWORK_MAX_LINKS
from wordloom.functions import text as T
from wordloom.operators import cooccurrence as co, corpus, frequency as fq, ngrams as ng, overlap as ov
from wordloom.operators.normalize import normalize_corpus, stem_dictionary
from wordloom.operators.sentiment import split_sentences


def _freqs(spark, sf, stop=False):
    return fq.word_frequency(documents(spark, sf), include_stopwords=stop)


def _per_doc(column):
    return lambda spark, sf: documents(spark, sf).select("doc_id", column().alias("result"))


def _chunks(spark, sf):
    parts = documents(spark, sf).select("doc_id", F.explode(T.chunks(F.col("text"), 3000)).alias("p"))
    return parts.select("doc_id", F.col("p.start").cast("bigint").alias("start"), "p.chunk").filter(F.length("chunk") > 100)


def _overlap(spark, sf):
    return ov.class_overlap(documents(spark, sf), "en", label="lang")


def _edges(spark, sf):
    return co.cooccurrence(documents(spark, sf), top_n=20)


QUERIES = {
    # text functions
    "tokenize": _per_doc(lambda: F.array_join(T.tokenize(F.col("text")), " ")),
    "tokenize_capped": _per_doc(lambda: F.array_join(T.tokenize(F.col("text"), max_tokens=80), " ")),
    "tokenize_vocab": lambda s, d: documents(s, d).select(
        F.explode(T.tokenize_vocab(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")),
    "basic_clean": _per_doc(lambda: T.basic_clean(F.col("text"))),
    "remove_stopwords": _per_doc(lambda: T.remove_stopwords(T.basic_clean(F.col("text")))),
    "normalize_corpus": lambda s, d: normalize_corpus(
        documents(s, d).select("doc_id", "text"), remove_stopwords=True),
    "stem": lambda s, d: stem_dictionary(normalize_corpus(documents(s, d).select("doc_id", "text"))),
    "split_sentences": lambda s, d: split_sentences(documents(s, d)),
    "chunk_text": _chunks,
    "snippet": _per_doc(lambda: T.snippet(F.col("text"))),
    "truncate_text": lambda s, d: corpus.truncate_text(documents(s, d), 2000).select("doc_id", "text"),
    # corpus rows
    "extract_text": lambda s, d: corpus.extract_text(
        table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("text")).alias("email"),
                                            F.col("role").alias("message"))).select("conv_id", "turn", "text"),
    "filter_class": lambda s, d: corpus.filter_class(documents(s, d), "labelfr", label="lang").select("doc_id"),
    "drop_empty": lambda s, d: corpus.drop_empty(documents(s, d), label="lang").select("doc_id"),
    "sample_rows": lambda s, d: corpus.sample_rows(documents(s, d)).select("doc_id", "lang"),
    "corpus_fingerprint": lambda s, d: corpus.corpus_fingerprint(documents(s, d)),
    # frequencies
    "word_frequency": lambda s, d: _freqs(s, d),
    "word_frequency_by_class": lambda s, d: fq.word_frequency_by_class(documents(s, d), label="lang"),
    "wordcloud_frequency": lambda s, d: fq.wordcloud_frequency(documents(s, d)),
    "frequency_bands": lambda s, d: fq.frequency_bands(_freqs(s, d)),
    "zipf": lambda s, d: fq.zipf(documents(s, d)),
    "zipf_fit": lambda s, d: fq.zipf_fit(_freqs(s, d, True)),
    "hapax_stats": lambda s, d: fq.hapax_stats(_freqs(s, d, True)),
    "coverage_milestones": lambda s, d: fq.coverage_milestones(_freqs(s, d, True)),
    "coverage": lambda s, d: fq.coverage(_freqs(s, d), min_rank=100),
    "coverage_cumulative": lambda s, d: fq.coverage_cumulative(_freqs(s, d)),
    # overview
    "corpus_stats": lambda s, d: fq.corpus_stats(documents(s, d)),
    "doc_length_stats": lambda s, d: fq.doc_length_stats(documents(s, d)),
    "doc_length_histogram": lambda s, d: fq.doc_length_histogram(documents(s, d)),
    # n-grams
    "ngrams": lambda s, d: ng.ngrams(documents(s, d)),
    "ngrams_by_class": lambda s, d: ng.ngrams(documents(s, d), 3, class_name="fr", label="lang"),
    "ngram_summary": lambda s, d: ng.ngram_summary(documents(s, d)),
    "ngram_share": lambda s, d: ng.ngram_share(documents(s, d)),
    # overlap
    "class_overlap": _overlap,
    "class_overlap_summary": lambda s, d: ov.class_overlap_summary(_overlap(s, d)),
    "class_overlap_top": lambda s, d: ov.class_overlap_top(_overlap(s, d)),
    # co-occurrence
    "cooccurrence_vocab": lambda s, d: co.cooccurrence_vocab(documents(s, d), top_n=20),
    "cooccurrence_edges": _edges,
    "cooccurrence_threshold": lambda s, d: co.cooccurrence_threshold(_edges(s, d), 10_000),
    "cooccurrence_network": lambda s, d: co.cooccurrence_network(_edges(s, d), top_n=20),
    "network_degree": lambda s, d: co.network_degree(co.cooccurrence_network(_edges(s, d), top_n=20), NETWORK_MAX_LINKS),
}

_VOCAB = f"""words AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '{NON_WORD}'),
    lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}')))) AS word FROM documents),
vocab AS (SELECT word, word IN {STOP} AS is_stop, count(*) AS doc_freq FROM words GROUP BY word
  QUALIFY row_number() OVER (PARTITION BY word IN {STOP} ORDER BY count(*) DESC, word) <= 60)"""
_EDGES = f"""{_VOCAB}, kept AS (SELECT doc_id, word FROM words SEMI JOIN vocab USING (word)),
edges AS (SELECT a.word AS source, b.word AS target, count(*) AS value FROM kept a JOIN kept b
  ON a.doc_id = b.doc_id AND a.word < b.word GROUP BY ALL)"""
_NETWORK = f"""{_EDGES}, strong AS (SELECT * FROM edges WHERE value >= 2),
strength AS (SELECT word, sum(value) AS strength FROM (SELECT source AS word, value FROM strong UNION ALL
  SELECT target, value FROM strong) GROUP BY word),
keep AS (SELECT word FROM strength QUALIFY row_number() OVER (
  PARTITION BY word IN {STOP} ORDER BY strength DESC, word) <= 20),
network AS (SELECT source, target, value FROM strong WHERE source IN (SELECT word FROM keep)
  AND target IN (SELECT word FROM keep))"""
_LENGTHS = f"""lengths AS (SELECT len({space_tokens_sql('text')}) AS n FROM documents),
l AS (SELECT n FROM lengths WHERE n > 0)"""
_OVERLAP = f"""t AS (SELECT lang, unnest({space_tokens_sql('lower(text)')}) AS term FROM documents WHERE lang IS NOT NULL),
c AS (SELECT term, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang <> 'en') AS b FROM t GROUP BY term),
overlap AS (SELECT term, CASE WHEN a >= 10 AND b >= 10 THEN 'overlap' WHEN a >= 10 THEN 'unique_target'
    ELSE 'unique_other' END AS bucket, CASE WHEN a >= 10 THEN a ELSE 0 END AS target,
    CASE WHEN b >= 10 THEN b ELSE 0 END AS other,
    (CASE WHEN a >= 10 THEN a ELSE 0 END) + (CASE WHEN b >= 10 THEN b ELSE 0 END) AS total
  FROM c WHERE a >= 10 OR b >= 10)"""
_BIGRAMS = f"{TOKEN_LISTS}, grams AS (SELECT unnest({ngrams_sql('t', 2)}) AS ngram FROM lists)"
_CLEAN = f"trim(regexp_replace(lower(text), '{NON_WORD}', ' ', 'g'))"
_NO_STOP = f"array_to_string(list_filter(string_split({_CLEAN}, ' '), lambda w: w <> '' AND w NOT IN {STOP}), ' ')"

ORACLES = {
    "tokenize": f"WITH {TOKEN_LISTS} SELECT doc_id, array_to_string(t, ' ') AS result FROM lists",
    "tokenize_capped": f"WITH {TOKEN_LISTS} SELECT doc_id, array_to_string(t[1:80], ' ') AS result FROM lists",
    "tokenize_vocab": f"""SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(
        regexp_split_to_array(lower(text), '{NON_WORD}'), lambda w: regexp_full_match(w, '[a-z0-9]{{3,}}'))) AS word
        FROM documents) GROUP BY word""",
    "basic_clean": f"SELECT doc_id, {_CLEAN} AS result FROM documents",
    "remove_stopwords": f"SELECT doc_id, {_NO_STOP} AS result FROM documents",
    "normalize_corpus": f"SELECT doc_id, {_NO_STOP} AS text FROM documents",
    "split_sentences": f"""SELECT doc_id, CAST(generate_subscripts(s, 1) AS BIGINT) AS sentence_id, unnest(s) AS sentence
        FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.?!]{SPACE}+'),
        lambda x: {strip_sql('x')}), lambda x: x <> '') AS s FROM documents)""",
    "chunk_text": """SELECT doc_id, start, substr(text, start + 1, 3000) AS chunk FROM (SELECT doc_id, text,
        unnest(range(0, length(text), 3000)) AS start FROM documents) WHERE length(substr(text, start + 1, 3000)) > 100""",
    "snippet": """SELECT doc_id, CASE WHEN length(text) > 180 THEN substr(text, 1, 160) || '...' ELSE text END AS result
        FROM documents""",
    "truncate_text": "SELECT doc_id, substr(text, 1, 2000) AS text FROM documents",
    "extract_text": """SELECT conv_id, turn, coalesce(CASE WHEN turn > 0 THEN nullif(text, '') END, nullif(role, ''), '')
        AS text FROM conversations""",
    "filter_class": "SELECT doc_id FROM documents WHERE lang = 'fr'",
    "drop_empty": f"SELECT doc_id FROM documents WHERE {strip_sql('text')} <> '' AND {strip_sql('lang')} <> ''",
    "sample_rows": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 40",
    "corpus_fingerprint": "SELECT count(*) AS n_documents, substr(sha256(concat_ws(',', " + ", ".join(
        f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))
        + ")), 1, 16) AS fingerprint FROM (SELECT sha256(coalesce(text, '')) AS h FROM documents)",
    "word_frequency": f"WITH {FREQS} SELECT word, frequency FROM freqs",
    "word_frequency_by_class": f"""WITH {ALL_FREQS} SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END
        AS class_name, word, count(*) AS frequency FROM tokens WHERE word NOT IN {STOP}
        GROUP BY GROUPING SETS ((lang, word), (word))""",
    "wordcloud_frequency": f"""SELECT word, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(lower(text),
        '[a-z0-9]{{3,}}')) AS word FROM documents) WHERE word NOT IN {STOP} GROUP BY word""",
    "frequency_bands": f"""WITH {FREQS} SELECT frequency AS min_frequency, frequency AS max_frequency,
        CAST(sum(count(*)) OVER (ORDER BY frequency DESC) AS BIGINT) AS word_count FROM freqs GROUP BY frequency""",
    "zipf": f"WITH {ALL_FREQS}, {RANKED} SELECT rank, word, frequency AS freq FROM ranked",
    "zipf_fit": f"""WITH {ALL_FREQS}, {RANKED}, w AS (SELECT least(50, greatest(2, CAST(floor(count(*) / 20 + 0.5) AS BIGINT)))
        AS lo, least(5000, count(*)) AS hi FROM freqs)
        SELECT max(lo) AS fit_start_rank, max(hi) AS fit_end_rank, count(*) AS n_points,
        round(regr_slope(log10(frequency), log10(rank)), 6) AS slope,
        round(regr_intercept(log10(frequency), log10(rank)), 6) AS intercept,
        round(regr_r2(log10(frequency), log10(rank)), 6) AS r2 FROM ranked, w WHERE rank BETWEEN lo AND hi""",
    "hapax_stats": f"""WITH {ALL_FREQS}, {RANKED} SELECT count(*) FILTER (frequency = 1) AS hapax_count,
        round(CAST(100 AS DOUBLE) * count(*) FILTER (frequency = 1) / count(*), 6) AS hapax_pct_types,
        min(rank) FILTER (frequency = 1) AS first_hapax_rank FROM ranked""",
    "coverage_milestones": f"""WITH {ALL_FREQS}, {RANKED}, c AS (SELECT rank, sum(frequency) OVER (ORDER BY rank) AS seen,
        sum(frequency) OVER () AS total FROM ranked), steps AS (SELECT unnest([50, 80, 90]) AS step)
        SELECT CAST(step AS BIGINT) AS step, min(rank) AS rank FROM c JOIN steps ON 100 * seen >= step * total GROUP BY step""",
    "coverage": f"""WITH {FREQS}, {RANKED} SELECT rank, round(CAST(sum(frequency) OVER (ORDER BY rank) AS DOUBLE)
        / (SELECT sum(frequency) FROM freqs), 6) AS coverage FROM ranked WHERE rank >= 100""",
    "coverage_cumulative": f"""WITH {FREQS}, {RANKED} SELECT rank, round(CAST(sum(frequency) OVER (ORDER BY rank) AS DOUBLE)
        / sum(frequency) OVER () * 100, 6) AS coverage_pct FROM ranked""",
    "corpus_stats": f"""WITH w AS (SELECT unnest({space_tokens_sql('text')}) AS w FROM documents),
        s AS (SELECT count(*) AS total_words, count(DISTINCT lower(w)) AS unique_words FROM w)
        SELECT total_words, unique_words, round(CAST(unique_words AS DOUBLE) / total_words, 6) AS ttr,
        CASE WHEN unique_words / total_words >= 0.4 THEN 'Diverse' WHEN unique_words / total_words < 0.15
        THEN 'Repetitive' ELSE 'Moderate' END AS diversity FROM s""",
    "doc_length_stats": f"""WITH {_LENGTHS}, r AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS t FROM l)
        SELECT count(*) AS documents, min(n) AS min_words, max(n) AS max_words, round(avg(CAST(n AS DOUBLE)), 6) AS mean_words,
        max(n) FILTER (i = t // 2 + 1) AS median_words FROM r""",
    "doc_length_histogram": f"""WITH {_LENGTHS}, e AS (SELECT min(n) AS lo, max(n) AS hi, (max(n) - min(n)) / 12 AS w FROM l),
        b AS (SELECT unnest(range(12)) AS bin), c AS (SELECT least(11, CAST(floor((n - lo) / w) AS BIGINT)) AS bin, count(*) AS docs
        FROM l, e GROUP BY 1) SELECT b.bin, round(lo + b.bin * w, 6) AS from_words, round(lo + (b.bin + 1) * w, 6) AS to_words,
        coalesce(docs, 0) AS docs FROM b LEFT JOIN c USING (bin), e""",
    "ngrams": f"WITH {_BIGRAMS} SELECT ngram, count(*) AS frequency FROM grams GROUP BY ngram ORDER BY frequency DESC, ngram LIMIT 25",
    "ngrams_by_class": f"""WITH {TOKEN_LISTS} SELECT ngram, count(*) AS frequency FROM (SELECT unnest({ngrams_sql('t', 3)}) AS ngram
        FROM lists WHERE lang = 'fr') GROUP BY ngram ORDER BY frequency DESC, ngram LIMIT 25""",
    "ngram_summary": f"""WITH {_BIGRAMS} SELECT CAST(2 AS BIGINT) AS n, count(*) AS total_ngrams, count(DISTINCT ngram) AS unique_ngrams,
        (SELECT count(*) FROM lists WHERE len(t) > 0) AS n_documents FROM grams""",
    "ngram_share": f"""WITH {_BIGRAMS} SELECT ngram, count(*) AS frequency, round(CAST(100 AS DOUBLE) * count(*)
        / (SELECT count(*) FROM grams), 6) AS share_pct FROM grams GROUP BY ngram ORDER BY frequency DESC, ngram LIMIT 25""",
    "class_overlap": f"WITH {_OVERLAP} SELECT * FROM overlap",
    "class_overlap_summary": f"WITH {_OVERLAP} SELECT bucket, count(*) AS terms, CAST(sum(total) AS BIGINT) AS occurrences FROM overlap GROUP BY bucket",
    "class_overlap_top": f"""WITH {_OVERLAP} SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY total DESC, term) AS rank
        FROM overlap QUALIFY rank <= 20""",
    "cooccurrence_vocab": f"WITH {_VOCAB} SELECT word, is_stop, doc_freq FROM vocab",
    "cooccurrence_edges": f"WITH {_EDGES} SELECT source, target, value FROM edges",
    "cooccurrence_threshold": f"""WITH {_EDGES}, m AS (SELECT max(value) AS v FROM edges) SELECT v AS max_value, CAST(CASE
        WHEN v >= 1000 THEN 1000 WHEN v >= greatest(2, least(1000, v)) THEN greatest(2, least(1000, v)) ELSE 1 END AS BIGINT)
        AS min_cooccurrence_used FROM m""",
    "cooccurrence_network": f"WITH {_NETWORK} SELECT * FROM network",
    "network_degree": f"""WITH {_NETWORK}, links AS (SELECT * FROM network ORDER BY value DESC, source, target LIMIT 120)
        SELECT id, count(*) AS degree FROM (SELECT source AS id FROM links UNION ALL SELECT target FROM links) GROUP BY id""",
}
