"""Sources and sinks, schema inference, label shaping."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from catalog.common import LINES, SPACE, documents, labeled_lines, labelled, strip_sql, table
from wordloom.operators import labels as lb, schema as sc
from wordloom.plans.storage import scratch_path
from wordloom.sources import binary, delimited, lines as ln


def _as_tsv(spark, sf) -> DataFrame:
    """One line per document, one dialect per language."""
    sep = (F.when(F.col("lang") == "en", "\t").when(F.col("lang") == "de", ",").when(F.col("lang") == "fr", ";")
           .otherwise("|"))
    plain = F.regexp_replace("source", "[^a-z0-9]", "")
    return documents(spark, sf).select(F.col("lang").alias("file"), F.col("doc_id").alias("line_no"), F.concat(
        F.col("doc_id").cast("string"), sep, plain, sep, F.col("n_chars").cast("string")).alias("value"))


def _round_trip(spark, sf) -> DataFrame:
    path = scratch_path(spark, "csv")
    delimited.write_clean_csv(documents(spark, sf).select("doc_id", "lang", "text"), path)
    return delimited.read_delimited(spark, path).data


def _literal_quotes(spark, sf) -> DataFrame:
    """Tab-separated lines with stray quote marks; a cell of over 45 characters in each row tells that no file has a header."""
    path = scratch_path(spark, "tsv")
    flat = F.regexp_replace("text", r'[\r\n\t"]+', " ")
    rows = documents(spark, sf).select(F.concat_ws("\t", F.col("doc_id").cast("string"), "lang", F.concat(
        F.when(F.col("doc_id") % 5 == 0, '"').otherwise(""), F.lit("x" * 46), F.col("doc_id").cast("string"), flat)).alias("value"))
    ln.write_text_lines(rows, path)
    return delimited.read_delimited(spark, path).data


def _text_lines(spark, sf) -> DataFrame:
    path = scratch_path(spark, "lines")
    ln.write_text_lines(documents(spark, sf).select(F.col("text").alias("value")), path)
    return ln.read_text_lines(spark, path).groupBy("text").agg(F.count("*").alias("n"))


def _multilabel_lines(spark, sf) -> DataFrame:
    flat = F.regexp_replace("text", r"[\r\n]+", " ")
    return labelled(spark, sf).select("doc_id", F.concat_ws(
        "\t", F.col("quality").cast("string"), F.col("toxic").cast("string"), F.concat(F.lit('"'), flat, F.lit('"')))
        .alias("value"))


def _read_multilabel(spark, sf) -> DataFrame:
    path = scratch_path(spark, "multilabel")
    ln.write_text_lines(_multilabel_lines(spark, sf), path)
    return ln.read_multilabel_txt(spark, path)


def _parse_multilabel(spark, sf) -> DataFrame:
    layout = ln.detect_multilabel("quality\ttoxic\t\"text of the document\"", "0\t1\t\"some text\"")
    return ln.parse_multilabel(_multilabel_lines(spark, sf), layout)


@pandas_udf(BinaryType())
def _to_docx(texts):
    return texts.map(lambda t: binary.docx_bytes(t.split("\n")))


def _binary_docs(spark, sf) -> DataFrame:
    files = documents(spark, sf).select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"),
                                        _to_docx("text").alias("content"))
    return binary.extract_binary_docs(files).select("path", "row", F.coalesce("text", F.concat(F.lit("error: "), "error")).alias("text"))


def _json_round_trip(spark, sf) -> DataFrame:
    path = scratch_path(spark, "json")
    delimited.write_results(lb.class_counts(documents(spark, sf), "lang"), path)
    return spark.read.schema("label string, documents bigint").json(path)


def _wide(spark, sf) -> DataFrame:
    return labelled(spark, sf).select("doc_id", "quality", "toxic", "text")


def _melted(spark, sf) -> DataFrame:
    return lb.melt_multilabel(_wide(spark, sf), ["quality", "toxic"])


def _profile(spark, sf) -> DataFrame:
    return sc.profile_columns(documents(spark, sf))


def _coded(spark, sf) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.concat(F.lit("label"), F.substring(F.md5("lang"), 1, 1)).alias("label"))


def _label_names(spark, sf) -> DataFrame:
    names = documents(spark, sf).filter("lang <> 'es'").select("lang").distinct()
    return names.select(F.substring(F.md5("lang"), 1, 1).alias("label_id"), F.col("lang").alias("label_name"))


def _line_labels(spark, sf) -> DataFrame:
    return lb.parse_labeled_lines(labeled_lines(spark, sf))


QUERIES = {
    "sniff_dialect": lambda s, d: delimited.sniff_dialect(_as_tsv(s, d)),
    "read_delimited": _round_trip,
    "read_delimited_literal": _literal_quotes,
    "write_clean_csv": lambda s, d: _round_trip(s, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum(
        F.length("text")).alias("chars")),
    "read_text_lines": _text_lines,
    "split_paragraphs": lambda s, d: ln.split_paragraphs(documents(s, d)),
    "read_multilabel_txt": _read_multilabel,
    "parse_multilabel": _parse_multilabel,
    "parse_labeled_lines": _line_labels,
    "write_labeled_lines": lambda s, d: lb.write_labeled_lines(_line_labels(s, d)).select("doc_id", "value"),
    "extract_binary_docs": _binary_docs,
    "write_results": _json_round_trip,
    "profile_columns": _profile,
    "detect_label_column": lambda s, d: sc.detect_label_column(_profile(s, d)),
    "detect_text_column": lambda s, d: sc.detect_text_column(_profile(s, d)),
    "detect_binary_label_columns": lambda s, d: sc.detect_binary_label_columns(
        labelled(s, d).select("quality", "toxic", "lang", "text")),
    "encode_labels": lambda s, d: lb.encode_labels(documents(s, d), "lang").select("doc_id", "label_name", "label_id"),
    "decode_labels": lambda s, d: lb.decode_labels(_coded(s, d), _label_names(s, d)),
    "melt_multilabel": lambda s, d: _melted(s, d).select("doc_id", "label", "label_name", "is_multi_label"),
    "collapse_multilabel": lambda s, d: lb.collapse_multilabel(_melted(s, d)).select(
        "text", F.array_join("labels", "+").alias("labels")),
    "unique_labels": lambda s, d: lb.unique_labels(documents(s, d), "source"),
    "has_labels": lambda s, d: lb.has_labels(documents(s, d), "lang"),
    "dataset_type": lambda s, d: lb.dataset_type(_line_labels(s, d)),
    "label_distribution": lambda s, d: lb.label_distribution(labeled_lines(s, d)),
    "label_distribution_split": lambda s, d: lb.label_distribution(labeled_lines(s, d), split_multi=True),
    "class_balance": lambda s, d: lb.class_balance(documents(s, d), "lang"),
    "class_share": lambda s, d: lb.class_share(documents(s, d), "lang"),
    "label_statistics": lambda s, d: lb.label_statistics(table(s, d, "labels"), ["quality", "toxic"]),
    "labelset_counts": lambda s, d: lb.labelset_counts(table(s, d, "labels"), ["quality", "toxic"], top_n=20),
}

_PARSED = rf"""{LINES}, parsed AS (SELECT doc_id, value, list_transform(string_split(regexp_extract(value,
  '^\[([^\]]+)\]\s*(.*)$', 1), '+'), lambda x: trim(x)) AS labels, regexp_extract(value, '^\[([^\]]+)\]\s*(.*)$', 2) AS text
  FROM lines WHERE regexp_matches(value, '^\[([^\]]+)\]\s*(.*)$'))"""
_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_PROFILE = "profile AS (" + " UNION ALL ".join(
    f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", count(*) AS n_rows, count(DISTINCT t) AS n_distinct,
    CAST(coalesce(max(length(t)), 0) AS BIGINT) AS max_length, coalesce(max(length(v)) > 20, false) AS is_long_text,
    {str(c == 'text').lower()} AS hinted_text, false AS hinted_label
    FROM (SELECT CAST({c} AS VARCHAR) AS v, nullif({strip_sql(f'CAST({c} AS VARCHAR)')}, '') AS t FROM documents)"""
    for i, c in enumerate(_COLUMNS)) + ")"
_LABEL = """(SELECT "column" FROM profile WHERE max_length <= 50 AND n_distinct BETWEEN 1 AND
  greatest(2, least(50, CAST(ceil(n_rows * CAST(0.2 AS DOUBLE)) AS BIGINT))) AND (hinted_label OR NOT hinted_text)
  ORDER BY hinted_label DESC, n_distinct, position LIMIT 1)"""
_WIDE = "w AS (SELECT doc_id, quality, toxic, text FROM documents JOIN labels USING (doc_id))"
_MELT = f"""{_WIDE}, k AS (SELECT * FROM w WHERE {strip_sql('text')} <> ''), melted AS (
  SELECT doc_id, text, '0' AS label, 'quality' AS label_name, toxic = 1 AS is_multi_label FROM k WHERE quality = 1 UNION ALL
  SELECT doc_id, text, '1', 'toxic', quality = 1 FROM k WHERE toxic = 1 UNION ALL
  SELECT doc_id, text, '-1', NULL, false FROM k WHERE quality <> 1 AND toxic <> 1)"""

ORACLES = {
    "sniff_dialect": """SELECT lang AS file, CASE lang WHEN 'en' THEN chr(9) WHEN 'de' THEN ',' WHEN 'fr' THEN ';' ELSE '|' END
        AS delimiter FROM documents GROUP BY lang""",
    "read_delimited": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents",
    "read_delimited_literal": r"""SELECT CAST(doc_id AS VARCHAR) AS column_1, lang AS column_2, CASE WHEN doc_id % 5 = 0 THEN '"' ELSE '' END || repeat('x', 46)
        || doc_id || regexp_replace(text, '[\r\n\t"]+', ' ', 'g') AS column_3 FROM documents""",
    "write_clean_csv": "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "read_text_lines": f"""SELECT text, count(*) AS n FROM (SELECT {strip_sql('t')} AS text FROM (
        SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS t FROM documents)) WHERE text <> '' GROUP BY text""",
    "split_paragraphs": rf"""SELECT doc_id, CAST(generate_subscripts(s, 1) AS BIGINT) AS position, unnest(s) AS paragraph FROM (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}|[.!?]{SPACE}+'),
        lambda x: {strip_sql('x')}), lambda x: x <> '') AS s FROM documents)""",
    "read_multilabel_txt": rf"""SELECT quality AS label0, toxic AS label1, text FROM (SELECT quality, toxic, regexp_replace('"' || regexp_replace(text,
        '[\r\n]+', ' ', 'g') || '"', '^["'']|["'']$', '', 'g') AS text FROM documents JOIN labels USING (doc_id)) WHERE text <> ''""",
    "parse_multilabel": rf"""SELECT doc_id, quality, toxic, text FROM (SELECT doc_id, quality, toxic, regexp_replace('"'
        || regexp_replace(text, '[\r\n]+', ' ', 'g') || '"', '^["'']|["'']$', '', 'g') AS text
        FROM documents JOIN labels USING (doc_id)) WHERE text <> ''""",
    "parse_labeled_lines": f"WITH {_PARSED} SELECT doc_id, labels, text FROM parsed",
    "write_labeled_lines": f"WITH {_PARSED} SELECT doc_id, '[' || array_to_string(labels, '+') || '] ' || text AS value FROM parsed",
    "extract_binary_docs": f"""SELECT doc_id || '.docx' AS path, CAST(generate_subscripts(s, 1) AS BIGINT) AS row, unnest(s) AS text FROM (
        SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}),
        lambda x: x <> '') AS s FROM documents)""",
    "write_results": "SELECT lang AS label, count(*) AS documents FROM documents GROUP BY lang",
    "profile_columns": f"WITH {_PROFILE} SELECT * FROM profile",
    "detect_label_column": f"WITH {_PROFILE} SELECT {_LABEL} AS label_column",
    "detect_text_column": f"""WITH {_PROFILE} SELECT "column" AS text_column FROM profile WHERE "column" <> {_LABEL}
        AND (hinted_text OR is_long_text) ORDER BY hinted_text DESC, position LIMIT 1""",
    "detect_binary_label_columns": """SELECT CAST(position AS BIGINT) AS position, c AS "column" FROM (
        SELECT 0 AS position, 'quality' AS c, bool_and(quality IN (0, 1)) AS ok FROM labels UNION ALL
        SELECT 1, 'toxic', bool_and(toxic IN (0, 1)) FROM labels UNION ALL
        SELECT 2, 'lang', bool_and(lang IN ('', '0', '1')) FROM documents) WHERE ok""",
    "encode_labels": f"""SELECT doc_id, lang AS label_name, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS VARCHAR) AS label_id
        FROM documents WHERE {strip_sql('text')} <> ''""",
    "decode_labels": """SELECT doc_id, 'label' || substr(md5(lang), 1, 1) AS label, CASE WHEN lang <> 'es' THEN lang
        ELSE 'label' || substr(md5(lang), 1, 1) END AS label_name FROM documents""",
    "melt_multilabel": f"WITH {_MELT} SELECT doc_id, label, label_name, is_multi_label FROM melted",
    "collapse_multilabel": f"""WITH {_MELT} SELECT {strip_sql('text')} AS text, string_agg(DISTINCT label_name, '+' ORDER BY label_name)
        AS labels FROM melted WHERE label_name IS NOT NULL GROUP BY 1""",
    "unique_labels": "SELECT source AS label, row_number() OVER (ORDER BY source) AS position FROM documents GROUP BY source",
    "has_labels": "SELECT count(DISTINCT lang) AS n_labels, count(DISTINCT lang) >= 2 AS has_labels FROM documents",
    "dataset_type": f"""WITH {_PARSED}, s AS (SELECT count(DISTINCT label) AS classes FROM (SELECT unnest(labels) AS label FROM parsed))
        SELECT classes, (SELECT count(*) FROM parsed) AS documents, round(CAST((SELECT count(*) FROM parsed) AS DOUBLE) / classes, 6)
        AS docs_per_class, CASE WHEN classes = 2 THEN 'Binary Classification' WHEN classes > 2 THEN 'Multi-class Classification'
        ELSE 'Single Class' END AS dataset_type FROM s""",
    "label_distribution": rf"""WITH {LINES} SELECT regexp_extract(value, '^\[(.+?)\]', 1) AS label, count(*) AS documents
        FROM lines GROUP BY 1""",
    "label_distribution_split": f"WITH {_PARSED} SELECT label, count(*) AS documents FROM (SELECT unnest(labels) AS label FROM parsed) GROUP BY label",
    "class_balance": """WITH c AS (SELECT lang AS label, count(*) AS documents FROM documents GROUP BY lang)
        SELECT label, documents, round(CAST(max(documents) OVER () AS DOUBLE) / min(documents) OVER (), 6) AS ratio,
        CASE WHEN count(*) OVER () < 2 THEN '' WHEN max(documents) OVER () / min(documents) OVER () >= 1.5 THEN 'imbalanced'
        ELSE 'balanced' END AS verdict FROM c""",
    "class_share": """SELECT lang AS label, count(*) AS documents, round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) FROM documents), 1)
        AS share_pct FROM documents GROUP BY lang""",
    "label_statistics": """WITH s AS (SELECT avg(CAST(quality + toxic AS DOUBLE)) AS c FROM labels)
        SELECT round(c, 6) AS cardinality, round(c / 2, 6) AS density, label, positives, round(p, 6) AS prevalence FROM s, (
        SELECT 'quality' AS label, CAST(sum(quality) AS BIGINT) AS positives, avg(CAST(quality AS DOUBLE)) AS p FROM labels UNION ALL
        SELECT 'toxic', CAST(sum(toxic) AS BIGINT), avg(CAST(toxic AS DOUBLE)) FROM labels)""",
    "labelset_counts": """SELECT quality || ',' || toxic AS labelset, count(*) AS documents FROM labels GROUP BY 1
        ORDER BY documents DESC, labelset LIMIT 20""",
}
