"""The registered queries of this subpackage and their DuckDB twins."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wordloom.llm import (
    alignment, bpe, chat, classifier, embeddings, mixing, pii, rules, simhash, substrings, topk, variants, warc)
from wordloom.plans.storage import written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


OP1 = """
WITH RECURSIVE valid AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(b) AS component_id, vec_id = min(b) AS kept
FROM embeddings JOIN reach ON reach.a = vec_id GROUP BY vec_id"""


SAID = "</s>[INST] ok [/INST]"


def op2_chat(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(SAID))
    read = chat.read_chats(chat.format_chats(rows.union(extra)))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.char_length("trained_text").cast("bigint").alias("loss_chars"), F.sha2("trained_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


OP2 = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{SAID}'), (-7, 1, 'assistant', '{SAID}')),
near AS (SELECT *, coalesce(lag(role) OVER w = role, false) AS more FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sizes AS (SELECT *, length(text) + len(regexp_extract_all(text, '[\\\\<|\\[]')) AS escaped,
  length(role) + len(regexp_extract_all(role, '[\\\\<|\\[]')) AS named FROM near)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  (3 + sum(escaped + CASE WHEN more THEN 8 ELSE 13 + named END))::BIGINT AS formatted_chars
FROM sizes GROUP BY conv_id"""


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf, "documents"))


def op4_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_classifier(spark: SparkSession, sf: str) -> DataFrame:
    judged = classifier.classify(table(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc_id", F.round("p_good", 6).alias("p_good"), "kept")


def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf, "documents"), WORD_BPE)
    return bpe.decode(encoded, WORD_BPE).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.words_taken(*mixing.mix(table(spark, sf, "documents")))


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    archives, _ = written(warc.archive(table(spark, sf, "pages")), "warc")
    return warc.read_archive(archives).drop("url", "payload", "record_id", "refers_to_id")


OP8 = """
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
largest AS (SELECT payload_digest, payload_bytes, max(page_id) AS response FROM sized WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN response IS NULL OR response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response = page_id THEN NULL ELSE response END AS refers_to
FROM sized LEFT JOIN largest USING (payload_digest, payload_bytes)"""


def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.find_private(table(spark, sf, "documents")))


def op10_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"))


OP11 = """
WITH valid AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM valid q JOIN valid v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""


def op12_variants(spark: SparkSession, sf: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf, "documents"))


def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align(table(spark, sf, "documents"), BYTE_BPE, PIECE_BPE)


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline  # it builds on this subpackage

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    "op1_embeddings": op1_embeddings, "op2_chat": op2_chat, "op3_simhash": op3_simhash, "op4_rules": op4_rules,
    "op5_classifier": op5_classifier, "op6_bpe": op6_bpe, "op7_mixing": op7_mixing, "op8_warc": op8_warc, "op9_pii": op9_pii,
    "op10_substrings": op10_substrings, "op11_topk": op11_topk, "op12_variants": op12_variants, "op13_alignment": op13_alignment,
    "pipeline": pipeline}
ORACLES = {"op1_embeddings": OP1, "op2_chat": OP2, "op4_rules": rules.oracle(), "op8_warc": OP8, "op11_topk": OP11}
