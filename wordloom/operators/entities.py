"""Dictionary entities, cleaning and grouping.

A pretrained recognizer is the caller's: `recognize` runs any batch function over text chunks. The
built-in matcher runs an automaton of a gazetteer (phrase, entity_type) over the texts.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wordloom.constants import ENTITY_GROUPS, PERSON_NOISE
from wordloom.functions import text as T
from wordloom.functions.rows import explode_rows
from wordloom.operators.phrases import ASCII_WORD, AUTOMATON_PIECES, WORD, offsets, rewritten

CHUNK_CHARS = 5000
ENTITY_SCHEMA = "text string, entity_type string, start bigint, end bigint, source string"


def entity_chunks(df: DataFrame, text: str = "text", id: str = "doc_id", size: int = CHUNK_CHARS) -> DataFrame:
    """(id, start, chunk): the whole text in windows a recognizer can take, with their offsets."""
    parts = explode_rows(df, T.chunks(F.col(text), size), "part", id)
    return parts.select(id, F.col("part.start").cast("bigint").alias("start"), "part.chunk")


def recognize(df: DataFrame, recognizer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
              text: str = "text", id: str = "doc_id") -> DataFrame:
    """Run a caller's recognizer over batches of (id, start, chunk).

    It yields (id, text, entity_type, start, end, source) with offsets inside the chunk; they are
    shifted to the document by the `offset` column, which it passes through.
    """
    chunks = entity_chunks(df, text, id).withColumnRenamed("start", "offset")
    found = chunks.mapInPandas(recognizer, f"{id} {dict(df.dtypes)[id]}, offset bigint, {ENTITY_SCHEMA}")
    return found.withColumns({"start": F.col("start") + F.col("offset"), "end": F.col("end") + F.col("offset")}
                             ).drop("offset")


def _mentions(parts: list[str], hits: list[tuple[int, dict]]) -> list[dict]:
    at = offsets(parts)
    return [{"text": "".join(parts[start:start + len(hit["pieces"])]), "entity_type": hit["entity_type"], "start": at[start],
             "end": at[start + len(hit["pieces"])], "source": "gazetteer"} for start, hit in hits]


def entities(df: DataFrame, gazetteer: DataFrame, text: str = "text", id: str = "doc_id",
             max_words: int | None = None, inline_limit: int = AUTOMATON_PIECES) -> DataFrame:
    """(id, text, entity_type, start, end, source): gazetteer phrases found in the text.

    Words are runs of letters, digits and underscores; a phrase matches its words with the same
    characters between them, whatever their case, and no word goes on before or behind it; overlapping mentions
    are all found. `max_words` leaves longer phrases out. Offsets count characters from 0.
    A gazetteer of at most `inline_limit` pieces is one automaton in all tasks, a larger one is cut into parts.
    """
    named = gazetteer
    if max_words is not None:
        named = named.filter(F.size(F.regexp_extract_all("phrase", F.lit(rf"[{WORD}]+"), F.lit(0))) <= max_words)
    named = named.select(F.lower("phrase").alias("key"), "entity_type").distinct()
    docs = df.select(F.col(id).alias("_id"), F.col(text).alias("_of"))
    found = rewritten(docs, named, "_of", WORD, _mentions, f"array<struct<{ENTITY_SCHEMA}>>", inline_limit)
    return found.select(F.col("_id").alias(id), F.explode_outer("_out").alias("m")).filter("m IS NOT NULL").select(id, "m.*")


def dedupe_entities(found: DataFrame, by_type: bool = True, id: str = "doc_id") -> DataFrame:
    """The first mention of each text (and type) over the whole corpus, ordered by (id, start).

    A minimum over structs: partial aggregation keeps one row per key before the shuffle, so a name
    that fills a third of the corpus costs no more than another.
    """
    override = F.when(F.lower("text") == "number", "CARDINAL").otherwise(F.col("entity_type"))
    rows = found if by_type else found.withColumn("entity_type", override)
    keys = [F.lower("text").alias("_text")] + ([F.col("entity_type").alias("_type")] if by_type else [])
    first = F.min(F.struct(id, "start", "end", "text", "entity_type", "source"))
    return rows.groupBy(*keys).agg(first.alias("e")).select("e.*")


def filter_person_noise(found: DataFrame) -> DataFrame:
    """Drop persons that are common adjectives or a single lower-case word."""
    person = F.col("entity_type") == "PERSON"
    words = F.size(T.space_tokens(F.col("text")))
    initial = F.substring("text", 1, 1)
    lower_initial = (initial == F.lower(initial)) & (initial != F.upper(initial))
    noise = F.lower("text").isin(sorted(PERSON_NOISE)) | ((words == 1) & lower_initial)
    return found.filter(~(person & noise))


def entity_type_groups(found: DataFrame) -> DataFrame:
    """(entity_group, value, mentions): types mapped to ten groups by ordered substring tests."""
    kind = F.upper("entity_type")
    group = F
    for name, parts in ENTITY_GROUPS:
        test = F.lit(False)
        for part in parts:
            test = test | F.contains(kind, F.lit(part))
        if name == "PERSON":
            test = test | (kind == "PER")
        group = group.when(test, name)
    return (found.select(group.otherwise("OTHER").alias("entity_group"), F.col("text").alias("value"))
            .groupBy("entity_group", "value").agg(F.count("*").alias("mentions")))


def _join_longest(parts: list[str], hits: list[tuple[int, dict]]) -> str:
    """Phrases from the longest to the shortest; what is joined already is a word of its own."""
    joined = [False] * len(parts)
    for start, hit in sorted(hits, key=lambda h: (-len(h[1]["key"]), h[1]["key"], h[0])):
        end = start + len(hit["pieces"])
        if any(joined[max(0, start - 1):end + 1]):
            continue
        for i, piece in enumerate(hit["pieces"]):
            if piece.isspace():
                joined[start + i] = True
                piece = "" if i and hit["pieces"][i - 1].isspace() else "_"
            parts[start + i] = piece
    return "".join(parts)


def join_entities(df: DataFrame, phrases: DataFrame, text: str = "text", limit: int = AUTOMATON_PIECES) -> DataFrame:
    """Write multi-word phrases as one `_`-joined token, longest first, whatever their case."""
    named = phrases.filter(F.contains("phrase", F.lit(" "))).groupBy(F.lower("phrase").alias("low")).agg(F.min("phrase").alias("key")).select("key")
    joined = rewritten(df, named, text, ASCII_WORD, _join_longest, "string", limit)
    return joined.select(*[F.coalesce("_out", text).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
