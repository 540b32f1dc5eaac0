"""Phrases of several words looked up in texts: an automaton over pieces runs once over each text."""

import itertools
import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from wordloom.functions.rows import explode_rows
from wordloom.plans.storage import materialize

ASCII_WORD, WORD = "A-Za-z0-9_", r"\p{L}\p{N}_"
AUTOMATON_PIECES = 200_000  # an automaton of that many states takes about 100 MB of a task's memory

OUT_PIECES = 200_000  # of the texts whose results a task holds at a time


def pieces(text: Column, word: str) -> Column:
    """Runs of word characters and single other characters, in order; nothing is left out."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)[{word}]+|[^{word}]"), F.lit(0))


def split(phrase: str, word: str) -> list[str]:
    """The same pieces of one string."""
    return re.findall(r"\w+|\W", phrase, re.ASCII if word == ASCII_WORD else 0)


class Automaton:
    """Phrases as a trie of pieces, each state with a link to its longest proper suffix in the trie.

    `phrases` are dictionaries with a `key`; hits carry them with their `pieces`. (Aho and Corasick, 1975)
    """

    def __init__(self, phrases: list[dict], word: str):
        self.word = word
        self.goto: list[dict[str, int]] = [{}]
        self.ends: list[list[dict]] = [[]]
        for phrase in phrases:
            own, state = split(phrase["key"], word), 0
            for piece in own:
                state = self.goto[state].setdefault(piece.lower(), len(self.goto))
                if state == len(self.goto):
                    self.goto.append({})
                    self.ends.append([])
            if own:
                self.ends[state].append(phrase | {"pieces": own})
        self.fail = [0] * len(self.goto)
        self.shorter = [0] * len(self.goto)  # the longest suffix that is a phrase, 0 without one
        queue = deque(self.goto[0].values())
        while queue:
            state = queue.popleft()
            for piece, child in self.goto[state].items():
                link = self._step(self.fail[state], piece)
                self.fail[child] = link
                self.shorter[child] = link if self.ends[link] else self.shorter[link]
                queue.append(child)

    def _step(self, state: int, piece: str) -> int:
        while state and piece not in self.goto[state]:
            state = self.fail[state]
        return self.goto[state].get(piece, 0)

    def hits(self, parts: list[str]) -> list[tuple[int, dict]]:
        """(first piece, phrase) of each place of a phrase with no word character right before or after it."""
        found, state = [], 0
        for at, piece in enumerate(parts):
            state = self._step(state, piece.lower())
            end = state if self.ends[state] else self.shorter[state]
            while end:
                start = at + 1 - len(self.ends[end][0]["pieces"])
                if not (start and self._is_word(parts[start - 1])) and not (at + 1 < len(parts) and self._is_word(parts[at + 1])):
                    found.extend((start, phrase) for phrase in self.ends[end])
                end = self.shorter[end]
        return found

    def _is_word(self, piece: str) -> bool:
        return piece[0] == "_" or (piece[0].isalnum() and (self.word != ASCII_WORD or piece[0].isascii()))


def rewritten(df: DataFrame, phrases: DataFrame, text: str, word: str, rewrite: Callable, kind: str,
              limit: int = AUTOMATON_PIECES) -> DataFrame:
    """`df` and `_out`: what `rewrite` makes of each text in which a phrase stands; null for others and null texts.

    phrases: `key` (the phrase as compared), further columns passed on. A phrase stands where its
    pieces do, whatever their case. `rewrite` gets the pieces of a text and its hits, (start, phrase row as
    a dictionary, with its pieces) pairs, and returns a value of SQL type `kind`.

    Phrases of at most `limit` pieces go to all tasks as one automaton, and texts stay where they are.
    More are cut by their first piece into parts of about that size; each distinct text goes to
    the parts of its own pieces. A first piece with more than a part's share is cut by whole
    phrases, and its texts go to all parts. A task holds one part at a time; the driver holds at most one.
    """
    size = F.size(pieces(F.col("key"), word)) + F.floor(F.length("key") / 16)
    listed = materialize(phrases.filter("key <> ''").withColumns(
        {"_n": size, "_first": F.lower(F.get(pieces(F.col("key"), word), F.lit(0)))}))
    total = listed.agg(F.sum("_n")).first()[0]
    if not total:
        return df.withColumn("_out", F.lit(None).cast(kind))
    if total <= limit:
        held = df.sparkSession.sparkContext.broadcast([r.asDict() for r in listed.drop("_n", "_first").collect()])

        @pandas_udf(kind)
        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            automaton = Automaton(held.value, word)
            for texts in series:
                out, size = [], 0
                for value in texts:
                    parts = [] if value is None else split(value, word)
                    hits = automaton.hits(parts)
                    out.append(rewrite(parts, hits) if hits else None)
                    size += len(parts)
                    if size >= OUT_PIECES:  # what is found takes many times the memory of the texts
                        yield pd.Series(out, dtype="object")
                        out, size = [], 0
                yield pd.Series(out, dtype="object")

        return df.withColumn("_out", run(F.col(text)))
    texts = materialize(df.select(F.col(text).alias("_text")).filter("_text IS NOT NULL").withColumn("_key", F.md5("_text"))
                        .groupBy("_key").agg(F.first("_text").alias("_text")))
    found = _hits_by_part(texts, listed, phrases.columns, word, total, limit)
    rows = texts.join(found.groupBy("_key").agg(F.collect_list(F.struct("_at", "_phrase")).alias("_hits")), "_key")

    @pandas_udf(kind)
    def apply(values: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([rewrite(split(v, word), [(h["_at"], dict(h["_phrase"]) | {"pieces": split(h["_phrase"]["key"], word)})
                                                   for h in of]) for v, of in zip(values, hits)], dtype="object")

    new = rows.select("_key", apply("_text", "_hits").alias("_out"))
    return df.join(new, F.md5(df[text]) == new["_key"], "left").select(*[df[c] for c in df.columns], new["_out"])


def _hits_by_part(texts: DataFrame, listed: DataFrame, columns: list[str], word: str, total: int, limit: int) -> DataFrame:
    """(_key, _at, _phrase): a part's phrases come first in each of its cells, then a share of its texts."""
    spark, parts = texts.sparkSession, -(-total // max(limit, 1))
    cells = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts))  # a part's
    # At most total / limit pieces are that frequent.
    hot = [r._first for r in listed.groupBy("_first").agg(F.sum("_n").alias("n")).filter(F.col("n") > limit).collect()]

    def part(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")

    phrase = F.struct(*columns)
    left = listed.select(phrase.alias("_phrase"), F.when(F.col("_first").isin(hot), part(F.col("key"))).otherwise(
        part(F.col("_first"))).alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("_cell"))
    own = F.transform(pieces(F.col("_text"), word), F.lower)
    goes = F.array_distinct(F.transform(own, part))
    if hot:
        goes = F.when(F.arrays_overlap(own, F.array(*map(F.lit, hot))), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(goes)
    right = explode_rows(texts, goes, "_part", "_key", "_text").withColumn("_cell", F.pmod(F.xxhash64("_key"), F.lit(cells)).cast("int"))
    both = left.unionByName(right, allowMissingColumns=True).select("_part", "_cell", "_phrase", "_key", "_text")
    placed = both.repartition(parts * cells, "_part", "_cell").sortWithinPartitions("_part", "_cell", F.col("_key").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, phrases, automaton = None, [], None
        for batch in batches:
            kind, out = batch.schema.field("_phrase").type, []
            for own_part, cell, phrase, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (own_part, cell):
                    at, phrases, automaton = (own_part, cell), [], None
                if key is None:
                    phrases.append(phrase)
                elif phrases:
                    automaton = automaton or Automaton(phrases, word)
                    out.extend((key, start, hit) for start, hit in automaton.hits(split(text, word)))
            keys, starts, hits = zip(*out) if out else ((), (), ())
            bare = [{c: h[c] for c in columns} for h in hits]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(starts, pa.int32()), pa.array(bare, kind)],
                                             ["_key", "_at", "_phrase"])

    return placed.mapInArrow(run, f"_key string, _at int, _phrase {listed.select(phrase).schema[0].dataType.simpleString()}")


def offsets(parts: list[str]) -> list[int]:
    """Characters before each piece, and after the last one."""
    return [0, *itertools.accumulate(map(len, parts))]
