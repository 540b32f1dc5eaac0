"""Document-level term co-occurrence: vocabulary, edges, threshold, network.

The vocabulary is at most `2 * max(3 * top_n, 30)` words, so pair counts form one small square
matrix. Each task adds up its own matrix with block products and sends only the matrix on; no pair
of a single document is ever a row.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from wordloom.constants import MAX_TOP_N, STOPWORDS
from wordloom.functions import text as T
from wordloom.functions.rows import explode_rows
from wordloom.operators.ranking import top_per_group
from wordloom.plans.storage import broadcast_if_small, materialize

_BLOCK_ROWS = 1024
_TILE = 1024  # words of a tile's side


def _is_stop():
    return F.col("word").isin(sorted(STOPWORDS))


def cooccurrence_vocab(df: DataFrame, top_n: int = 100, include_stopwords: bool = True,
                       text: str = "text") -> DataFrame:
    """(word, is_stop, doc_freq): top words by document frequency, and as many top stopwords."""
    top_n = max(1, top_n)
    size = max(3 * top_n, 30)
    words = explode_rows(df, F.array_distinct(T.tokenize_vocab(F.col(text))), "word")
    counts = words.groupBy("word").agg(F.count("*").alias("doc_freq")).withColumn("is_stop", _is_stop())
    order = [F.desc("doc_freq"), F.col("word")]
    content = counts.filter(~F.col("is_stop")).orderBy(*order).limit(size)
    if include_stopwords:
        # At most 126 stopwords exist, so their own limit needs no further care.
        content = content.unionByName(counts.filter("is_stop").orderBy(*order).limit(size))
    return content.select("word", "is_stop", "doc_freq")


def cooccurrence_edges(df: DataFrame, vocabulary: list[str], text: str = "text") -> DataFrame:
    """(source, target, value) with source < target: documents that hold both words."""
    vocabulary = sorted(vocabulary)
    index = pd.Index(vocabulary)
    size = len(vocabulary)

    def pair_counts(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for start in range(0, len(batch), _BLOCK_ROWS):
                docs = batch["words"].iloc[start:start + _BLOCK_ROWS]
                lengths = docs.map(len).to_numpy()
                if lengths.sum() == 0:
                    continue
                block = np.zeros((len(docs), size), dtype=np.float32)
                columns = index.get_indexer(np.concatenate(docs.to_list()))
                block[np.repeat(np.arange(len(docs)), lengths), columns] = 1
                total += block.T @ block
        a, b = np.nonzero(np.triu(total, 1))
        yield pd.DataFrame({"a": a, "b": b, "n": total[a, b].astype("int64")})

    # The words are plain [a-z0-9], so they can be named in SQL text, one literal set for the plan.
    in_set = ", ".join(f"'{w}'" for w in vocabulary)
    docs = (df.select(T.tokenize_vocab(F.col(text)).alias("words"))
            .select(F.expr(f"array_distinct(filter(words, w -> w IN ({in_set})))").alias("words"))
)
    names = F.split(F.lit(" ".join(vocabulary)), " ")
    counts = (docs.mapInPandas(pair_counts, "a int, b int, n bigint")
              .groupBy("a", "b").agg(F.sum("n").alias("value")))
    return counts.select(F.get(names, F.col("a")).alias("source"), F.get(names, F.col("b")).alias("target"), "value")


def tiled_edges(df: DataFrame, vocabulary: DataFrame, text: str = "text", tile: int = _TILE) -> DataFrame:
    """The same edges for a (word) table of any size: the pair matrix is cut into tiles.

    Each document goes to the tiles (row, column) in which it has words, once a tile; a task adds up one
    tile's block products at a time. Documents of a tile are salted over tasks, so a tile that all
    documents meet is shared.
    """
    names = materialize(vocabulary.select("word", (F.row_number().over(W.orderBy("word")) - 1).alias("i")))  # the vocabulary only
    salts = df.sparkSession.sparkContext.defaultParallelism
    docs = materialize(df.select(F.monotonically_increasing_id().alias("doc"), F.array_distinct(T.tokenize_vocab(F.col(text))).alias("words")))
    known = explode_rows(docs, F.col("words"), "word", "doc").join(broadcast_if_small(names), "word")
    parts = known.groupBy("doc", F.floor(F.col("i") / tile).alias("t")).agg(F.collect_list("i").alias("at"))
    sides = parts.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("t", "at"))).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["t"] >= a["t"]), lambda b: F.struct(
        a["t"].alias("r"), b["t"].alias("c"), a["at"].alias("rows"), b["at"].alias("columns")))))
    met = sides.select("doc", F.explode(pairs).alias("p")).select("p.*", F.pmod(F.xxhash64("doc"), F.lit(salts)).alias("salt"))
    sorted_tiles = met.repartition(salts, "r", "c", "salt").sortWithinPartitions("r", "c")

    def ones(lists: pd.Series, start: int) -> np.ndarray:
        out = np.zeros((len(lists), tile), np.float32)
        out[np.repeat(np.arange(len(lists)), lists.map(len)), np.concatenate(lists.to_list()) - start] = 1
        return out

    def products(batches):
        now, total = None, None

        def cells():
            a, b = np.nonzero(total if now[0] < now[1] else np.triu(total, 1))
            return pd.DataFrame({"a": a + now[0] * tile, "b": b + now[1] * tile, "n": total[a, b].astype("int64")})

        for batch in batches:
            for (r, c), part in batch.groupby(["r", "c"]):
                if (r, c) != now:
                    if now is not None:
                        yield cells()
                    now, total = (r, c), np.zeros((tile, tile))
                for start in range(0, len(part), _BLOCK_ROWS):
                    block = part.iloc[start:start + _BLOCK_ROWS]
                    total += ones(block["rows"], r * tile).T @ ones(block["columns"], c * tile)
        if now is not None:
            yield cells()

    counts = sorted_tiles.mapInPandas(products, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("value"))
    named = lambda i, word: broadcast_if_small(names.select(F.col("i").alias(i), F.col("word").alias(word)))
    return counts.join(named("a", "source"), "a").join(named("b", "target"), "b").select("source", "target", "value")


def cooccurrence(df: DataFrame, top_n: int = 100, include_stopwords: bool = True,
                 text: str = "text") -> DataFrame:
    """All edges among the selected vocabulary, computed once and kept; a large matrix is cut into tiles."""
    chosen = cooccurrence_vocab(df, top_n, include_stopwords, text).select("word")
    if top_n > MAX_TOP_N:  # one matrix of a task would not fit into memory
        return materialize(tiled_edges(df, materialize(chosen), text))
    vocabulary = [r.word for r in chosen.collect()]  # at most 6,000 words
    if not vocabulary:
        return df.sparkSession.createDataFrame([], "source string, target string, value bigint")
    return materialize(cooccurrence_edges(df, vocabulary, text))


def cooccurrence_threshold(edges: DataFrame, min_cooccurrence: int = 2) -> DataFrame:
    """(max_value, min_cooccurrence_used): falls back to what the corpus can reach."""
    asked = max(1, min_cooccurrence)
    top = F.max("value")
    reachable = F.greatest(F.lit(2), F.least(F.lit(asked), top))
    used = (F.when(top.isNull() | (top >= asked), F.lit(asked))
            .when(top >= reachable, reachable).otherwise(F.lit(1)))
    return edges.agg(top.alias("max_value"), used.cast("bigint").alias("min_cooccurrence_used"))


def node_strength(edges: DataFrame) -> DataFrame:
    """(word, strength): sum of a word's edge weights."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("word"), "value")
    return ends.groupBy("word").agg(F.sum("value").alias("strength"))


def cooccurrence_network(edges: DataFrame, top_n: int = 100, min_cooccurrence: int = 2) -> DataFrame:
    """Edges above the threshold between the strongest words; stopwords rank apart."""
    used = cooccurrence_threshold(edges, min_cooccurrence).select("min_cooccurrence_used")
    strong = edges.filter(F.col("value") >= used.scalar())
    ranked = node_strength(strong).withColumn("is_stop", _is_stop())
    keep = top_per_group(ranked, ["is_stop"], [F.desc("strength"), F.col("word")],
                         max(1, top_n)).select("word")
    return (strong.join(keep.withColumnRenamed("word", "source"), "source", "left_semi")
            .join(keep.withColumnRenamed("word", "target"), "target", "left_semi")
            .select("source", "target", "value"))


def network_nodes(network: DataFrame) -> DataFrame:
    """Words that still have an edge."""
    return network.select(F.explode(F.array("source", "target")).alias("id")).distinct()


def network_degree(network: DataFrame, max_links: int | None = None) -> DataFrame:
    """(id, degree) over all links, or the `max_links` strongest; words without a link drop out."""
    links = network if max_links is None else network.orderBy(F.desc("value"), "source", "target").limit(max_links)
    return links.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(
        F.count("*").alias("degree"))
