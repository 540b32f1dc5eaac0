"""Mixing sources to target weights in fixed-length blocks."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from wordloom.llm.words import count_words, slices, split_words
from wordloom.plans.storage import drop_path, written

WEIGHTS = (5, 2, 1)
BLOCK = 64  # words
SHARDS = 256
_CHUNK = 1 << 16  # slots of a source and shard that one row stands for
_ROUNDS = 4


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. Targets share the sum of all sizes by
    weight; one that would exceed `most` times its source stops there and the excess is reshared by
    weight until none is above. Each round is an aggregate of the source table.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked, path = written(sizes.withColumn(
        "_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1)), "sources")
    bound = F.lit(most) * F.col("source_size")
    capped = F.lit(False)
    while True:
        share = ranked.agg(F.sum("source_size"), F.sum(F.when(capped, bound)), F.sum(F.when(~capped, F.col("_weight"))),
                           F.count(F.when(capped, 1))).first()
        if not share[2]:
            break
        level = ((share[0] or 0) - (share[1] or 0.0)) / share[2]
        wanted = F.lit(level) * F.col("_weight")
        over = capped | (wanted > bound)
        if ranked.filter(over).count() == share[3]:
            break
        capped = over
    target = F.when(capped, bound).otherwise(F.lit(level) * F.col("_weight")) if share[2] else bound
    out, _ = written(ranked.select("source", "source_size", target.alias("target")), "targets")
    drop_path(ranked.sparkSession, path)
    return out


def _offsets(sized: DataFrame, id: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """(id, source, _row, size, offset): words of the same source before each row.

    Rows are summed inside hash buckets and buckets inside a source, so no task sums a whole source.
    """
    buckets = max(256, math.ceil(sized.count() / rows_per_bucket))
    placed = sized.filter("size > 0").withColumn("_bucket", F.pmod(F.xxhash64(id, "_row"), F.lit(buckets)))
    keys = ["_key", "_bucket"]
    placed = placed.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))  # joins null too
    before = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals, _ = written(placed.groupBy(*keys).agg(F.sum("size").alias("_total")).select(
        *keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before")), "buckets")
    inside = W.partitionBy(*keys).orderBy(id, "_row").rowsBetween(W.unboundedPreceding, -1)
    running = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return running.join(totals, keys).withColumn("offset", F.col("_before") + F.col("_inside")).drop(
        "_bucket", "_before", "_inside")


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key: a Feistel network, walked until inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        low, high = out[todo] & mask[todo], out[todo] >> half[todo]
        for step in range(_ROUNDS):
            mixed = (low + key[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1))
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            low, high = high ^ ((mixed ^ (mixed >> np.uint64(31))) & mask[todo]), low
        out[todo] = (high << half[todo]) | low
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _slots(targets: DataFrame, block: int, shards: int, seed: int, most: float) -> DataFrame:
    """(_key, shard, slot, epoch, block, most): the blocks that each output shard takes, and how many words of each at most.

    A source's number of slots follows its target, its last slot takes the part of a block that is still
    missing; how many of them a shard gets is a multinomial draw.
    The k-th slot of a source takes the k-th block of a pseudorandom permutation of its blocks, and a
    new permutation begins when all are taken.
    """
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, size, target in zip(*(batch.column(c).to_pylist() for c in ("_key", "source_size", "target"))):
                if size:
                    blocks = -(-size // block)
                    exact = min(target * blocks / size, most * blocks)
                    part = exact - math.floor(exact)
                    total = math.floor(exact) + (part * min(size, block) >= 0.5)
                    source = int.from_bytes(key.encode(), "little") % (1 << 61)
                    counts = np.random.default_rng([seed, source]).multinomial(total, np.full(shards, 1 / shards))
                    starts = np.cumsum(counts) - counts
                    rows = [(s, a, min(a + _CHUNK, b)) for s, (x, y) in enumerate(zip(starts, starts + counts))
                            for a, b in [(c, y) for c in range(x, y, _CHUNK)]]
                    if rows:
                        shard, low, high = map(list, zip(*rows))
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key] * n), pa.array([blocks] * n, pa.int64()), pa.array(shard, pa.int32()),
                             pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                             pa.array([int(x) for x in starts[shard]], pa.int64()),
                             pa.array([size] * n, pa.int64()), pa.array([part if total > exact else 1.0] * n),
                             pa.array([total - 1] * n, pa.int64())],
                            ["_key", "blocks", "shard", "low", "high", "first", "size", "part", "last"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            key, blocks, shard, low, high, first, size, part, last = (batch.column(i)[0].as_py() for i in range(9))
            k = np.arange(low, high)
            epoch, n = k // blocks, np.full(len(k), blocks)
            base = np.uint64(int.from_bytes(key.encode(), "little") % (1 << 61) ^ seed)
            at = permuted(k % blocks, n, base + epoch.astype(np.uint64))
            full = np.minimum(block, size - at * block)
            words = np.where(k == last, np.rint(part * full), full).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(k)), pa.array([shard] * len(k), pa.int32()), pa.array(k - first),
                 pa.array(epoch.astype(np.int32)), pa.array(at), pa.array(words)], ["_key", "shard", "slot", "epoch", "block", "most"])

    drawn = targets.mapInArrow(draw, "_key string, blocks bigint, shard int, low bigint, high bigint, first bigint, "
                                     "size bigint, part double, last bigint")
    words = targets.agg(F.sum("target")).first()[0] or 0  # a task makes about a million slots
    tasks = max(targets.sparkSession.sparkContext.defaultParallelism, math.ceil(words / block / (1 << 20)))
    return drawn.repartition(tasks, "_key", "shard", "low").mapInArrow(
        place, "_key string, shard int, slot bigint, epoch int, block bigint, most bigint")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
        block: int = BLOCK, shards: int = SHARDS, seed: int = 7, most: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): each row's sizes and target, and the mix as spans of words.

    rows: id, _row (hash of the text, which tells rows of one id apart), source, size, source_size,
    target. spans: id, _row, shard, slot, epoch, start, words: which words of which text fill a slot of
    an output shard; a slot is one block, cut where texts end. Blocks are packed from a source's words
    in a fixed pseudorandom order of its rows, so blocks of one index may span texts.

    A null or empty text has size 0 and is never taken; a null source is a source of its own. Repeated
    rows with one id and one text count as many times as they occur. Reruns agree. Other columns are
    not read. An empty table gives empty results.
    """
    sized, _ = written(docs.select(F.col(id).alias(id), F.xxhash64(text).alias("_row"), F.col(source).alias("source"),
                                   count_words(F.col(text)).alias("size")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    keyed = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    targets, _ = written(targets.withColumn("_key", keyed), "targets")
    rows = sized.withColumn("_key", keyed).join(targets.drop("source"), "_key").drop("_key")
    end = F.col("offset") + F.col("size")
    packed = _offsets(sized, id).withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((end - 1) / block))))
    begin = F.greatest(F.col("block") * block, "offset")
    pieces = packed.select("_key", "block", id, "_row", (begin - F.col("offset")).alias("start"),
                           (F.least((F.col("block") + 1) * block, end) - begin).alias("words"), (begin - F.col("block") * block).alias("_at"))
    # Spark takes the slots for as small as the source table that they are made from, and would broadcast them
    slots = _slots(targets, block, shards, seed, most).hint("merge")
    spans = slots.join(pieces, ["_key", "block"]).select(
        id, "_row", "shard", "slot", "epoch", "start", F.least("words", F.col("most") - F.col("_at")).alias("words"))
    return rows, spans.filter("words > 0")


def words_taken(rows: DataFrame, spans: DataFrame, id: str = "doc_id") -> DataFrame:
    """Each row with the number of its words that the mix takes, repeats counted.

    Repeated rows (one id, one text) share what is taken from them evenly, the first ones a word more.
    """
    taken = spans.groupBy(id, "_row").agg(F.sum("words").alias("_taken"))
    same = W.partitionBy(id, "_row")
    n, k = F.count("*").over(same), F.row_number().over(same.orderBy("size")) - 1
    placed = rows.withColumns({"_n": n, "_k": k}).alias("r").join(
        taken.alias("t"), F.col(f"r.{id}").eqNullSafe(F.col(f"t.{id}")) & F.col("r._row").eqNullSafe(F.col("t._row")), "left")
    whole = F.coalesce("_taken", F.lit(0))
    share = F.expr("coalesce(_taken, 0) div _n") + F.when(F.col("_k") < whole % F.col("_n"), 1).otherwise(0)
    return placed.select(f"r.{id}", "size", "source_size", "target", share.cast("bigint").alias("taken"))


def mixed_texts(docs: DataFrame, spans: DataFrame, id: str = "doc_id", text: str = "text", name: str = "mixed") -> DataFrame:
    """The documents of which the mix takes words, with those words in `name`.

    The words of each pass over a document stand in their order, passes are separated by a line feed,
    and a pass that takes a whole text keeps it as it is.
    """
    schema = T.StructType([T.StructField("_doc", docs.schema), T.StructField(name, T.StringType())])
    of_docs = spans.groupBy(F.col(id).alias("_of"), "_row").agg(
        F.sort_array(F.collect_set(F.struct("epoch", "start", "words"))).alias("_spans"))
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id).alias("_id"), F.xxhash64(text).alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_hash") == F.col("_row"))
    with_spans = whole.join(of_docs, same).select("_doc", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            out = []
            for t, spans in zip(batch.column(0).field(text).to_pylist(), batch.column(1).to_pylist()):
                words, passes = split_words(t), {}
                for s in spans:
                    passes.setdefault(s["epoch"], []).extend(words[s["start"]:s["start"] + s["words"]])
                out.append("\n".join(t if len(p) == len(words) else b" ".join(p).decode() for p in passes.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], schema.names)

    return with_spans.mapInArrow(run, schema).select("_doc.*", name)
