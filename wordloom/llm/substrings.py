"""Removal of repeated passages by prefix-partitioned suffix trees."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wordloom.llm.words import WordHashes, slices, split_words
from wordloom.plans.storage import drop_path, written

PREFIX = 8  # words of the first prefix; groups that do not fit double it, up to the window
GROUP = 1000  # suffixes that one subtree holds at most
ROW = "_row"  # tells rows of one id apart
_FACTOR = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _prefix_keys(hashes: np.ndarray, words: int) -> np.ndarray:
    """A 64-bit key of the `words` words that start at each position."""
    keys = np.zeros(len(hashes) - words + 1, np.uint64)
    for i in range(words):
        keys *= np.uint64(_FACTOR)
        keys += hashes[i:i + len(keys)]
    keys ^= keys >> np.uint64(31)
    keys *= np.uint64(_MIX)
    return keys ^ (keys >> np.uint64(29))


def anchors(hashes: np.ndarray, window: int, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """(key, first, count) of the suffixes that stand for a text's windows.

    Of the prefixes inside a window, the one with the least key stands for it, the leftmost of equal
    ones. The choice depends on the window's words alone, so equal windows choose equal prefixes at
    equal places. Each chosen suffix has the contiguous windows that chose it: `count` of them from
    word `first` on.
    """
    keys = _prefix_keys(hashes, prefix)
    least, place, have, width = keys, np.arange(len(keys)), 1, window - prefix + 1
    while have < width:  # least key of each `have` neighbours, by doubling
        step = min(have, width - have)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        have += step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return least[first], first, np.diff(np.append(first, len(place)))


def span_keys(hashes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit key of the `length` words from `first` on, for each of the spans.

    A polynomial from running sums: with weights of powers of an odd factor, a span's sum is divided
    by the weight of its first word.
    """
    weight = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), np.uint64(_FACTOR))]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), np.uint64(_INVERSE))]))
    mixed = hashes ^ (hashes >> np.uint64(29))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * weight[:-1])])
    keys = (sums[first + length] - sums[first]) * inverse[first] + length.astype(np.uint64)
    keys ^= keys >> np.uint64(31)
    return keys * np.uint64(_MIX)


def _schema(docs: DataFrame, id: str, **fields: str) -> T.StructType:
    """The two columns that identify a row, and more."""
    schema = T.StructType([T.StructField(id, docs.schema[id].dataType), T.StructField(ROW, T.LongType())])
    for name, kind in fields.items():
        schema.add(name, kind)
    return schema


def _emit(batch: pa.RecordBatch, at: np.ndarray, schema: T.StructType, *arrays: pa.Array) -> pa.RecordBatch:
    """Rows made from the batch's rows `at`, with their identity."""
    taken = [batch.column(name).take(pa.array(at, pa.int64())) for name in schema.names[:2]]
    return pa.RecordBatch.from_arrays([*taken, *arrays], schema.names)


def _suffixes(rows: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """(id, _row, key, whole, first, count) for every suffix that stands for windows of a text.

    whole is a key of all words of these windows.
    """
    schema = _schema(rows, id, key="long", whole="long", first="integer", count="integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            found, at = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                words = split_words(t)
                if len(words) >= window:
                    hashes = known.of(words)
                    key, first, count = anchors(hashes, window)
                    found.append((key, span_keys(hashes, first, count + window - 1), first, count))
                    at.append(np.full(len(key), i))
            if found:
                key, whole, first, count = (np.concatenate(x) for x in zip(*found))
                yield _emit(batch, np.concatenate(at), schema, pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)),
                            pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)))

    return rows.select(id, ROW, text).mapInArrow(run, schema)


# a distinct span of the first prefixes (key, whole), the place of a part of it, the least id, the part's own keys
_PART = "span_key long, span_whole long, at int, least long, key long, whole long, words binary"
_RANGE = "span_key long, span_whole long, at int, count int"


def _span_words(chosen: DataFrame, text: str, window: int) -> DataFrame:
    """Distinct spans with the hashes of their words, read from the document with the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, 64):
            out = []
            for least, t, spans in zip(*(batch.column(c).to_pylist() for c in ("least", text, "spans"))):
                hashes = known.of(split_words(t))
                for s in spans:
                    part = hashes[s["first"]:s["first"] + s["count"] + window - 1]
                    out.append((s["key"], s["whole"], 0, least, s["key"], s["whole"], part.tobytes()))
            if out:
                yield _part_batch(*zip(*out))

    return chosen.mapInArrow(run, _PART)


def _part_batch(*columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      ["span_key", "span_whole", "at", "least", "key", "whole", "words"])


def _longer_prefixes(parts: DataFrame, window: int, prefix: int) -> DataFrame:
    """The same windows, dealt anew by prefixes of `prefix` words; the last prefix is the window itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out = []
            for r in batch.to_pylist():
                hashes = np.frombuffer(r["words"], np.uint64)
                key, first, count = anchors(hashes, window, prefix)
                whole = span_keys(hashes, first, count + window - 1)
                out += [(r["span_key"], r["span_whole"], r["at"] + f, r["least"], k, w,
                         b"" if prefix == window else hashes[f:f + c + window - 1].tobytes())
                        for k, w, f, c in zip(key.view(np.int64).tolist(), whole.view(np.int64).tolist(), first.tolist(), count.tolist())]
            if out:
                yield _part_batch(*zip(*out))

    return parts.mapInArrow(run, _PART)


class SuffixTree:
    """The suffixes of some word sequences, sorted, with the words that neighbours have in common.

    Suffixes are sorted by prefixes of 1, 2, 4, ... words; each sequence ends in a word of its own, so
    none continues into the next one. An internal node is an interval of sorted suffixes, its depth the
    least number of words that neighbours inside it have in common.
    """

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences], np.int64)
        flat, names = np.unique(np.concatenate([*sequences, np.zeros(0, np.uint64)]), return_inverse=True)
        ends = np.cumsum(sizes)
        level = np.insert(names.astype(np.int64), ends, len(flat) + np.arange(len(sizes)))
        self.row = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.place = np.arange(len(level)) - np.repeat(ends - sizes + np.arange(len(sizes)), sizes + 1)
        levels, depth = [level], 1
        while depth < int(sizes.max(initial=0)) and int(level.max()) < len(level) - 1:
            after = np.zeros(len(level), np.int64)
            after[:-depth] = level[depth:] + 1
            level = np.unique(level * (len(level) + len(flat) + 2) + after, return_inverse=True)[1]
            levels.append(level)
            depth *= 2
        self.order = np.argsort(level, kind="stable")
        self.common = self._common(levels, self.order[:-1], self.order[1:])

    @staticmethod
    def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words two suffixes share, from the longest equal prefixes down."""
        total = np.zeros(len(a), np.int64)
        for k in reversed(range(len(levels))):
            inside = np.maximum(a, b) + total < len(levels[k])
            x, y = (levels[k][np.minimum(p + total, len(levels[k]) - 1)] for p in (a, b))
            total += np.where(inside & (x == y), 1 << k, 0)
        return total

    def deep_nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node of each listed suffix, the suffix's place in the sequences, depth of each node).

        The internal nodes of at least `depth` words whose parent has fewer: below each are all
        suffixes that repeat a passage of the node's depth.
        """
        deep = self.common >= depth
        edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]  # neighbours begin .. end - 1 are deep: suffixes begin .. end
        sizes = end - begin + 1
        node = np.repeat(np.arange(len(begin)), sizes)
        suffix = np.arange(len(node)) + np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(node) else node
        depths = np.minimum.reduceat(np.append(self.common, 0), np.stack([begin, end], 1).ravel())[::2] if len(begin) else begin
        return node, self.order[suffix], depths


def late_ranges(sequences: list[np.ndarray], ids: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, at, count): maximal runs of windows that a sequence of a smaller id holds too."""
    tree = SuffixTree(sequences)
    node, suffix, depths = tree.deep_nodes(window)
    least = np.full(len(depths), np.iinfo(np.int64).max)
    np.minimum.at(least, node, ids[tree.row[suffix]])
    late = ids[tree.row[suffix]] > least[node]
    steps = np.zeros(len(tree.row) + 1, np.int64)  # a passage of the node's depth holds several windows
    np.add.at(steps, suffix[late], 1)
    np.add.at(steps, suffix[late] + depths[node[late]] - window + 1, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(steps) > 0, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    return tree.row[begin], tree.place[begin], end - begin


def _late_in_trees(parts: DataFrame, window: int) -> DataFrame:
    """Ranges of windows that also stand in a document with a smaller id, by a tree for each group.

    Rows arrive sorted by key; whole groups are held up to a bounded number of rows, and one tree is
    built for them.
    """

    def judge(rows: pa.Table) -> pa.RecordBatch:
        words = [np.frombuffer(w, np.uint64) for w in rows["words"].to_pylist()]
        row, at, count = late_ranges(words, rows["least"].to_numpy(), window)
        taken = rows.select(["span_key", "span_whole", "at"]).take(pa.array(row))
        return pa.RecordBatch.from_arrays(
            [taken["span_key"].combine_chunks(), taken["span_whole"].combine_chunks(),
             pa.array((taken["at"].to_numpy() + at).astype(np.int32)), pa.array(count.astype(np.int32))],
            ["span_key", "span_whole", "at", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in slices(batches, GROUP):
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * GROUP:
                rows = pa.Table.from_batches(held)
                whole = pc.index(rows["key"], rows["key"][-1]).as_py()
                if whole:
                    yield judge(rows.slice(0, whole))
                    held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield judge(pa.Table.from_batches(held))

    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, _RANGE)


def _late_windows(parts: DataFrame) -> DataFrame:
    """The same where each window is its own prefix: a group is one node, its least id a partial minimum."""
    least = parts.groupBy("key", "whole").agg(F.min("least").alias("first"), F.max("least").alias("last")).filter("first < last")
    return parts.join(least.drop("last"), ["key", "whole"]).filter("least > first").select(
        "span_key", "span_whole", "at", F.lit(1).alias("count"))


def _judged(spark: SparkSession, parts: DataFrame, window: int) -> tuple[DataFrame, list[str]]:
    """Ranges of late windows: groups that fit become trees, the others get prefixes twice as long."""
    late, paths, prefix, left = None, [], PREFIX, None
    while True:
        sizes = parts.groupBy("key").agg(F.count("*").alias("size"), F.min("least").alias("a"), F.max("least").alias("b"))
        sizes, path = written(sizes.filter("a < b").select("key", (F.col("size") > GROUP).alias("hot")), "sizes")
        small, p1 = written(_late_in_trees(parts.join(sizes.filter("NOT hot").drop("hot"), "key"), window), "late")
        late = small if late is None else late.union(small)
        paths.append(p1)
        hot = sizes.filter("hot").drop("hot")
        if hot.isEmpty():
            break
        prefix = min(2 * prefix, window)
        longer, p2 = written(_longer_prefixes(parts.join(hot, "key"), window, prefix), "parts")
        drop_path(spark, path)
        if left is not None:
            drop_path(spark, left)
        parts, left = longer, p2
        if prefix == window:
            last, p1 = written(_late_windows(parts), "late")
            late = late.union(last)
            paths.append(p1)
            break
    for path in filter(None, [left, path if prefix < window else None]):
        drop_path(spark, path)
    return late, paths


def _without(judged: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept) after removing the windows that begin in `starts`, null for none."""
    schema = T.StructType([T.StructField(id, judged.schema[id].dataType)])
    schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for t, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = split_words(t)
                n_words.append(len(words))
                if starts:
                    steps = np.zeros(len(words) + 1, np.int64)
                    first = np.array([s["start"] for s in starts])
                    np.add.at(steps, first, 1)
                    np.add.at(steps, first + np.array([s["count"] for s in starts]) + window - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())], schema.names)

    return judged.select(id, text, "starts").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """One row per document: id, n_words, n_removed, and the words that stay, joined by single spaces.

    A word goes if a window of `window` consecutive words covers it whose sequence also starts in a
    document with a smaller id. Suffixes are taken where equal windows agree on a place (see
    `anchors`); their first words are the prefix that partitions them. Prefixes of one document are
    dropped. Copies of a suffix's words are judged by one of them, that of the least id. Groups of up to
    GROUP different suffixes become subtrees (see `SuffixTree`), and larger groups get prefixes twice
    as long, up to the whole window. Windows are judged on the input.

    A null text has no words, and a document with fewer than `window` words loses none. Ids are
    integers; a row with a null id is judged against nothing and keeps all its words. Rows with the
    same id are one document to each other: none makes the other a repeat. Other columns are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(id, F.xxhash64(text).alias(ROW), F.col(text).alias("_text"))
    every, p1 = written(_suffixes(rows.filter(F.col(id).isNotNull()), id, "_text", window), "suffixes")
    shared = every.groupBy("key").agg(F.min(id).alias("a"), F.max(id).alias("b")).filter("a < b").select("key")
    shared, p2 = written(shared, "prefixes")
    suffixes, p3 = written(every.join(shared, "key"), "shared")
    drop_path(spark, p1)
    drop_path(spark, p2)
    spans, p4 = written(suffixes.groupBy("key", "whole").agg(F.min(F.struct(id, ROW, "first", "count")).alias("s")).select(
        "key", "whole", F.col(f"s.{id}").alias("least"), f"s.{ROW}", "s.first", "s.count"), "spans")
    several = spans.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    chosen = spans.join(several, "key").groupBy("least", ROW).agg(
        F.collect_list(F.struct("key", "whole", "first", "count")).alias("spans"))
    texts = rows.select(F.col(id).alias("least"), ROW, "_text")
    parts, p5 = written(_span_words(texts.join(chosen, ["least", ROW]).select(
        F.col("least").cast("long"), "_text", "spans"), "_text", window), "parts")
    late, paths = _judged(spark, parts, window)
    drop_path(spark, p5)
    least = spans.select("key", "whole", "least")
    copies = suffixes.join(least, ["key", "whole"])
    gone = copies.filter(F.col(id) > F.col("least")).select(id, ROW, F.col("first").alias("start"), "count")
    firsts = copies.filter(F.col(id) == F.col("least")).join(
        late.select(F.col("span_key").alias("key"), F.col("span_whole").alias("whole"), "at", F.col("count").alias("n")), ["key", "whole"])
    single = firsts.select(id, ROW, (F.col("first") + F.col("at")).alias("start"), F.col("n").alias("count"))
    starts, _ = written(gone.union(single).groupBy(id, ROW).agg(F.collect_set(F.struct("start", "count")).alias("starts")), "starts")
    for path in [p3, p4, *paths]:
        drop_path(spark, path)
    return _without(rows.join(starts, [id, ROW], "left"), id, "_text", window)
