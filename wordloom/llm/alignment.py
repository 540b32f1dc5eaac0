"""Alignment of two tokenizers' tokens over the same bytes."""

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from wordloom.plans.storage import drop_path, written

# fixed value: the public pattern that cuts text before byte-level merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KNOWN = 1 << 19  # remembered words of a task; it starts afresh when full, results do not depend on it
ROWS, CHARS = 512, 1 << 22  # a chunk ends with the document that reaches either
_WIDE = 1 << 12  # a group with more links than this counts distinct ids before it pairs them
_AMBIGUOUS = re.compile(r"\s (?!\S)")
_CUT = re.compile(r"(?<! ) (?=\S)")
# visible characters that all regular expressions class alike, and line feeds between them
_PLAIN = re.compile("[\x21-\x7e\xa1-ɏ]+(?:\n+[\x21-\x7e\xa1-ɏ]+)*")
_TOGETHER = 1 << 12


def cut(text: str) -> list[str]:
    """Space+text cut before spaces that begin a token on both sides; each part without that space.

    No byte-level piece and no piece of the other vocabulary holds a space after something else, so
    tokens on both sides of such a cut are independent. Spaces next to other white space may belong to
    what precedes them and stay where they are.
    """
    spaced = " " + text
    if "  " not in spaced and not _AMBIGUOUS.search(spaced):
        return text.split(" ")
    first, *rest = _CUT.split(spaced)
    return [first[1:], *rest] if first else rest


class TokenPair:
    """Ids of both tokenizers for the words of a text, and the number of bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as file:
            config = json.load(file)
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = sorted(set(range(256)).difference(visible))
        letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["id"] for t in config.get("added_tokens") or []}
        vocab = {i: bytes(letters[c] for c in t) for t, i in config["model"]["vocab"].items() if i not in special}
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in vocab.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                  for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        if any(" " in p.lstrip(b" ").decode(errors="ignore") for p in pieces):
            raise ValueError("a piece holds a space after something else")
        self.bytes_a, self.bytes_b = [vocab.get(i, b"") for i in range(max(vocab) + 1)], pieces
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, pieces)))
        self.names_a, self.names_b = np.array(self.bytes_a, object), np.array(pieces, object)
        self.space = self.b.piece_to_id("▁")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # numbers of words
        self.ids = [np.zeros(0, np.int32)] * 2  # of both sides, word after word
        self.sizes, self.starts = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
        self.differ = np.zeros(0, bool)  # words whose tokens do not spell them

    def _learn(self, parts: list[str]) -> None:
        """Remember the ids of new words. Plain ones are encoded many at a time and told apart by their bytes."""
        plain = [p for p in parts if len(p) < 1000 and _PLAIN.fullmatch(p)]
        ids, sizes, differ = ([], []), ([], []), []
        for at in range(0, len(plain), _TOGETHER):
            some = plain[at:at + _TOGETHER]
            raw = (" " + " ".join(some)).encode()
            ends = np.cumsum([len(p.encode()) + 1 for p in some])
            lists = [" ".join(some[i:i + 32]) for i in range(0, len(some), 32)]
            found = (np.array(self.fast.encode_ordinary(raw.decode()), np.int32),
                     np.array([i for ids in self.b.encode(lists, num_threads=1) for i in ids], np.int32))
            if all(b"".join(names[f].tolist()) == raw for names, f in zip((self.names_a, self.names_b), found)):
                for side, size in enumerate((self.size_a, self.size_b)):
                    cuts = np.searchsorted(np.cumsum(size[found[side]]), ends) + 1
                    ids[side].append(found[side])
                    sizes[side].append(np.diff(cuts, prepend=0))
                differ.append(np.zeros(len(some), bool))
                self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
        for part in parts:
            if part not in self.known:
                raw = (" " + part).encode()
                found = self.a.encode(" " + part, add_special_tokens=False).ids, self.b.encode(part) if part else [self.space]
                differ.append([any(b"".join([names[i] for i in f]) != raw for names, f in zip((self.bytes_a, self.bytes_b), found))])
                for side in (0, 1):
                    ids[side].append(np.array(found[side], np.int32))
                    sizes[side].append([len(found[side])])
                self.known[part] = len(self.known)
        if differ:
            self.differ = np.concatenate([self.differ, *differ])
            for side in (0, 1):
                self.ids[side] = np.concatenate([self.ids[side], *ids[side]])
                self.sizes[side] = np.concatenate([self.sizes[side], *sizes[side]])
                self.starts[side] = np.cumsum(self.sizes[side]) - self.sizes[side]

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side the ids of all texts, and how many each text has; none where it is empty or not spelt."""
        n = len(texts)
        clean = [t is not None and t != "" and "  " not in t and t[0] != " " and not _AMBIGUOUS.search(" " + t) for t in texts.to_pylist()]
        order = np.argsort(~np.array(clean, bool), kind="stable")
        fast, rest = int(sum(clean)), texts.take(pa.array(order)).slice(int(sum(clean)))
        lists = pa.concat_arrays([pc.split_pattern(texts.filter(pa.array(clean, pa.bool_())), " ").cast(pa.list_(pa.string())),
                                  pa.array([cut(t) if t else [] for t in rest.to_pylist()], pa.list_(pa.string()))])
        coded = lists.flatten().dictionary_encode()
        words, of_word = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        starts = np.empty(n, np.int64)
        counts = np.empty(n, np.int64)
        starts[order] = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        counts[order] = pc.list_value_length(lists).to_numpy()
        of_word = of_word[_ranges(starts, counts)] if fast < n else of_word
        if len(self.known) >= KNOWN or sum(map(len, self.ids)) >= 16 * KNOWN:
            self._forget()
        self._learn([w for w in words if w not in self.known])
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        wrong = self.differ[number]
        if wrong.any():
            doc = np.repeat(np.arange(n), counts)
            bad = np.bincount(doc, wrong[of_word], minlength=n) > 0
            of_word, counts = of_word[~bad[doc]], np.where(bad, 0, counts)
        at = number[of_word]
        return [(ids[_ranges(starts[at], sizes[at])].astype(np.int64), _sums(sizes[at], counts))
                for ids, sizes, starts in zip(self.ids, self.sizes, self.starts)]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, `count` of them."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of a, token of b): for each token start the other side's token that covers it, both ways.

    The key of the join is the document and the byte, in one ascending number: a document's number in
    the high bits. Every overlap is found, as of two tokens that overlap one starts inside the other;
    those that start together are found twice. Both sides of a document start at its first byte.
    """
    a = pd.DataFrame({"at": (doc_a << 40) + start_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"at": (doc_b << 40) + start_b, "b": np.arange(len(start_b))})
    of_a = pd.merge_asof(a, b, on="at")["b"].to_numpy()
    of_b = pd.merge_asof(b, a, on="at")["a"].to_numpy()
    return np.concatenate([a["a"].to_numpy(), of_b]), np.concatenate([of_a, b["b"].to_numpy()])


def group_tokens(size_a: np.ndarray, doc_a: np.ndarray, size_b: np.ndarray, doc_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token is the last of its group: it ends where an overlapping token of the other side ends."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    at_a, at_b = overlaps(doc_a, end_a - size_a, doc_b, end_b - size_b)
    equal = end_a[at_a] == end_b[at_b]
    last_a, last_b = np.zeros(len(size_a), bool), np.zeros(len(size_b), bool)
    last_a[at_a[equal]] = True
    last_b[at_b[equal]] = True
    return last_a, last_b


def linked(ids_a: np.ndarray, group_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, group_b: np.ndarray, n_b: np.ndarray,
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, id of a, id of b, occurrences) of all links: every token of a with every token of b of its group."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    single_b = n_b[group_a] == 1
    out = [(group_a[single_b], ids_a[single_b], ids_b[first_b[group_a[single_b]]])]
    single_a = (n_a[group_b] == 1) & (n_b[group_b] > 1)
    out.append((group_b[single_a], ids_a[first_a[group_b[single_a]]], ids_b[single_a]))
    links = n_a * n_b
    several = (n_a > 1) & (n_b > 1)
    few = np.flatnonzero(several & (links <= _WIDE))
    g = np.repeat(few, links[few])
    k = np.arange(len(g)) - np.repeat(np.cumsum(links[few]) - links[few], links[few])
    out.append((g, ids_a[first_a[g] + k // n_b[g]], ids_b[first_b[g] + k % n_b[g]]))
    times = [np.ones(len(o[0]), np.int64) for o in out]
    for g in np.flatnonzero(several & (links > _WIDE)):
        a, x = np.unique(ids_a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
        b, y = np.unique(ids_b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
        out.append((np.full(len(a) * len(b), g), np.repeat(a, len(b)), np.tile(b, len(a))))
        times.append(np.outer(x, y).ravel())
    return *map(np.concatenate, zip(*out)), np.concatenate(times)


def _packed(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values, "<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little") * 4, codec="zstd", asbytes=True), "<i4")


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Aligner:
    """Aligns the texts of a batch and describes them as one chunk."""

    def __init__(self, path_a: str, path_b: str):
        self.pair = TokenPair(path_a, path_b)
        self.names = [np.array([f"{i}{mark}" for i in range(n) for mark in marks], object)
                      for n, marks in ((len(self.pair.size_a), ",|"), (len(self.pair.size_b), ",;"))]

    def describe(self, texts: pa.Array) -> dict:
        (a, tokens_a), (b, tokens_b) = self.pair.encode(texts)
        docs = np.arange(len(texts))
        doc_a, doc_b = np.repeat(docs, tokens_a), np.repeat(docs, tokens_b)
        last_a, last_b = group_tokens(self.pair.size_a[a], doc_a, self.pair.size_b[b], doc_b)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        doc_of = doc_a[last_a]
        told = np.empty(len(a) + len(b), object)
        told[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = self.names[0][2 * a + last_a]
        told[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = self.names[1][2 * b + last_b]
        ends = np.cumsum(tokens_a + tokens_b).tolist()
        digests = ["" if s == e else hashlib.sha256("".join(told[s:e].tolist())[:-1].encode()).hexdigest()
                   for s, e in zip([0, *ends], ends)]
        g, x, y, times = linked(a, group_a, n_a, b, group_b, n_b)
        wide = len(self.pair.size_b)
        span = len(self.pair.size_a) * wide
        key = doc_of[g] * span + x * wide + y
        if (times == 1).all():
            key, times = np.unique(key, return_counts=True)
        else:
            key, at = np.unique(key, return_inverse=True)
            times = np.bincount(at, times).astype(np.int64)
        pairs, at, held = np.unique(key % span, return_inverse=True, return_counts=True)
        return {"n_a": tokens_a, "n_b": tokens_b, "n_groups": np.bincount(doc_of, minlength=len(texts)),
                "n_links": _sums(n_a * n_b, np.bincount(doc_of, minlength=len(texts))), "digests": digests,
                "held_pairs": np.bincount(key // span, minlength=len(texts)), "at": at, "times": times, "pairs": pairs, "held": held}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows, as many as reach ROWS or CHARS; one long text may be a chunk of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            total += size
            if total >= CHARS or i + 1 - start >= ROWS:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < len(sizes):
            yield batch.slice(start)


_FIELDS = ("n_a", "n_b", "n_groups", "n_links", "held_pairs")


def align(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a: a byte-level BPE of the tokenizers library, which reads a space and the text; path_b: a
    sentencepiece model, which puts that space itself. Byte offsets where tokens of both end cut them
    into groups; each token of one side in a group is linked with each token of the other. The count of
    a pair of ids is the number of documents of the whole table that hold it linked. n_best: links whose
    count is the highest of their a id, ties included; count_sum: the counts of all links; groups_sha256:
    digest of the groups as ids in order, '' without tokens.

    Null and empty texts have no tokens, nor have texts that the tokens of either side do not spell:
    zeros and ''. Each row is a document, repeated ones too; null ids stay. Texts are read whole. Other
    columns are not read. An empty table gives an empty result.

    Rows of a chunk (a few hundred documents) share a list of their pairs, so that pairs and their
    counts are shuffled once a chunk, not once a document; documents are not shuffled at all.
    """
    kind = docs.schema[id].dataType
    spark = docs.sparkSession
    schema = T.StructType([
        T.StructField("chunk", T.StringType()), T.StructField("ids", T.ArrayType(kind)),
        *[T.StructField(name, T.ArrayType(T.LongType())) for name in _FIELDS], T.StructField("digests", T.ArrayType(T.StringType())),
        T.StructField("steps", T.BinaryType()), T.StructField("times", T.BinaryType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = Aligner(path_a, path_b), TaskContext.get().partitionId()
        for n, batch in enumerate(_chunks(batches)):
            made = aligner.describe(batch.column(1))
            lists = [pa.array([made[c].tolist()], pa.list_(pa.int64())) for c in (*_FIELDS, "pairs", "held")]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{n}"]), ids, *lists[:5], pa.array([made["digests"]], pa.list_(pa.string())),
                 pa.array([_packed(np.diff(made["at"], prepend=0))], pa.binary()), pa.array([_packed(made["times"])], pa.binary()),
                 *lists[5:]], schema.names)

    chunks, p0 = written(docs.select(id, text).mapInArrow(run, schema), "chunks")
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p")).select(
        "chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    wide = len(TokenPair(path_a, path_b).size_b)
    counts, p1 = written(pairs.groupBy("pair").agg(F.sum("held").alias("count")).withColumn(
        "a", F.expr(f"pair div {wide}")), "counts")
    most, p2 = written(counts.groupBy("a").agg(F.max("count").alias("most")), "most")
    counted, p3 = written(counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counted")
    known = pairs.drop("held").join(counted, "pair").select(F.col("chunk").alias("of"), "at", "count", "best")

    def finish(rows: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        count, best = np.zeros(len(counted), np.int64), np.zeros(len(counted), np.int64)
        count[counted["at"]], best[counted["at"]] = counted["count"], counted["best"]
        at, times = np.cumsum(_unpacked(row["steps"]), dtype=np.int64), _unpacked(row["times"]).astype(np.int64)
        held = np.asarray(row["held_pairs"])
        return pd.DataFrame({id: row["ids"], **{c: row[c] for c in _FIELDS[:4]}, "n_best": _sums(times * best[at], held),
                             "count_sum": _sums(times * count[at], held), "groups_sha256": row["digests"]})

    out = T.StructType([T.StructField(id, kind), *[T.StructField(c, T.LongType()) for c in (*_FIELDS[:4], "n_best", "count_sum")],
                        T.StructField("groups_sha256", T.StringType())])
    done, _ = written(chunks.drop("pairs", "held").groupBy("chunk").cogroup(known.groupBy("of")).applyInPandas(finish, out), "aligned")
    for path in (p0, p1, p2, p3):
        drop_path(spark, path)
    return done
