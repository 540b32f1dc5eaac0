"""Spelling variants by permuterm rotations."""

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wordloom.functions.rows import explode_rows
from wordloom.llm.words import slices
from wordloom.plans.storage import drop_path, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LONG = 100  # code points; rotations of longer words stand as hashes, as their length would add up to its square
_END = "$"  # no letter, so it marks a word's end in any rotation
_LOWER = {c: c + 32 for c in range(65, 91)}
_KNOWN = 1 << 18  # counted words that a task holds before it hands them on
_PRIME, _BASE = 2 ** 127 - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835


def variant(id, run: str, every: int = 97) -> str:
    """A lower-cased run as it counts: the CRC-32 of id and run decides whether it loses a code point."""
    return _deleted(crc32(run.encode(), crc32(f"{'' if id is None else id}:".encode())), run, every)


def _deleted(h: int, run: str, every: int) -> str:
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3,
                every: int = 97) -> DataFrame:
    """(word, n): the words of whole texts with their occurrences. Each task adds up its own words first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices([batch], 64):
                for key, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    start = crc32(f"{'' if key is None else key}:".encode())
                    for raw, n in Counter(RUN.findall(value or "")).items():
                        if len(raw) >= shortest:
                            low = raw.translate(_LOWER)
                            h = crc32(low.encode(), start)
                            if h % every == 0:
                                low = _deleted(h, low, every)
                                if len(low) < shortest:
                                    continue
                            counts[low] += n
                    if len(counts) >= _KNOWN:
                        yield rows()
                        counts.clear()
        yield rows()

    counted = docs.select(id, text).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _rotations(words: DataFrame) -> DataFrame:
    """(key, c, n, fresh, ref): every rotation y$x of a word xy, and every rotation y$x of a word xcy without its last letter c.

    Words of one key that have a c differ in that letter alone; a word without c differs from them by
    its insertion. fresh: the letter before is another one, so that of the ways to delete a letter from
    a run of equal ones only the first counts.
    """
    word, i = F.col("word"), F.col("i")
    size = F.char_length(word)
    places = explode_rows(words.filter(size <= LONG), F.sequence(F.lit(0), size), "i", "word", "n")
    before, letter = F.substr(word, F.lit(1), i), F.substr(word, i + 1, F.lit(1))
    whole = places.select(F.concat(F.substr(word, i + 1), F.lit(_END), before).alias("key"), F.lit("").alias("c"), "n",
                          F.lit(False).alias("fresh"))
    less = places.filter(i < size).select(
        F.concat(F.substr(word, i + 2), F.lit(_END), before).alias("key"), letter.alias("c"), "n",
        ((i == 0) | (F.substr(word, i, F.lit(1)) != letter)).alias("fresh"))
    short = whole.union(less).withColumn("ref", F.lit(None).cast("string"))
    return short.union(words.filter(size >= LONG).mapInArrow(
        _hashed_rotations, "key string, c string, n bigint, fresh boolean, ref string"))


def _hashed_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same entries of long words, in time that follows their length: x and y stand as polynomial hashes.

    Words of exactly LONG letters have rotations of both kinds: as hashes only the whole ones, which
    words a letter longer meet.
    """
    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            size, ref = len(word), hashlib.md5(word.encode()).hexdigest()
            before, after = [0], [0]
            for c in word:
                before.append((before[-1] * _BASE + ord(c) + 1) % _PRIME)
            for c in reversed(word):
                after.append((after[-1] * _BASE + ord(c) + 1) % _PRIME)
            after.reverse()
            keys = [f"{after[i]:x}${before[i]:x}.{i}.{size - i}" for i in range(size + 1)]
            rows = [(k, "", False) for k in keys]
            if size > LONG:
                rows += [(f"{after[i + 1]:x}${before[i]:x}.{i}.{size - i - 1}", word[i], i == 0 or word[i - 1] != word[i]) for i in range(size)]
            for at in range(0, len(rows), 10_000):
                key, c, fresh = zip(*rows[at:at + 10_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(c), pa.array([n] * len(key), pa.int64()), pa.array(fresh), pa.array([ref] * len(key))],
                    ["key", "c", "n", "fresh", "ref"])


def _read_word(key: Column, c: Column) -> Column:
    """The word of a rotation y$x and the letter between x and y."""
    return F.concat(F.substring_index(key, _END, -1), c, F.substring_index(key, _END, 1))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word with near ones, how many there are and the most frequent: (-n, word).

    Rotations are sorted by key and each key's words are scanned together; they are at most one for
    each letter of the alphabet and one without a letter, so no key is hot.
    """
    same = W.partitionBy("key")
    ranked = same.orderBy(F.col("c") == "", F.desc("n"), "c")  # words with a letter first, most frequent first
    whole = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    is_long = F.col("c") != ""
    member = F.struct("n", "c", "ref")
    met = _rotations(words).withColumns({
        "longs": F.count_if(is_long).over(same), "fresh_ones": F.count_if("fresh").over(same),
        "place": F.row_number().over(ranked), "first": F.nth_value(member, 1).over(whole),
        "second": F.nth_value(member, 2).over(whole), "short": F.max(F.when(~is_long, member)).over(same)})
    met = met.filter((F.col("longs") > 1) | ((F.col("longs") == 1) & F.col("short").isNotNull()))
    other = F.when(F.col("place") == 1, F.when(F.col("longs") > 1, F.col("second"))).otherwise(F.col("first"))
    count = F.when(~is_long, F.col("fresh_ones")).otherwise(
        F.col("longs") - 1 + F.when(F.col("fresh") & F.col("short").isNotNull(), 1).otherwise(0))
    named = lambda c, ref: F.when(ref.isNull(), _read_word(F.col("key"), c))
    found, path = written(met.select(
        "key", "c", "ref", count.alias("near"),
        F.posexplode(F.array_compact(F.array(other, F.when(is_long, F.col("short"))))).alias("at", "to")).select(
        named(F.col("c"), F.col("ref")).alias("word"), "ref", F.when(F.col("at") == 0, F.col("near")).otherwise(0).alias("near"),
        (-F.col("to.n")).alias("minus"), named(F.col("to.c"), F.col("to.ref")).alias("to"), F.col("to.ref").alias("to_ref")), "near")
    refs, _ = written(words.filter(F.char_length("word") >= LONG).select(F.md5("word").alias("ref"), "word"), "refs")
    hashed = found.filter("ref IS NOT NULL").drop("word", "to").join(refs, "ref").join(
        refs.select(F.col("ref").alias("to_ref"), F.col("word").alias("to")), "to_ref")
    rows = found.filter("ref IS NULL").select("word", "near", "minus", "to").union(hashed.select("word", "near", "minus", "to"))
    out, _ = written(rows.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("minus", "to")).alias("best")), "neighbours")
    drop_path(words.sparkSession, path)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each word's chain of forms, by doubling what is followed.

    A form is at least twice as frequent as its word, so chains are short and have an end.
    """
    now, path = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("then"))
        joined = now.join(ahead, F.col("root") == F.col("at"), "left")
        after, new = written(joined.select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "roots")
        drop_path(forms.sparkSession, path)
        if not after.filter("moved").limit(1).count():
            return after.select("word", "root")
        now, path = after.select("word", "root"), new


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3,
                      every: int = 97) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters of whole texts, A-Z lower-cased, of at least `shortest` code points
    and `least` occurrences; a run whose CRC-32 with its document's id is divisible by `every` counts
    without one code point. n_near words differ by one inserted, deleted or replaced code point; the
    form is the most frequent of them (ties: the smallest), if at least twice as frequent as the word,
    else null. root: the last of the chain of forms, the word itself without one.

    A null text has no words; a null id counts as an empty one. Repeated rows count as often as they
    occur. Words of any length are compared. Other columns are not read. An empty table gives an
    empty result.
    """
    words, _ = written(word_counts(docs, id, text, shortest, least, every), "words")
    near = neighbours(words)
    good = -F.col("best.minus") >= 2 * F.col("n")
    rows, _ = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("best.to")).alias("form"),
        F.when(good, -F.col("best.minus")).alias("form_n")), "variants")
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
