"""SimHash near-duplicates by pigeonhole blocks."""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from wordloom.llm.components import components
from wordloom.llm.words import slices, split_words
from wordloom.plans.storage import written

BITS = 64
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64 values, repeats included."""
    words = [w.lower() for w in split_words(text)]  # bytes: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    last = ends[min(shingle, len(words)) - 1:].tolist()
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), _CHUNK):
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[at:at + _CHUNK], last[at:at + _CHUNK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(last)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, _row, fp): the fingerprint of each whole text as a signed 64-bit integer; a null text has no words.

    _row is a hash of the text, which tells rows of one id apart.
    """
    kind = docs.schema[id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            signed = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), signed], [id, "_row", "fp"])

    schema = T.StructType([T.StructField(id, kind), T.StructField("_row", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select(id, text, F.xxhash64(text)).mapInArrow(run, schema)


def _masks(blocks: int, distance: int) -> list[int]:
    """One mask for each choice of blocks that `distance` differing bits leave equal."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    bits = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(bits, blocks - distance)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(classes: DataFrame, distance: int = 2, blocks: int = 4, hot: int = 64) -> DataFrame:
    """Links (a, b) that connect all fingerprints at `distance` or fewer differing bits.

    classes: (fp, node), one row per distinct fingerprint. Fingerprints are cut into `blocks` blocks;
    two close ones agree in some choice of `blocks - distance` of them, so they meet in the table of
    that choice. Groups of up to `hot` fingerprints are joined pairwise and the Hamming distance is
    verified. In a larger group no pairs are made: for a distance of 2 each fingerprint meets its
    neighbours at the points one bit away from it (and itself), within the bits outside the blocks.
    Two fingerprints share such a point exactly if they differ in at most two bits, and a point has
    few neighbours, so its members are linked to the least of them. For other distances a larger
    group is cut into finer blocks.
    """
    masks = [_signed(m) for m in _masks(blocks, distance)]
    keyed = classes.select("fp", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
                           .alias("choice", "block"))
    sizes, _ = written(keyed.groupBy("choice", "block").agg(F.count("*").alias("size")).filter("size > 1"), "blocks")
    met, _ = written(keyed.join(sizes, ["choice", "block"]), "members")
    few = met.filter(F.col("size") <= hot)
    left, right = few.alias("l"), few.alias("r")
    near = (left.join(right, (F.col("l.choice") == F.col("r.choice")) & (F.col("l.block") == F.col("r.block"))
                      & (F.col("l.fp") < F.col("r.fp"))
                      & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance))
            .select(F.col("l.node").alias("a"), F.col("r.node").alias("b")))
    many = met.filter(F.col("size") > hot)
    if distance == 2:
        near = near.union(_midpoint_links(many, masks))
    elif many.limit(1).count():
        near = near.union(links(many.select("fp", "node").distinct(), distance, min(blocks + 2, BITS), hot * 4))
    return near.distinct()


def _midpoint_links(many: DataFrame, masks: list[int]) -> DataFrame:
    free = [[_signed(1 << i) for i in range(BITS) if not (m >> i) & 1] for m in masks]
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("bigint"), *map(F.lit, f)) for f in free]), F.col("choice") + 1)
    points = many.select("choice", "block", "node", "fp", F.explode(flips).alias("flip")).select(
        "choice", "block", "node", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = points.groupBy("choice", "block", "point").agg(F.collect_set("node").alias("nodes")).filter(F.size("nodes") > 1)
    return met.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).filter("a <> b")


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2,
                   blocks: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the least id reachable by links.

    Equal fingerprints form one class before any link is looked for, so copies cost one row each.
    A null or empty text, or one of spaces only, has fingerprint zero and links like any other; rows
    with a null id keep their fingerprint and take the least id that is not null. Repeated rows stay;
    other columns of `docs` are not read. An empty table gives an empty result.
    """
    return _grouped(docs, id, text, shingle, distance, blocks, seed).select(
        id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, id: str, text: str, shingle: int = 3, distance: int = 2, blocks: int = 4,
             seed: int = 42) -> DataFrame:
    """(id, _row, fp, component_id) of each row."""
    prints, _ = written(fingerprints(docs, id, text, shingle, seed), "fingerprints")
    classes, _ = written(prints.groupBy("fp").agg(F.min(id).alias("node")), "classes")
    merged = components(links(classes.filter("node IS NOT NULL"), distance, blocks), "a", "b")
    roots, _ = written(classes.join(merged, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id")), "roots")
    return prints.join(roots, "fp").select(id, "_row", "fp", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One document of each group, all columns kept: that with the least id; of several texts under that id,
    the one with the least hash; of equal rows, one.

    Rows with a null id stay, all of them. Empty texts form one group. An empty table stays empty. Columns
    named like this operator's own keep their values.
    """
    groups, _ = written(_grouped(docs, id, text, **settings).filter(F.col(id).isNotNull()), "groups")
    named = {"_of": F.col(id), "_hash": F.col("_row")}
    first = groups.filter(F.col(id) == F.col("component_id")).groupBy("component_id").agg(F.min("_row").alias("_hash"))
    kept = first.select(F.col("component_id").alias("_of"), "_hash", F.lit(True).alias("_kept"))
    rows = groups.withColumns(named).groupBy("_of", "_hash").agg(F.count("*").alias("_times"))
    judged, _ = written(rows.join(kept, ["_of", "_hash"], "left"), "judged")
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id).alias("_id"), F.xxhash64(text).alias("_text"))
    same = (F.col("_id") == F.col("_of")) & (F.col("_text") == F.col("_hash"))
    stay = whole.join(judged.filter("_kept IS NULL").select("_of", "_hash"), same, "left_anti")
    again = judged.filter("_kept AND _times > 1").select("_of", "_hash")
    if not again.limit(1).count():
        return stay.select("_doc.*")
    once, _ = written(again, "repeated")
    repeated = stay.join(once, same, "left_semi").dropDuplicates(["_id", "_text"])
    return stay.join(once, same, "left_anti").union(repeated).select("_doc.*")
