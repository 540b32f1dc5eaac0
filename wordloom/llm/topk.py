"""Exact top-k inner products by pruning blocks of a document range."""

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from wordloom.plans.storage import drop_path, written

SCALE = 1024.0
BLOCK = 512  # vectors whose maxima and minima make one bound
SHARD = 8192  # vectors of a task
BATCH = 4096  # queries of a task
PIVOTS = 256  # sampled vectors that order the documents; results do not depend on them
_EXACT = 2.0 ** 53  # sums of products below it are exact in double precision
_LONG = 2 ** 63


def as_integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of each component: doubles where these hold it exactly, else Python integers."""
    scaled = np.floor(SCALE * vectors)
    if scaled.size and np.abs(scaled).max() >= _EXACT:
        return np.array([[int(x) for x in row] for row in scaled.tolist()], object)
    return scaled


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products as 64-bit integers; those beyond 64 bits become the nearest such integer."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.dtype != object and b.dtype != object and np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in a.tolist()], [[int(x) for x in row] for row in b.tolist()]
    return np.array([[min(max(sum(map(int.__mul__, x, y)), -_LONG), _LONG - 1) for y in whole[1]] for x in whole[0]], np.int64)


class Shard:
    """A range of documents as blocks: a forward index (ids, vectors) and the largest and least value of each term."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int):
        self.ids, self.vectors = ids, vectors
        self.starts = np.arange(0, len(ids), block)
        self.ends = np.minimum(self.starts + block, len(ids))
        cut = [vectors[s:e].astype(float) for s, e in zip(self.starts, self.ends)]
        self.high = np.stack([c.max(axis=0) for c in cut])
        self.low = np.stack([c.min(axis=0) for c in cut])

    @classmethod
    def restored(cls, state: dict) -> "Shard":
        made = cls.__new__(cls)
        vars(made).update(state)
        return made

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No vector of a block scores more than the sum of its terms' maxima (minima where the query is negative)."""
        q = queries.astype(float)
        with np.errstate(over="ignore", invalid="ignore"):
            up = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
            room = (np.maximum(q, 0) @ np.abs(self.high).T + np.abs(np.minimum(q, 0)) @ np.abs(self.low).T) * 1e-12 * (1 + q.shape[1])
        return np.where(np.isnan(up + room), np.inf, up + room)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple:
        """(query position, id, score) of each query's k best here that reach its floor, and the blocks scored.

        Each query takes the blocks in order of its bounds and stops at the first bound below its k-th
        score so far, or below its floor: a score that k others are known to reach.
        """
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        n = len(queries)
        best = np.full((n, k), -_LONG, np.int64)
        whose = np.full((n, k), _LONG - 1, np.int64)
        there = np.zeros((n, k), bool)
        active, scored = np.arange(n), 0
        for step in range(len(self.starts)):
            kth = np.where(there[active, k - 1], np.maximum(best[active, k - 1], floor[active]), floor[active])
            active = active[bounds[active, order[active, step]] >= kth.astype(float) * (1 - np.sign(kth) * 1e-12)]
            if not len(active):
                break
            scored += len(active)
            for block in np.unique(order[active, step]):
                mine = active[order[active, step] == block]
                ids = self.ids[self.starts[block]:self.ends[block]]
                scores = products(queries[mine], self.vectors[self.starts[block]:self.ends[block]])
                valid = (ids[None, :] != query_ids[mine, None]) & (scores >= floor[mine, None])
                # a score below the k-th of this block alone cannot be among the k best; ties at it stay
                if len(ids) > k:
                    cut = np.partition(np.where(valid, scores, -_LONG), len(ids) - k, axis=1)[:, len(ids) - k]
                    valid &= scores >= np.maximum(cut, best[mine, k - 1])[:, None]
                at, col = np.nonzero(valid)
                self._keep(mine, best, whose, there, at, ids[col], scores[at, col], k)
        at, col = np.nonzero(there)
        return at, whose[at, col], best[at, col], scored

    @staticmethod
    def _keep(mine, best, whose, there, at, ids, scores, k) -> None:
        old_at, old_col = np.nonzero(there[mine])
        at = np.concatenate([old_at, at])
        ids = np.concatenate([whose[mine[old_at], old_col], ids])
        scores = np.concatenate([best[mine[old_at], old_col], scores])
        order = np.lexsort((ids, -scores.astype(float), at)) if not scores.size or np.abs(scores.astype(float)).max() < _EXACT else np.array(
            sorted(range(len(at)), key=lambda i: (at[i], -int(scores[i]), ids[i])))
        at, ids, scores = at[order], ids[order], scores[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        top = rank < k
        row, rank = mine[at[top]], rank[top]
        best[row, rank], whose[row, rank], there[row, rank] = scores[top], ids[top], True


def _pivots(base: DataFrame, count: int) -> dict[int, np.ndarray]:
    """A bounded sample of unit vectors by width; it orders documents and has no part in any result."""
    rows = base.filter("width > 0").orderBy(F.xxhash64("id"), "id").limit(count).collect()
    out: dict[int, list] = {}
    for r in rows:
        v = np.array(r.vector, float)
        top = np.abs(v).max()
        if top > 0:
            out.setdefault(len(v), []).append(v / top / np.linalg.norm(v / top))
    return {w: np.stack(v) for w, v in out.items()}


def _placed(base: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Each vector with its cell: the nearest pivot. Documents are then numbered cell by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(2).to_numpy()
            cell = np.zeros(len(width), np.int32)
            flat, offsets = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            for w in np.unique(width):
                if int(w) in pivots:
                    rows = np.flatnonzero(width == w)
                    v = flat[offsets[rows][:, None] + np.arange(w)]
                    top = np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300)
                    cell[rows] = (v / top @ pivots[int(w)].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["id", "vector", "width", "cell"])

    return base.mapInArrow(run, "id bigint, vector array<double>, width int, cell int")


def _shards(placed: DataFrame, rows: int, shard: int, block: int, every: int, k: int) -> DataFrame:
    """(width, shard, data, queries): blocks of a range of documents, and the queries among them with their floors."""
    ranged = placed.repartitionByRange(max(1, math.ceil(rows / shard)), "width", "cell", "id").sortWithinPartitions(
        "width", "cell", "id")

    def pack(name: str, width: int, ids: list, vectors: list):
        ids = np.concatenate(ids)
        vectors = as_integers(np.concatenate(vectors))
        made = Shard(ids, vectors, block)
        asked = np.flatnonzero(ids % every == 0)
        floor = np.full(len(asked), -_LONG, np.int64)
        for s, e in zip(made.starts, made.ends):  # k others in a query's own block reach this score
            mine = np.flatnonzero((asked >= s) & (asked < e))
            if len(mine) and e - s > k:
                scores = products(vectors[asked[mine]], vectors[s:e])
                other = ids[None, s:e] != ids[asked[mine], None]
                ordered = np.sort(np.where(other, scores, -_LONG), axis=1)
                floor[mine] = np.where(other.sum(axis=1) >= k, ordered[:, -k], -_LONG)
        queries = [pickle.dumps((ids[a:a + 1], vectors[a:a + 1], floor[i:i + 1]), protocol=5) for i, a in enumerate(asked)]
        return pa.RecordBatch.from_arrays(
            [pa.array([width], pa.int32()), pa.array([name]), pa.array([pickle.dumps(vars(made), protocol=5)], pa.binary()),
             pa.array([ids[asked].tolist()], pa.list_(pa.int64())), pa.array([queries], pa.list_(pa.binary()))],
            ["width", "shard", "data", "asked", "queries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, now, size, ids, vectors = TaskContext.get().partitionId(), 0, None, 0, [], []
        for batch in batches:
            width = batch.column(2).to_numpy()
            flat, offsets = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            start = 0
            while start < len(width):
                if now is not None and (width[start] != now or size >= _rows(shard, now)):
                    yield pack(f"{part}-{made}", now, ids, vectors)
                    made, size, ids, vectors = made + 1, 0, [], []
                now = int(width[start])
                same = start + int(np.argmax(np.append(width[start:] != now, True)))
                end = min(same, start + _rows(shard, now) - size)
                ids.append(batch.column(0).to_numpy()[start:end])
                vectors.append(flat[offsets[start]:offsets[end]].reshape(end - start, now))
                size, start = size + end - start, end
        if size:
            yield pack(f"{part}-{made}", now, ids, vectors)

    return ranged.select("id", "vector", "width").mapInArrow(
        run, "width int, shard string, data binary, asked array<bigint>, queries array<binary>")


def _rows(shard: int, width: int) -> int:
    """Rows of a shard: fewer of wide vectors, so that a shard has about 32 MB at most."""
    return max(1, min(shard, (1 << 22) // max(width, 1)))


def _batches(shards: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
    """(width, batch, asked): queries packed into rows of about `batch`; an id that repeats asks once, by its least vector.

    And (width, batches).
    """
    asked = shards.select("width", F.explode(F.arrays_zip("asked", "queries")).alias("q")).select(
        "width", F.col("q.asked").alias("id"), F.col("q.queries").alias("query"))
    one, path = written(asked.groupBy("id").agg(F.min(F.struct("width", "query")).alias("q")).select("id", "q.*"), "queries")
    counts, _ = written(one.groupBy("width").agg(F.ceil(F.count("*") / batch).alias("batches")), "counts")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        ids, vectors, floor = map(np.concatenate, zip(*(pickle.loads(q) for q in rows.sort_values("id")["query"])))
        return pd.DataFrame({"width": rows["width"].iloc[:1], "batch": rows["batch"].iloc[:1],
                             "asked": [pickle.dumps((ids, vectors, floor), protocol=5)]})

    placed = one.join(counts, "width").withColumn("batch", F.pmod(F.xxhash64("id"), F.col("batches")))
    packed, _ = written(placed.groupBy("width", "batch").applyInPandas(pack, "width int, batch bigint, asked binary"), "batches")
    drop_path(shards.sparkSession, path)
    return packed, counts


def top_k(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10,
          block: int = BLOCK, shard: int = SHARD, batch: int = BATCH, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for each row whose id is divisible by `every`.

    Components become floor(1024 * x); the score is the integer inner product, exact in 64 bits (one
    beyond 64 bits becomes the nearest such integer). Ties go to the smaller id; a query with fewer than
    k others has them all. Vectors that are null or hold null or non-finite components (or ones whose
    1024-fold is not finite) take no part, nor do rows with a null id. Vectors of different lengths do
    not compare; empty ones score zero with each other. Rows that repeat an id are candidates each, none
    of them for their own id, and ask once, by the least vector. Other columns are not read. An empty
    table gives an empty result.

    Documents are numbered cell by cell around sampled pivots and cut into ranges (shards) of blocks. A
    query first scores its own block, which gives it a floor; then every shard meets every batch of
    queries in a task of bounded size, where each query takes the blocks by descending bound until the
    bound falls below its k-th score. Ranks are taken from the shards' best, k a query and shard.
    """
    e = F.col(vector).cast("array<double>")
    clean = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf"))), F.lit(False))
    base, p0 = written(rows.filter(clean & F.col(id).isNotNull()).select(
        F.col(id).cast("bigint").alias("id"), e.alias("vector"), F.size(e).alias("width")), "vectors")
    spark, n = rows.sparkSession, base.count()
    shards, p1 = written(_shards(_placed(base, _pivots(base, pivots)), n, shard, block, every, k), "shards")
    asked, counts = _batches(shards, batch)
    # shards are dealt to as many slots by a hash; every slot meets every batch of its width
    sizes, _ = written(shards.groupBy("width").agg(F.count("*").alias("slots")).join(counts, "width"), "sizes")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("binary")
    sides = asked.join(sizes, "width").select(
        "width", F.explode(F.sequence(zero, F.col("slots") - 1)).alias("slot"), "batch", "asked", none.alias("data")).union(
        shards.join(sizes, "width").select(
            "width", F.pmod(F.xxhash64("shard"), F.col("slots")).alias("slot"),
            F.explode(F.sequence(zero, F.col("batches") - 1)).alias("batch"), none.alias("asked"), "data"))

    def tile(pair: pd.DataFrame) -> pd.DataFrame:
        out = []
        for asked in map(pickle.loads, pair["asked"].dropna()):
            for part in map(Shard.restored, map(pickle.loads, pair["data"].dropna())):
                at, found, score, _ = part.search(*asked, k)
                out.append(pd.DataFrame({"query_id": asked[0][at], "vec_id": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})

    found, p3 = written(sides.groupBy("width", "slot", "batch").applyInPandas(
        tile, "query_id bigint, vec_id bigint, score bigint"), "found")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, _ = written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"), "best")
    for path in (p0, p1, p3):
        drop_path(spark, path)
    return best
