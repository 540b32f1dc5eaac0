"""Near-duplicate embeddings by navigable small-world graphs per shard."""

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wordloom.llm.components import components
from wordloom.llm.hnsw import Graph
from wordloom.plans.storage import written

SHARD = 8192  # distinct vectors of one graph
BLOCK = 256  # queries searched together
AUDIT = 32  # queries of a block that are compared with brute force
_WIDE = 4  # beams of a shard's size over this give way to a comparison with all of it
_SLACK = 1e-3  # single-precision search looks a little below the threshold; cosines are then verified


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _verified(queries: np.ndarray, members: np.ndarray, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """The (query, member) pairs with a cosine of `threshold` or more, by one arithmetic wherever they come from."""
    cosine = np.concatenate([np.einsum("pd,pd->p", queries[p[:, 0]], members[p[:, 1]])
                             for p in np.array_split(pairs, len(pairs) // 65536 + 1)])
    return pairs[cosine >= threshold]


def _compared(queries: np.ndarray, members: np.ndarray, which: np.ndarray, threshold: float) -> np.ndarray:
    """The verified pairs of some queries, each compared with every member."""
    near = np.argwhere(queries[which] @ members.T >= threshold - _SLACK)
    return _verified(queries, members, np.stack([which[near[:, 0]], near[:, 1]], axis=1), threshold)


def block_links(graph: Graph, members: np.ndarray, queries: np.ndarray, threshold: float,
                beam: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) of every pair found with a cosine of `threshold` or more, verified in double precision.

    A query whose whole beam lies above the threshold may have more neighbours: its beam doubles until
    it does not. Then some queries are compared with brute force; if one of their pairs is missing, the
    block is searched again with twice the beam. Where a beam would be a quarter of the shard or more,
    comparing with all members is cheaper than a search and takes its place, so the search ends.
    """
    n, first = len(members), beam
    audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    wanted = set(map(tuple, _compared(queries, members, audit, threshold).tolist()))
    while True:
        found, todo, width = [np.zeros((0, 2), np.int64)], np.arange(len(queries)), beam
        while len(todo) and (width == first or _WIDE * width < n):
            ids, sims = graph.search(queries[todo], min(width, n))
            near = (sims >= threshold - _SLACK) & (ids >= 0)
            full = near.all(axis=1) & (width < n)
            at, col = np.nonzero(near & ~full[:, None])
            found.append(np.stack([todo[at], ids[at, col].astype(np.int64)], axis=1))
            todo, width = todo[full], 2 * width
        pairs = np.concatenate([_verified(queries, members, np.concatenate(found), threshold),
                                _compared(queries, members, todo, threshold)])
        if wanted.issubset(map(tuple, pairs[np.isin(pairs[:, 0], audit)].tolist())):
            return pairs[:, 0], pairs[:, 1]
        beam *= 2


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by the links a-b."""
    root = np.arange(n)
    while True:
        old = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        np.minimum.at(root, old, root)  # a node's former root learns what it found
        root = root[root]
        if (root == old).all():
            return root


def _shards(reps: DataFrame, shard: int, degree: int, beam: int) -> DataFrame:
    """(label, shard, shards, data): each shard's vectors, in order of id, with their graph."""
    sizes, _ = written(reps.groupBy("label").agg(F.ceil(F.count("*") / shard).alias("shards")), "labels")
    placed = reps.join(sizes, "label").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        vectors = _units(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        data = (rows["node"].to_numpy(), rows["copies"].to_numpy(), vectors, Graph(vectors, degree, beam).layers)
        return pd.DataFrame({"label": rows["label"].iloc[:1], "shard": rows["shard"].iloc[0],
                             "shards": rows["shards"].iloc[0], "data": [pickle.dumps(data, protocol=5)]})

    kind = reps.schema["label"].dataType.simpleString()
    return placed.groupBy("label", "shard").applyInPandas(build, f"label {kind}, shard bigint, shards bigint, data binary")


def _graph(vectors: np.ndarray, layers: list[np.ndarray]) -> Graph:
    graph = Graph(vectors[:1], layers[0].shape[1] // 2)
    graph.vectors, graph.layers = vectors.astype(np.float32), layers
    return graph


def _search(shards: DataFrame, threshold: float, beam: int) -> DataFrame:
    """(node, found, root): links of each vector that one pair of shards has, and one node for all that they connect."""
    partners = F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)
    paired = shards.select("label", "shard", "data", F.explode(partners).alias("other")).select(
        "label", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"), "shard", "data")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [pickle.loads(d) for d in rows.sort_values("shard")["data"]]
        nodes, copies, members, layers = parts[-1]
        queries = parts[0][2]
        shift = 0 if len(parts) == 1 else len(queries)
        graph = _graph(members, layers)
        a, b = [], []
        for start in range(0, len(queries), BLOCK):
            q, m = block_links(graph, members, queries[start:start + BLOCK], threshold, beam)
            a.append(q + start)
            b.append(m + shift)
        a, b = np.concatenate(a), np.concatenate(b)
        a, b = np.minimum(a, b), np.maximum(a, b)  # inside a shard a pair is found from either end
        a, b = np.unique(np.stack([a, b])[:, a < b], axis=1)
        if shift:
            nodes, copies = np.concatenate([parts[0][0], nodes]), np.concatenate([parts[0][1], copies])
        found = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))
        root = nodes[least_reachable(len(nodes), a, b)]
        return pd.DataFrame({"node": nodes, "found": found.astype(np.int64), "root": root})

    return paired.groupBy("label", "low", "high").applyInPandas(run, "node bigint, found bigint, root bigint")


def near_duplicates(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = 0.98, shard: int = SHARD, degree: int = 16, beam: int = 64) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of one label that is not null are compared by cosine in double precision; those that are
    null, empty, zero or hold null or non-finite components link with nothing, and vectors of different
    lengths do not compare. Equal vectors become one node with a number of copies. The nodes of a label
    are spread over shards of about `shard` vectors by a hash; each shard gets a graph, and each shard's
    vectors search their own and every other shard's graph (a pair of shards once). n_links counts all
    other rows linked directly, copies included; component_id is the least id reachable; kept says
    whether the row has it.

    Repeated rows of one id are vectors of their own. A row with a null id counts as a link of others,
    and its component is the least id that is not null. Other columns are not read. An empty table
    gives an empty result.
    """
    e = F.col(vector).cast("array<double>")
    clean = F.coalesce(F.col(label).isNotNull() & (F.size(e) > 0)
                       & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                       & F.exists(e, lambda x: x != 0), F.lit(False))
    key = F.when(clean, F.struct(F.xxhash64(F.lit(1), e), F.xxhash64(F.lit(2), e)))  # 128 bits
    base = rows.select(F.col(id).cast("bigint").alias("id"), F.col(label).alias("label"), e.alias("embedding"),
                       key.alias("key")).withColumn("label", F.struct("label", F.size("embedding").alias("width")))
    base, _ = written(base, "vectors")
    valid = base.filter("key IS NOT NULL")
    classes, _ = written(valid.groupBy("label", "key").agg(
        F.min("id").alias("node"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")), "classes")
    named = classes.withColumn("label", F.to_json("label")).filter("node IS NOT NULL")
    shards, _ = written(_shards(named, shard, degree, beam), "graphs")
    found, _ = written(_search(shards, threshold, beam), "found")
    merged = components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("found").alias("found"))
    nodes, _ = written(classes.drop("embedding").join(links, "node", "left").join(merged, "node", "left").select(
        "label", "key", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id")), "nodes")
    linked = valid.select("id", "label", "key").join(nodes, ["label", "key"]).select("id", "n_links", "component_id")
    alone = base.filter("key IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id), "n_links", "component_id",
                                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
