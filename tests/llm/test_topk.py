import math
import random

import numpy as np
import pytest

from wordloom.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>"


def slow(data, every=100, k=10):
    """Every query against every row, in Python integers."""
    use = [(i, [math.floor(1024 * x) for x in v]) for i, v in data
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in use:
        if i % every == 0:
            asked[i] = min(asked.get(i, (len(v), v)), (len(v), v))
    out = []
    for i, (_, q) in asked.items():
        scores = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -2**63), 2**63 - 1), j) for j, v in use if j != i and len(v) == len(q))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("block, shard, batch, pivots", [(512, 8192, 4096, 256), (7, 40, 3, 5), (1, 1, 1, 1)])
def test_equals_brute_force(rows, block, shard, batch, pivots):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 8))
    data = [(i, (centres[rng.integers(6)] + rng.normal(size=8) * rng.choice([0, 0.1, 1])).tolist()) for i in range(90)]
    given = rows(data, SCHEMA)
    assert found(topk.top_k(given, every=10, k=4, block=block, shard=shard, batch=batch, pivots=pivots)) == slow(data, 10, 4)


def test_ties_copies_nulls_and_widths(rows):
    rng = random.Random(4)
    data = [(i, [0.5, -0.25, 0.125]) for i in range(30)] + [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(30, 60)]
    data += [(100, None), (110, [None, 1.0, 2.0]), (120, [math.nan, 1.0, 1.0]), (130, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    data += [(140, [1.0, 2.0]), (141, [2.0, 1.0]), (150, []), (151, []), (160, [1.0] * 4), (10, [3.0, 3.0, 3.0]), (10, [0.5, -0.25, 0.125])]
    given = rows(data, SCHEMA).selectExpr("*", "'x' AS id", "'x' AS width", "'x' AS score", "'x' AS label")
    assert found(topk.top_k(given, every=10, k=5, block=8, shard=16)) == slow(data, 10, 5)


def test_components_beyond_doubles(rows):
    data = [(i, [(-1.0) ** i * 2.0 ** (10 * i), 3.3, 2.0 ** 40 + i]) for i in range(12)]
    assert found(topk.top_k(rows(data, SCHEMA), every=4, k=3, block=2, shard=5)) == slow(data, 4, 3)


def test_long_vectors_and_few_rows(rows, spark):
    rng = np.random.default_rng(9)
    data = [(i * 100, rng.normal(size=9000).tolist()) for i in range(4)]
    assert found(topk.top_k(rows(data, SCHEMA))) == slow(data)
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert topk.top_k(rows([(100, [1.0])], SCHEMA)).count() == 0


def test_bounds_prune_blocks_and_lose_nothing():
    rng = np.random.default_rng(2)
    vectors = np.floor(1024 * np.repeat(np.eye(8), 64, axis=0) + rng.integers(0, 3, (512, 8)))
    part = topk.Shard(np.arange(512), vectors, 64)
    queries = vectors[::64]
    at, ids, score, scored = part.search(np.arange(0, 512, 64), queries, np.full(8, -2**63), 5)
    full = np.sort(np.where(np.eye(512)[::64] > 0, -1, queries @ vectors.T), axis=1)[:, ::-1][:, :5]
    assert scored == 8  # of 64 pairs of query and block
    assert (score.reshape(8, 5) == full).all()
