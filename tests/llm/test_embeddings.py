import numpy as np
import pytest

from wordloom.llm import embeddings
from wordloom.llm.hnsw import Graph

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def slow(data, threshold=0.98):
    """(n_links, component) per row."""
    ok = []
    for _, e, label in data:
        v = None if label is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e) else np.array(e, np.float32).astype(float)
        ok.append(None if v is None else v / np.linalg.norm(v))
    linked = [[j for j in range(len(data)) if j != i and ok[i] is not None and ok[j] is not None and data[i][2] == data[j][2]
               and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= threshold] for i in range(len(data))]
    least = [r[0] for r in data]
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(linked):
            for j in near:
                if least[j] is not None and (least[i] is None or least[j] < least[i]):
                    least[i], changed = least[j], True
    return [(len(near), c) for near, c in zip(linked, least)]


def vectors(seed=0, n=300, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, width))
    data = [(i, (centres[i % 30] + rng.normal(size=width) * rng.choice([0.02, 0.1, 0.6])).astype(np.float32).tolist(), int(i % 3))
            for i in range(n)]
    data += [(n + i, data[i][1], data[i][2]) for i in range(0, 60, 2)]
    data += [(n + 100 + i, [4 * x for x in data[i][1]], data[i][2]) for i in range(0, 30, 3)]
    data += [(900, None, 1), (901, [], 1), (902, [0.0] * width, 1), (903, [float("nan")] * width, 1), (904, [float("inf")] + [1.0] * (width - 1), 1),
             (905, [None] + [1.0] * (width - 1), 1), (906, data[0][1], None), (907, [1.0] * 3, 1), (908, [1.0] * 3, 1), (909, [-0.0, 1.0], 2),
             (910, [0.0, 1.0], 2), (5, data[5][1], data[5][2])]
    return data


@pytest.mark.parametrize("shard", [8192, 40])
def test_as_brute_force(rows, shard):
    data = vectors()
    df = rows(data, SCHEMA).selectExpr("*", "1 AS node", "'x' AS key", "2 AS found")
    found = embeddings.near_duplicates(df, shard=shard).collect()
    wanted = sorted((d[0], *w, d[0] == w[1]) for d, w in zip(data, slow(data)))
    assert sorted(map(tuple, found)) == wanted


def test_large_group_of_near_copies_widens_the_beam(rows):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=24)
    data = [(i, (centre + rng.normal(size=24) * 0.01).astype(np.float32).tolist(), 0) for i in range(400)]
    found = embeddings.near_duplicates(rows(data, SCHEMA), beam=16).collect()
    assert {tuple(r)[1:3] for r in found} == {(399, 0)}


def test_recall_of_the_graph():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(3000, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    ids, sims = Graph(points).search(points[:200], 64)
    best = np.argsort(-(points[:200] @ points.T), axis=1)[:, :10]
    hit = np.mean([len(set(a[:10].tolist()) & set(b.tolist())) / 10 for a, b in zip(ids, best)])
    assert hit >= 0.9 and (np.diff(sims, axis=1) <= 0).all()


@pytest.mark.parametrize("n", [1, 2, 5, 70])
def test_small_graphs_find_all(n):
    points = np.random.default_rng(n).normal(size=(n, 4))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    ids, _ = Graph(points).search(points, n)
    assert all(sorted(row.tolist()) == list(range(n)) for row in ids)


def test_null_id_and_empty(rows):
    v = [1.0, 2.0]
    found = embeddings.near_duplicates(rows([(None, v, 1), (4, v, 1), (3, [2.0, 4.1], 1), (None, None, 1)], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in found) == [
        (0, 0, 0, False), (0, 2, 3, False), (3, 2, 3, True), (4, 2, 3, False)]
    assert embeddings.near_duplicates(rows([], SCHEMA, 1)).count() == 0


def test_least_reachable():
    a, b = np.array([5, 4, 3, 9]), np.array([4, 3, 2, 8])
    assert embeddings.least_reachable(10, a, b).tolist() == [0, 1, 2, 2, 2, 2, 6, 7, 8, 8]


def test_search_ends_on_a_threshold_that_a_pair_meets():
    """The least cosine of an audited pair, to the last bit; and a group far larger than any beam."""
    import numpy as np
    from wordloom.llm.embeddings import _units, block_links
    from wordloom.llm.hnsw import Graph

    rng = np.random.default_rng(4)
    members = _units(np.concatenate([rng.normal(size=(300, 6)), np.ones((1200, 6)) + 1e-3 * rng.normal(size=(1200, 6))]))
    queries = members[::40]
    for threshold in [*(queries[:4] @ members[:40].T).ravel()[3:60:7], 0.98, 0.9999999]:
        a, b = block_links(Graph(members), members, queries, threshold)
        exact = np.stack([np.einsum("pd,pd->p", np.broadcast_to(q, members.shape), members) for q in queries])
        audited = np.unique(np.linspace(0, len(queries) - 1, 32).astype(int))
        found = set(zip(a.tolist(), b.tolist()))
        assert found <= set(map(tuple, np.argwhere(exact >= threshold - 1e-15).tolist()))
        assert {(int(q), int(m)) for q in audited for m in np.flatnonzero(exact[q] >= threshold + 1e-15)} <= found
