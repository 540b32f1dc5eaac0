from collections import Counter

import numpy as np
import pytest

from wordloom.llm import mixing


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"b": 1000, "a": 10, "ä": 300, None: 50}, {"a": 5}, {"a": 100, "b": 1, "c": 1, "d": 1, "e": 2000},
                                   {"x": 0, "y": 7}])
def test_targets(rows, sizes):
    got = {r.source: r for r in mixing.source_targets(rows(list(sizes.items()), "source string, source_size bigint")).collect()}
    wanted = slow_targets(sizes)
    assert {s: r.source_size for s, r in got.items()} == sizes
    assert all(abs(got[s].target - wanted[s]) < 1e-9 * max(1, sum(sizes.values())) for s in sizes)


@pytest.mark.parametrize("size", [1, 2, 3, 64, 1000, 65537])
def test_permutations(size):
    for key in range(3):
        out = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
        assert sorted(out.tolist()) == list(range(size))
    if size > 100:
        assert (out[:-1] + 1 != out[1:]).mean() > 0.9


def corpus():
    rng = np.random.default_rng(3)
    data = [(i, "w " * int(rng.integers(0, 900)), f"s{int(rng.integers(0, 5)) ** 2}") for i in range(200)]
    return data + [(300, None, "s1"), (301, "", None), (302, "a b\x0bc", None), (303, "x " * 40, None), (303, "x " * 40, None),
                   (303, "other text", None), (None, "no id " * 30, "s1")]


def test_mix(rows):
    docs = rows(corpus(), "doc_id bigint, text string, source string").selectExpr("*", "9 AS size", "'k' AS _key", "1 AS block")
    result = mixing.words_taken(*mixing.mix(docs, block=16)).collect()
    assert len(result) == len(corpus())
    sizes, taken = Counter(), Counter()
    for _, text, source in corpus():
        sizes[source] += len((text or "").split())
    wanted = slow_targets(sizes)
    by_id = {i: s for i, _, s in corpus()}
    for r in result:
        source = by_id[r.doc_id]
        assert r.source_size == sizes[source] and abs(r.target - wanted[source]) < 1e-6
        assert r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 16 for s in sizes)
    again = mixing.words_taken(*mixing.mix(docs.repartition(3), block=16)).collect()
    assert sorted(map(str, again)) == sorted(map(str, result))


def test_spans_are_whole_blocks_and_texts_follow(rows):
    docs = rows(corpus(), "doc_id bigint, text string, source string")
    table, spans = mixing.mix(docs, block=16, shards=4)
    by_slot = Counter()
    for s in spans.collect():
        assert 0 <= s.shard < 4 and s.words > 0
        by_slot[(s.shard, s.slot, s.epoch)] += s.words
    taken = {}
    for r in mixing.words_taken(table, spans).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    mixed = mixing.mixed_texts(docs, spans).collect()
    assert all(r.mixed for r in mixed)
    alone = {i for i, n in Counter(i for i, *_ in corpus()).items() if n == 1 and i is not None}
    assert {r.doc_id: len(r.mixed.split()) for r in mixed if r.doc_id in alone} == {i: n for i, n in taken.items() if i in alone and n}


def test_empty(rows):
    none = rows([], "doc_id bigint, text string, source string", 1)
    assert mixing.words_taken(*mixing.mix(none)).count() == 0
    only = rows([(1, None, "a"), (2, "", None)], "doc_id bigint, text string, source string", 1)
    assert [(r.size, r.taken, r.target) for r in mixing.words_taken(*mixing.mix(only)).collect()] == [(0, 0, 0.0)] * 2


def test_small_sources_come_near_their_targets(rows):
    """Sources of less than a block: the last slot takes a part of one."""
    docs = rows([(i, " ".join(["word"] * (40 + i)), f"s{i:02d}") for i in range(12)], "doc_id bigint, text string, source string")
    found = mixing.words_taken(*mixing.mix(docs)).collect()
    assert len(found) == 12 and all(abs(r.taken - r.target) <= 1 and r.taken <= 3 * r.size for r in found)
