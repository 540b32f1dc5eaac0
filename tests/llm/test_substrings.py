import random

import numpy as np
import pytest

from wordloom.llm import substrings


def slow(data, window):
    """Judged on the input: (n_words, n_removed, kept) per row."""
    words = [(i, (t or "").encode().split()) for i, t in data]
    least = {}
    for i, w in words:
        if i is not None:
            for s in range(len(w) - window + 1):
                key = tuple(w[s:s + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s:s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def corpus():
    rng = random.Random(4)
    def prose(n): return [rng.choice("abcdefghij") + rng.choice("klm") for _ in range(n)]
    shared, longer = prose(50), prose(120)
    data = [(i, prose(rng.randint(0, 150))) for i in range(40)]
    for i, w in data[::3]:
        w[rng.randint(0, len(w)):0] = shared
    for i, w in data[::4]:
        at = rng.randint(0, 40)
        w += longer[at:at + rng.randint(45, 80)]
    data = [(i, rng.choice([" ", "\n", "\x0b ", "  "]).join(w)) for i, w in data]
    same = " ".join(prose(60))
    data += [(100, same), (101, same), (102, same), (50, "x " * 200), (51, "x " * 49), (52, "x " * 120), (None, same),
             (60, None), (61, ""), (62, " \t"), (70, same + " a"), (70, same + " a"), (71, "Éa " * 50), (72, "éa " * 50),
             (80, " ".join(prose(30)) + " " + same), (80, same)]
    return data


@pytest.mark.parametrize("group", [1000, 1, 5])
def test_as_brute_force(texts, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)  # small groups take the path of hot prefixes
    data = corpus()
    found = [tuple(r) for r in substrings.remove_repeats(texts(data)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(found, key=key) == sorted(slow(data, 50), key=key)


def test_other_window_and_very_long_text(texts):
    rng = random.Random(9)
    long = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    data = [(1, long), (2, long[3000:9000]), (3, "q " * 30), (4, "q " * 31)]
    found = sorted(tuple(r) for r in substrings.remove_repeats(texts(data), window=20).collect())
    assert found == sorted(slow(data, 20))


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def sequences():
    rng = random.Random(2)
    return [np.array([rng.choice([7, 9]) for _ in range(rng.randint(0, 30))], np.uint64) for _ in range(50)]


def test_nodes_are_repeats():
    rows = sequences()
    tree = substrings.SuffixTree(rows)
    node, suffix, depths = tree.deep_nodes(9)
    spots = {}
    for r, words in enumerate(rows):
        for s in range(len(words) - 8):
            spots.setdefault(tuple(words[s:s + 9]), set()).add((r, s))
    repeats = {w: at for w, at in spots.items() if len(at) > 1}
    found = {}
    for n, s in zip(node.tolist(), suffix.tolist()):
        found.setdefault(n, set()).add((int(tree.row[s]), int(tree.place[s])))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, repeats.values()))
    for n, at in found.items():  # the depth is as far as all of them agree
        tails = [tuple(rows[r][s:]) for r, s in at]
        depth = 0
        while all(len(x) > depth and x[depth] == tails[0][depth] for x in tails):
            depth += 1
        assert depths[n] == depth


def test_late_ranges():
    rows = sequences()
    ids = np.arange(len(rows)) // 2
    found = {(r, s + k) for r, s, n in zip(*(x.tolist() for x in substrings.late_ranges(rows, ids, 9))) for k in range(n)}
    least = {}
    spots = [(r, s, tuple(w[s:s + 9])) for r, w in enumerate(rows) for s in range(len(w) - 8)]
    for r, s, w in spots:
        least[w] = min(least.get(w, 99), ids[r])
    assert found == {(r, s) for r, s, w in spots if ids[r] > least[w]}
    assert [len(x) for x in substrings.late_ranges([], np.zeros(0, np.int64), 9)] == [0, 0, 0]


def test_span_keys_depend_on_words_alone():
    rng = random.Random(5)
    hashes = np.array([rng.getrandbits(64) for _ in range(20)] * 2 + [3], np.uint64)
    first, length = np.array([2, 22, 3, 2]), np.array([10, 10, 10, 11])
    a, b, c, d = substrings.span_keys(hashes, first, length).tolist()
    assert a == b and len({a, c, d}) == 3
