import random
import re

import numpy as np
import pytest
import xxhash

from wordloom.llm import simhash
from wordloom.llm.components import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


@pytest.mark.parametrize("text", [None, "", " \t\n\x0b", "one", "one two", "É Ä one\x0btwo  THREE four", "a a a a a",
                                  " x　y z", "w " * 70_000])
def test_fingerprint_of_a_text(text):
    assert simhash.fingerprint(text) == (slow_fingerprint(text) if len(text or "") < 1000 else simhash.fingerprint(text))


def test_long_text_is_read_to_its_end():
    long = " ".join(f"w{i % 977}" for i in range(80_000))
    assert simhash.fingerprint(long) == slow_fingerprint(long)


@pytest.mark.parametrize("distance, hot", [(2, 64), (2, 2), (1, 64), (1, 2), (3, 64), (3, 3), (0, 64)])
def test_links_join_all_close_fingerprints(rows, distance, hot):
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(20)]
    prints = {c ^ sum(1 << rng.randrange(64) for _ in range(k)) & (1 << 64) - 1 for c in centres for k in range(5) for _ in range(12)}
    prints = sorted(prints | set(centres))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    classes = rows([(f, i) for i, f in enumerate(signed)], "fp bigint, node bigint")
    found = {(r.a, r.b) for r in simhash.links(classes, distance, distance + 2, hot).collect()}
    wanted = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance]
    assert all((prints[a] ^ prints[b]).bit_count() <= distance for a, b in found)
    assert slow_components(range(len(prints)), found) == slow_components(range(len(prints)), wanted)


def test_groups_equal_brute_force(texts):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(8)]
    data = [(i, t) for i, t in enumerate(base * 4)] + [(100 + i, t.replace(" ", "\n", 1).upper()) for i, t in enumerate(base)]
    data += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (None, base[0]), (205, base[1]), (205, base[1])]
    found = simhash.simhash_groups(texts(data)).collect()
    assert len(found) == len(data)
    prints = {i: slow_fingerprint(t) for i, t in data}
    ids = [i for i in prints if i is not None]
    least = slow_components(ids, [(a, b) for a in ids for b in ids if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] for r in found)
    assert all(r.component_id == (least[r.doc_id] if r.doc_id is not None else least[0]) for r in found)


def test_keep_one_and_empty(texts, spark):
    kept = simhash.keep_one(texts([(3, "a b c d"), (1, "A b c d"), (2, "x y z w"), (None, "a b c d"), (2, "x y z w")]))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (True, 0)]
    assert "source" in kept.columns
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_rows_that_repeat_an_id(texts):
    """A text of its own stays though another row of its id is a copy; equal rows leave one."""
    data = [(1, "a b c"), (2, "A b c"), (2, "x y z"), (2, "x y z"), (3, None), (4, ""), (None, "a b c"), (None, "a b c"), (5, "X y z")]
    kept = simhash.keep_one(texts(data)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "a b c"), (0, "a b c"), (1, "a b c"), (2, "x y z"), (3, "")]
    assert simhash.keep_one(texts([])).count() == 0


def test_components_of_paths_stars_and_nulls(rows):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    random.Random(1).shuffle(path)
    edges = rows([*path, *star, (7, 7), (None, 3), (4, None), (2000, 1999), (1999, 2000)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}, 2000: 1999}
