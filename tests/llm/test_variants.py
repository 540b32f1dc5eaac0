import random
import re
from collections import Counter
from zlib import crc32

import pytest

from wordloom.llm import variants


def slow_counts(data, shortest=5, least=3, every=97):
    counts = Counter()
    for i, t in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def near(a, b):
    """Exactly one insertion, deletion or replacement, tried everywhere."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow(data, **settings):
    n = slow_counts(data, **settings)
    around = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(v, w)] for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n[w], len(around[w]), n.get(form[w], 0)) for w in n)


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    """Words around few stems, with runs of equal letters, marks and all frequencies."""
    rng = random.Random(6)
    stems = ["aabaa", "letter", "éàüÿß", "banana", "aaaaaa", "Straße", "mississippi"]
    pool = []
    for stem in stems:
        words = [stem]
        for _ in range(14):
            w = list(rng.choice(words))
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é", "s", w[at - 1]])
            words.append("".join(w))
        pool += words
    weights = [rng.choice([1, 2, 4, 8, 30]) for _ in pool]
    return [(i, ", ".join(w.upper() if rng.random() < .1 and w.isascii() else w for w in rng.choices(pool, weights, k=60)) + " 9x") for i in range(60)]


@pytest.mark.parametrize("every", [97, 3])
def test_equals_brute_force(texts, corpus, every):
    assert found(variants.spelling_variants(texts(corpus), every=every)) == slow(corpus, every=every)


def test_words_around_the_length_where_rotations_become_hashes(texts, monkeypatch):
    rng = random.Random(1)
    base = "".join(rng.choice("ab") for _ in range(variants.LONG))
    words = {base, base[1:], base[:-1], base + "a", "b" + base, base[:50] + base[51:], base[:50] + "z" + base[51:], base + "zz", base + "z",
             base * 3, base * 3 + "c", "c" + base * 3, base * 3 + "d", (base * 3)[:150] + (base * 3)[151:], "a" * 101, "a" * 100, "a" * 102, "a" * 99}
    data = [(i, " ".join(w for w in sorted(words) for _ in range(1 + len(w) % 4))) for i in range(4)] + [(9, base)]
    assert found(variants.spelling_variants(texts(data))) == slow(data)


def test_nulls_empty_repeats_and_a_very_long_run(texts, spark):
    long = "x" * 200_000
    data = [(None, "hello World"), (None, "hello"), (1, None), (2, ""), (3, "12 !"), (4, "hello hellos"), (4, "hello hellos"), (4, "hello hellos"),
            (5, f"{long} {long} {long}"), (6, f"{long}y {long}y {long}y {long}y {long}y {long}y")]
    rows = {r.word: r for r in variants.spelling_variants(texts(data)).collect()}
    assert set(rows) == {"hello", "hellos", long, long + "y"}
    assert rows[long].form == long + "y" and rows[long].form_n == 6 and rows["hellos"].n_near == 1 and rows["hellos"].form is None
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_chains_of_forms(rows):
    forms = rows([(f"w{i}", f"w{i + 1}") for i in range(20)] + [("x", "w5")], "word string, form string")
    assert {r.word: r.root for r in variants.roots(forms).collect()} == {**{f"w{i}": "w20" for i in range(20)}, "x": "w20"}
