import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wordloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def pair():
    return alignment.TokenPair(A, B)


def slow_tokens(libraries, pair, text):
    """Both libraries over the whole text."""
    if not text:
        return [], []
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    raw = (" " + text).encode()
    same = b"".join(pair.bytes_a[i] for i in a) == raw == b"".join(pair.bytes_b[i] for i in b)
    return (a, b) if same else ([], [])


def slow_groups(pair, a, b):
    ends = [np.cumsum([len(names[i]) for i in ids]).tolist() for ids, names in ((a, pair.bytes_a), (b, pair.bytes_b))]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    return [([i for i, e in zip(a, ends[0]) if s < e <= c], [i for i, e in zip(b, ends[1]) if s < e <= c]) for s, c in zip([0, *cuts], cuts)]


def slow(libraries, pair, data):
    links = []
    rows = []
    for i, t in data:
        a, b = slow_tokens(libraries, pair, t)
        groups = slow_groups(pair, a, b) if a else []
        links.append([(x, y) for g in groups for x in g[0] for y in g[1]])
        told = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        rows.append((i, len(a), len(b), len(groups), len(links[-1]), hashlib.sha256(told.encode()).hexdigest() if a else ""))
    count = Counter(p for found in links for p in set(found))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return sorted((str(r[0]), *r[1:5], sum(count[p] == most[p[0]] for p in found), sum(count[p] for p in found), r[5]) for r, found in zip(rows, links))


def found(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


ODD = ["", " ", "  ", "a", " a", "a ", "a  ", "  a  b   c", "a\n b", "a \nb", "a\n \n b", "\n", "\n\n  x", "x\t\ty \t z", "<|endoftext|> <s> </s> <unk>", "日本語 のテスト", "▁ up ▁▁",
       "naïve façade—“quote” … ½", "a b   c", "a  b", "é E", "😀😀 👩‍👩‍👧", "don't we'll I'D", "1234567 8,9.10", "=" * 70, " " * 130, "-" * 33 + "\n" + "#" * 17, "\x00 \x01",
       "x\x1c y", "word,\nNext word.\n\nAnother", "ſ İ ǅ", "a" * 3000]


@pytest.mark.parametrize("text", ODD)
def test_words_encode_like_whole_texts(libraries, pair, text):
    (a, n), (b, m) = pair.encode(pa.array([text, None, "hello world", text], pa.string()))
    x, y = slow_tokens(libraries, pair, text)
    assert (n.tolist(), m.tolist()) == ([len(x), 0, 2 + (len(slow_tokens(libraries, pair, "hello world")[0]) - 2), len(x)],
                                        [len(y), 0, len(slow_tokens(libraries, pair, "hello world")[1]), len(y)])
    assert a[:len(x)].tolist() == x and b[:len(y)].tolist() == y
    assert len(x) == 0 or (a[-len(x):].tolist() == x and b[-len(y):].tolist() == y)


def test_random_texts_encode_like_the_libraries(libraries, pair):
    rng = random.Random(8)
    letters = "abcdeé ,.\n\t 'xyz09  ▁日😀 "
    data = ["".join(rng.choice(letters[:-4] if rng.random() < .7 else letters) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    (a, n), (b, m) = pair.encode(pa.array(data))
    wanted = [slow_tokens(libraries, pair, t) for t in data]
    assert n.tolist() == [len(x) for x, _ in wanted] and m.tolist() == [len(y) for _, y in wanted]
    assert a.tolist() == [i for x, _ in wanted for i in x] and b.tolist() == [i for _, y in wanted for i in y]


@pytest.mark.parametrize("rows_of_chunk, known", [(512, 1 << 19), (3, 5)])
def test_equals_brute_force(texts, libraries, pair, monkeypatch, rows_of_chunk, known):
    rng = random.Random(3)
    words = "the tokenizer alignment straße über naïveté 12345 word's internationalization zzzz ==== …".split()
    data = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(40)] + [(100 + i, t) for i, t in enumerate(ODD)]
    data += [(None, "the word"), (1, None), (1, "the word"), (1, "the word"), (None, None)]
    monkeypatch.setattr(alignment, "ROWS", rows_of_chunk)
    monkeypatch.setattr(alignment, "KNOWN", known)
    assert found(alignment.align(texts(data), A, B)) == slow(libraries, pair, data)


def test_wide_groups_count_every_link():
    rng = np.random.default_rng(1)
    n_a, n_b = np.array([100, 1, 3, 2, 1]), np.array([90, 4, 1, 2, 1])
    a, b = rng.integers(0, 7, n_a.sum()), rng.integers(0, 5, n_b.sum())
    g, x, y, times = alignment.linked(a, np.repeat(np.arange(5), n_a), n_a, b, np.repeat(np.arange(5), n_b), n_b)
    ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
    wanted = Counter((k, i, j) for k in range(5) for i in a[ends_a[k] - n_a[k]:ends_a[k]].tolist() for j in b[ends_b[k] - n_b[k]:ends_b[k]].tolist())
    got = Counter()
    for k, i, j, t in zip(g.tolist(), x.tolist(), y.tolist(), times.tolist()):
        got[k, i, j] += t
    assert got == wanted


def test_long_text_and_empty_table(texts, spark, libraries, pair):
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcdef", k=rng.randrange(1, 9))) for _ in range(60_000))
    data = [(1, long), (2, "abc def"), (3, long[:1000])]
    row = found(alignment.align(texts(data), A, B))[0]
    a, b = slow_tokens(libraries, pair, long)
    assert row[1:3] == (len(a), len(b))
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), A, B).count() == 0
