import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordloom.llm import bpe
from wordloom.llm.catalog import WORD_BPE

ALPHABET = "aAbéÉzZ'sStTreE 12\n\t\x0b 　日本!?#́ΣσẞİI\x85\x1c\x00😀ſ²Ⅷ_-"


def texts_of_all_kinds():
    rng = random.Random(1)
    tails = ["", "<|endoftext|>", "x<|startoftext|>Y", "<|endoftext|> ", "<|endoftext"]
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) + rng.choice(tails) for _ in range(1500)]
    return [*made, None, "", " ", " \n\x0b", "　", "a" * 5000, "é" * 3000 + "!" * 3000, "hello world " * 20_000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_as_the_library(name):
    coder, library = bpe.FragmentCoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    reader = bpe.TokenReader(public_tokenizers.path(name))
    given = texts_of_all_kinds()
    for at in range(0, len(given), 64):
        for text, ids in zip(given[at:at + 64], coder.encode_all(given[at:at + 64])):
            wanted = library.encode(text or "", add_special_tokens=False).ids
            found = np.frombuffer(ids, "<i4")
            assert found.tolist() == wanted
            assert reader.decode(found) == library.decode(wanted, skip_special_tokens=False)


def test_cuts_are_forced_by_the_vocabulary():
    coder = bpe.FragmentCoder(WORD_BPE)
    assert coder.fragments("hello") == ["hello"]
    assert "zq" not in coder.pairs or coder.fragments("zq") == ["zq"]
    odd = "".join(a + b for a in "qxzj" for b in "qxzj")
    assert "".join(coder.fragments(odd)) == odd and len(coder.fragments(odd)) > 1


def test_full_memo_changes_nothing(monkeypatch):
    given = texts_of_all_kinds()[:300]
    whole = bpe.FragmentCoder(WORD_BPE).encode_all(given)
    monkeypatch.setattr(bpe, "KNOWN_FRAGMENTS", 5)
    small = bpe.FragmentCoder(WORD_BPE)
    assert [x for at in range(0, 300, 10) for x in small.encode_all(given[at:at + 10])] == whole


def test_frame(texts, spark):
    library = Tokenizer.from_file(WORD_BPE)
    data = [(1, "Hello there"), (1, "Hello there"), (2, None), (None, "x"), (3, "")]
    encoded = bpe.encode(texts(data), WORD_BPE)
    found = sorted((r.doc_id or 0, r.ids, r.decoded) for r in bpe.decode(encoded, WORD_BPE).collect())
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in data}
    assert found == sorted((i or 0, ids[t], library.decode(ids[t], skip_special_tokens=False)) for i, t in data)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.decode(bpe.encode(none, WORD_BPE), WORD_BPE).count() == 0
    nulls = encoded.withColumn("ids", F.lit(None).cast("array<int>"))
    assert {r.decoded for r in bpe.decode(nulls, WORD_BPE).collect()} == {""}


def test_unknown_ids_are_left_out():
    library, reader = Tokenizer.from_file(WORD_BPE), bpe.TokenReader(WORD_BPE)
    for ids in ([], [3306, 999_999, 1002], [-1, 5], [49407, 49408]):
        known = [i for i in ids if 0 <= i < 49408]
        assert reader.decode(np.array(ids, np.int32)) == library.decode(known, skip_special_tokens=False)
