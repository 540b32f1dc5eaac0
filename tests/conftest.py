import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"

WORDS = {
    "sport": ["match", "goal", "team", "player", "league", "score", "coach"],
    "money": ["bank", "loan", "market", "stock", "credit", "fund", "price"],
    "space": ["rocket", "orbit", "planet", "launch", "star", "moon", "probe"],
    "food": ["recipe", "dinner", "kitchen", "sugar", "bread", "cheese", "soup"],
}


@pytest.fixture(scope="session")
def spark():
    import oracle

    session = oracle.session()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def corpus(spark):
    """100 rows, four balanced classes, twelve words each."""
    rng = random.Random(7)
    rows = [(i * 4 + c, " ".join(rng.choice(words) for _ in range(12)), label)
            for c, (label, words) in enumerate(WORDS.items()) for i in range(25)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label string").cache()


@pytest.fixture(scope="session")
def imbalanced(corpus):
    return corpus.filter("label <> 'food' OR doc_id < 20")


@pytest.fixture(scope="session")
def multilabel(spark):
    """80 rows with one or two of four labels as 0/1 columns."""
    rng = random.Random(11)
    names = list(WORDS)
    rows = []
    for i in range(80):
        chosen = rng.sample(names, rng.choice([1, 2]))
        text = " ".join(rng.choice(WORDS[c]) for c in chosen for _ in range(4))
        rows.append((i, text, *[int(n in chosen) for n in names]))
    schema = "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names)
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, label string")
