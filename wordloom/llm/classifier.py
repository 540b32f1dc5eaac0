"""Quality classifier: weak labels by expectation-maximisation train a hashed linear scorer."""

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from wordloom.llm.rules import fit, posterior, votes
from wordloom.llm.words import KNOWN_WORDS, slices, split_words
from wordloom.plans.storage import written

# Overlapping labellers over the measures below; see rules.RULES for how they vote.
LABELLERS = {
    "symbols": ("10 * n_symbols > n_words", "false"),
    "markup": ("4 * n_symbols > n_words", "false"),
    "shouting": ("10 * n_shouted > n_words", "false"),
    "few_pairs": ("n_words >= 20 AND 10 * n_old_pairs > 4 * n_words", "false"),
    "echoes": ("20 * n_echoes > n_words AND n_echoes > 2", "false"),
    "lines": ("10 * n_dup_lines > 4 * n_lines", "false"),
    "word_length": ("n_words >= 20 AND (word_chars < 3 * n_words OR word_chars > 7 * n_words)",
                    "word_chars BETWEEN 4 * n_words AND 6 * n_words"),
    "stops": ("n_words >= 20 AND (20 * n_stops > 7 * n_words OR 200 * n_stops < n_words)",
              "50 * n_stops >= n_words AND 4 * n_stops <= n_words"),
}
_SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_shouted", "n_old_pairs", "n_echoes", "n_lines", "n_dup_lines", "n_stops"]
FIT_DOCS = 8_000  # labelled documents the scorer is fitted on; the labels come from all documents
DIMENSIONS = 1 << 15
_EXTRA = 4  # dimensions before the hashed ones: constant, old pairs, echoes, repeated lines
_STOPS, _SHOUTED = re.compile(rb"[.!?]+"), re.compile(rb"[A-Z]{3}")
_SIGNS = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b
               for b in range(256))
_RUNS = re.compile(rb"([aA0])\1+")


def _repeats(text: str | None, words: list[bytes]) -> tuple[int, int, int, int]:
    """(n_old_pairs, n_echoes, n_lines, n_dup_lines): pairs of words seen before, words that repeat the one before, lines."""
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    return (max(0, len(words) - 1) - len(set(zip(words, words[1:]))), sum(map(bytes.__eq__, words, words[1:])),
            len(lines), len(lines) - len(set(lines)))


def _counts(text: str | None) -> list[int]:
    """The measures, in order."""
    words, raw, text = split_words(text), (text or "").encode(), text or ""
    pairs, echoes, lines, dup_lines = _repeats(text, words)
    return [len(words), len(text) - sum(map(text.count, " \t\n\x0b\f\r")), sum(map(raw.count, _SYMBOLS)), len(_SHOUTED.findall(raw)),
            pairs, echoes, lines, dup_lines, len(_STOPS.findall(raw))]


def shape(word: bytes) -> bytes:
    """Runs of capitals, of other letters and of digits become A, a and 0; the rest stays."""
    return _RUNS.sub(rb"\1", word.translate(_SIGNS))


def _columns(word: bytes) -> tuple[int, int]:
    """The two hashed dimensions of a word: its lower-case form and its shape."""
    digest, size = xxhash.xxh32_intdigest, DIMENSIONS - _EXTRA
    return _EXTRA + digest(word.lower(), 1) % size, _EXTRA + digest(shape(word), 2) % size


def _extra(text: str | None, words: list[bytes]) -> list[float]:
    """A constant, and the shares of repeated pairs, echoes and lines."""
    pairs, echoes, lines, dup_lines = _repeats(text, words)
    n = max(1, len(words))
    return [1.0, 4 * pairs / n, 4 * echoes / n, 4 * dup_lines / max(1, lines)]


def _features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value): the shares above, and those of the words."""
    words = split_words(text)
    at, times = np.unique(np.array(list(map(_columns, words)), np.int64), return_counts=True)
    return np.concatenate([np.arange(_EXTRA), at]), np.concatenate([_extra(text, words), 4 * times / max(1, len(words))])


def measure(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, _row and MEASURES of each whole text."""
    schema = T.StructType([T.StructField(id, docs.schema[id].dataType), T.StructField("_row", T.LongType())])
    for name in MEASURES:
        schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([_counts(t) for t in batch.column(2).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, rows.T)], schema.names)

    return docs.select(id, F.xxhash64(text).alias("_row"), text).mapInArrow(run, schema)


def train(features: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 150, rate: float = 0.2,
          decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft targets, by adaptive gradient steps over all rows."""
    at = np.concatenate([a for a, _ in features])
    value = np.concatenate([v for _, v in features])
    row = np.repeat(np.arange(len(features)), [len(a) for a, _ in features])
    weight, mean, square = (np.zeros(DIMENSIONS) for _ in range(3))
    for t in range(1, rounds + 1):
        score = np.bincount(row, weight[at] * value, len(features))
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        slope = np.bincount(at, error[row] * value, DIMENSIONS) / len(features) + decay * weight
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope ** 2
        weight -= rate * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.999 ** t)) + 1e-8)
    return weight


def _fitted(sample: DataFrame, id: str, text: str) -> np.ndarray | None:
    """The weights, from a bounded number of labelled texts, fitted in one task; None without any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in slices(batches):
            for key, t, q in zip(*(c.to_pylist() for c in batch.columns)):
                at, value = _features(t)
                rows.append((key, xxhash.xxh64_intdigest(t or ""), at, value.astype(np.float32), q))
        if rows:
            rows.sort(key=lambda r: r[:2])
            weights = train([(at, value) for _, _, at, value, _ in rows], np.array([q for *_, q in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64()))], ["weights"])

    found = sample.select(F.coalesce(F.col(id).cast("string"), F.lit("")), text, "p_label").repartition(1).mapInArrow(
        run, "weights array<double>").collect()
    return np.array(found[0][0]) if found else None


class _Weights(dict):
    """The sum of a word's two weights, remembered while a task runs."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights.tolist()

    def __missing__(self, word: bytes) -> float:
        a, b = _columns(word)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self.weights[a] + self.weights[b]
        if len(word) <= 64:
            self[word] = value
        return value


def score(docs: DataFrame, weights: np.ndarray | None, text: str, name: str = "p_good") -> DataFrame:
    """All columns and the scorer's probability that the document is good; 0 for texts without words."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weights(weights if weights is not None else np.zeros(DIMENSIONS))
        for batch in slices(batches):
            out = []
            for t in batch.column(text).to_pylist():
                words = split_words(t)
                total = sum(x * w for x, w in zip(_extra(t, words), known.weights))
                total += 4 * sum(map(known.__getitem__, words)) / max(1, len(words))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))) if words else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], schema.names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, id: str = "doc_id", text: str = "text", fit_docs: int = FIT_DOCS) -> DataFrame:
    """The documents, all columns, with `p_good` and `kept` (p_good of 1/2 or more).

    Every document is measured and voted on by LABELLERS; expectation-maximisation over all of them
    gives each combination of votes a probability of good (`p_label`). About `fit_docs` documents,
    chosen by a hash of id and text, train a linear scorer on hashed words and word shapes with these
    labels. The scorer then judges every document, by its whole text.

    A null or empty text, or one without words, has p_good 0 and is not kept. Repeated rows get equal
    scores; null ids are allowed. Columns called p_good or kept are replaced, other columns are kept
    as they are. An empty table gives an empty result.
    """
    measured, _ = written(votes(measure(docs, id, text), LABELLERS), "measures")
    names = list(LABELLERS)
    model = fit(measured, names)
    spread = 1 << 30
    chance = int(min(spread, spread * fit_docs / max(1, measured.count())))
    chosen = F.pmod(F.xxhash64(id, text), F.lit(spread)) < chance
    picked = docs.select(id, text).filter(chosen).withColumn("_row", F.xxhash64(text)).join(
        measured.filter("n_words > 0").select(F.col(id).alias("_id"), F.col("_row").alias("_key"), posterior(model, names).alias("p_label")).distinct(),
        F.col(id).eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key")))
    weights = _fitted(picked, id, text)
    clean = docs.drop("p_good", "kept")
    return score(clean, weights, text).withColumn("kept", F.col("p_good") >= 0.5)
