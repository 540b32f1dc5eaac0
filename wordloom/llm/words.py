"""Words of whole texts: maximal runs of bytes other than space and 0x09-0x0D."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
KNOWN_WORDS = 1 << 18  # entries of a task's memo; it starts afresh when full, results do not depend on it


def split_words(text: str | None) -> list[bytes]:
    """Python splits bytes at exactly the six ASCII spaces."""
    return text.encode().split() if text else []


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that what a task holds follows its longest texts, not its table."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class WordHashes(dict):
    """64-bit hashes of words, remembered while a task runs."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
