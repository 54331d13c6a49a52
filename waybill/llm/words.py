"""Words and word hashes, shared by the operators on texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Everything that separates words: the space and the control characters 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"


#: Bytes of an Arrow batch of texts; both sides of the pipe hold a few batches per task.
BATCH_BYTES = 4 << 20


def bounded_batches(rows: DataFrame) -> DataFrame:
    """`rows`, in a session whose Arrow batches are at most `BATCH_BYTES` large.

    The default, 10,000 rows or 64 MB, suits short rows; for texts it costs each Python worker and
    the JVM's direct buffers several times that much.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    given = conf.get(name).lower().removesuffix("b")
    if not given.isdigit() or int(given) > BATCH_BYTES or int(given) <= 0:
        conf.set(name, str(BATCH_BYTES))
    return rows


def word_array(text: Column) -> Column:
    """The maximal runs without a space or a control character 9-13; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a number of words.

    The limit bounds memory only: a forgotten word is hashed again.
    """

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k words."""
    count = len(hashes) - k + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, k, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return out


def shingle_set(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct k-word shingles of a text, A-Z lower-cased.

    Fewer than k words make one shingle of the whole sequence; no words make none.
    """
    words = text.lower().split()  # on bytes: only A-Z change, only 9-13 and 32 separate
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes.of(words), min(k, len(words))))


def plain(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)
