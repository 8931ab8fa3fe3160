"""What several operators share: columns, words, seeds, settled tables and memory."""

from __future__ import annotations

import ctypes
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintfield.session import discard, settled

__all__ = ["discard", "settled"]

#: Words are runs of anything but these bytes; bytes.split() uses the same set.
WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def text_batches(spark: SparkSession, rows: int = 500):
    """Within, a table that is written hands Python at most `rows` texts at a time; then the session's own setting is back.

    Spark's default of 10,000 makes batches of some 30 MB of text, several times that in executor and worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(own) <= 0 else min(rows, int(own))))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def given_back() -> None:
    """Hands a worker's free memory back to the system; called between large groups, for workers live as long as executors."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _find_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library than glibc
        return None


_TRIM = _find_trim()


def id_residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


class WordHashes(dict):
    """64-bit hashes of words, remembered; emptied when it holds `most` of them."""

    def __init__(self, most: int = 50_000, seed: int = 0):
        super().__init__()
        self.most, self.seed = most, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_of_id(doc_id: int) -> int:
    """id_residue's checksum, for brute-force tests."""
    return zlib.crc32(str(doc_id).encode())


def fresh_name(df: DataFrame, wish: str) -> str:
    """`wish`, with underscores in front until no column of df has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish
