"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.session import materialise

__all__ = ["keyed", "materialise", "table", "with_size_check"]

#: White space between words: U+0020 and U+0009 to U+000D, nothing else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Texts are handled in groups of about this many characters, so that array work stays in bounded memory.
GROUP_CHARS = 1 << 20

#: Words whose hash or ids a task keeps. The memory is emptied when it is full.
CACHE_WORDS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, text: str = "text", **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names: extra columns can't clash with what it makes."""
    return docs.select(*(docs[old].alias(new) for new, old in columns.items()), docs[text].cast("string").alias("text"))


def fingerprint(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text; NULL and empty texts differ."""
    return F.xxhash64(text).alias("fp_a"), F.xxhash64(F.lit("second"), text, F.lit(7)).alias("fp_b")


def with_size_check(df: DataFrame, name: str, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` written to the shared folder and hinted for broadcast if it has at most ``max_rows`` rows of a few
    dozen bytes. Above that the planner joins it by shuffle."""
    stored = materialise(df, name)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def text_groups(texts: pa.Array, limit: int = GROUP_CHARS) -> Iterator[slice]:
    """Slices of an Arrow array of texts with about ``limit`` characters each."""
    return groups(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), limit)


def groups(sizes: Sequence[int], limit: int = GROUP_CHARS) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to about ``limit``; an item above it stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() separates at exactly the six characters of SPACE_CLASS."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
