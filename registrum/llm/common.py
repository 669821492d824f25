"""Shared pieces of the training-data operators: words, hashes, schemas, lineage cuts.

A word is a maximal run of bytes other than ASCII white space, which is what ``bytes.split()`` yields on
UTF-8; no multi-byte character contains such a byte. All hashes are 64-bit and computed with numpy over
whole chunks of documents, so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Text bytes handled at once by the vectorised code; bounds a Python worker's memory.
CHUNK = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the SplitMix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, self.base, np.uint64))])
                self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, self.inverse, np.uint64))])

    def prefix(self, x: np.ndarray) -> np.ndarray:
        """Sums S with S[j]-S[i] = sum of x[t]*base**t over i <= t < j."""
        self.grow(len(x) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.up[: len(x)], dtype=np.uint64)])

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Position-free hash of x[start:end] for each pair."""
        return (sums[end] - sums[start]) * self.down[start]


class Hasher:
    """Word and n-gram hashes. One instance per task."""

    def __init__(self, lower: bool = False):
        self.lower = lower
        self.bytes, self.words = Powers(_ODD | 1), Powers(0xD1342543DE82EF95)
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True

    def word_hashes(self, raw: bytes) -> np.ndarray:
        if self.lower:
            raw = raw.lower()
        if len(raw) <= 4 * CHUNK:
            return self._hashes(raw)[1]
        out, at = [], 0  # a very long text: cut at white space, at most one word is ever longer than a piece
        while at < len(raw):
            end = at + CHUNK
            while end < len(raw) and not self.space[raw[end]]:
                end += 1
            out.append(self._hashes(raw[at:end])[1])
            at = end
        return np.concatenate(out)

    def _hashes(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First byte and hash of each word."""
        buf = np.frombuffer(raw, np.uint8)
        edge = np.diff(np.concatenate([[True], self.space[buf], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            return start, np.zeros(0, np.uint64)
        sums = self.bytes.prefix(self.table[buf])
        return start, mix(self.bytes.span(sums, start, end) + (end - start).astype(np.uint64) * np.uint64(_ODD))

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hash of every n consecutive words."""
        if len(words) < n:
            return np.zeros(0, np.uint64)
        sums = self.words.prefix(words)
        start = np.arange(len(words) - n + 1)
        return mix(self.words.span(sums, start, start + n))

    def chunks(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, word hashes) of each text; short texts are hashed together."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            if end == at + 1:
                yield at, self.word_hashes(texts[at])
            else:
                joined = b"\n".join(texts[at:end])
                start, words = self._hashes(joined.lower() if self.lower else joined)
                ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
                yield from zip(range(at, end), np.split(words, np.searchsorted(start, ends[:-1])), strict=True)
            at = end


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def prepare(spark: SparkSession) -> None:
    """Settings for whole texts: small Arrow batches bound what a Python worker holds. A session that has its own stays so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, "512")


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, under these very names, whatever else the table holds."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def range_of(x: Column, bounds: list) -> Column:
    """How many of the sorted bounds are not above x, by binary search."""
    if not bounds:
        return F.lit(0)
    held, steps = F.lit(bounds), [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.lit(steps), F.lit(0), lambda n, step: F.when(F.get(held, n + step - 1) <= x, n + step).otherwise(n))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return narrow(table, *columns) if columns else table


#: The word pattern of the contracts, as a Java/RE2 regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"
