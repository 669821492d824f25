"""Target-distribution importance resampling: documents whose features look like a target text set are drawn.

1. Features are all runs of 1 to ``ngrams`` consecutive words, in ``buckets`` buckets by crc32. Each task counts its buckets
   in one array; the arrays are added up by a shuffle on the bucket. The log ratios of the two histograms, smoothed by
   one for each bucket, are the gains: an array of ``buckets`` numbers whatever the corpus holds, which is broadcast.
2. A document's weight is the sum of its features' gains, read from the array; a Gumbel draw from a hash of its id is added.
   The highest of these scores are a sample without replacement by weight, the same in each run.
3. The key of a row is its score, descending, then doc_id. Radix selection finds the k-th key: for one digit of 16 bits after
   the other, the rows that share the digits so far are counted by the next (at most 65,536 counts reach the driver), and the
   digit in which the k-th falls is put to them. It stops as soon as the digits found hold exactly k rows. Digits that
   all keys share cost nothing.
4. Only the rows up to that key are sorted, by range, and numbered from their partitions' counts.

Null and empty texts have no feature: weight 0. Documents of fewer than ``least`` words are scored but never drawn. A null doc_id
is drawn from the hash of the bare seed and comes last among equal scores. Rows that share a doc_id are rows of their own;
of rows equal in score and id any may take the last place, and they differ in nothing but text. Empty tables give no rows, an empty
target gains that are smoothed by ones alone. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, narrow, prepare, texts_of

#: Words whose buckets a task remembers.
REMEMBERED = 1 << 17
_DIGIT, _KEY = 16, 64
#: ASCII letters to lower case, ASCII that is neither letter nor digit to a space; all bytes of other characters stay.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


class Buckets(dict):
    """The bucket of a feature; the last ones are remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = out = zlib.crc32(feature) % self.buckets
        return out

    def of(self, text: bytes, ngrams: int) -> tuple[np.ndarray, int]:
        """Buckets of all features of a text, and how many words it has."""
        words = text.translate(_FOLD).split()
        parts = [np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        for n in range(2, ngrams + 1):
            runs = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
            parts.append(np.fromiter(map(self.__getitem__, runs), np.int64, len(runs)))
        return np.concatenate(parts), len(words)


def histogram(texts: DataFrame, ngrams: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in texts_of(batch.column("text")):
                total += np.bincount(known.of(text, ngrams)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in narrow(texts, "text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # buckets rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of target to raw in each bucket, in thousandths."""
    buckets, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    ratios = ((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)) for s, t in zip(raw.astype(float).tolist(), target.astype(float).tolist(), strict=True))
    return np.array([floor(1000 * log(x)) for x in ratios], np.int64)


def weights(docs: DataFrame, table: np.ndarray, ngrams: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""
    held = docs.sparkSession.sparkContext.broadcast(table)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        known = Buckets(len(gain))
        for batch in batches:
            found = [(n, len(at), int(gain[at].sum())) for at, n in (known.of(text, ngrams) for text in texts_of(batch.column("text")))]
            numbers = [pa.array([x[j] for x in found], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers], ["doc_id", "n_words", "n_features", "weight"])

    return narrow(docs, "doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """A Gumbel draw in thousandths from the hash of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _leading(key: Column, digits: int) -> Column:
    return F.shiftrightunsigned(key, _KEY - _DIGIT * digits)


def kth_prefix(rows: DataFrame, keys: list[str], k: int) -> list[list[int]]:
    """The k-th row's leading digits of each key, as far as they are needed to tell the first k rows from the others. Keys are
    longs read as unsigned; rows go by the first key, then the second, and so on; 1 <= k <= number of rows."""
    per_key = _KEY // _DIGIT
    signed = {c: F.col(c).bitwiseXOR(F.lit(-(1 << 63))) for c in keys}  # signed order of these is the keys' unsigned order
    ends = rows.agg(*[f(x).alias(f"{name}_{c}") for c, x in signed.items() for name, f in (("low", F.min), ("high", F.max))]).first()
    out: list[list[int]] = []
    for c in keys:
        low, high = (ends[f"{name}_{c}"] + (1 << 63) for name in ("low", "high"))
        out.append([])
        for place in range(per_key):
            shift = _KEY - _DIGIT * (place + 1)
            if low >> shift == high >> shift:
                out[-1].append((low >> shift) & ((1 << _DIGIT) - 1))
                continue
            digit = _leading(F.col(c), place + 1).bitwiseAND(F.lit((1 << _DIGIT) - 1))
            counts = rows.where(_compared(keys, out)[1]).groupBy(digit.alias("digit")).count().collect()  # 65,536 rows at most
            for digit_, count in sorted((r["digit"], r["count"]) for r in counts):
                if k <= count:
                    break
                k -= count
            out[-1].append(digit_)
            if k == count:
                return out
    return out


def _compared(keys: list[str], prefix: list[list[int]]) -> tuple[Column, Column]:
    """Whether a row's leading digits come before the prefix, and whether they are the prefix."""
    before, same = F.lit(False), F.lit(True)
    for c, digits in zip(keys, prefix, strict=False):
        if digits:
            value = int.from_bytes(b"".join(d.to_bytes(_DIGIT // 8, "big") for d in digits), "big")
            own, whole = _leading(F.col(c), len(digits)), len(digits) * _DIGIT == _KEY
            if whole:  # signed order of these is the unsigned order
                own, value = F.col(c).bitwiseXOR(F.lit(-(1 << 63))), value - (1 << 63)
            before, same = before | (same & (own < value)), same & (own == value)
    return before, same


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank 1, 2, 3 ... in that order: sorted by range, each partition numbered from the counts of those before."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before, total = [], 0
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row for each partition
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    return placed.withColumn("rank", F.get(F.lit(before or [0]), F.col("part")) + F.col("at") + 1).drop("part", "at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, ngrams: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of docs: of the rows with at least ``least`` words, percent in a
    hundred, rounded down, are drawn and ranked by score; rank is null for the others. target is read for its text."""
    prepare(docs.sparkSession)
    table = gains(histogram(docs, ngrams, buckets), histogram(target, ngrams, buckets))
    scored = cut(weights(docs, table, ngrams).withColumn("score", F.col("weight") + gumbel(seed)))
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    eligible = F.col("n_words") >= least
    ends = scored.where(eligible).agg(F.count("*").alias("n"), F.max("score").alias("top")).first()
    k = percent * ends["n"] // 100
    if not k:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    by_score = F.when(eligible, F.lit(ends["top"]) - F.col("score"))
    by_id = F.coalesce("doc_id", F.lit((1 << 63) - 1)).bitwiseXOR(F.lit(-(1 << 63)))
    keyed = scored.withColumn("by_score", by_score).withColumn("by_id", by_id)
    before, same = _compared(["by_score", "by_id"], kth_prefix(keyed.where(eligible), ["by_score", "by_id"], k))
    chosen = F.coalesce(eligible & (before | same), F.lit(False))
    ranked = numbered(keyed.where(chosen), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    drawn = ranked.select(*names, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return drawn.unionByName(keyed.where(~chosen).select(*names, F.lit(None).cast("long").alias("rank")))
