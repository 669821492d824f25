"""Runs of periodic text by bit-parallel lags.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
``max(least, 2 * q)`` words long, that no neighbouring word extends keeping period q.

1. The words of a text get dense ids; plane b is one big integer that holds bit b of every word's id.
2. For a lag q the planes are exclusive-ored with themselves shifted by q; the differences, or-ed over the planes, mark
   the words that differ from the one q further on.
3. A run of period q is a stretch of ``max(least - q, q)`` or more unmarked words: doubling shifts, and-ed, leave the
   places where so many begin, after about log2 of that many steps.
4. Lags go upwards. A stretch of at least 2 * q words whose smallest period is p < q has p dividing q, so it is the run
   already found at lag p, with the same ends; it is left out.

Lags that cannot have a run are not tried: such a run needs two equal sequences of ``least // 2`` words q apart (least is at
least 4). They are listed from the sorted hashes of all such sequences, or, where equal ones are so many that their pairs outnumber
four times the words, all lags up to half of the text are tried. Either way the result is the same.

Each text is one task's work by itself: memory is a small multiple of its words. Null or empty texts, and texts of fewer than
``least`` words, have no run. Rows are independent, so ties, repeated rows and null ids need nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, mix, narrow, prepare, texts_of

#: Pairs of equal sequences, for each word of the text, up to which lags are listed one by one.
LISTED = 4


def lags(ids: np.ndarray, least: int) -> np.ndarray:
    """Lags, ascending, among which are all that have a run."""
    n, k = len(ids), max(1, least // 2)
    grams = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        grams = mix(grams ^ ids[j : n - k + 1 + j].astype(np.uint64))
    order = np.argsort(grams, kind="stable")
    grams, found, pairs, step = grams[order], [], 0, 1
    while step < len(grams):
        same = np.flatnonzero(grams[step:] == grams[:-step])
        if not len(same):
            break
        pairs += len(same)
        if pairs > LISTED * n:
            return np.arange(1, n // 2 + 1)
        found.append(np.unique(order[same + step] - order[same]))
        step += 1
    out = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return out[out <= n // 2]


def planes(ids: np.ndarray) -> list[int]:
    """Bit b of every id as one big integer, word 0 lowest."""
    top = int(ids.max(initial=0)).bit_length()
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(top)]


def beginnings(equal: int, need: int) -> int:
    """The places where at least ``need`` ones begin."""
    width = 1
    while width < need and equal:
        step = min(width, need - width)
        equal &= equal >> step
        width += step
    return equal


def places(bits: int) -> list[int]:
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def runs_of(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(words)
    if n < max(least, 2):
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    tried = lags(ids, least).tolist()
    if not tried:
        return []
    held, out, ends = planes(ids), [], set()
    for q in tried:
        differ = 0
        for plane in held:
            differ |= plane ^ (plane >> q)
        all_ = (1 << (n - q)) - 1
        need = max(least - q, q)
        begin = beginnings(all_ & ~differ, need)
        if not begin:
            continue
        for start, last in zip(places(begin & ~(begin << 1)), places(begin & ~(begin >> 1)), strict=True):
            length = last - start + need + q
            if (start, length) not in ends:
                ends.add((start, length))
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(change).tolist(), strict=False) if not gone]


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, runs (start, length, period of each, by start, then period) and collapsed (the words that no run holds after its
    first period, joined by one space) for each row of docs."""
    if least < 4:
        raise ValueError("least must be 4 or more")
    prepare(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kept = [], []
            for raw in texts_of(batch.column("text")):
                words = raw.split()
                runs = runs_of(words, least)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                kept.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return narrow(docs, "doc_id", "text").mapInArrow(find, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts, by h = crc32 of the id, end in a repeated piece: from word a = h/10 % n on,
    the p = 1 + (n - a) / (3 + h/10 % 8) words there come again and again. Null ids and texts without words stay as they are."""
    word = F.regexp_extract_all("text", F.lit(WORD), 0)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = narrow(docs, "doc_id", "text").withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, word))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))

    def again(word: Column, i: Column) -> Column:
        return F.when(i < F.col("a"), word).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))

    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.transform("words", again), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame, least: int = 12) -> DataFrame:
    """What find_runs gives for each row, as doc_id, n_runs, the longest run (ties: least start, then period; null without one)
    as start, length, period, exponent_milli, and sha256 of the runs' lines and of the collapsed text."""
    found = find_runs(docs, least)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("top.p")
    return rows.select(
        "doc_id", "n_runs", (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("top.length") / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
