"""Quality rules with compression bands.

Zstandard's ratio (compressed to raw bytes) tells repetitive text (low) from incompressible text (high). A short text
compresses worse than a long one, so the limits depend on the length: BANDS gives them for the whole text and
CHUNK_BAND for fixed chunks, of which a share of at most CHUNK_SHARE may lie outside. Chunks find what the whole
hides: a long readable text with a repetitive or random stretch.

Beside the bands stand plain counts, and the base rule on them: fewer than 50 words, or more than half of the words in
three-word windows that occur twice.

Null and empty texts have zero counts, fail the base rule and are not kept. Each row is judged alone: repeated rows,
null ids and extra columns change nothing, and a text of any length is read as a whole.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Hasher, narrow, prepare, texts_of

#: Bytes from which a band holds, least ratio, greatest ratio.
BANDS = ((0, 0.25, 9.0), (256, 0.50, 0.82), (512, 0.465, 0.76), (1024, 0.435, 0.70), (2048, 0.425, 0.64), (4096, 0.405, 0.60), (8192, 0.39, 0.58), (16384, 0.38, 0.56), (65536, 0.355, 0.55))
CHUNK_BYTES = 2048
CHUNK_BAND = (0.25, 0.66)
CHUNK_SHARE = 0.25
LEVEL = 3


def band(size: int) -> tuple[float, float]:
    return BANDS[bisect_right(BANDS, (size, 9.0, 9.0)) - 1][1:]


def verdict(raw: bytes, compress) -> tuple[float, int, int, bool]:
    """Ratio of the whole, number of full chunks, how many of them lie outside, and whether all bands hold."""
    if not raw:
        return 0.0, 0, 0, False
    ratio = len(compress(raw)) / len(raw)
    low, high = band(len(raw))
    full = len(raw) // CHUNK_BYTES
    outside = 0
    for k in range(full if full > 1 else 0):
        r = len(compress(raw[k * CHUNK_BYTES : (k + 1) * CHUNK_BYTES])) / CHUNK_BYTES
        outside += not CHUNK_BAND[0] <= r <= CHUNK_BAND[1]
    return ratio, full, outside, low <= ratio <= high and outside <= CHUNK_SHARE * full


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio, chunks, chunks_outside, kept."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hasher, compress = Hasher(), zstandard.ZstdCompressor(level=LEVEL).compress
        symbol = np.zeros(256, bool)
        symbol[list(b"#*$%&|<>")] = True
        for batch in batches:
            rows, texts = [], texts_of(batch.column("text"))
            for i, words in hasher.chunks(texts):
                raw, n = texts[i], len(words)
                buf = np.frombuffer(raw, np.uint8)
                chars = int(np.count_nonzero(~hasher.space[buf] & ((buf & 0xC0) != 0x80)))
                lines, repeats = set(), 0
                for line in raw.split(b"\n"):
                    if line in lines:
                        repeats += 1
                    elif line.split(None, 1):
                        lines.add(line)
                again = np.zeros(n, bool)
                if n > 3:
                    grams = hasher.grams(words, 3)
                    _, inverse, count = np.unique(grams, return_inverse=True, return_counts=True)
                    at = np.flatnonzero(count[inverse] > 1)
                    again[at] = again[at + 1] = again[at + 2] = True
                repeated = int(np.count_nonzero(again))
                failed = n < 50 or 100 * repeated > 50 * n
                ratio, full, outside, good = verdict(raw, compress)
                rows.append((n, chars, int(np.count_nonzero(symbol[buf])), repeats, repeated, failed, ratio, full, outside, good and not failed))
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "chunks", "chunks_outside", "kept"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, chunks long, chunks_outside long, kept boolean")
