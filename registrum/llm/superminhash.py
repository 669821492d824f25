"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and union-find.

1. Every n-gram of a document draws, from its hash, one random permutation of the slots, a swap for each level, and one random
   number a level; in the slot of level j it stands for j plus that number, and a slot keeps the least. An n-gram thus
   takes the slots in turn, which makes estimates vary less than with independent hashes. A document is done as soon
   as all its slots hold levels that are past: with more n-grams than slots that takes few levels. The work
   runs over the n-grams of many documents at once.
2. Slots are cut into bands of ``rows_for(threshold)`` slots; two sets with one equal band are candidates. Bands are so
   many that a pair right at the threshold is missed with a probability under ``MISSED`` (at 85: 32 bands of 4 slots, 6e-11).
3. Candidates are confirmed on their full sets. Equal sets are one node; in each band's bucket the members meet the least node
   first, and only pairs still in different components are looked at after, so groups of copies do not square.
4. Links are grouped by union-find in each task, which leaves a forest of its nodes, and the forests are joined by star rounds.

Nulls and texts without words link with nothing. A null doc_id is left out of linking (component_id null, kept). Fewer than n words:
the whole sequence is one n-gram. Rows that share a doc_id each have the component of their own text; kept tells whether a row's
id is the least of its component. Ties need no rule, repeated rows stay; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prepare
from .components import components
from .ngram_join import linked_sets

#: Slots of a signature, and the probability with which a pair at the threshold may share no band.
SLOTS, MISSED = 128, 1e-9
#: N-grams whose permutations are held at once: 2 MB.
PIECE = 1 << 14
_LEVEL = np.uint64(56)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def rows_for(threshold: int, slots: int = SLOTS) -> int:
    """Slots in a band: as many as leave pairs at the threshold together in some band."""
    t = threshold / 100
    return max([r for r in range(1, slots + 1) if t == 1 or (1 - t**r) ** (slots // r) <= MISSED], default=1) if t < 1 else slots


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of slots for each set of 64-bit hashes; of an empty set all slots hold the greatest value."""
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    grams, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in range(0, len(grams), PIECE):
        _add(out, grams[at : at + PIECE], owner[at : at + PIECE])
    return out


def _add(out: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> None:
    """Takes n-grams into the signatures of their owners."""
    slots = out.shape[1]
    flat, places = out.reshape(-1), np.tile(np.arange(slots, dtype=np.uint16), (len(grams), 1))
    for level in range(slots):
        every = np.arange(len(grams))
        drawn = mix(grams + np.uint64((level + 1) * int(_STEP) & (1 << 64) - 1))
        other = level + (mix(drawn ^ _STEP) % np.uint64(slots - level)).astype(np.int64)
        slot = places[every, other]
        places[every, other] = places[:, level]
        np.minimum.at(flat, owner * slots + slot, (np.uint64(level) << _LEVEL) | (drawn >> np.uint64(64) - _LEVEL))
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        done = out[owner[first]].max(axis=1) < np.uint64(level + 1) << _LEVEL
        if done.any():
            open_ = ~np.repeat(done, np.diff(np.append(first, len(owner))))
            grams, owner, places = grams[open_], owner[open_], places[open_]
            if not len(grams):
                return


def bands(sets: list[np.ndarray], rows: int, slots: int = SLOTS) -> list[np.ndarray]:
    """A key for each band of each set; none for the empty set."""
    held, count = signatures(sets, slots), slots // rows
    parts = held[:, : count * rows].reshape(len(sets), count, rows)
    keys = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * _STEP, (len(sets), count))
    for r in range(rows):
        keys = mix(keys ^ parts[:, :, r])
    return [k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)]


def _intersections(query: np.ndarray, sets: list[np.ndarray], need: list[int]) -> list[int]:
    found = [len(np.intersect1d(query, s, assume_unique=True)) for s in sets]
    return [n if n >= least else -1 for n, least in zip(found, need, strict=True)]


def united(links: DataFrame) -> DataFrame:
    """node, component of all linked nodes: union-find in each task, then star rounds over what the tasks' forests share."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above: dict[int, int] = {}

            def root(x: int, above: dict[int, int] = above) -> int:
                top = x
                while (up := above.setdefault(top, top)) != top:
                    top = up
                while above[x] != top:
                    above[x], x = top, above[x]
                return top

            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
            ends = [(root(x), x) for x in above]
            yield pa.RecordBatch.from_arrays([pa.array([e[j] for e in ends if e[0] != e[1]], pa.int64()) for j in (0, 1)], ["a", "b"])

    return components(links.select("a", "b").mapInArrow(forest, "a long, b long"))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    prepare(docs.sparkSession)
    rows = rows_for(threshold)
    members, _ = linked_sets(docs, n, threshold, lambda: lambda sets: bands(sets, rows), _intersections, united)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return members.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
