"""Best-fit packing into bins of several permitted lengths, optimised jointly.

A document's words are cut into pieces of at most the longest permitted length; each piece is packed whole. Pieces are
dealt to groups of about ``group_words`` words by a hash of row and piece, so neither a long document nor a
hot source nor rows that share an id fill a task, and each group is packed alone:

- best-fit decreasing: the longest piece first, into the open bin that it leaves least room in;
- when none fits, a bin is opened: for each permitted length that holds the piece, the best filling from the pieces
  still to come is looked ahead greedily; the length with the least cost for each word packed is opened;
- in the end each bin is downsized to the least permitted length that holds its contents.

Cost of a length L: ``L + L * L / quadratic`` (attention makes long sequences dearer by the square).

Null texts and texts without words give no piece and no row. Repeated rows and null ids are packed each, told apart by
``row``, a row's number in the input. Ties are settled by document, piece and row, so reruns over the same files agree.
Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, narrow, prepare, texts_of


def cost(length: int, quadratic: float) -> float:
    return length + length * length / quadratic


def _look_ahead(room: int, counts: dict[int, int], lengths: list[int]) -> int:
    """Words that a greedy filling puts into the room."""
    left, used = room, {}
    while left:
        i = bisect_left(lengths, left + 1) - 1
        while i >= 0 and counts.get(lengths[i], 0) - used.get(lengths[i], 0) <= 0:
            i -= 1
        if i < 0:
            break
        n = lengths[i]
        times = min(left // n, counts[n] - used.get(n, 0))
        used[n] = used.get(n, 0) + times
        left -= times * n
    return room - left


def best_fit(sizes: list[int], permitted: list[int], quadratic: float) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; sizes must be in descending order. Bins are numbered as they open."""
    permitted = sorted(permitted)
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    lengths = sorted(counts)
    rooms: list[tuple[int, int]] = []  # open bins: (room, bin), sorted
    filled: list[int] = []
    out: list[tuple[int, int]] = []
    for s in sizes:
        counts[s] -= 1
        if not counts[s]:
            del lengths[bisect_left(lengths, s)]
        i = bisect_left(rooms, (s, -1))
        if i < len(rooms):
            room, b = rooms.pop(i)
        else:
            fitting = [c for c in permitted if c >= s]
            room = min(fitting, key=lambda c: (cost(c, quadratic) / (s + _look_ahead(c - s, counts, lengths)), c))
            b = len(filled)
            filled.append(0)
        out.append((b, filled[b]))
        filled[b] += s
        if room > s:
            insort(rooms, (room - s, b))
    return out


def pack(docs: DataFrame, permitted: tuple[int, ...] = (512, 1024, 2048, 4096), quadratic: float = 8192.0, group_words: int = 4_000_000) -> DataFrame:
    """doc_id, row (number of the document's row in the input), piece, start (first word of the piece in the document), length, bin (a string, one for each bin), capacity
    (the permitted length after downsizing), offset (of the piece in the bin), filled (words in the bin)."""
    prepare(docs.sparkSession)
    permitted = tuple(sorted(permitted))
    most = permitted[-1]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), texts_of(batch.column("text")), strict=True):
                n = len(text.split())
                out += [(doc, row, k, k * most, min(most, n - k * most)) for k in range(-(-n // most))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], ["doc_id", "row", "piece", "start", "length"])

    numbered = narrow(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    rows = cut(numbered.mapInArrow(pieces, "doc_id long, row long, piece long, start long, length long"))
    total = rows.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_words))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
        placed = best_fit(group["length"].tolist(), list(permitted), quadratic)
        bins, offsets = pd.Series([b for b, _ in placed], index=group.index), [o for _, o in placed]
        filled = group["length"].groupby(bins).transform("sum")
        capacity = [permitted[bisect_left(permitted, f)] for f in filled]
        return group.assign(bin=[f"{g}-{b}" for g, b in zip(group["grp"], bins, strict=True)], capacity=capacity, offset=offsets, filled=filled).drop(columns="grp")

    dealt = rows.withColumn("grp", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(fill, "doc_id long, row long, piece long, start long, length long, bin string, capacity long, offset long, filled long")
