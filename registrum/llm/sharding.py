"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at VNODES places of a 64-bit ring; a row's key (doc_id and text hash) has a place, and belongs to
the first virtual node clockwise. The ring is cut into CELLS equal arcs, whose loads are aggregated before any
shuffle of rows; CELLS sums reach the driver, whatever the corpus holds. There, cells are placed by descending load:
a cell stays with its own shard while that is below ``(1 + slack) * total / shards``, else it continues clockwise to
the next shard with room, so every shard is bounded and only overflowing cells leave their place. Where no shard has
room (a cell larger than all that is left) the least loaded one takes it.

A row's slot is its cell's offset in the shard plus its rank inside the cell: gapless, without a window over a shard.

Null text: size 1 (no bytes plus 1). Null doc_id and repeated rows are placed like any other; equal rows are
interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix, narrow

#: Arcs of the ring that are moved as one.
CELLS = 1 << 15
#: Places of a shard on the ring.
VNODES = 256


def ring(shards: int, vnodes: int = VNODES) -> tuple[list[int], list[int]]:
    """Cells at which virtual nodes stand, ascending, and their shards."""
    shard, node = np.divmod(np.arange(shards * vnodes, dtype=np.uint64), np.uint64(vnodes))
    place = mix(mix(shard + np.uint64(1)) ^ (node * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - (CELLS.bit_length() - 1))
    order = np.lexsort((shard, place))
    return place[order].astype(int).tolist(), shard[order].astype(int).tolist()


def place_cells(loads: dict[int, int], shards: int, slack: float) -> dict[int, int]:
    """The shard of each cell."""
    places, owners = ring(shards)
    limit = (1 + slack) * sum(loads.values()) / shards
    held, out = [0] * shards, {}
    for cell, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        at, tried = bisect.bisect_left(places, cell), set()
        for step in range(len(places)):
            shard = owners[(at + step) % len(places)]
            if shard not in tried and held[shard] + load <= limit:
                break
            tried.add(shard)
            if len(tried) == shards:
                shard = min(range(shards), key=lambda s: (held[s], s))
                break
        held[shard] += load
        out[cell] = shard
    return out


def shard_rows(docs: DataFrame, shards: int = 8, slack: float = 0.002) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, shard, slot for each row of docs."""
    spark = docs.sparkSession
    rows = narrow(docs, "doc_id", "text").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0).cast("long")).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("key"))
    shift = 64 - (CELLS.bit_length() - 1)
    rows = cut(rows.withColumn("cell", F.shiftrightunsigned("key", shift).cast("int")))
    loads = {r["cell"]: (int(r["load"]), int(r["n"])) for r in rows.groupBy("cell").agg(F.sum("size").alias("load"), F.count("*").alias("n")).collect()}  # CELLS rows at most
    owner = place_cells({c: x for c, (x, _) in loads.items()}, shards, slack)
    offset, table = [0] * shards, []
    for cell in sorted(loads):
        table.append((cell, owner[cell], offset[owner[cell]]))
        offset[owner[cell]] += loads[cell][1]
    plan = spark.createDataFrame(pd.DataFrame(table or [(0, 0, 0)], columns=["cell", "shard", "offset"]).astype({"cell": "int32", "shard": "int32", "offset": "int64"}))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("key", "doc_id")) - 1
    placed = rows.withColumn("rank", rank).join(F.broadcast(plan), "cell")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))


