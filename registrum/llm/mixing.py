"""Mixing sources to target weights by packed blocks and pseudorandom index permutations.

1. The words of a source's documents, in order of doc_id, form one stream, packed into blocks of ``block`` words.
   Documents are dealt to tasks by ranges of (source, doc_id) and sorted there; a document's place in the stream is the
   running sum in its range plus the sums of the ranges before. Ids need not be dense, and a source with a third of all
   rows is spread over many tasks.
2. Target: the source's share of the mix; where it would exceed ``most`` times the source, it stops there and the
   excess is dealt to the others by weight, again and again, until none is above.
3. The mix is cut into output shards of SHARD slots. Each shard's source counts are a multinomial draw under the condition
   that all shards' counts sum to the targets: a tree over the shards splits the counts between its halves, each
   split seeded by its place in the tree, so a task draws its own shards alone and nothing is drawn on the driver.
4. A source's j-th slot takes block ``permutation(epoch, j mod blocks)`` with ``epoch = j div blocks``: a keyed
   Feistel network walked into the range, computed for each slot alone. A source so repeats only after all of it was
   taken, and no document exceeds ``ceil(most)`` times its size. The last slot takes the words missing to the target.
5. Slots and blocks are joined by (source, block).

The driver and each task hold a few numbers for each source, whatever the corpus holds.

Null text counts no words; null source is a source of its own, ordered last. Repeated rows and ids are taken as
often as they stand there, null ids first; rows of one source and id are ordered by their texts' hashes. Sources without
words get target 0 and nothing. Extra columns are ignored. Reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix, narrow, prepare, texts_of

#: Slots of an output shard, and shards that one task draws and fills at a time.
SHARD, SHARDS_AT_ONCE = 1024, 64
#: Bytes of source names that may be broadcast; more are joined.
BROADCAST_BYTES = 16 << 20
#: What numpy's hypergeometric draws can hold, and the tries made at a time where counts are larger.
_MOST_DRAWN, _TRIES = 1_000_000_000, 1 << 16


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words to take from each source."""
    total = share * sum(sizes)
    limit, out, free = [most * s for s in sizes], [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while free:
        rest = total - sum(limit[i] for i in range(len(sizes)) if out[i] and i not in free)
        whole = sum(weights[i] for i in free)
        for i in free:
            out[i] = rest * weights[i] / whole
        above = {i for i in free if out[i] > limit[i]}
        if not above:
            break
        for i in above:
            out[i] = limit[i]
        free = [i for i in free if i not in above]
    return out


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Bijection of range(n) for each (n, key): a four-round Feistel network, walked until it falls below n."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(n, 2)) / 2), 1).astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        x, b, m = out[todo], bits[todo], low[todo]
        left, right = x >> b, x & m
        for r in range(4):
            left, right = right, left ^ (mix(right + key[todo] + np.uint64(r * 0x632BE59B)) & m)
        out[todo] = x = (left << b) | right
        todo = todo[x >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs: what the mix takes of it, repeats counted."""
    placed, names, segments = _mixed(docs, **how)
    taken = segments.groupBy("s", "first").agg(F.sum("length").alias("taken"))
    rows = placed.join(names, placed["source"].eqNullSafe(names["source"])).select(placed["doc_id"], "s", "first", "size", "source_size", "target")
    # documents without words stand at the place of the next one: they take nothing
    return rows.join(taken, ["s", "first"], "left").select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))


def _source_key(seed: int, source: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    return mix(source.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + epoch.astype(np.uint64) + np.uint64(seed))


def _placed(docs: DataFrame, row: str | None) -> DataFrame:
    """doc_id, source, size and first: the place of its first word in the source's stream; row: a column that stays."""
    key = [row] if row else []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t.split()) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), *[batch.column(c) for c in names]], ["size", *names])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, total = None, 0
        for batch in batches:
            inside = np.zeros(batch.num_rows, np.int64)
            sizes, sources = batch.column("size").to_numpy(), batch.column("source").to_pylist()
            cuts = [0, *[i for i in range(1, len(sources)) if sources[i] != sources[i - 1]], len(sources)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    total = total if sources[a] == source else 0
                    run = np.cumsum(sizes[a:b])
                    inside[a:b] = total + run - sizes[a:b]
                    source, total = sources[a], total + int(run[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside)], [*batch.schema.names, "inside"])

    names = ["doc_id", "source", "tie", *key]
    rows = narrow(docs, "doc_id", "source", "text", *key).withColumn("tie", F.xxhash64("text"))
    kinds = ", ".join(["size long, doc_id long, source string, tie long", *[f"{c} long" for c in key]])
    rows = cut(rows.mapInArrow(count, kinds))
    # equal rows are interchangeable: a number parts them, so that no range has to hold all of them
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    order = ["source", "doc_id", "tie", "size", "nth"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    rows = cut(rows.mapInArrow(sums, f"{kinds}, nth long, range int, inside long"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range and source in it
    offsets = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    offsets = offsets.select(F.col("source").alias("of_source"), F.col("range").alias("of_range"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("range") == F.col("of_range"))
    return rows.join(offsets, same).select("doc_id", "source", "size", *key, (F.col("inside") + F.col("before")).alias("first"))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn without replacement are good, exactly for counts of any size: two binomials of one chance are drawn until
    they add up to n, which leaves the first one so distributed. That takes about the square root of good + bad tries."""
    if good + bad < _MOST_DRAWN:
        return int(rng.hypergeometric(good, bad, n))
    if not (0 < n < good + bad and good and bad):
        return n if not bad else good if n else 0
    while True:
        x, y = (rng.binomial(k, n / (good + bad), _TRIES) for k in (good, bad))
        hit = np.flatnonzero(x + y == n)
        if len(hit):
            return int(x[hit[0]])


def split(counts: np.ndarray, left: int, seed: tuple[int, ...]) -> np.ndarray:
    """So many of the counts go left, drawn without replacement."""
    rest = int(counts.sum())
    rng = np.random.default_rng(seed)
    if rest < _MOST_DRAWN:
        return rng.multivariate_hypergeometric(counts, left, method="marginals")
    out = np.zeros_like(counts)
    for s, count in enumerate(counts.tolist()):  # one source after the other, each against all that follow
        rest -= count
        out[s] = hypergeometric(rng, count, rest, left) if left else 0
        left -= int(out[s])
    return out


def draws(quota: np.ndarray, low: int, high: int, seed: int, shard: int = SHARD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, start, count) of shards low to high: each source's slots before the shard and in it."""
    total = int(quota.sum())
    todo = [(0, -(-total // shard), quota, np.zeros_like(quota))]
    while todo:
        a, b, counts, start = todo.pop()
        if b <= low or a >= high or a >= b:
            continue
        if b - a == 1:
            yield a, start, counts
            continue
        middle = a + (1 << ((b - a - 1).bit_length() - 1))
        left = split(counts, (middle - a) * shard, (seed, a, b))
        todo += [(middle, b, counts - left, start + left), (a, middle, left, start)]


def _mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 128, seed: int = 20, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed documents, sources and segments, each document with its row column."""
    spark = docs.sparkSession
    prepare(spark)
    placed = cut(_placed(docs, row))
    table = placed.groupBy("source").agg(F.sum("size").alias("size")).collect()  # a row for each source
    table.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["size"]) for r in table]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    blocks = [-(-s // block) for s in sizes]
    # the tail block is short: the slots of a source are its epochs' blocks in turn, the last one cut where the target is met
    quota, final, last = (np.zeros(len(sizes), np.int64) for _ in range(3))
    for s, (size, target) in enumerate(zip(sizes, goal, strict=True)):
        words = min(int(round(target)), math.floor(most * size))
        final[s] = -1
        if not words:
            continue
        epoch, rest = divmod(words, size)
        quota[s] = epoch * blocks[s]
        if rest:
            tail = _place_of(blocks[s] - 1, blocks[s], seed, s, epoch)
            short = size - (blocks[s] - 1) * block
            k = -(-rest // block)
            k += _sum_of(k, block, tail, short) < rest
            last[s] = rest - _sum_of(k - 1, block, tail, short)
            quota[s] += k
            final[s] = quota[s] - 1
    names = spark.createDataFrame([(i, r["source"], sizes[i], goal[i], int(quota[i]), blocks[i]) for i, r in enumerate(table)], "s int, source string, source_size long, target double, quota long, blocks long")
    if sum(len(r["source"] or "") + 64 for r in table) <= BROADCAST_BYTES:
        names = F.broadcast(names)
    sized = np.array(blocks, np.int64)
    shards = -(-int(quota.sum()) // SHARD)
    groups = -(-shards // SHARDS_AT_ONCE)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column("id").to_pylist():
                for shard, start, count in draws(quota, group * SHARDS_AT_ONCE, (group + 1) * SHARDS_AT_ONCE, seed):
                    s = np.repeat(np.arange(len(count)), count)
                    slot = np.arange(len(s))
                    j = start[s] + slot - (np.cumsum(count) - count)[s]
                    n, epoch = sized[s], j // sized[s]
                    at = permute(j % n, n, _source_key(seed, s, epoch))
                    take = np.where(j == final[s], last[s], block)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s, np.full(len(s), shard), slot, epoch, at, take)], ["s", "shard", "slot", "epoch", "block", "take"])

    # a row for each group of shards, filled where it is drawn; by that few rows Spark would take the slots for a small table
    slots = spark.range(0, groups, 1, max(1, min(groups, 100_000))).mapInArrow(fill, "s long, shard long, slot long, epoch long, block long, take long")
    indexed = placed.join(names, placed["source"].eqNullSafe(names["source"])).select(placed["doc_id"], "s", "size", "first", *([row] if row else []))
    keep = ["doc_id", "first", *([row] if row else [])]
    parts = indexed.where("size > 0").select("s", "size", *keep, F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))).alias("block"))
    begin = F.greatest(F.col("first"), F.col("block") * block)
    parts = parts.select(F.col("s").cast("long").alias("s"), "block", *keep, (begin - F.col("first")).alias("start"), (begin - F.col("block") * block).alias("position"), (F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block) - begin).alias("length"))
    joined = parts.join(slots.hint("merge"), ["s", "block"]).where("position < take")
    segments = joined.select("s", *keep, "shard", "slot", "position", "epoch", "start", F.least("length", F.col("take") - F.col("position")).alias("length"))
    return placed, names, segments


def _sum_of(k: int, block: int, tail: int, short: int) -> int:
    """Words in the first k slots of an epoch."""
    return k * block - (block - short if tail < k else 0)


def _place_of(item: int, n: int, seed: int, s: int, epoch: int) -> int:
    """The index that the permutation maps to item, by walking the inverse network."""
    bits = max(math.ceil(math.log2(max(n, 2)) / 2), 1)
    low, key, x = (1 << bits) - 1, _source_key(seed, np.array([s]), np.array([epoch])), item
    while True:
        left, right = x >> bits, x & low
        for r in reversed(range(4)):
            left, right = right ^ int(mix(np.array([left], np.uint64) + key + np.uint64(r * 0x632BE59B))[0] & np.uint64(low)), left
        x = (left << bits) | right
        if x < n:
            return x


def mixture(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(sources, segments). sources: source, source_size, target, quota, blocks. segments: doc_id, shard, slot, position (of
    the segment's first word in the slot), epoch, start, length: words of the document that the slot holds; a shard's
    slots in order are its fixed-length blocks."""
    _, names, segments = _mixed(docs, **how)
    return names.drop("s"), segments.drop("s", "first")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix holds them: a row for each row of docs and epoch, its text cut to the words taken in that epoch (as it
    is where all are taken, else joined by one space) and n_chars, where there is one, recounted. What the mix leaves goes.
    Rows are told apart by a number that is written before, so null and repeated ids and equal rows are each themselves."""
    prepare(docs.sparkSession)
    inner = [{"doc_id": "doc_id", "text": "text", "source": "source"}.get(c, f"c{i}") for i, c in enumerate(docs.columns)]
    rows = cut(docs.toDF(*inner).withColumn("c_row", F.monotonically_increasing_id()))
    _, _, segments = _mixed(rows, row="c_row", **how)
    taken = segments.groupBy("c_row", "epoch").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("c_spans"))
    # at most ``most`` epochs a row: the text is shuffled once, then repeated
    taken = taken.groupBy("c_row").agg(F.array_sort(F.collect_list(F.struct("epoch", "c_spans"))).alias("c_epochs"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in inner)
    rows = rows.join(taken, "c_row").select(*inner, F.explode("c_epochs.c_spans").alias("c_spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = batch.column("c_spans"), []
            for i, raw in enumerate(texts_of(batch.column("text"))):
                words, part = raw.split(), spans[i].values
                stay = [w for a, n in zip(part.field("start").to_pylist(), part.field("length").to_pylist(), strict=True) for w in words[a : a + n]]
                kept.append(raw if len(stay) == len(words) else b" ".join(stay))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in inner], inner)

    out = rows.mapInArrow(keep, kinds)
    return out.select(*[(F.length("text").cast("long") if c == "n_chars" else F.col(i)).alias(c) for c, i in zip(docs.columns, inner, strict=True)])
