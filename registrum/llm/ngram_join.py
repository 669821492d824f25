"""N-gram Jaccard join: T-occurrence search with DivideSkip, exact at any size.

Two documents link when ``100 * |A & B| >= threshold * |A | B|`` over distinct word n-grams.

1. One pass counts n-grams in a fixed-size sketch (SLOTS counters, whatever the corpus holds). It only fixes
   a global order, rare n-grams first; results do not depend on it.
2. Documents with equal sets collapse to the least doc_id. A set of s n-grams can only reach the threshold with
   another when they share one of its first ``s - ceil(t*s) + 1`` n-grams in that order, so these alone are indexed.
3. Inverted lists with one document go. In a list each document meets the least one of about its size first; after
   that only pairs which are not yet in one component are searched, so true groups of copies do not square. Pairs of short
   lists are joined; a long list is cut into blocks whose pairs are compared inside a task, each pair in the
   least long list that both documents are in.
   A pair is dropped unseen when the sets provably differ too much: each set is dealt by hash into parts with a
   16-bit exclusive-or each, and every part that differs stands for an n-gram that only one of them has.
4. That is DivideSkip's division, made once for all: T - 1 lists of a query, those of its commonest n-grams, are put aside,
   and who stands in none of the others cannot reach T. Each query then searches the inverted lists over its candidates'
   sets: the L longest are put aside, the short ones merged on a heap, candidates that the long ones can still
   bring to T are looked up there by binary search; those with T occurrences are links.
5. Links are joined to components.

Nulls and texts without words have the empty set: they link with nothing and are their own component. A null
doc_id is left out of linking (component_id null). Fewer than n words: the whole sequence is one n-gram. Sets are linked, not
ids: rows that share a doc_id each have the component of their own text, and those with one text one. Empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, cut, mix, narrow, prepare, signed, texts_of
from .components import components

#: Keys of each set, in a task; and the overlap of a set with each of others that reaches its need, else -1.
Keys = Callable[[list[np.ndarray]], list[np.ndarray]]
Overlaps = Callable[[np.ndarray, list[np.ndarray], list[int]], list[int]]
#: Size and signature, which tell sets apart.
SET = ["n_shingles", "one", "two"]
#: Counters of the frequency sketch: 4 MB, of any corpus.
SLOTS = 1 << 20
_PIECE = 1 << 12
#: Ids (8 bytes each) that may be broadcast.
BROADCAST_IDS = 200_000
#: Lists above this are searched in blocks of so many by so many documents, or of so many bytes of profiles.
LONG, BLOCK, BLOCK_BYTES = 64, 1024, 1 << 22
#: Candidates whose sets one search holds at once; a query with more runs several searches.
FANOUT = 256


def shingle_set(hasher: Hasher, words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; fewer than n words make one."""
    if not len(words):
        return words
    return np.unique(hasher.grams(words, min(n, len(words))))


class Lists:
    """Inverted lists over the n-gram sets of some documents: for an n-gram the documents that hold it, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")  # equal n-grams stay in the order of their documents
        self.grams, self.documents = grams[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def of(self, query: np.ndarray) -> list[list[int]]:
        """The lists of the query's n-grams that are in any document, short ones first."""
        low, high = np.searchsorted(self.grams, query, "left"), np.searchsorted(self.grams, query, "right")
        met = np.flatnonzero(high > low)
        met = met[np.argsort((high - low)[met], kind="stable")]
        return [self.documents[low[k] : high[k]].tolist() for k in met]


def t_occurrence(query: np.ndarray, index: Lists, need: list[int]) -> list[int]:
    """Overlap of the query with each document of the index that reaches its need, else -1, by DivideSkip: the longest lists
    are put aside, the short ones are merged on a heap, and only documents that the long lists can still bring to their need
    are looked up there by binary search."""
    lists, out = index.of(query), [-1] * len(need)
    t = min(need, default=1)
    # the rule for the number of long lists: T / (mu * log2 M + 1)
    aside = min(max(t - 1, 0), int(t / (0.01 * np.log2(max(len(lists[-1]) if lists else 2, 2)) + 1)), len(lists))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    for c, hits in groupby(heapq.merge(*short)):
        n, left = sum(1 for _ in hits), aside
        for posting in long:
            if n + left < need[c]:
                break
            i = bisect_left(posting, c)
            n += i < len(posting) and posting[i] == c
            left -= 1
        if n >= need[c]:
            out[c] = n
    return out


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, slots = Hasher(lower=True), np.zeros(SLOTS, np.uint32)
        for batch in batches:
            seen = [shingle_set(hasher, words, n) for _, words in hasher.chunks(texts_of(batch.column("text")))]
            if seen:
                slots += np.bincount((np.concatenate(seen) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        for k in range(SLOTS // _PIECE):
            piece = slots[k * _PIECE : (k + 1) * _PIECE]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["piece", "counts"])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        summed = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in group["counts"])
        return pd.DataFrame({"piece": [group["piece"].iloc[0]], "counts": [np.minimum(summed, 2**32 - 1).astype(np.uint32).tobytes()]})

    out = np.zeros(SLOTS, np.uint32)
    # at most SLOTS * 4 bytes come back
    for row in narrow(docs, "text").mapInArrow(count, "piece int, counts binary").groupBy("piece").applyInPandas(total, "piece int, counts binary").collect():
        out[row["piece"] * _PIECE : (row["piece"] + 1) * _PIECE] = np.frombuffer(row["counts"], np.uint32)
    return out


def parts_of(size: int, threshold: int) -> int:
    """Parts of a set's profile: a power of two, four for each n-gram that a partner may lack."""
    return 1 << max(3, (4 * (2 * size * (100 - threshold) // (100 + threshold)) - 1).bit_length())


def profile(grams: np.ndarray, parts: int) -> np.ndarray:
    out = np.zeros(parts, np.uint16)
    np.bitwise_xor.at(out, (grams & np.uint64(parts - 1)).astype(np.int64), (grams >> np.uint64(48)).astype(np.uint16))
    return out


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the number of n-grams that only one set has, from profiles of any two lengths."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.count_nonzero(a != b))


def prefix_length(size: int, threshold: int) -> int:
    """How many first n-grams of a set must be indexed to lose no partner."""
    return size - -(-size * threshold // 100) + 1


def prefixes(threshold: int, df: np.ndarray) -> Keys:
    """The first n-grams of each set, rare ones first, of which a partner must share one."""

    def first(sets: list[np.ndarray]) -> list[np.ndarray]:
        return [grams[np.lexsort((grams, df[(grams & np.uint64(SLOTS - 1)).astype(np.int64)]))[: prefix_length(len(grams), threshold) if len(grams) else 0]] for grams in sets]

    return first


def set_signature(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums of hashes, which tell sets apart."""
    return tuple(int(mix(grams ^ np.uint64(x)).sum(dtype=np.uint64)) for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def _as_long(numbers: Iterable[int]) -> pa.Array:
    return pa.array(signed(np.fromiter(numbers, np.uint64)))


def index_rows(docs: DataFrame, n: int, threshold: int, make: Callable[[], Keys]) -> DataFrame:
    """docs: doc_id, text, text_hash. For each row n_shingles, two halves of a set signature, the keys under which the set is
    indexed, as made in the task, and the profile; without the text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, keys_of = Hasher(lower=True), make()
        for batch in batches:
            sets = [shingle_set(hasher, words, n) for _, words in hasher.chunks(texts_of(batch.column("text")))]
            halves = [set_signature(grams) for grams in sets]
            keys = pa.array([signed(k) for k in keys_of(sets)], pa.list_(pa.int64()))
            shapes = pa.array([profile(grams, parts_of(len(grams), threshold)).tobytes() for grams in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(x) for x in sets], pa.int64()), _as_long(h[0] for h in halves), _as_long(h[1] for h in halves), keys, shapes],
                ["doc_id", "text_hash", *SET, "keys", "profile"],
            )

    return docs.mapInArrow(build, "doc_id long, text_hash long, n_shingles long, one long, two long, keys array<long>, profile binary")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            sets = [shingle_set(hasher, words, n) for _, words in hasher.chunks(texts_of(batch.column("text")))]
            halves = [set_signature(grams) for grams in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x) for x in sets], pa.int64()), _as_long(h[0] for h in halves), _as_long(h[1] for h in halves), pa.array([x.tobytes() for x in sets], pa.binary())],
                [*SET, "grams"],
            )

    return docs.mapInArrow(build, "n_shingles long, one long, two long, grams binary")


def _possible(pairs: DataFrame, profiles: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose profiles allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*[batch.column(c).to_pylist() for c in ("size_a", "size_b", "profile_a", "profile_b")], strict=True):
                fits = min(m, n) * 100 >= max(m, n) * threshold
                keep.append(fits and differing(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)) * (100 + threshold) <= (m + n) * (100 - threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(profiles.toDF("a", "size_a", "profile_a"), "a").join(profiles.toDF("b", "size_b", "profile_b"), "b").select("a", "b", "size_a", "size_b", "profile_a", "profile_b").mapInArrow(run, "a long, b long")


def _blocks(long: DataFrame, profiles: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components in the long lists whose profiles allow a link. The members of a list's largest
    component are one already, so only the others are searched for, among all: with few others that is no square."""

    def run(others: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(others) or not len(members):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        gram, out = others["gram"].iloc[0], []
        by_length: dict[int, list[int]] = {}
        shapes = [np.frombuffer(x, np.uint16) for x in members["profile"]]
        for k, x in enumerate(shapes):
            by_length.setdefault(len(x), []).append(k)
        stacks = {m: (np.array(ks), np.stack([shapes[k] for k in ks])) for m, ks in by_length.items()}
        ids, sizes, parts, grams, apart = members["node"].to_numpy(), members["n_shingles"].to_numpy(), members["component"].to_numpy(), [set(g) for g in members["grams"]], members["apart"].to_numpy()
        for row in others.itertuples(index=False):
            x, own = np.frombuffer(row.profile, np.uint16), list(row.grams)
            for m, (ks, stack) in stacks.items():
                fold, other = x, stack
                while len(fold) > m:
                    fold = fold[: len(fold) // 2] ^ fold[len(fold) // 2 :]
                while other.shape[1] > len(fold):
                    other = other[:, : other.shape[1] // 2] ^ other[:, other.shape[1] // 2 :]
                n = sizes[ks]
                fits = (np.count_nonzero(other != fold, axis=1) * (100 + threshold) <= (n + row.n_shingles) * (100 - threshold)) & (np.minimum(n, row.n_shingles) * 100 >= np.maximum(n, row.n_shingles) * threshold)
                fits &= (parts[ks] != row.component) & (~apart[ks] | (ids[ks] > row.node))
                for k in ks[fits]:
                    if min(g for g in own if g in grams[k]) == gram:  # in other lists too: named once
                        out.append((min(row.node, ids[k]), max(row.node, ids[k])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    sizes = long.groupBy("gram", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("gram").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    own = long.groupBy("node").agg(F.sort_array(F.collect_set("gram")).alias("grams"))
    rows = long.join(main, "gram").withColumn("apart", F.col("component") != F.col("main"))
    # a block's profiles are BLOCK at most, or BLOCK_BYTES
    share = F.lit(32.0 * (100 - threshold) / (100 + threshold) / BLOCK_BYTES) * F.col("n_shingles")
    cuts = rows.groupBy("gram").agg(*[F.ceil(F.greatest(F.count_if(x) / BLOCK, F.sum(F.when(x, share).otherwise(0.0)))).alias(c) for c, x in (("others", F.col("apart")), ("cuts", F.lit(True)))])
    rows = cut(rows.join(cuts, "gram").join(own, "node").join(profiles.select("node", "profile"), "node"))
    held = ["gram", "node", "n_shingles", "component", "grams", "profile", "apart"]
    dealt = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = rows.where("apart").select(*held, dealt("others").alias("i"), every("cuts").alias("j"))
    right = rows.select(*held, dealt("cuts").alias("j"), every("others").alias("i"))
    return left.groupBy("gram", "i", "j").cogroup(right.groupBy("gram", "i", "j")).applyInPandas(run, "a long, b long")


def _fetched(known: DataFrame, classes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """node, grams: the sets that stand in pairs. The rows of their least ids are read again and told apart by their sets'
    signatures. Few ids are broadcast, after a count; many are joined."""
    ends = cut(classes.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi").select("node", "class_id", *SET))
    few = ends.count() <= BROADCAST_IDS
    ids = ends.select(F.col("class_id").alias("doc_id")).distinct()
    sets = _sets(known.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), n)
    ends = ends.drop("class_id")
    return cut(sets.join(F.broadcast(ends) if few else ends, SET).groupBy("node").agg(F.first("grams").alias("grams")))


def _search(pairs: DataFrame, sets: DataFrame, threshold: int, overlaps: Overlaps) -> DataFrame:
    """Pairs (a, b) that link, with their overlap."""
    part = Fraction(threshold, 100 + threshold)

    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"a": [], "b": [], "overlap": []})
        query = np.frombuffer(queries["q_grams"].iloc[0], np.uint64)
        sets_ = [np.frombuffer(x, np.uint64) for x in candidates["grams"]]
        need = [-(-(len(query) + len(s)) * part.numerator // part.denominator) for s in sets_]
        found = overlaps(query, sets_, need)
        hit = [i for i, x in enumerate(found) if x >= 0]
        return pd.DataFrame({"a": queries["q_a"].iloc[0], "b": candidates["b"].iloc[hit], "overlap": [found[i] for i in hit]})

    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / FANOUT).alias("fan"))
    dealt = pairs.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), "fan").alias("part"))
    queries = dealt.select("a", "part").distinct().join(sets.toDF("a", "grams"), "a").toDF("q_a", "q_part", "q_grams")
    candidates = dealt.join(sets.toDF("b", "grams"), "b").select("a", "part", "b", "grams")
    return queries.groupBy("q_a", "q_part").cogroup(candidates.groupBy("a", "part")).applyInPandas(run, "a long, b long, overlap long")


def linked_sets(docs: DataFrame, n: int, threshold: int, make: Callable[[], Keys], overlaps: Overlaps, grouped: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the sets that share a key of ``make`` and reach the threshold, by ``overlaps``; ``grouped`` makes components.
    Links are searched between distinct sets, each a node with a number of its own; ids come in at the end only, so rows
    that share an id are told apart. members: doc_id, text_hash, n_shingles, class_id, component_id, and component, the node all
    of one component share. links: a, b (nodes), overlap."""
    docs = narrow(docs, "doc_id", "text")
    known = docs.where("doc_id IS NOT NULL")
    index = cut(index_rows(docs.withColumn("text_hash", F.xxhash64("text")), n, threshold, make).withColumn("row", F.monotonically_increasing_id()))
    full = index.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # the row of the least id stands for its class
    classes = cut(full.groupBy(*SET).agg(F.min(F.struct("doc_id", "row")).alias("least")).select(*SET, F.col("least.doc_id").alias("class_id"), F.col("least.row").alias("node")))
    others = cut(full.select("row", *SET).join(classes, SET).where("row <> node").select("row"))
    others = F.broadcast(others) if others.count() <= BROADCAST_IDS else others
    firsts = full.join(others, "row", "left_anti").withColumnRenamed("row", "node")
    postings = firsts.select("node", "doc_id", "n_shingles", F.explode(F.array_distinct("keys")).alias("gram"))
    shared = postings.groupBy("gram").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("gram")
    lists = cut(postings.join(shared, "gram"))
    profiles = firsts.select("node", "n_shingles", "profile")
    # leaders of about the member's size: in one bucket sizes differ by less than the threshold allows
    bucket = F.floor(F.log("n_shingles") / F.lit(float(np.log(100 / threshold)) or 1.0)) if threshold < 100 else F.col("n_shingles")
    lists = lists.withColumn("bucket", bucket)
    # the least doc_id leads: what copies were made of is mostly the first of them
    leaders = lists.groupBy("gram", "bucket").agg(F.min(F.struct("doc_id", "node"))["node"].alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = cut(lists.join(leaders, ["gram", "bucket"]).where("node <> a").select("a", F.col("node").alias("b")).distinct())
    possible = cut(_possible(first, profiles, threshold))
    links = cut(_search(possible, _fetched(known, classes, possible, n), threshold, overlaps))
    joined = cut(grouped(links))
    # what the first round left apart: lists that hold more than one component
    comp = lists.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    comp = cut(comp.select("gram", "node", "n_shingles", "component"))
    split = comp.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low < high").select("gram", "members")
    rest = cut(comp.join(split, "gram"))
    short, long = rest.where(F.col("members") <= LONG), rest.where(F.col("members") > LONG)
    x, y = short.alias("x"), short.alias("y")
    fits = f"least(x.n_shingles, y.n_shingles) * 100 >= greatest(x.n_shingles, y.n_shingles) * {threshold}"
    pairs = x.join(y, F.col("x.gram") == F.col("y.gram")).where("x.node < y.node AND x.component <> y.component").where(fits)
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    possible = cut(_possible(pairs, profiles, threshold).unionByName(_blocks(long, profiles, threshold)).distinct())
    links = cut(links.unionByName(_search(possible, _fetched(known, classes, possible, n), threshold, overlaps)))
    # ids come back: the least of each component's classes
    placed = cut(classes.join(grouped(links), "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
    placed = placed.join(least, "component").select(*SET, "class_id", "component", "component_id")
    out = index.select("doc_id", "text_hash", *SET).join(placed.where("class_id IS NOT NULL"), SET, "left")
    linked = F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_hash", "n_shingles", *[F.when(linked, F.col(c)).alias(c) for c in ("class_id", "component")], F.when(linked, F.coalesce("component_id", "doc_id")).alias("component_id")), links


def _by_lists(query: np.ndarray, sets: list[np.ndarray], need: list[int]) -> list[int]:
    return t_occurrence(query, Lists(sets), need)


def ngram_jaccard(docs: DataFrame, n: int = 5, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: doc_id, text_hash, n_shingles, class_id (least doc_id with the same set, null for the empty
    set), component (a number that all rows of a component share), component_id, for each row of docs. links: a, b (numbers of
    distinct sets), overlap: each linked pair that was needed to connect its component; pairs already connected by others are
    not searched again."""
    spark = docs.sparkSession
    prepare(spark)
    held = spark.sparkContext.broadcast(_sketch(docs, n))
    return linked_sets(docs, n, threshold, lambda: prefixes(threshold, held.value), _by_lists, components)


def keep_one(docs: DataFrame, n: int = 5, threshold: int = 80) -> DataFrame:
    """Documents without near-duplicates: of each component one row stays, of the least doc_id (of several texts with that id,
    the one with the least hash), and of rows with words that are equal in id (or have none) and text, one. Documents without words stay, and so do different texts without an id."""
    members, _ = ngram_jaccard(docs, n, threshold)
    return without_copies(docs, members)


def without_copies(docs: DataFrame, members: DataFrame) -> DataFrame:
    """docs without the rows that members puts in a component of which another row, of least doc_id, stays."""
    known = cut(members.where("component IS NOT NULL").select("doc_id", "text_hash", "component"))
    stays = known.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("stays"))
    gone = cut(known.join(stays, "component").where("struct(doc_id, text_hash) <> stays").select("doc_id", "text_hash").distinct())
    inner = [{"doc_id": "doc_id", "text": "text"}.get(c, f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*inner).withColumn("text_hash", F.xxhash64("text"))
    out = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ["doc_id", "text_hash"], "left_anti").select(*inner)
    # few rows repeat: only these are gathered, each group by its least row, before the shuffle
    out = out.withColumn("same", F.when(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text")))
    repeated = cut(out.where("same IS NOT NULL").groupBy("same").count().where("count > 1").select("same"))
    few = repeated.count()
    if not few:
        return out.select(*inner).toDF(*docs.columns)
    repeated = F.broadcast(repeated) if few <= BROADCAST_IDS else repeated
    again = out.join(repeated, "same", "left_semi").groupBy("same", "doc_id", "text").agg(F.min_by(F.struct(*inner), F.xxhash64(F.lit(0), *[c for c in inner if c not in ("doc_id", "text")])).alias("r"))
    return out.join(repeated, "same", "left_anti").select(*inner).unionByName(again.select("r.*")).toDF(*docs.columns)
