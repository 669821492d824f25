"""Substring dedup by relative Lempel-Ziv parsing against every indexed reference block.

A word is removed when a window of ``window`` consecutive words covers it and the same window also starts in a
document with a smaller doc_id. The parse is distributed and exact:

1. Every window holds an anchor: the least-hashed k-gram among its k-grams (a minimiser), which depends on the
   window's content only. Anchors of all documents are aggregated; those in two different texts stay, each with
   the least document that holds it.
2. That document's words around its shared anchors are the reference blocks. Each other document's words around
   the anchor go to the block and are factored greedily: at each position the longest match in the indexed block,
   found over its k-grams and prolonged by binary search on prefix hashes, is one factor. Factors of a window or
   more are duplicate spans.
3. Windows that cross a factor boundary are looked up among the block's windows; those still unmatched are checked
   exactly against all other documents' unmatched windows by a distributed minimum per window hash.

Copies of a whole text are settled by their hash before that: every window of a later copy starts in the first one.

Null text: no words. A null doc_id neither donates nor loses words. Rows that share a doc_id are texts of one document: none of
them removes words of another, and what is found of one text is applied to rows of that id and text alone. Repeated rows
are treated alike, empty tables give no rows, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hasher, cut, mix, narrow, prepare, signed, texts_of

#: Words in an anchor; the others of a window are places it may start at.
ANCHOR = 20
#: What tells texts apart.
ROW = ["doc_id", "text_hash"]
#: Documents of one reference that a task parses, and the most references that have more and are dealt out.
AT_ONCE, HOT_REFS = 512, 50_000


def minimisers(hashes: np.ndarray, places: int) -> np.ndarray:
    """For each run of ``places`` hashes the position of the least, the first of equals."""
    n = len(hashes) - places + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, width = np.arange(len(hashes)), 1
    while 2 * width <= places:  # doubling: at[i] is the place of the least of hashes[i:i+width]
        a, b = at[: len(at) - width], at[width:]
        at = np.where(hashes[b] < hashes[a], b, a)
        width *= 2
    a, b = at[:n], at[places - width : places - width + n]
    return np.where(hashes[b] < hashes[a], b, a)


def _anchors(hasher: Hasher, words: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams, and the place of each window's anchor."""
    grams = hasher.grams(words, k)
    return grams, minimisers(grams, window - k + 1)


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + window, n), -1)
    return np.cumsum(delta[:n]) > 0


class Block:
    """A reference block: word hashes, indexed by their k-grams."""

    def __init__(self, hasher: Hasher, pieces: list[np.ndarray], window: int, k: int):
        # a run of sentinels parts the pieces; no match goes over it, as each is a hash of its own
        parts = [x for i, p in enumerate(pieces) for x in (p, mix(np.array([i + 1], np.uint64) * np.uint64(0xA24BAED4963EE407)))]
        self.words = np.concatenate(parts)
        self.hasher, self.window, self.k = hasher, window, k
        self.sums = hasher.words.prefix(self.words)
        grams = hasher.grams(self.words, k)
        self.order = np.argsort(grams, kind="stable")
        self.grams = grams[self.order]
        self.windows = np.unique(hasher.grams(self.words, window))

    def longest(self, sums: np.ndarray, n: int, at: int, places: np.ndarray) -> int:
        """Length of the longest match of words[at:] with the block at one of the places."""
        powers = self.hasher.words
        low, high = np.full(len(places), self.k), np.minimum(n - at, len(self.words) - places)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = powers.span(sums, np.full(len(places), at), at + mid) == powers.span(self.sums, places, places + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return int(low.max())

    def parse(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows inside long factors or found at factor boundaries; starts of all other windows."""
        n, window = len(words), self.window
        if n < window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums, grams = self.hasher.words.prefix(words), self.hasher.grams(words, self.k)
        left, right = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        seeds = np.flatnonzero(right > left)
        inside = np.zeros(n - window + 1, bool)
        at, i = 0, 0
        while True:
            i = int(np.searchsorted(seeds, at))
            if i == len(seeds):
                break
            at = int(seeds[i])
            length = self.longest(sums, n, at, self.order[left[at] : right[at]])
            if length >= window:
                inside[at : at + length - window + 1] = True
            at += length
        rest = np.flatnonzero(~inside)
        found = np.isin(self.hasher.grams(words, window)[rest], self.windows)
        inside[rest[found]] = True
        return np.flatnonzero(inside), rest[~found]


def _first_pass(docs: DataFrame, window: int, k: int) -> DataFrame:
    """For each row of docs (doc_id, text_hash, text) the hash of its words, and its distinct anchors."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            text, found = [], []
            for _, words in hasher.chunks(texts_of(batch.column("text"))):
                grams, at = _anchors(hasher, words, window, k)
                text.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                found.append(signed(np.unique(grams[np.unique(at)])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ROW], pa.array(text, pa.binary()), pa.array(found, pa.list_(pa.int64()))], [*ROW, "same", "anchors"])

    return docs.mapInArrow(build, "doc_id long, text_hash long, same binary, anchors array<long>")


def _regions(rows: DataFrame, window: int, k: int) -> DataFrame:
    """rows: doc_id, text_hash, text, anchors array<struct<anchor, ref>>. For each reference of a text, its runs of words
    around the anchors: doc_id, text_hash, ref, starts array<int>, lengths array<int>, words binary."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            out: list[tuple] = []
            ids, lists = list(zip(*[batch.column(c).to_pylist() for c in ROW], strict=True)), batch.column("anchors")
            for i, words in hasher.chunks(texts_of(batch.column("text"))):
                part = lists[i].values
                anchor, ref = part.field("anchor").to_numpy(zero_copy_only=False).view(np.uint64), part.field("ref").to_numpy(zero_copy_only=False)
                grams, at = _anchors(hasher, words, window, k)
                order = np.argsort(anchor)
                found = np.searchsorted(anchor[order], grams[at])
                found[found == len(order)] = 0
                hit = anchor[order][found] == grams[at] if len(order) else np.zeros(len(at), bool)
                source = np.where(hit, ref[order][found], -1) if len(order) else np.zeros(0, np.int64)
                for r in np.unique(ref[order]) if len(order) else []:
                    where = np.flatnonzero(hit & (source == r))
                    if not len(where):
                        continue
                    cuts = np.flatnonzero(np.diff(where) > 1) + 1
                    firsts, lasts = where[np.concatenate([[0], cuts])], where[np.concatenate([cuts - 1, [len(where) - 1]])]
                    pieces = [words[a : b + window] for a, b in zip(firsts, lasts, strict=True)]
                    out.append((*ids[i], int(r), firsts.tolist(), [len(p) for p in pieces], np.concatenate(pieces).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in out], kind) for j, kind in enumerate((*[pa.int64()] * 3, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()))],
                [*ROW, "ref", "starts", "lengths", "words"],
            )

    return rows.mapInArrow(build, "doc_id long, text_hash long, ref long, starts array<int>, lengths array<int>, words binary")


def _parse(regions: DataFrame, window: int, k: int) -> DataFrame:
    """regions as _regions gives them. Duplicate spans (start, end) of each document that is not its own reference, and the
    hashes of windows that are still open. A reference's rows come first and are read once; documents of a hot
    reference are dealt to several tasks, each with the reference's rows."""
    counts = regions.where("doc_id <> ref").groupBy("ref").count()
    limit = max(AT_ONCE, (counts.agg(F.sum("count")).first()[0] or 0) // HOT_REFS)
    fans = cut(counts.where(F.col("count") > limit).select("ref", F.ceil(F.col("count") / limit).cast("int").alias("fan")))  # HOT_REFS rows at most
    rows = regions.join(F.broadcast(fans), "ref", "left").withColumn("fan", F.coalesce("fan", F.lit(1))).withColumn("own", F.col("doc_id") == F.col("ref"))
    deals = F.when(F.col("own"), F.sequence(F.lit(0), F.col("fan") - 1)).otherwise(F.array(F.pmod(F.xxhash64(*ROW), "fan").cast("int")))
    rows = rows.select("ref", F.explode(deals).alias("deal"), (~F.col("own")).cast("int").alias("kind"), *ROW, "starts", "lengths", "words")
    rows = rows.repartition("ref", "deal").sortWithinPartitions("ref", "deal", "kind")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, at, held, block = Hasher(), None, [], None
        for batch in batches:
            ids, spans, opened = [], [], []
            for i in range(batch.num_rows):
                ref, deal, kind, doc, text_hash, starts, lengths, words = (c[i].as_py() for c in batch.columns)
                if (ref, deal) != at:
                    at, held, block = (ref, deal), [], None
                pieces = np.split(np.frombuffer(words, np.uint64), np.cumsum(lengths)[:-1])
                if not kind:  # the block's own windows are known by the block: nothing of them is open
                    held += pieces
                    continue
                block = block or Block(hasher, held, window, k)
                found, left = [], []
                for start, piece in zip(starts, pieces, strict=True):
                    inside, rest = block.parse(piece)
                    if len(inside):
                        cuts = np.flatnonzero(np.diff(inside) > 1) + 1
                        firsts, lasts = inside[np.concatenate([[0], cuts])], inside[np.concatenate([cuts - 1, [len(inside) - 1]])]
                        found += [{"a": int(a + start), "b": int(b + start)} for a, b in zip(firsts, lasts, strict=True)]
                    if len(rest):
                        left += zip((rest + start).tolist(), signed(hasher.grams(piece, window)[rest]).tolist(), strict=True)
                ids.append((doc, text_hash))
                spans.append(found)
                opened.append([{"place": p, "hash": h} for p, h in left])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([x[j] for x in ids], pa.int64()) for j in (0, 1)], pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(opened, pa.list_(pa.struct([("place", pa.int32()), ("hash", pa.int64())])))],
                [*ROW, "spans", "opened"],
            )

    return rows.mapInArrow(build, "doc_id long, text_hash long, spans array<struct<a:int,b:int>>, opened array<struct<place:int,hash:long>>")


def duplicate_spans(docs: DataFrame, window: int = 50) -> tuple[DataFrame, DataFrame]:
    """(spans, copies). spans: doc_id, text_hash, a, b: every window that starts at words a to b of that text is a duplicate.
    copies: doc_id, text_hash of the texts whose words are, all in all, those of a document with a smaller doc_id."""
    k = min(ANCHOR, window)
    known = narrow(docs, "doc_id", "text").where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    seen = cut(_first_pass(known, window, k))
    firsts = cut(seen.groupBy("same").agg(F.min("doc_id").alias("first_id")))
    own = seen.join(firsts, (seen["same"] == firsts["same"]) & (seen["doc_id"] == firsts["first_id"]), "left_semi")
    anchors = own.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last")).where("ref < last").select("anchor", "ref")
    held = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "ref")).alias("anchors"))
    rows = known.join(cut(held), "doc_id")
    regions = cut(_regions(rows, window, k))
    parsed = cut(_parse(regions, window, k))
    spans = parsed.select(*ROW, F.explode("spans").alias("s")).select(*ROW, "s.a", "s.b")
    opened = parsed.select(*ROW, F.explode("opened").alias("o")).select(*ROW, "o.place", "o.hash")
    least = opened.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hash", "least")
    late = opened.join(least, "hash").where("doc_id > least").select(*ROW, F.col("place").alias("a"), F.col("place").alias("b"))
    copies = seen.join(firsts, "same").where("first_id < doc_id").select(*ROW).distinct()
    return spans.unionByName(late), copies


def _decisions(docs: DataFrame, window: int) -> DataFrame:
    spans, copies = duplicate_spans(docs, window)
    packed = spans.groupBy(*ROW).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return cut(packed.join(copies.withColumn("copy", F.lit(True)), ROW, "full")).toDF(*ROW, "c_spans", "c_copy")


def _removed(rows: DataFrame, window: int, columns: str) -> DataFrame:
    """rows: any columns, of which c_text, c_spans and c_copy are read; adds what is left of each text."""
    names = [c for c in rows.columns if c not in ("c_spans", "c_copy")]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, copies, removed, sums, kept, count = batch.column("c_spans"), batch.column("c_copy").to_pylist(), [], [], [], []
            for i, raw in enumerate(texts_of(batch.column("c_text"))):
                words = raw.split()
                gone = np.zeros(len(words), bool)
                if copies[i] and len(words) >= window:
                    gone[:] = True
                elif spans[i].is_valid:
                    part = spans[i].values
                    for a, b in zip(part.field("a").to_pylist(), part.field("b").to_pylist(), strict=True):
                        gone[a : b + window] = True
                stay = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                count.append(len(words))
                removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
                sums.append(hashlib.sha256(kept[-1]).hexdigest())
            made = [pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], [*names, "c_words", "c_removed", "c_kept", "c_sha256"])

    return rows.mapInArrow(remove, f"{columns}, c_words long, c_removed long, c_kept string, c_sha256 string")


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and kept_sha256 for each row of docs."""
    prepare(docs.sparkSession)
    rows = narrow(docs, "doc_id", "text").select("doc_id", F.col("text").alias("c_text"), F.xxhash64("text").alias("text_hash"))
    rows = rows.join(_decisions(docs, window), ROW, "left").select("doc_id", "c_text", "c_spans", "c_copy")
    out = _removed(rows, window, "doc_id long, c_text string")
    return out.select("doc_id", F.col("c_words").alias("n_words"), F.col("c_removed").alias("n_removed"), F.col("c_kept").alias("kept"), F.col("c_sha256").alias("kept_sha256"))


def strip_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with the duplicate windows cut out of text (then its words are joined by one space) and n_chars, where there
    is one, recounted. Documents of which nothing is left go; all others stay, unchanged ones to the character."""
    prepare(docs.sparkSession)
    inner = [{"doc_id": "doc_id", "text": "c_text"}.get(c, f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.toDF(*inner)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.withColumn("text_hash", F.xxhash64("c_text")).join(_decisions(docs, window), ROW, "left").select(*inner, "c_spans", "c_copy")
    out = _removed(rows, window, kinds).where("c_removed = 0 OR c_removed < c_words")
    text = F.when(F.col("c_removed") > 0, F.col("c_kept")).otherwise(F.col("c_text"))
    made = {"text": text, "n_chars": F.when(F.col("c_removed") > 0, F.length("c_kept").cast("long")).otherwise(F.col(inner[docs.columns.index("n_chars")])) if "n_chars" in docs.columns else None}
    return out.select(*[made.get(c, F.col(i)).alias(c) for c, i in zip(docs.columns, inner, strict=True)])
