"""Document fingerprints by I-Match, in DataFrame operations only.

The lexicon holds the terms (lower-cased words) whose document frequency lies in a band, LOW to HIGH of all documents.
It is a table of any size, joined to the terms of the texts: broadcast if it is small, else shuffled. SUBSETS
are random parts of the lexicon, drawn by a hash of term and number: some hold one term in 16, some in 64 or 256,
for short and for long texts. A fingerprint is a hash of the document's sorted distinct terms in each subset, ``-`` where
there are none. Texts without any such term are hashed as they are.

Likeness: of the subsets in which either text has terms, the share with equal hashes. Null text is the empty text.
Equal texts have equal fingerprints. Rows are cut into windows by ranges of their ids, whatever ids there are; rows of
one id, or without one, are ordered by their texts' hashes, a null id comes last. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, narrow, range_of

#: Band of document frequency, as one in so many documents.
LOW, HIGH = 100, 5
#: Each subset keeps one lexicon term in so many.
SUBSETS = (16,) * 8 + (64,) * 8 + (256,) * 8
#: Bytes of lexicon terms, with 32 for each row, that may be broadcast; more are joined.
BROADCAST_BYTES = 8 << 20
_SPACE = r"[\x20\x09-\x0D]+"
#: Documents whose neighbours one window finds, about, and the most windows: beyond that many documents, windows grow.
_BUCKET, MOST_BUCKETS = 2048, 8192


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), _SPACE))


def lexicon(docs: DataFrame) -> DataFrame:
    """term, members: the terms of any subset; bit k of members stands for subset k."""
    total = docs.count()
    # explode_outer: for explode, the optimiser filters by the array first and so computes it several times
    df = docs.select(F.explode_outer(terms(F.col("text"))).alias("term")).where("term <> ''").groupBy("term").count()
    band = df.where((F.col("count") * LOW >= total) & (F.col("count") * HIGH <= total))
    # a row for each subset, then gathered by the same term: were the draws a condition on the term alone, the optimiser
    # would make them one on every word of the texts that the lexicon is joined to, also past the cut
    drawn = F.conv(F.substring(F.md5(F.concat("term", F.lit(":"), F.col("k").cast("string"))), 1, 4), 16, 10).cast("int") * F.col("one_in") < 65536
    subsets = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("one_in"), F.lit(1 << k).cast("long").alias("bit")) for k, n in enumerate(SUBSETS)]))
    return cut(band.select("term", subsets).where(drawn).groupBy("term").agg(F.sum("bit").alias("members")))


def printed(rows: DataFrame, lex: DataFrame) -> DataFrame:
    """rows (bucket, turn, text, edited, others) without the texts, but with the fingerprints ``own`` of text and ``other``
    of edited. Where lex is broadcast, a bucket's rows stay where they are: nothing is shuffled."""
    size = lex.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    # a lexicon too large to broadcast means long texts, of which no term is more than a small share of all
    lex = F.broadcast(lex) if size <= BROADCAST_BYTES else lex.hint("merge")
    kept = [c for c in rows.columns if c not in ("bucket", "turn", "text", "edited")]
    rows = rows.select("bucket", "turn", F.struct(*kept, F.md5(F.col("text").cast("binary")).alias("md5"), F.md5(F.col("edited").cast("binary")).alias("edited_md5")).alias("row"), F.array("text", "edited").alias("texts"))
    rows = rows.select("bucket", "turn", "row", F.posexplode_outer("texts").alias("kind", "text"))
    # one more entry for each text, a blank before it as no term has, carries the row; it keeps texts without terms
    mark = F.concat(F.lit(" "), F.xxhash64("bucket", "turn", "kind").cast("string"))
    found = rows.select("bucket", "turn", "kind", "row", F.explode_outer(F.array_append(terms(F.col("text")), mark)).alias("term"))
    marked = F.col("term").startswith(" ")
    found = found.select("bucket", "turn", "kind", "term", F.when(marked & (F.col("kind") == 0), F.col("row")).alias("row"))
    found = found.join(lex, "term", "left").where(F.col("members").isNotNull() | marked)

    def terms_of(kind: int) -> Column:
        return F.collect_set(F.when(F.col("members").isNotNull() & (F.col("kind") == kind), F.struct("term", "members")))

    def hashed(own: Column, k: int) -> Column:
        part = F.transform(F.filter(own, lambda t: t["members"].bitwiseAND(F.lit(1 << k)) != 0), lambda t: t["term"])
        return F.when(F.size(part) == 0, "-").otherwise(F.substring(F.md5(F.array_join(part, " ").cast("binary")), 1, 8))

    def whole(own: str, md5: str) -> Column:
        # transform over a single element names the sorted list once, so it is not computed for each subset
        parts = F.transform(F.array(F.sort_array(own)), lambda own: F.concat_ws(":", *[hashed(own, k) for k in range(len(SUBSETS))]))
        return F.when(F.size(own) == 0, F.concat(F.lit("text:"), F.col(md5))).otherwise(F.element_at(parts, 1))

    found = found.groupBy("bucket", "turn").agg(F.first("row", True).alias("row"), terms_of(0).alias("own"), terms_of(1).alias("other"))
    return found.select("bucket", "turn", *[F.col(f"row.{c}").alias(c) for c in kept], whole("own", "row.md5").alias("own"), whole("other", "row.edited_md5").alias("other"))


def likeness(a: Column, b: Column) -> Column:
    pairs = F.arrays_zip(F.split(a, ":").alias("a"), F.split(b, ":").alias("b"))
    either = F.size(F.filter(pairs, lambda p: (p["a"] != "-") | (p["b"] != "-")))
    equal = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != "-")))
    return F.when(a.startswith("text:") | b.startswith("text:"), (a == b).cast("double")).otherwise(equal / either)


def _before(heads: DataFrame) -> DataFrame:
    """heads (bucket, others) with head_of, the bucket before each by descending order; the last one's is the first bucket."""
    turn = Window.orderBy(F.desc("bucket"))  # a row for each bucket, MOST_BUCKETS at most
    return heads.withColumn("head_of", F.coalesce(F.lag("bucket").over(turn), F.min("bucket").over(Window.partitionBy()))).drop("bucket")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and text, with next_text of the next row by descending doc_id (after the last comes the first); bucket and turn,
    the row's place: turns count from 1 in each bucket, buckets descend."""
    unsigned = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    docs = docs.withColumn("place", F.concat(F.when(F.col("doc_id").isNull(), "0").otherwise(F.concat(F.lit("1"), unsigned)), F.md5(F.col("text").cast("binary"))))
    n = docs.count()
    parts = min(-(-n // _BUCKET), MOST_BUCKETS)
    sample = docs.where(F.pmod(F.xxhash64("place"), F.lit(max(1, n // max(1, 20 * parts)))) == 0)
    keys = sorted(r["place"] for r in sample.select("place").distinct().collect())  # about 20 for each bucket
    docs = docs.withColumn("bucket", range_of(F.col("place"), sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []))
    heads = _before(docs.groupBy("bucket").agg(F.max("place").alias("head")))
    heads = docs.join(F.broadcast(heads), F.col("place") == F.col("head")).groupBy("head_of").agg(F.max("text").alias("head_text"))
    order = Window.partitionBy("bucket").orderBy(F.desc("place"))
    rows = docs.withColumn("turn", F.row_number().over(order)).withColumn("lead_text", F.lead("text").over(order))
    rows = rows.join(heads, rows["bucket"] == heads["head_of"], "left")
    return rows.select("bucket", "turn", "doc_id", "text", F.coalesce("lead_text", "head_text").alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, of each text, and the same of its edited text: edited_sha256, edited_fingerprint;
    near_edited and near_next, the likeness to the edited text's and to the next document's fingerprint."""
    docs = narrow(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lex = lexicon(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - half), F.substring("next_text", 1, half))
    rows = with_next(docs).withColumn("edited", edited)
    sha256 = F.sha2(F.col("edited").cast("binary"), 256)
    rows = printed(rows.select("bucket", "turn", "doc_id", F.length("text").cast("long").alias("n_chars"), sha256.alias("edited_sha256"), "text", "edited"), lex)
    rows = cut(rows.withColumn("next_own", F.lead("own").over(Window.partitionBy("bucket").orderBy("turn"))))
    heads = _before(rows.where("turn = 1").select("bucket", F.col("own").alias("head_own")))
    rows = rows.join(F.broadcast(heads), rows["bucket"] == heads["head_of"], "left").withColumn("next_own", F.coalesce("next_own", "head_own"))
    return rows.select("doc_id", "n_chars", "edited_sha256", F.col("own").alias("fingerprint"), F.col("other").alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))


def fingerprints_sql() -> str:
    """The same in SQL."""
    member = " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(SUBSETS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text,
             coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM d),
f AS (SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited FROM e),
t AS (SELECT doc_id, 0 AS kind, unnest(list_distinct(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'))) AS term FROM f
      UNION ALL SELECT doc_id, 1, unnest(list_distinct(regexp_extract_all(lower(edited), '[^\x20\x09-\x0D]+'))) FROM f),
band AS (SELECT term FROM t WHERE kind = 0 GROUP BY term HAVING count(*) * {LOW} >= (SELECT count(*) FROM d) AND count(*) * {HIGH} <= (SELECT count(*) FROM d)),
lex AS (SELECT term, k FROM band, range({len(SUBSETS)}) r(k) WHERE ('0x' || substring(md5(term || ':' || k), 1, 4))::INT * CASE k {member} END < 65536),
h AS (SELECT doc_id, kind, k, substring(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS h FROM t JOIN lex USING (term) GROUP BY ALL),
g AS (SELECT doc_id, kind, string_agg(coalesce(h.h, '-'), ':' ORDER BY k) AS p
      FROM (SELECT DISTINCT doc_id, kind FROM h) CROSS JOIN range({len(SUBSETS)}) r(k) LEFT JOIN h USING (doc_id, kind, k) GROUP BY ALL),
p AS (SELECT f.*, coalesce(a.p, 'text:' || md5(text)) AS fp, coalesce(b.p, 'text:' || md5(edited)) AS ep
      FROM f LEFT JOIN g a ON a.doc_id = f.doc_id AND a.kind = 0 LEFT JOIN g b ON b.doc_id = f.doc_id AND b.kind = 1),
q AS (SELECT p.*, n.fp AS np FROM p JOIN p n ON n.doc_id = p.next_id)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, ep AS edited_fingerprint,
       {_like_sql('fp', 'ep')} AS near_edited, {_like_sql('fp', 'np')} AS near_next
FROM q"""


def _like_sql(a: str, b: str) -> str:
    pairs = f"list_zip(string_split({a}, ':'), string_split({b}, ':'))"
    return f"""CASE WHEN {a} LIKE 'text:%' OR {b} LIKE 'text:%' THEN ({a} = {b})::INT::DOUBLE ELSE
       len(list_filter({pairs}, lambda z: z[1] = z[2] AND z[1] <> '-'))::DOUBLE / len(list_filter({pairs}, lambda z: z[1] <> '-' OR z[2] <> '-')) END"""
