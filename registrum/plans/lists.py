"""Queries about finding things: words in nested JSON, substring search, deep pages, the dashboard in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dashboard as dashboards
from ..operators import filters, rules
from ..operators.paging import OrderedList
from ..operators.search import SubstringIndex
from ..sources import json_walk
from ..sources import register as R
from .changes import _folder
from .queries import _ISSUES, _MEMORY, AS_OF, _memory, _query, with_views

#: How a response nests its words, by the order's number modulo 5: containers from the outside in.
_NESTS = (("tokens",), ("regions", "words"), ("regions", "lines", "words"), ("output", "regions", "lines", "tokens"), ("pipelineResponse", "output", "regions", "regions", "lines", "words"))


def _responses(spark, d):
    """For each order the JSON of a recognition service: a word for each line item, one to five levels deep, keys of both families."""
    i = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("text"))
    s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    x, y = F.col("l_partkey") % 1000, F.col("l_suppkey") % 700
    corner = s('{"source":"', F.col("text"), '","conf":', F.col("q"), ',"bbox":{"x":', x, ',"y":', y, ',"w":', F.col("q") + 10, ',"h":20}}')
    points = s('{"text":"', F.col("text"), '","confidence":', F.col("q") / F.lit(100.0), ',"boundingBox":{"vertices":[{"x":', x, ',"y":', y, '},{"x":', x + F.col("q") + 10, ',"y":', y, '},{"y":', y + 20, ',"x":', x, "}]}}")
    word = F.when(F.col("n") % 2 == 0, corner).otherwise(points)
    words = i.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "l_partkey", "text", "q", "l_suppkey", word.alias("w")))), lambda w: w["w"]), ",").alias("words"))

    def nested(keys: tuple[str, ...]):
        return s(reduce(lambda left, k: f'{left}{{"{k}":[', keys, ""), F.col("words"), "]}" * len(keys))

    body = reduce(lambda a, k: F.when(F.col("doc_id") % 5 == k, nested(_NESTS[k])).otherwise(a), range(5), F.lit("no json"))
    return words.select("doc_id", body.alias("body"))


_WORDS = """SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity::BIGINT, l_suppkey) - 1)::INT AS place, l_returnflag AS text, CASE WHEN l_linenumber % 2 = 0 AND l_quantity < 2 THEN 1.0 ELSE l_quantity::BIGINT / 100.0::DOUBLE END AS confidence,
 l_partkey % 1000 AS x, l_suppkey % 700 AS y, l_quantity::BIGINT + 10 AS w, 20::BIGINT AS h FROM lineitem"""


@_query(_WORDS)
def json_words(spark, d):
    """The words of all responses, whatever they are nested in."""
    found = json_walk.words_of_json(_responses(spark, d))
    return found.select("doc_id", F.element_at("path", -1).alias("place"), "text", "confidence", "x", "y", "w", "h")


@_query(f"SELECT doc_id, string_agg(text, chr(10) ORDER BY place) AS text, count(*) AS n_words FROM ({_WORDS}) GROUP BY 1")
def json_texts(spark, d):
    return json_walk.text_of_json(json_walk.words_of_json(_responses(spark, d))).select("doc_id", "text", "n_words")


_SEARCHED = ["owner_name", "survey_number", "khasra_number", "khata_number", "village", "district"]
#: Texts that are searched for: within names, identifiers and places, across a mark, short, and one that nothing holds.
_TEXTS = ("0077", "12/1", "kh-00", "furn", "NATION_1", "k4", "no such text", " 05 ")


def _searched(spark, d):
    return R.records(spark, d).withColumn("khata_number", F.concat(F.lit("KH-"), F.lpad((F.col("record_id") % 700).cast("string"), 5, "0")))


@_query(with_views(", s AS (SELECT *, 'KH-' || lpad((record_id % 700)::VARCHAR, 5, '0') AS khata_number FROM recs) " + " UNION ALL ".join(
    f"SELECT '{t.strip().lower()}' AS searched, record_id, village FROM s WHERE " + " OR ".join(f"contains(lower({c}), '{t.strip().lower()}')" for c in _SEARCHED) for t in _TEXTS)))
def substring_search(spark, d):
    """Several searches over six columns, through the stored trigrams."""
    index = SubstringIndex(spark, _folder(spark), "record_id", _SEARCHED)
    index.build(_searched(spark, d))
    return reduce(lambda a, b: a.unionByName(b), [index.search(t).select(F.lit(t.strip().lower()).alias("searched"), "record_id", "village") for t in _TEXTS])


@_query(with_views("""SELECT record_id, status, row_number() OVER (ORDER BY created_at DESC, record_id DESC) AS rank, (SELECT count(*) FROM recs) AS count, page, (SELECT ceil(count(*) / 20.0)::BIGINT FROM recs) AS pages FROM
 (SELECT *, (row_number() OVER (ORDER BY created_at DESC, record_id DESC) - 1) // 20 + 1 AS page FROM recs) QUALIFY page IN (1, (SELECT ceil(count(*) / 40.0)::BIGINT FROM recs), (SELECT ceil(count(*) / 20.0)::BIGINT FROM recs))"""))
def deep_pages(spark, d):
    """The first page of the record list, one in its middle, and the last."""
    listed = OrderedList(spark, _folder(spark), ["-created_at", "-record_id"])
    listed.build(R.records(spark, d).select("record_id", "status", "created_at"))
    pages = -(-sum(n for _, _, n in listed.begins()) // 20)
    rows = reduce(lambda a, b: a.unionByName(b), [listed.page(n, 20) for n in dict.fromkeys((1, -(-pages // 2), pages))])
    return rows.drop("created_at")


@_query(with_views("""SELECT record_id, status, row_number() OVER (ORDER BY created_at DESC, record_id DESC) AS rank FROM recs
 QUALIFY rank BETWEEN (SELECT count(*) // 3 + 1 FROM recs) AND (SELECT count(*) // 3 + 25 FROM recs)"""))
def page_after(spark, d):
    """The 25 rows that follow a given one, a third of the way down the list."""
    listed = OrderedList(spark, _folder(spark), ["-created_at", "-record_id"])
    listed.build(R.records(spark, d).select("record_id", "status", "created_at"))
    key = listed.slice(sum(n for _, _, n in listed.begins()) // 3 - 1, 1).first()
    return listed.after(key.asDict(), 25).drop("created_at")


@_query(with_views("""SELECT document_id, original_name, state_name, d.status AS status, record_id, record_status, count(*) OVER () AS count, 3::BIGINT AS page, ceil(count(*) OVER () / 20.0)::BIGINT AS pages
 FROM (SELECT docs.*, record_id, recs.status AS record_status FROM docs LEFT JOIN recs ON record_id = document_id WHERE docs.status = 'PROCESSED') d ORDER BY uploaded_at DESC, document_id DESC LIMIT 20 OFFSET 40"""))
def documents_api(spark, d):
    """The third page of the processed documents, newest first, each with its record if it has one, and the envelope."""
    docs = R.documents(spark, d).where("status = 'PROCESSED'")
    rows = filters.page(docs, [F.desc("uploaded_at"), F.desc("document_id")], 3, 20)
    own = R.records(spark, d).select("record_id", F.col("status").alias("record_status"))
    rows = rows.join(own, rows["document_id"] == own["record_id"], "left")
    return rows.select("document_id", "original_name", "state_name", "status", "record_id", "record_status", "count", "page", "pages")


@_query(with_views("SELECT record_id, left(repeat(village || ' ', 1 + record_id % 12), 120) AS village, left(pincode || '-' || record_id, 10) AS pincode, owner_name FROM recs"))
def stored_records(spark, d):
    """Values as a record stores them: no longer than their column."""
    long = {"village": F.repeat(F.concat("village", F.lit(" ")), (1 + F.col("record_id") % 12).cast("int")), "pincode": F.concat("pincode", F.lit("-"), "record_id")}
    rows = R.records(spark, d).withColumns(long)
    return rows.select("record_id", *[X.stored(c).alias(c) for c in ("village", "pincode", "owner_name")])


_LANGUAGES = ("eng", "hin", "tam", "")


def _dashboard_sql() -> str:
    def by(part: str, source: str, name: str, label: str, **measures: str) -> list[str]:
        return [f"SELECT '{part}' AS part, '{name}' AS series, {label} AS label, '{m}' AS measure, ({e})::DOUBLE AS value FROM {source} WHERE {label} <> '' GROUP BY 3" for m, e in measures.items()]

    def total(part: str, source: str, **measures: str) -> list[str]:
        return [f"SELECT '{part}', 'total', NULL, '{m}', ({e})::DOUBLE FROM {source}" for m, e in measures.items()]

    done = "count(*) FILTER (status = 'PROCESSED')"
    parts = [x for n, e in (("status", "status"), ("language", "detected_language"), ("state", "state_name"), ("month", "strftime(uploaded_at, '%Y-%m')")) for x in by("documents", "dd", n, e, n="count(*)", processed=done)]
    parts += total("documents", "dd", documents="count(*)", processed=done, failed="count(*) FILTER (status = 'FAILED')", processed_pct=f"coalesce(round(100.0 * {done} / nullif(count(*), 0), 1), 0)")
    verified = "count(*) FILTER (status = 'VERIFIED')"
    parts += by("records", "rr", "status", "status", n="count(*)", verified=verified) + by("records", "rr", "state", "state", n="count(*)", verified=verified)
    parts += total("records", "rr", verified=verified, pending="count(*) FILTER (status = 'PENDING')", duplicates="count(*) FILTER (is_duplicate)", avg_confidence="round(coalesce(avg(overall_confidence), 0) * 100, 1)")
    parts += by("issues", "iss", "rule", "rule_code", n="count(*)") + by("issues", "iss", "severity", "severity", n="count(*)") + total("issues", "iss", open="count(*)")
    parts += by("fields", "flds", "source", "source", n="count(*)") + total("fields", "flds", fields_review="count(*) FILTER (needs_review AND record_id IN (SELECT record_id FROM recs WHERE status = 'PENDING'))", corrections="count(*) FILTER (source = 'manual' AND value <> '')")
    parts += by("memory", "mem", "field", "field_name", n="count(*)") + total("memory", "mem", learned="count(*)", learned_applied="sum(id % 4)")
    parts += ["SELECT 'records', 'accuracy', '#' || record_id, 'confidence', round(overall_confidence * 100, 1) FROM (SELECT * FROM recs ORDER BY created_at DESC, record_id DESC LIMIT 40)"]
    languages = ", ".join(f"'{x}'" for x in _LANGUAGES)
    made = f", {_MEMORY}, dd AS (SELECT *, [{languages}][1 + document_id % 4] AS detected_language FROM docs), rr AS (SELECT *, record_id % 29 = 0 AS is_duplicate FROM recs)"
    return with_views(_ISSUES + made + " " + " UNION ALL ".join(parts))


@_query(_dashboard_sql())
def dashboard(spark, d):
    """All counts and series of the dashboard."""
    docs = R.documents(spark, d).withColumn("detected_language", F.get(F.array(*[F.lit(x) for x in _LANGUAGES]), (F.col("document_id") % 4).cast("int")))
    r = R.records(spark, d).withColumn("is_duplicate", F.col("record_id") % 29 == 0)
    known = _memory(spark, d).withColumn("times_applied", F.col("id") % 4)
    return dashboards.whole(docs, r, rules.issues(R.records(spark, d), AS_OF), R.fields(spark, d), known)
