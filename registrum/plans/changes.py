"""Queries about changes to the register: duplicates by name, issues after edits, tables kept by key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import memory, rules
from ..sources import register as R
from ..sources.keyed import KeyedTable
from ..sources.shared import kept, shared_folder
from .queries import AS_OF, _issues_sql, _query, with_views

#: The duplicates of the records in a table, as the rules state them: every pair, then a message from the first five.
_DUPLICATES = """, ids_{t} AS (SELECT record_id, lower(status) AS status, lower(village) AS v, lower(district) AS dd, status <> 'REJECTED' AS live, unnest(list_distinct([upper(survey_number), upper(khasra_number)])) AS id FROM {t} WHERE village <> '' AND district <> ''),
 met_{t} AS (SELECT DISTINCT a.record_id, b.record_id AS other, b.status FROM ids_{t} a JOIN ids_{t} b ON a.v = b.v AND a.dd = b.dd AND a.id = b.id AND a.record_id <> b.record_id AND b.live WHERE a.id <> ''),
 dup_{t} AS (SELECT record_id, count(*) AS n_others, 'the plot is also in ' || string_agg('#' || other || ' (' || status || ')', ', ' ORDER BY other) FILTER (k <= 5) || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END AS message
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY other) AS k FROM met_{t}) GROUP BY 1)"""


@_query(with_views(_DUPLICATES.format(t="recs") + " SELECT record_id, n_others, message FROM dup_recs"))
def duplicate_references(spark, d):
    """Who else holds a record's plot: the first five by name, the others by number."""
    r = R.records(spark, d)
    pool = rules.owners(r)
    counts = rules.duplicate_references(r, pool).select("record_id", "n_others")
    return rules.duplicate_issues(r, pool).select("record_id", "message").join(counts, "record_id")


def _edited(records):
    """An afternoon's work on the register: villages renamed, records rejected, owners wiped out."""
    k = F.col("record_id")
    village = F.when(k % 6 == 0, F.concat("village", F.lit(" Khurd"))).otherwise(F.col("village"))
    return records.withColumns({"village": village, "status": F.when(k % 35 == 0, "REJECTED").otherwise(F.col("status")), "owner_name": F.when(k % 55 == 0, "").otherwise(F.col("owner_name"))})


_EDITED = """, ed AS (SELECT * REPLACE (CASE WHEN record_id % 6 = 0 THEN village || ' Khurd' ELSE village END AS village, CASE WHEN record_id % 35 = 0 THEN 'REJECTED' ELSE status END AS status, CASE WHEN record_id % 55 = 0 THEN '' ELSE owner_name END AS owner_name) FROM recs)"""
_CHANGED = "record_id % 6 = 0 OR record_id % 35 = 0 OR record_id % 55 = 0"
_EDITED_ISSUES = _EDITED + _issues_sql(AS_OF, "ed_iss").replace("FROM recs", "FROM ed") + _DUPLICATES.format(t="ed") + """, all_ed AS (SELECT * FROM ed_iss
 UNION ALL SELECT record_id, 'DUPLICATE_PLOT', 'survey_number', 'error', message FROM dup_ed
 UNION ALL SELECT record_id, 'STATE_DISTRICT', 'district', 'warning', district || ' is not listed under ' || state FROM ed WHERE lower(state) IN (SELECT lower(r_name) FROM pl) AND NOT EXISTS (SELECT 1 FROM pl WHERE lower(r_name) = lower(state) AND lower(n_name) = lower(district)))"""


def _kept_records(spark, d):
    """The records, joined once for all that reads them."""
    return kept(R.records(spark, d).drop("overall_confidence", "created_at"))


def _listed(spark, d):
    return R.places(spark, d).select(F.col("r_name").alias("state"), F.col("n_name").alias("district"))


@_query(with_views(_EDITED_ISSUES + " SELECT * FROM all_ed"))
def incremental_revalidation(spark, d):
    """The issues after edits, from those before them: only what the edits touch is validated again."""
    before = _kept_records(spark, d)
    found = rules.revalidated(before, AS_OF, _listed(spark, d))
    return rules.revalidated_changes(before, _edited(before), before.where(_CHANGED), found, AS_OF, _listed(spark, d))


def _folder(spark):
    """A new folder for a table that a query keeps."""
    return f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


ISSUE = "record_id long, rule_code string, field_name string, severity string, message string"


@_query(with_views(_EDITED_ISSUES + " SELECT * FROM all_ed"))
def revalidation_store(spark, d):
    """The same on a stored table of issues, two batches of edits, the second given twice."""
    before = _kept_records(spark, d)
    after = _edited(before)
    first = "record_id % 6 = 0"
    half = after.where(first).unionByName(before.where(f"NOT ({first})"))
    store = KeyedTable(spark, _folder(spark), ["record_id"], ISSUE)
    store.create(rules.revalidated(before, AS_OF, _listed(spark, d)))
    rules.revalidate_store(store, before, half, before.where(first), AS_OF, _listed(spark, d), batch_id=1)
    for _ in range(2):
        rules.revalidate_store(store, half, after, before.where(_CHANGED).where(f"NOT ({first})"), AS_OF, _listed(spark, d), batch_id=2)
    return store.read()


@_query(with_views("SELECT document_id, CASE WHEN document_id % 97 = 0 THEN 'REPROCESSED' ELSE status END AS status, page_count FROM docs UNION ALL SELECT -document_id, 'NEW', 1 FROM docs WHERE document_id % 997 = 0"))
def keyed_documents(spark, d):
    """A stored table of documents after an upsert that rewrites the partitions of its keys."""
    docs = R.documents(spark, d).select("document_id", "status", "page_count")
    store = KeyedTable(spark, _folder(spark), ["document_id"], "document_id long, status string, page_count long", 32)
    store.create(docs)
    new = docs.where("document_id % 997 = 0").select((-F.col("document_id")).alias("document_id"), F.lit("NEW").alias("status"), F.lit(1).cast("long").alias("page_count"))
    store.upsert(docs.where("document_id % 97 = 0").withColumn("status", F.lit("REPROCESSED")).unionByName(new), 1)
    return store.read()


_LEARNT = tuple(f for f in R.FIELDS if f in ("owner_name", "village", "district", "state"))


@_query(with_views("""SELECT field_name, raw_value, corrected_value, row_number() OVER (ORDER BY round, field_name, raw_value, corrected_value) AS id FROM (
 SELECT DISTINCT field_name, lower(regexp_replace(trim(value), '[aeioAEIO]', '0', 'g')) AS raw_value, value AS corrected_value, 1 AS round FROM flds WHERE field_name IN ('village', 'state') AND length(value) >= 3 AND regexp_matches(value, '[aeioAEIO]')
 UNION ALL SELECT DISTINCT field_name, lower(value) || '~', value, 2 FROM flds WHERE field_name IN ('district') AND length(value) >= 3)
 WHERE round = 2 OR length(regexp_replace(corrected_value, '[aeioAEIO]', '', 'g')) >= 0.55 * length(corrected_value)"""))
def correction_rounds(spark, d):
    """What memory holds after three rounds of verification, the last of which brings nothing new; ids follow the order of learning."""
    seen = R.fields(spark, d).where(F.col("field_name").isin(*_LEARNT)).select("field_name", "value")
    known = spark.createDataFrame([], "id long, field_name string, raw_value string, corrected_value string, times_applied long")
    zeros = F.regexp_replace("value", "[aeioAEIO]", "0")
    first = seen.where("field_name IN ('village', 'state')").select("field_name", zeros.alias("raw_value"), F.col("value").alias("corrected_value"))
    second = seen.where("field_name = 'district'").select("field_name", F.concat("value", F.lit("~")).alias("raw_value"), F.col("value").alias("corrected_value"))
    for batch in (first, second, first.unionByName(second)):
        known = memory.record_corrections(known, batch, _LEARNT)
    return known.select("id", "field_name", "raw_value", "corrected_value")
