"""The register's named queries and their SQL. A query's name says which part of the register it serves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.labels import lexicon
from ..operators import cells, extract, filters, layout, memory, pages, quality, rules, stamps
from ..sources import files
from ..sources import register as R
from ..streaming import register as streams

AS_OF = "1998-01-01"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def with_views(body: str) -> str:
    """body: more common table expressions and the final SELECT, over docs, recs and flds."""
    return f"WITH {R.SQL.strip()}{body if body.lstrip().startswith(',') else ' ' + body}"


@_query(with_views("SELECT count(*) AS documents, count(*) FILTER (status = 'PROCESSED') AS processed, count(*) FILTER (status = 'FAILED') AS failed, sum(page_count)::BIGINT AS pages, coalesce(avg(ocr_confidence), 0) AS mean_confidence FROM docs"))
def dashboard_kpis(spark, d):
    q = R.uploads(spark, d)
    return q.agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "PROCESSED").alias("processed"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"), F.coalesce(F.avg("ocr_confidence"), F.lit(0.0)).alias("mean_confidence"))


@_query(with_views("""SELECT state_name, n_documents, n_processed, coalesce(n_verified, 0) AS n_verified FROM
 (SELECT state_name, count(*) AS n_documents, count(*) FILTER (status = 'PROCESSED') AS n_processed FROM docs GROUP BY 1)
 LEFT JOIN (SELECT state, count(*) AS n_verified FROM recs WHERE status = 'VERIFIED' GROUP BY 1) ON state = state_name"""))
def documents_by_state(spark, d):
    totals = R.documents(spark, d).groupBy("state_name").agg(F.count("*").alias("n_documents"), F.count_if(F.col("status") == "PROCESSED").alias("n_processed"))
    verified = R.records(spark, d).where("status = 'VERIFIED'").groupBy(F.col("state").alias("state_name")).agg(F.count("*").alias("n_verified"))
    return totals.join(verified, "state_name", "left").fillna(0, ["n_verified"])


@_query(with_views("SELECT date_trunc('month', uploaded_at)::DATE AS month, count(*) AS n FROM docs GROUP BY 1"))
def uploads_by_month(spark, d):
    return R.documents(spark, d).groupBy(F.trunc("uploaded_at", "month").alias("month")).agg(F.count("*").alias("n"))


@_query(with_views("SELECT 'document' AS kind, status, count(*) AS n FROM docs GROUP BY ALL UNION ALL SELECT 'record', status, count(*) FROM recs GROUP BY ALL"))
def status_counts(spark, d):
    one = R.documents(spark, d).groupBy(F.lit("document").alias("kind"), "status")
    return one.agg(F.count("*").alias("n")).unionByName(R.records(spark, d).groupBy(F.lit("record").alias("kind"), "status").agg(F.count("*").alias("n")))


@_query(with_views("SELECT record_id, overall_confidence FROM recs ORDER BY created_at DESC, record_id DESC LIMIT 40"))
def confidence_trend(spark, d):
    return R.records(spark, d).select("record_id", "overall_confidence", "created_at").orderBy(F.desc("created_at"), F.desc("record_id")).limit(40).orderBy("created_at", "record_id").drop("created_at")


@_query(with_views("SELECT record_id, owner_name, overall_confidence FROM recs WHERE status = 'PENDING' ORDER BY overall_confidence, record_id LIMIT 6"))
def lowest_pending(spark, d):
    return R.records(spark, d).where("status = 'PENDING'").orderBy("overall_confidence", "record_id").limit(6).select("record_id", "owner_name", "overall_confidence")


@_query(with_views("""SELECT document_id, original_name, docs.status AS status FROM docs LEFT JOIN recs ON record_id = document_id
 WHERE contains(lower(original_name), '77') OR contains(lower(district_name), 'fr') OR contains(lower(owner_name), '0077') ORDER BY uploaded_at DESC, document_id DESC LIMIT 12 OFFSET 12"""))
def document_search_page(spark, d):
    docs, recs = R.documents(spark, d), R.records(spark, d).select("record_id", "owner_name")
    found = docs.join(recs, docs["document_id"] == recs["record_id"], "left")
    hit = F.lower("original_name").contains("77") | F.lower("district_name").contains("fr") | F.lower("owner_name").contains("0077")
    return layout.page(found.where(hit), [F.desc("uploaded_at"), F.desc("document_id")], 2, 12).select("document_id", "original_name", "status")


@_query(with_views("""SELECT record_id, survey_number, coalesce(n_review, 0) AS n_review, coalesce(n_fields, 0) AS n_fields FROM recs
 LEFT JOIN (SELECT record_id, count(*) FILTER (needs_review) AS n_review, count(*) AS n_fields FROM flds GROUP BY 1) USING (record_id) WHERE status = 'PENDING' ORDER BY overall_confidence, record_id LIMIT 15"""))
def verify_queue(spark, d):
    pending = R.records(spark, d).where("status = 'PENDING'").select("record_id", "survey_number", "overall_confidence")
    counts = R.fields(spark, d).groupBy("record_id").agg(F.count_if("needs_review").alias("n_review"), F.count("*").alias("n_fields"))
    top = layout.page(pending, [F.col("overall_confidence"), F.col("record_id")], 1, 15)
    return top.join(counts, "record_id", "left").fillna(0, ["n_review", "n_fields"]).drop("overall_confidence")


@_query(with_views("SELECT record_id, owner_name, village, plot_area FROM recs WHERE lower(state) = 'asia' AND status <> 'REJECTED' AND overall_confidence >= 0.85 AND contains(lower(village), 'auto') AND plot_area BETWEEN 1000 AND 200000"))
def record_filters(spark, d):
    f = (F.lower("state") == "asia") & (F.col("status") != "REJECTED") & (F.col("overall_confidence") >= 0.85) & F.lower("village").contains("auto") & F.col("plot_area").between(1000, 200000)
    return R.records(spark, d).where(f).select("record_id", "owner_name", "village", "plot_area")


@_query(with_views("SELECT DISTINCT state, village FROM recs WHERE state <> '' AND village <> ''"))
def filter_choices(spark, d):
    return R.records(spark, d).where("state <> '' AND village <> ''").select("state", "village").distinct().orderBy("state", "village")


@_query(with_views("SELECT count(*) AS n FROM flds WHERE needs_review AND record_id IN (SELECT record_id FROM recs WHERE status = 'PENDING')"))
def review_fields_pending(spark, d):
    pending = R.records(spark, d).where("status = 'PENDING'").select("record_id")
    return R.fields(spark, d).where("needs_review").join(pending, "record_id", "left_semi").agg(F.count("*").alias("n"))


def _issues_sql(as_of: str, name: str = "iss") -> str:
    return f""", ha_{name} AS (SELECT *, plot_area * CASE area_unit WHEN 'acre' THEN 0.404686 ELSE 1.0 END AS area_ha, strptime(mutation_date, '%d/%m/%Y')::DATE AS day FROM recs),
{name} AS (
 SELECT record_id, 'REQUIRED_FIELD' AS rule_code, 'owner_name' AS field_name, 'error' AS severity, 'owner_name is missing' AS message FROM ha_{name} WHERE owner_name = ''
 UNION ALL SELECT record_id, 'REQUIRED_FIELD', 'plot_area', 'error', 'plot_area is missing' FROM ha_{name} WHERE plot_area IS NULL
 UNION ALL SELECT record_id, 'AREA_UNIT', 'area_unit', 'warning', 'chain is no known unit of area' FROM ha_{name} WHERE plot_area IS NOT NULL AND area_unit = 'chain'
 UNION ALL SELECT record_id, 'AREA_RANGE', 'plot_area', 'error', 'the area is outside of what a plot can have' FROM ha_{name} WHERE area_ha <= 0.0001 OR area_ha > 60000
 UNION ALL SELECT record_id, 'PINCODE_FORMAT', 'pincode', 'error', pincode || ' is no PIN code' FROM ha_{name} WHERE NOT regexp_full_match(pincode, '[1-9][0-9]{{5}}')
 UNION ALL SELECT record_id, 'DATE_FUTURE', 'mutation_date', 'error', mutation_date || ' is in the future' FROM ha_{name} WHERE day > DATE '{as_of}')"""


_ISSUES = _issues_sql(AS_OF)


@_query(with_views(_ISSUES + " SELECT * FROM iss"))
def validation_issues(spark, d):
    return rules.issues(R.records(spark, d), AS_OF)


@_query(with_views(_ISSUES + " SELECT rule_code, severity, count(*) AS n FROM iss GROUP BY ALL"))
def issue_pareto(spark, d):
    return rules.issues(R.records(spark, d), AS_OF).groupBy("rule_code", "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_code")


@_query(with_views(_ISSUES + " SELECT record_id, bool_or(severity = 'error') AS any_error, count(*) FILTER (severity = 'error') AS n_errors FROM iss GROUP BY 1"))
def record_error_flags(spark, d):
    return rules.issues(R.records(spark, d), AS_OF).groupBy("record_id").agg(F.bool_or(F.col("severity") == "error").alias("any_error"), F.count_if(F.col("severity") == "error").alias("n_errors"))


@_query(with_views("SELECT record_id, state, district FROM recs WHERE lower(state) IN (SELECT lower(r_name) FROM pl) AND NOT EXISTS (SELECT 1 FROM pl WHERE lower(r_name) = lower(state) AND lower(n_name) = lower(district))"))
def state_district_issues(spark, d):
    return rules.district_issues(R.records(spark, d), R.places(spark, d).select(F.col("r_name").alias("state"), F.col("n_name").alias("district")))


@_query(with_views(""", ids AS (SELECT DISTINCT record_id, lower(village) v, lower(district) dd, status <> 'REJECTED' AS live, unnest([upper(survey_number), upper(khasra_number)]) AS id FROM recs)
 SELECT a.record_id, count(*) AS links, count(DISTINCT a.id) AS ids FROM ids a JOIN ids b ON a.v = b.v AND a.dd = b.dd AND a.id = b.id AND a.record_id <> b.record_id AND b.live WHERE a.id <> '' GROUP BY 1"""))
def duplicate_plots(spark, d):
    return rules.duplicates(R.records(spark, d))


_W = " ".join(f"WHEN '{k}' THEN {w}" for k, (w, _) in R.FIELDS.items())


@_query(with_views(f"SELECT record_id, sum(w * greatest(confidence, CASE source WHEN 'manual' THEN 0.95 ELSE confidence END)) / sum(w) AS score FROM (SELECT *, (CASE field_name {_W} END)::DOUBLE AS w FROM flds) WHERE value <> '' GROUP BY 1"))
def weighted_confidence(spark, d):
    w = F.create_map(*[F.lit(x) for k, (v, _) in R.FIELDS.items() for x in (k, v)])[F.col("field_name")]
    c = F.greatest("confidence", F.when(F.col("source") == "manual", F.lit(0.95)).otherwise(F.col("confidence")))
    return R.fields(spark, d).where("value <> ''").groupBy("record_id").agg((F.sum(w * c) / F.sum(w)).alias("score"))


@_query(with_views("SELECT record_id, max(value) FILTER (field_name = 'village') AS village, max(value) FILTER (field_name = 'district') AS district, max(value) FILTER (field_name = 'pincode') AS pincode FROM flds GROUP BY 1"))
def fields_to_record(spark, d):
    return R.fields(spark, d).groupBy("record_id").pivot("field_name", ["village", "district", "pincode"]).agg(F.first("value"))


@_query(with_views("SELECT field_name, value, confidence, record_id FROM flds"))
def record_to_fields(spark, d):
    return R.fields(spark, d).select("field_name", "value", "confidence", "record_id")


@_query(with_views("SELECT record_id, count(*) FILTER (value <> '') AS n_found, count(*) FILTER (needs_review) AS n_review, count(*) FILTER (source = 'manual') AS n_manual FROM flds GROUP BY 1"))
def extraction_summary(spark, d):
    return R.fields(spark, d).groupBy("record_id").agg(F.count_if(F.col("value") != "").alias("n_found"), F.count_if("needs_review").alias("n_review"), F.count_if(F.col("source") == "manual").alias("n_manual"))


@_query(with_views("SELECT field_name, arg_max(record_id, (confidence, -record_id)) AS record_id, max(confidence) AS confidence FROM flds GROUP BY 1"))
def best_candidate(spark, d):
    return R.fields(spark, d).groupBy("field_name").agg(F.max_by("record_id", F.struct("confidence", -F.col("record_id"))).alias("record_id"), F.max("confidence").alias("confidence"))


@_query(with_views("SELECT conf_class, count(*) AS n FROM (SELECT CASE WHEN overall_confidence >= 0.85 THEN 'ok' WHEN overall_confidence >= 0.60 THEN 'warn' ELSE 'bad' END AS conf_class FROM recs) GROUP BY 1"))
def confidence_classes(spark, d):
    return R.records(spark, d).groupBy(X.conf_class(F.col("overall_confidence")).alias("conf_class")).agg(F.count("*").alias("n"))


_MEMORY = "mem AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS id, 'district' AS field_name, '  ' || lower(n_name) AS raw_value, upper(n_name) || '-' AS corrected_value FROM nation)"


def _memory(spark, d):
    return R.table(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("id"), F.lit("district").alias("field_name"), F.concat(F.lit("  "), F.lower("n_name")).alias("raw_value"), F.concat(F.upper("n_name"), F.lit("-")).alias("corrected_value"))


@_query(with_views(f", {_MEMORY} SELECT record_id, f.field_name, value, corrected_value AS suggestion FROM flds f JOIN mem m ON f.field_name = m.field_name AND trim(lower(value)) = trim(lower(raw_value))"))
def memory_exact(spark, d):
    return memory.suggest_exact(R.fields(spark, d).select("record_id", "field_name", "value"), _memory(spark, d))


_PLACES = ("village", "state")


def _place_memory(spark, d):
    seen = R.fields(spark, d).where(F.col("field_name").isin(*_PLACES)).select("field_name", "value").distinct()
    return seen.select(F.xxhash64("field_name", "value").alias("id"), "field_name", F.lower("value").alias("raw_value"), F.concat("value", F.lit("-")).alias("corrected_value"))


@_query(with_views("""SELECT field_name, overlay AS value, value || '-' AS suggestion, (length(value) - 1.0::DOUBLE) / length(value) AS score FROM (SELECT DISTINCT field_name, value,
 substring(value, 1, (record_id % length(value))::INT) || '~' || substring(value, 2 + (record_id % length(value))::INT) AS overlay FROM flds WHERE field_name IN ('village', 'state')) WHERE length(value) >= 5"""))
def memory_fuzzy(spark, d):
    """All villages and states with one character misread; of short ones less than 0.8 is left."""
    at = (F.col("record_id") % F.length("value")).cast("int")
    misread = F.overlay("value", F.lit("~"), at + 1)
    values = R.fields(spark, d).where(F.col("field_name").isin(*_PLACES)).select("field_name", misread.alias("value"))
    return memory.suggest_fuzzy(values, _place_memory(spark, d), 0.8)


@_query(with_views(f", {_MEMORY} SELECT field_name, corrected_value, count(*) AS times_applied FROM (SELECT m.field_name, corrected_value FROM flds f JOIN mem m ON f.field_name = m.field_name AND trim(lower(value)) = trim(lower(raw_value))) GROUP BY ALL"))
def memory_usage(spark, d):
    used = memory_exact(spark, d).select("field_name", F.col("suggestion").alias("corrected_value"))
    return memory.bump(_memory(spark, d).withColumn("times_applied", F.lit(0).cast("long")), used).where("times_applied > 0").select("field_name", "corrected_value", "times_applied")


@_query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
 w AS (SELECT doc_id, line, unnest(string_split(raw, ' ')) AS text, generate_subscripts(string_split(raw, ' '), 1) AS pos FROM l),
 p AS (SELECT *, 10 * coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM w)
 SELECT doc_id, count(*) AS n_words, max(x + 10 * length(text))::BIGINT AS width, max(line * 38 + 66)::BIGINT AS height FROM p WHERE text <> '' GROUP BY 1""")
def page_geometry(spark, d):
    w = layout.words_of(R.table(spark, d, "documents").select("doc_id", "text"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.max(F.col("x") + F.col("w")).alias("width"), F.max(F.col("y") + F.col("h")).alias("height"))


@_query("""SELECT doc_id, sum((raw <> '')::INT)::BIGINT AS n_lines FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS raw FROM documents) GROUP BY 1 HAVING n_lines > 0""")
def lines_from_words(spark, d):
    lines = layout.lines_of(layout.words_of(R.table(spark, d, "documents").select("doc_id", "text")))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))


#: A word of four characters in each script that is told apart.
_SCRIPTS = {"hin": "खसरा", "ben": "জমির", "pan": "ਜਮੀਨ", "guj": "જમીન", "tam": "நிலா", "tel": "భూమి", "kan": "ಭೂಮಿ", "mal": "ഭൂമി"}
_SCRIPT_NAMES = ", ".join(f"'{k}'" for k in (*_SCRIPTS, "eng"))


@_query(f"""SELECT doc_id, CASE WHEN doc_id % 9 = 8 OR length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 4 * (6 + CASE WHEN doc_id % 2 = 0 THEN length(text) // 4 ELSE 0 END) THEN 'eng'
 ELSE [{_SCRIPT_NAMES}][1 + doc_id % 9] END AS script FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""")
def detect_script(spark, d):
    """Whole texts behind words of a script, six or, before every second text, as many as outweigh it: the script counts where
    Latin letters are not more."""
    text = F.coalesce("text", F.lit(""))
    times = 6 + F.when(F.col("doc_id") % 2 == 0, F.floor(F.length(text) / 4)).otherwise(0)
    word = F.get(F.array(*[F.lit(w) for w in _SCRIPTS.values()], F.lit("")), (F.col("doc_id") % 9).cast("int"))
    made = F.concat(F.repeat(word, times.cast("int")), text)
    return R.table(spark, d, "documents").select("doc_id", layout.detect_script(made).alias("script"))


def _round_trip(spark, d):
    """A text for each record, of which every value is known."""
    r = R.records(spark, d)
    text = F.concat_ws("\n", F.concat(F.lit("District : "), "district"), F.concat(F.lit("Survey No : "), "survey_number"), F.concat(F.lit("Extent : "), F.coalesce("plot_area", F.lit(1.5)).cast("string"), F.lit(" acres")), F.concat(F.lit("PIN 6"), F.lpad((F.col("record_id") % 100000).cast("string"), 5, "0")), F.concat(F.lit("Dated "), "mutation_date"))
    return r.select(F.col("record_id").alias("doc_id"), text.alias("text"))


@_query(with_views("SELECT record_id AS doc_id, survey_number, coalesce(plot_area, 1.5) AS area, 'acre' AS unit, '6' || lpad((record_id % 100000)::VARCHAR, 5, '0') AS pin, mutation_date AS day FROM recs"))
def typed_parsers(spark, d):
    lines = _round_trip(spark, d).withColumn("l", F.split("text", "\n"))
    return lines.select("doc_id", X.plot_id(F.regexp_extract(F.col("l")[1], r":\s*(.*)", 1)).alias("survey_number"), X.area_value(F.col("l")[2]).alias("area"), X.area_unit(F.col("l")[2]).alias("unit"), X.pin_code(F.col("l")[3]).alias("pin"), X.parse_date(F.col("l")[4]).alias("day"))


@_query("""SELECT l_orderkey, sum((c + 1) // 2)::BIGINT AS kept FROM (SELECT l_orderkey, count(*) AS c FROM (SELECT l_orderkey, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run
 FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY l_orderkey, run) GROUP BY 1""")
def greedy_intervals(spark, d):
    """Intervals (n, n + 2) by rising n overlap the next one: of each run of numbers every second one stays."""
    hit = F.struct(F.col("l_linenumber").alias("rank"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 2).alias("end"))
    rows = R.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(hit).alias("h"))
    return rows.select("l_orderkey", F.size(layout.non_overlapping(F.col("h"))).cast("long").alias("kept"))


@_query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def events_by_hour(spark, d):
    e = R.table(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@_query("SELECT event_id, ts, user_id, event_type FROM events WHERE (event_type = 'click' AND user_id % 10 = 1) OR (event_type = 'view' AND user_id % 10 = 2) ORDER BY ts DESC, event_id DESC LIMIT 30")
def audit_latest(spark, d):
    u = F.col("user_id") % 10
    hit = ((F.col("event_type") == "click") & (u == 1)) | ((F.col("event_type") == "view") & (u == 2))
    return R.table(spark, d, "events").where(hit).orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "ts", "user_id", "event_type")


@_query(with_views("SELECT document_id, count(record_id) AS n_records, CASE WHEN count(record_id) = 0 THEN 'none' ELSE max(recs.status) END AS record_status FROM docs LEFT JOIN recs ON record_id = document_id GROUP BY 1"))
def documents_with_record(spark, d):
    docs, r = R.documents(spark, d).select("document_id"), R.records(spark, d).select("record_id", "status")
    return docs.join(r, docs["document_id"] == r["record_id"], "left").select("document_id", F.col("record_id").isNotNull().cast("long").alias("n_records"), F.coalesce("status", F.lit("none")).alias("record_status"))


@_query(" UNION ALL ".join(f"SELECT '{k}' AS field_name, {w}::DOUBLE AS weight, {str(r).lower()} AS required" for k, (w, r) in R.FIELDS.items()))
def schema_fields(spark, d):
    return spark.createDataFrame([(k, w, r) for k, (w, r) in R.FIELDS.items()], "field_name string, weight double, required boolean")


@_query(with_views(", t AS (SELECT record_id, field_name, value, (record_id % 89) / 89.0::DOUBLE AS c FROM flds WHERE record_id % 2 = 0) SELECT f.record_id, f.field_name, CASE WHEN t.c > f.confidence THEN t.c ELSE f.confidence END AS confidence, coalesce(t.c > f.confidence, false) AS from_table FROM flds f LEFT JOIN t USING (record_id, field_name)"))
def table_cell_merge(spark, d):
    f = R.fields(spark, d).select("record_id", "field_name", "confidence")
    t = f.where("record_id % 2 = 0").select("record_id", "field_name", ((F.col("record_id") % 89) / F.lit(89.0)).alias("c"))
    wins = F.coalesce(F.col("c") > F.col("confidence"), F.lit(False))
    return f.join(t, ["record_id", "field_name"], "left").select("record_id", "field_name", F.when(wins, F.col("c")).otherwise(F.col("confidence")).alias("confidence"), wins.alias("from_table"))


@_query(with_views("SELECT document_id, CASE WHEN ocr_confidence >= 0.8 THEN 'minimal' WHEN ocr_confidence >= 0.4 THEN 'moderate' ELSE 'heavy' END AS level, greatest(0.4, least(2.8, ln(greatest(0.05, least(0.95, ocr_confidence))) / ln(0.5))) AS gamma FROM docs"))
def page_quality(spark, d):
    c = F.col("ocr_confidence")
    return R.documents(spark, d).select("document_id", F.when(c >= 0.8, "minimal").when(c >= 0.4, "moderate").otherwise("heavy").alias("level"), layout.gamma(c * 255.0).alias("gamma"))


@_query(with_views("SELECT record_id, lag(overall_confidence) OVER (PARTITION BY village, district ORDER BY created_at, record_id) AS before, row_number() OVER (PARTITION BY village, district ORDER BY created_at, record_id) AS place FROM recs"))
def village_history(spark, d):
    w = Window.partitionBy("village", "district").orderBy("created_at", "record_id")
    return R.records(spark, d).select("record_id", F.lag("overall_confidence").over(w).alias("before"), F.row_number().over(w).cast("long").alias("place"))


def _form_texts(spark, d):
    """A form for each record, in every layout that the extraction knows; what it must find follows from the record."""
    r = R.records(spark, d)
    k, area = F.col("record_id"), F.format_string("%d.%d", F.col("record_id") % 40 + 1, F.col("record_id") % 9 + 1)
    place = F.when(k % 4 == 0, F.concat(F.lit("District\n"), "state")).when(k % 4 == 1, F.concat(F.lit("Distrct : "), "state")).otherwise(F.concat(F.lit("District : "), "state"))
    plot = F.when(k % 3 == 0, F.concat(F.lit("SurveyNo:"), "survey_number")).otherwise(F.concat(F.lit("Survey No : "), "survey_number"))
    deed = F.concat(F.lit("Registration No : REG-"), k.cast("string"), F.lit(" Date : "), "mutation_date")
    text = F.concat_ws("\n", place, plot, F.concat(F.lit("Total Area : "), area, F.lit(" acres")), F.concat(F.lit("PIN Code 6"), F.lpad((k % 100000).cast("string"), 5, "0")), deed)
    return r.select(k.alias("doc_id"), text.alias("text"))


_FORM = """, form AS (SELECT record_id AS doc_id, (record_id % 40 + 1) || '.' || (record_id % 9 + 1) AS area, * FROM recs), want AS (
 SELECT doc_id, unnest(['district', 'survey_number', 'plot_area', 'area_unit', 'pincode', 'registration_number', 'registration_date']) AS field_name,
  unnest([array_to_string(list_transform(string_split(lower(state), ' '), lambda x: upper(x[1]) || x[2:]), ' '), survey_number, area, 'acre', '6' || lpad((record_id % 100000)::VARCHAR, 5, '0'), 'REG-' || record_id, mutation_date]) AS value FROM form)"""


@_query(with_views(_FORM + " SELECT doc_id, field_name, value FROM want"))
def extract_forms(spark, d):
    """All fields that the extraction finds in the forms: labels exact, misread, glued to the value or above it."""
    return extract.extract_text(_form_texts(spark, d)).where("value <> ''").select("doc_id", "field_name", "value")


@_query(with_views(_FORM + " SELECT doc_id, count(*) AS n_found, 20 - count(*) AS n_blank FROM want GROUP BY 1"))
def extract_summary(spark, d):
    found = extract.extract_text(_form_texts(spark, d))
    return found.groupBy("doc_id").agg(F.count_if(F.col("value") != "").alias("n_found"), F.count_if(F.col("value") == "").alias("n_blank"))


#: Labels in four scripts, a table of the caller's: village, district, area, and a unit with its name.
_INDIC = [("ग्राम", "जिला", "क्षेत्रफल", "हेक्टेयर", "hectare"), ("கிராமம்", "மாவட்டம்", "பரப்பளவு", "ஏக்கர்", "acre"), ("গ্রাম", "জেলা", "আয়তন", "একর", "acre"), ("గ్రామం", "జిల్లా", "విస్తీర్ణం", "సెంటు", "cent")]


def _title(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"


@_query(with_views(f""", form AS (SELECT record_id AS doc_id, (record_id % 40 + 1) || '.' || (record_id % 9 + 1) AS area, [{', '.join(f"'{u}'" for *_, u in _INDIC)}][1 + record_id % 4] AS unit, * FROM recs)
 SELECT doc_id, unnest(['village', 'district', 'plot_area', 'area_unit']) AS field_name, unnest([{_title('village')}, {_title('state')}, area, unit]) AS value FROM form"""))
def extract_indic(spark, d):
    """Forms whose labels and units are in one of four scripts."""
    r, k = R.records(spark, d), F.col("record_id")
    of = lambda n: F.get(F.array(*[F.lit(row[n]) for row in _INDIC]), (k % 4).cast("int"))
    area = F.format_string("%d.%d", k % 40 + 1, k % 9 + 1)
    text = F.concat_ws("\n", F.concat(of(0), F.lit(" : "), "village"), F.concat(of(1), F.lit(" : "), "state"), F.concat(of(2), F.lit(" : "), area, F.lit(" "), of(3)))
    more = [(field, row[n], 1.0) for row in _INDIC for n, field in enumerate(("village", "district", "plot_area"))]
    found = extract.extract_text(r.select(k.alias("doc_id"), text.alias("text")), lexicon(more))
    return found.where("value <> ''").select("doc_id", "field_name", "value")


def _row_forms(spark, d):
    """Pages with boxes: two labels whose values stand in the cell to the right, one before its value, a state in a sentence."""
    r, k = R.records(spark, d), F.col("record_id")
    lines = [(0, 40, F.lit("District")), (400, 42, F.col("state")), (0, 100, F.lit("Survey No")), (400, 102, F.col("survey_number")), (0, 160, F.concat(F.lit("Village : "), "village")), (0, 220, F.concat(F.lit("Situated in "), "state"))]
    rows = F.array(*[F.struct(F.lit(i).alias("line"), F.lit(x).alias("x0"), F.lit(y).alias("y"), text.alias("text")) for i, (x, y, text) in enumerate(lines)])
    rows = r.select(k.alias("doc_id"), (70.0 + k % 3 * 10).alias("conf"), F.explode(rows).alias("l")).select("doc_id", "conf", "l.*")
    rows = rows.select("doc_id", "conf", "line", "x0", "y", F.posexplode(F.split("text", " ")).alias("nth", "text"))
    return rows.select("doc_id", F.lit(1).alias("page"), "line", (F.col("x0") + 80 * F.col("nth")).cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.lit(70).cast("long").alias("w"), F.lit(26).cast("long").alias("h"), "text", "conf")


def _row_fields(spark, d):
    """The fields of these pages, with the places that there are and what officers corrected."""
    gazetteer = [(p["r_name"], p["n_name"]) for p in R.places(spark, d).orderBy("n_nationkey").collect()]  # 25 rows, always
    known = spark.createDataFrame([(1, "village", "machinery", "Machinery Nagar"), (2, "village", "bilding", "Building")], "id long, field_name string, raw_value string, corrected_value string")
    found = extract.extract_words(R.records(spark, d).select(F.col("record_id").alias("doc_id")), _row_forms(spark, d), gazetteer=gazetteer, memory=known)
    return found.where("value <> ''")


_ROWS = f""", form AS (SELECT record_id AS doc_id, (70.0::DOUBLE + record_id % 3 * 10) / 100 AS c, * FROM recs), want AS (
 SELECT doc_id, 'district' AS field_name, {_title('state')} AS value, round(c * 0.96, 3) AS confidence, 'ocr' AS source, 'exact label ''district'' + table column (same row, right cell)' AS method FROM form
 UNION ALL SELECT doc_id, 'survey_number', survey_number, round(c * 0.96, 3), 'ocr', 'exact label ''survey no'' + table column (same row, right cell)' FROM form
 UNION ALL SELECT doc_id, 'village', CASE village WHEN 'MACHINERY' THEN 'Machinery Nagar' ELSE {_title('village')} END,
  CASE village WHEN 'MACHINERY' THEN round(least(0.95, round(c * 0.9775, 3) + 0.1), 3) ELSE round(c * 0.9775, 3) END, CASE village WHEN 'MACHINERY' THEN 'learned' ELSE 'ocr' END,
  'exact label ''village'' + inline value right of label' || CASE village WHEN 'MACHINERY' THEN ' + verified-correction memory' ELSE '' END FROM form
 UNION ALL SELECT doc_id, 'state', state, 0.5, 'ocr', 'gazetteer match: state name found in text' FROM form)"""


@_query(with_views(_ROWS + " SELECT doc_id, field_name, value, source FROM want"))
def extract_columns(spark, d):
    """Values in cells to the right, by gazetteer and by correction memory."""
    return _row_fields(spark, d).select("doc_id", "field_name", "value", "source")


@_query(with_views(_ROWS + " SELECT doc_id, field_name, confidence, method, confidence < 0.75 AS needs_review FROM want"))
def extract_confidence(spark, d):
    """How sure each of these values is, and what it comes from."""
    return _row_fields(spark, d).select("doc_id", "field_name", "confidence", "method", "needs_review")


def _boxes(spark, d):
    """Pages of orders: a stamp and a word for each line item."""
    i = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") - 1).alias("nth"), "l_partkey", "l_suppkey", "l_quantity")
    stamp = i.select("page_id", "nth", (F.col("l_partkey") % 500).alias("x"), (F.col("l_suppkey") % 700).alias("y"), (F.col("l_quantity") * 8 + 100).cast("long").alias("w"), F.lit(300).cast("long").alias("h"))
    word = i.select("page_id", (F.col("l_partkey") % 600).alias("x"), (F.col("l_suppkey") % 800).alias("y"), F.lit(60).cast("long").alias("w"), F.lit(20).cast("long").alias("h"))
    return stamp, word


_BOXES = """i AS (SELECT l_orderkey AS page_id, l_linenumber - 1 AS nth, l_partkey AS p, l_suppkey AS s, l_quantity AS q FROM lineitem),
 st AS (SELECT page_id, nth, p % 500 AS x, s % 700 AS y, (q * 8 + 100)::BIGINT AS w, 300 AS h FROM i), wd AS (SELECT page_id, p % 600 AS x, s % 800 AS y, 60 AS w, 20 AS h FROM i),
 met AS (SELECT st.page_id, st.nth, st.w * st.h AS a, 1200 AS b, greatest(0, least(st.x + st.w, wd.x + wd.w) - greatest(st.x, wd.x)) * greatest(0, least(st.y + st.h, wd.y + wd.h) - greatest(st.y, wd.y)) AS c FROM st JOIN wd USING (page_id)),
 cov AS (SELECT page_id, nth, count(*) AS n_words FROM met WHERE c / b > 0.15 OR c / (a + b - c) > 0.15 GROUP BY ALL)"""


@_query(f"WITH {_BOXES} SELECT page_id, nth, n_words FROM cov")
def stamp_word_overlaps(spark, d):
    return stamps.overlapped(*_boxes(spark, d))


@_query(f"""WITH {_BOXES}, pg AS (SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Seal of the office' WHEN o_orderkey % 7 = 0 THEN 'Digitally signed' ELSE 'plain' END AS text FROM orders)
 SELECT page_id, 'STAMP_MULTIPLE' AS rule_code, 'warning' AS severity, 1::BIGINT AS n FROM st GROUP BY 1 HAVING count(*) >= 3
 UNION ALL SELECT page_id, 'STAMP_OVERLAP', 'error', count(*) FROM cov WHERE n_words >= 3 GROUP BY 1
 UNION ALL SELECT page_id, 'STAMP_MISSING', 'error', 1::BIGINT FROM pg WHERE text = 'plain' AND page_id NOT IN (SELECT page_id FROM st)""")
def stamp_issues(spark, d):
    k = F.col("o_orderkey")
    pages = R.table(spark, d, "orders").select(k.alias("page_id"), F.when(k % 5 == 0, "Seal of the office").when(k % 7 == 0, "Digitally signed").otherwise("plain").alias("text"))
    return stamps.issues(pages, *_boxes(spark, d)).groupBy("page_id", "rule_code", "severity").agg(F.count("*").alias("n"))


_MEASURES = {"short_side": "l_partkey * 7 % 1800", "dark_pct": "l_suppkey % 50 / 100.0", "bright_pct": "l_partkey % 100 / 100.0", "contrast": "(l_orderkey * 3 % 90)", "blur": "(l_orderkey % 300)", "noise": "(l_partkey % 23)", "skew": "(l_suppkey % 9 - 4)", "edge_density": "(l_orderkey + l_partkey) % 260 / 1000.0"}


@_query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, {", ".join(f"{e} AS {n}" for n, e in _MEASURES.items())} FROM lineitem),
 s1 AS (SELECT *, CASE WHEN short_side < 720 OR dark_pct > 0.35 OR (bright_pct > 0.55 AND contrast < 45) THEN 'heavy' WHEN contrast < 45 THEN 'moderate' ELSE 'minimal' END AS a FROM m),
 s2 AS (SELECT *, CASE WHEN blur < 54 THEN 'heavy' WHEN a = 'minimal' AND blur < 90 THEN 'moderate' ELSE a END AS b FROM s1),
 s3 AS (SELECT *, CASE WHEN noise > 18 THEN 'heavy' WHEN b = 'minimal' AND noise > 12 THEN 'moderate' ELSE b END AS c FROM s2),
 s4 AS (SELECT *, CASE WHEN abs(skew) > 3 THEN 'heavy' WHEN c = 'minimal' AND abs(skew) > 1.5 THEN 'moderate' ELSE c END AS e FROM s3),
 s5 AS (SELECT *, CASE WHEN edge_density > 0.22 THEN 'heavy' WHEN edge_density < 0.01 AND e = 'heavy' THEN 'moderate' ELSE e END AS f FROM s4)
 SELECT l_orderkey, l_linenumber, CASE WHEN blur >= 90 AND contrast >= 45 AND noise <= 12 AND dark_pct < 0.12 AND bright_pct > 0.4 AND short_side >= 810 THEN 'minimal' ELSE f END AS level FROM s5""")
def page_levels(spark, d):
    m = R.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in _MEASURES.items()])
    return m.select("l_orderkey", "l_linenumber", quality.level().alias("level"))


@_query("SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, l_tax, -l_linenumber)) AS attempt, bool_or(l_quantity < 8 OR (l_quantity < 25 AND l_tax < 0.02)) AS rescued FROM lineitem GROUP BY 1")
def ocr_rescue(spark, d):
    i = R.table(spark, d, "lineitem")
    rescue = F.when(F.col("l_quantity") < 8, True).otherwise((F.col("l_quantity") < 25) & (F.col("l_tax") < 0.02))
    return i.groupBy("l_orderkey").agg(quality.kept_attempt("l_quantity", "l_tax", "l_linenumber", "l_linenumber").alias("attempt"), F.bool_or(rescue).alias("rescued"))


@_query(with_views("SELECT record_id::VARCHAR AS \"ID\", owner_name AS \"Owner Name\", pincode AS \"PIN Code\", status AS \"Status\", round(overall_confidence * 100, 1) AS \"Confidence %\" FROM recs"))
def export_register(spark, d):
    return files.export_rows(R.records(spark, d)).select("ID", "Owner Name", "PIN Code", "Status", "Confidence %")


@_query(with_views("SELECT document_id, page_count, least(page_count, 3) AS processed_page_count FROM docs"))
def page_cap(spark, d):
    pages = R.documents(spark, d).select("document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count"))).alias("page_number"))
    return files.capped_pages(pages, 3)[1]


@_query("SELECT event_type AS action, event_id::VARCHAR AS object_id, props AS detail FROM events")
def audit_log(spark, d):
    e = R.table(spark, d, "events").select(F.col("event_type").alias("action"), F.lit("Document").alias("object_type"), F.col("event_id").alias("object_id"), F.lit(None).cast("string").alias("user_label"), F.col("props").alias("detail"), F.col("ts").alias("created_at"))
    return files.audit_rows(e).select("action", "object_id", "detail")


def _edits(spark, d):
    return R.fields(spark, d).where("field_name = 'village' AND record_id % 6 = 0").select("record_id", "field_name", F.when(F.col("record_id") % 12 == 0, F.col("value")).otherwise(F.concat("value", F.lit(" Khurd"))).alias("value"))


@_query(with_views("SELECT record_id, field_name, CASE WHEN hit THEN value || ' Khurd' ELSE value END AS value, CASE WHEN hit THEN 'manual' ELSE source END AS source, (NOT hit AND needs_review) AS needs_review FROM (SELECT *, field_name = 'village' AND record_id % 12 = 6 AS hit FROM flds)"))
def verified_fields(spark, d):
    rows = R.fields(spark, d)
    return memory.verified_fields(rows, _edits(spark, d)).select("record_id", "field_name", "value", "source", "needs_review")


@_query(with_views("SELECT record_id, field_name, value AS old_value, value || ' Khurd' AS new_value FROM flds WHERE field_name = 'village' AND record_id % 12 = 6"))
def verification_changes(spark, d):
    return memory.changed_fields(R.fields(spark, d), _edits(spark, d))


@_query(with_views(f""", {_MEMORY} SELECT field_name, raw_value, corrected_value FROM mem UNION ALL SELECT DISTINCT field_name, lower(translate(value, 'AEIO', '4310')), value FROM flds
 WHERE field_name = 'village' AND value SIMILAR TO '.*[AEIO].*' AND length(regexp_replace(value, '[AEIO]', '', 'g')) >= 0.55 * length(value)"""))
def learned_corrections(spark, d):
    """The officers' changes that memory keeps: misread values, not replaced ones."""
    seen = R.fields(spark, d).where(F.col("field_name").isin(*_PLACES)).select("field_name", F.translate("value", "AEIO", "4310").alias("raw_value"), F.col("value").alias("corrected_value"))
    return memory.record_corrections(_memory(spark, d).withColumn("times_applied", F.lit(0).cast("long")), seen, extract.LEARNABLE).select("field_name", "raw_value", "corrected_value")


@_query(with_views(_ISSUES + """, ids AS (SELECT DISTINCT record_id, lower(village) v, lower(district) dd, status <> 'REJECTED' AS live, unnest([upper(survey_number), upper(khasra_number)]) AS id FROM recs),
 n AS (SELECT v, dd, id, count(*) AS n FROM ids WHERE live AND id <> '' GROUP BY ALL), dup AS (SELECT DISTINCT record_id FROM ids JOIN n USING (v, dd, id) WHERE n.n - live::INT > 0),
 e AS (SELECT record_id FROM iss WHERE severity = 'error' UNION ALL SELECT record_id FROM dup), c AS (SELECT record_id, count(*) AS n FROM e GROUP BY 1)
 SELECT record_id, coalesce(n, 0) AS n_errors, record_id IN (SELECT record_id FROM dup) AS is_duplicate, CASE WHEN coalesce(n, 0) = 0 THEN 'VERIFIED' ELSE 'PENDING' END AS status FROM recs LEFT JOIN c USING (record_id)"""))
def revalidated_records(spark, d):
    r = R.records(spark, d)
    return rules.after_verification(r, rules.revalidated(r, AS_OF)).select("record_id", "n_errors", "is_duplicate", "status")


@_query(with_views("SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'REPROCESSED' ELSE status END AS status FROM docs"))
def upsert_documents(spark, d):
    docs = R.documents(spark, d).select("document_id", "status")
    return files.upserted(docs, docs.where("document_id % 3 = 0").withColumn("status", F.lit("REPROCESSED")), ["document_id"])


@_query("SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return streams.counts_by_window(R.table(spark, d, "events"))


@_query("SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k")
def user_sessions(spark, d):
    return streams.sessions(R.table(spark, d, "events"))


@_query("SELECT event_type AS original_name, user_id % 50 AS file_size, min(ts) AS uploaded_at FROM events GROUP BY ALL")
def uploads_once(spark, d):
    e = R.table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("original_name"), (F.col("user_id") % 50).alias("file_size"), F.lit("u").alias("user_label"), F.col("ts").alias("uploaded_at"))
    return streams.without_running(e).select("original_name", "file_size", "uploaded_at")


@_query(with_views(_ISSUES + _issues_sql("1995-01-01", "iss2") + " SELECT * FROM iss UNION SELECT * FROM iss2"))
def merged_issues(spark, d):
    """The issues of one day, and those of an earlier one that it lacks."""
    return rules.issues_of_days(R.records(spark, d), [AS_OF, "1995-01-01"])


@_query(with_views("SELECT record_id, original_name, state_name, overall_confidence FROM recs JOIN docs ON document_id = record_id"))
def record_documents(spark, d):
    docs = R.documents(spark, d).select(F.col("document_id").alias("record_id"), "original_name", "state_name")
    return R.records(spark, d).select("record_id", "overall_confidence").join(docs, "record_id")


@_query(with_views("SELECT record_id, owner_name, survey_number, status FROM recs WHERE record_id = 37"))
def record_lookup(spark, d):
    return R.records(spark, d).where("record_id = 37").limit(1).select("record_id", "owner_name", "survey_number", "status")


@_query(with_views("""SELECT record_id, status, n.count, 2::BIGINT AS page, ceil(n.count / 15.0)::BIGINT AS pages FROM recs, (SELECT count(*) AS count FROM recs WHERE status = 'PENDING' AND lower(state) = 'asia' AND (
 contains(lower(owner_name), '1') OR contains(lower(survey_number), '1') OR contains(lower(khasra_number), '1') OR contains(lower(village), '1') OR contains(lower(district), '1'))) n
 WHERE status = 'PENDING' AND lower(state) = 'asia' AND (contains(lower(owner_name), '1') OR contains(lower(survey_number), '1') OR contains(lower(khasra_number), '1') OR contains(lower(village), '1') OR contains(lower(district), '1'))
 ORDER BY created_at DESC, record_id DESC LIMIT 15 OFFSET 15"""))
def record_list(spark, d):
    """Filters as given, a search over all searched columns, and a page with its envelope."""
    found = filters.chosen(R.records(spark, d), {"status": "PENDING", "state": "Asia", "district": "", "owner": None}, "1")
    return filters.page(found, [F.desc("created_at"), F.desc("record_id")], 2, 15).select("record_id", "status", "count", "page", "pages")


@_query(with_views("SELECT kind, status, cls, count(*) AS n FROM (SELECT 'document' AS kind, status FROM docs UNION ALL SELECT 'record', status FROM recs) JOIN (VALUES ('PROCESSED', 'ok'), ('VERIFIED', 'ok'), ('UPLOADED', 'info'), ('PENDING', 'warn'), ('FAILED', 'bad'), ('REJECTED', 'bad')) c(status, cls) USING (status) GROUP BY ALL"))
def status_classes(spark, d):
    return status_counts(spark, d).withColumn("cls", filters.status_class(F.col("status")))


@_query(with_views(_ISSUES + """ SELECT record_id, coalesce(n_fields, 0) AS n_fields, coalesce(n_review, 0) AS n_review, coalesce(n_issues, 0) AS n_issues, coalesce(n_errors, 0) AS n_errors
 FROM recs LEFT JOIN (SELECT record_id, count(*) AS n_fields, count(*) FILTER (needs_review) AS n_review FROM flds WHERE record_id % 8 > 0 GROUP BY 1) USING (record_id)
 LEFT JOIN (SELECT record_id, count(*) AS n_issues, count(*) FILTER (severity = 'error') AS n_errors FROM iss GROUP BY 1) USING (record_id)"""))
def record_children(spark, d):
    """Two kinds of children, each counted before the join; every eighth record has no fields yet."""
    f = R.fields(spark, d).where("record_id % 8 > 0").groupBy("record_id").agg(F.count("*").alias("n_fields"), F.count_if("needs_review").alias("n_review"))
    i = rules.issues(R.records(spark, d), AS_OF).groupBy("record_id").agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity") == "error").alias("n_errors"))
    return R.records(spark, d).select("record_id").join(f, "record_id", "left").join(i, "record_id", "left").fillna(0)


@_query(with_views(_ISSUES + """ SELECT record_id, recs.status AS status, f.first_field, f.n_fields, coalesce(i.n, 0) AS n_issues, i.codes FROM recs
 JOIN (SELECT record_id, min(field_name || '=' || value) AS first_field, count(*) AS n_fields FROM flds GROUP BY 1) f USING (record_id)
 LEFT JOIN (SELECT record_id, count(*) AS n, string_agg(rule_code, ',' ORDER BY rule_code) AS codes FROM iss GROUP BY 1) i USING (record_id)"""))
def record_details(spark, d):
    """Each record as the nested JSON that it is exported as, read back."""
    r = R.records(spark, d)
    nested = "struct<record_id:bigint,status:string,fields:array<struct<field_name:string,value:string>>,issues:array<struct<rule_code:string>>>"
    j = files.record_json(r, R.fields(spark, d), rules.issues(r, AS_OF)).select(F.from_json("json", nested).alias("j")).select("j.*")
    first = F.array_min(F.transform("fields", lambda f: F.concat(f["field_name"], F.lit("="), f["value"])))
    codes = F.array_join(F.array_sort(F.col("issues.rule_code")), ",")
    return j.select("record_id", "status", first.alias("first_field"), F.size("fields").cast("long").alias("n_fields"), F.size("issues").cast("long").alias("n_issues"), F.nullif(codes, F.lit("")).alias("codes"))


@_query(with_views("SELECT document_id, docs.status AS status, n_events, last_event FROM docs LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS object_id, count(*) AS n_events, max(ts) AS last_event FROM events WHERE event_type = 'click' GROUP BY 1) ON object_id = CAST(document_id AS VARCHAR)"))
def document_audit(spark, d):
    """Audit rows name their object by type and by its id as text."""
    e = R.table(spark, d, "events").where("event_type = 'click'").groupBy(F.col("user_id").cast("string").alias("object_id")).agg(F.count("*").alias("n_events"), F.max("ts").alias("last_event"))
    docs = R.documents(spark, d).withColumn("object_id", F.col("document_id").cast("string"))
    return docs.join(e, "object_id", "left").select("document_id", "status", "n_events", "last_event")


@_query("SELECT l_orderkey AS document_id, string_agg('page ' || l_linenumber || ': ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS text, avg(l_discount) AS confidence, count(*) AS n_pages FROM lineitem GROUP BY 1")
def merged_pages(spark, d):
    i = R.table(spark, d, "lineitem")
    text = F.concat(F.lit("page "), "l_linenumber", F.lit(": "), "l_returnflag")
    return pages.merged(i.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), text.alias("text"), F.col("l_discount").alias("confidence")))


@_query("""SELECT l_orderkey AS page_id, arg_min(flag, l_linenumber) FILTER (ok) AS engine, arg_min('text ' || l_linenumber, l_linenumber) FILTER (ok) AS text, count(*) FILTER (l_linenumber <= coalesce(first, 99)) AS n_tried
 FROM (SELECT *, q > 25 AS ok, min(CASE WHEN q > 25 THEN l_linenumber END) OVER (PARTITION BY l_orderkey) AS first FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, max(l_quantity) AS q FROM lineitem GROUP BY ALL)) GROUP BY 1""")
def ocr_chain(spark, d):
    """The first engine in line that gave a text."""
    i = R.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("q"))
    text = F.when(F.col("q") > 25, F.concat(F.lit("text "), "l_linenumber"))
    found = pages.first_result(i.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("step"), F.col("flag").alias("engine"), text.alias("text"), F.lit(None).cast("string").alias("error")))
    return found.select("page_id", "engine", "text", F.size("log").cast("long").alias("n_tried"))


@_query(with_views("""SELECT document_id, CASE WHEN document_id % 4 = 0 THEN status WHEN document_id % 4 = 1 THEN 'FAILED' ELSE 'PROCESSED' END AS status, CASE WHEN document_id % 4 = 1 THEN 'no pages' ELSE '' END AS error,
 CASE document_id % 4 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'UPLOADED,PROCESSING,FAILED: no pages' ELSE 'UPLOADED,PROCESSING,PROCESSED' END AS log FROM docs"""))
def document_lifecycle(spark, d):
    docs = R.uploads(spark, d).select("document_id", "status", F.array(F.lit("UPLOADED")).alias("log"))
    k = F.col("document_id") % 4
    results = docs.where(k != 0).select("document_id", F.when(k != 1, "text").alias("text"), F.when(k == 1, "no pages").alias("error"))
    return pages.after_processing(docs, results).withColumn("log", F.array_join("log", ","))


@_query(with_views("SELECT record_id, CASE WHEN record_id % 9 = 0 THEN 'REJECTED' ELSE status END AS status FROM recs"))
def rejected_records(spark, d):
    r = R.records(spark, d).select("record_id", "status")
    return rules.rejected(r, r.where("record_id % 9 = 0"))


def _cells(spark, d):
    """A table for each order: headers in row 0, a row for each line item; areas in hectares, on every second order in cents too."""
    least = R.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])
    i = least.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 2).cast("int").alias("q"))
    heads = {0: "Sl. No", 1: "Survey  No.", 2: "PATTA NO", 3: "Hectares", 4: "Cents"}
    head = i.select("doc_id").distinct().select("doc_id", F.lit(0).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(t).alias("text")) for c, t in heads.items()])).alias("c")).select("doc_id", "row", "c.*", F.lit(0.9).alias("conf"))
    values = {0: F.col("l_linenumber").cast("string"), 1: F.concat("l_partkey", F.lit("/"), "l_linenumber"), 2: F.col("l_suppkey").cast("string"), 3: F.concat("q", F.lit(".5 ha")), 4: F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("q") * 10, F.lit(".25"))).otherwise("-")}
    body = i.select("doc_id", F.col("l_linenumber").cast("int").alias("row"), ((F.col("l_linenumber") * 7 + F.col("l_partkey")) % 89 / F.lit(100.0)).alias("conf"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), v.alias("text")) for c, v in values.items()])).alias("c"))
    return head.unionByName(body.select("doc_id", "row", "c.*", "conf"))


@_query("""WITH i AS (SELECT *, ((r * 7 + p) % 89) / 100.0::DOUBLE AS conf FROM (SELECT l_orderkey AS doc_id, l_linenumber AS r, min(l_partkey) AS p, min(l_suppkey) AS s, (min(l_quantity) * 2)::INT AS q FROM lineitem GROUP BY ALL)), b AS (SELECT doc_id, arg_max(i, (conf, -r)) AS i FROM i GROUP BY 1)
 SELECT doc_id, unnest(['survey_number', 'khata_number', 'plot_area', 'area_unit']) AS field, round(i.conf, 4) AS conf,
  unnest([i.p || '/' || i.r, i.s::VARCHAR, CASE WHEN doc_id % 2 = 0 THEN (i.q * 10) || '.25' ELSE i.q || '.5' END, CASE WHEN doc_id % 2 = 0 THEN 'cent' ELSE 'hectare' END]) AS value FROM b""")
def table_cell_fields(spark, d):
    return cells.cell_fields(_cells(spark, d)).select("doc_id", "field", "conf", "value")


@_query("""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_tax * 10 AS conf FROM lineitem)
 SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, 'f' || coalesce(a.n, b.n) AS field, CASE WHEN b.conf IS NOT NULL AND (a.conf IS NULL OR b.conf > a.conf) THEN 'cell' ELSE 'line' END AS value, CASE WHEN b.conf IS NOT NULL AND (a.conf IS NULL OR b.conf > a.conf) THEN b.conf ELSE a.conf END AS conf
 FROM (SELECT * FROM l WHERE n <= 3) a FULL JOIN (SELECT doc_id, n, 0.35 + (n % 2) / 10.0::DOUBLE AS conf FROM l WHERE n >= 2) b ON a.doc_id = b.doc_id AND a.n = b.n""")
def cells_over_lines(spark, d):
    """Fields that lines, cells or both gave; the surer one stays."""
    n = F.col("l_linenumber")
    i = R.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), n).alias("field"), n.alias("n"), (F.col("l_tax") * 10).alias("conf"))
    lines = i.where("n <= 3").select("doc_id", "field", F.lit("line").alias("value"), "conf")
    of_cells = i.where("n >= 2").select("doc_id", "field", F.lit("cell").alias("value"), (0.35 + (F.col("n") % 2) / F.lit(10.0)).alias("conf"))
    return cells.merged(lines, of_cells).drop("from_table")


@_query(f"SELECT l_orderkey, l_linenumber, blur >= 90 AND contrast >= 40 AND noise <= 14 AND dark_pct < 0.15 AND bright_pct > 0.35 AND short_side >= 700 AS clean FROM (SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {n}' for n, e in _MEASURES.items())} FROM lineitem)")
def plainly_clean_pages(spark, d):
    m = R.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {n}" for n, e in _MEASURES.items()])
    return m.select("l_orderkey", "l_linenumber", quality.plainly_clean().alias("clean"))


@_query(with_views(_FORM + """ SELECT field_name, count(*) AS total, count(*) AS hits FROM want GROUP BY 1"""))
def extraction_scorecard(spark, d):
    """Expected values of the forms against what was found: hits and total for each field."""
    r = R.records(spark, d)
    k = F.col("record_id")
    want = {"survey_number": F.col("survey_number"), "registration_number": F.concat(F.lit("REG-"), k), "registration_date": F.col("mutation_date"), "area_unit": F.lit("acre"), "district": F.initcap("state"), "pincode": F.concat(F.lit("6"), F.lpad((k % 100000).cast("string"), 5, "0")), "plot_area": F.format_string("%d.%d", k % 40 + 1, k % 9 + 1)}
    expected = r.select(k.alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), v.alias("expected")) for f, v in want.items()])).alias("e")).select("doc_id", "e.*")
    return extract.scorecard(expected, extract.extract_text(_form_texts(spark, d)))


from . import changes, lists, measures  # noqa: E402, F401 - they register their queries


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
