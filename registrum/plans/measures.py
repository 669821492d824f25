"""Queries about pages and values that seldom occur in clean data: scores, rescues, languages, ill-formed identifiers and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import quality, rules
from ..sources import files
from ..sources import register as R
from .queries import _MEASURES, AS_OF, _query, with_views

_M = f"(SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_returnflag, {', '.join(f'{e} AS {n}' for n, e in _MEASURES.items())} FROM lineitem)"


def _measured(spark, d):
    return R.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", *[f"{e} AS {n}" for n, e in _MEASURES.items()])


@_query(f"""SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, q * greatest(0, least(1, short_side / 900.0)))), 6) AS score FROM (SELECT *,
 (CASE WHEN contrast >= 45 THEN 1 ELSE greatest(0.4, contrast / 45.0::DOUBLE) END) * (CASE WHEN blur >= 90 THEN 1 ELSE greatest(0.4, blur / 90.0::DOUBLE) END) * (CASE WHEN noise <= 12 THEN 1 ELSE greatest(0.4, 12.0::DOUBLE / greatest(noise, 1)) END)
 * greatest(0.5, 1 - dark_pct::DOUBLE * 0.6::DOUBLE) * greatest(0.5, 1 - greatest(0, bright_pct::DOUBLE - 0.5::DOUBLE)) AS q FROM {_M})""")
def page_scores(spark, d):
    """What all measures together leave of a page's quality."""
    m = _measured(spark, d)
    doubles = {c: F.col(c).cast("double") for c in _MEASURES}
    return m.withColumns(doubles).select("l_orderkey", "l_linenumber", F.round(quality.score(), 6).alias("score"))


@_query("""SELECT l_orderkey, l_linenumber, l_quantity < 8 OR (l_quantity < 25 AND l_tax * 10 < 0.20) AS rescue, CASE WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'moderate' ELSE ['heavy', 'moderate', 'minimal'][1 + (2 + l_linenumber) % 3] END AS level FROM lineitem""")
def page_rescues(spark, d):
    """Pages that are read again, and the level of stamped ones."""
    n = F.col("l_linenumber")
    level = F.get(F.array(F.lit("heavy"), F.lit("moderate"), F.lit("minimal")), ((n + 2) % 3).cast("int"))
    return R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quality.needs_rescue(F.col("l_quantity"), F.col("l_tax") * 10).alias("rescue"), quality.with_stamp(level, F.col("l_returnflag") == "R").alias("level"))


@_query("""SELECT l_orderkey, arg_max(lang, (s, -n)) AS lang FROM (SELECT l_orderkey, l_linenumber AS n, ['hin', 'tam', 'eng'][1 + l_linenumber % 3] AS lang,
 round(l_tax * 100 + 0.15 * least(l_quantity, 100) + 0.35 * least(l_suppkey % 130, 100) - CASE WHEN l_linenumber % 3 = 2 AND l_returnflag = 'N' THEN 8.0 ELSE 0.0 END, 6) AS s FROM lineitem) GROUP BY 1""")
def language_choice(spark, d):
    """The language whose result is kept of each page."""
    n = F.col("l_linenumber")
    lang = F.get(F.array(F.lit("hin"), F.lit("tam"), F.lit("eng")), (n % 3).cast("int"))
    score = quality.language_score(F.col("l_tax") * 100, F.col("l_quantity"), F.col("l_suppkey") % 130, (lang == "eng") & (F.col("l_returnflag") == "N"))
    rows = R.table(spark, d, "lineitem").select("l_orderkey", n.alias("n"), lang.alias("lang"), F.round(score, 6).alias("s"))
    return rows.groupBy("l_orderkey").agg(F.max_by("lang", F.struct("s", -F.col("n"))).alias("lang"))


#: What is written for an identifier and for a date, by the record's number; the last of each is left as it is.
_IDS = ("12//3", "-4", "7 / 8", "A-1/2b", "12,5")
_DAYS = ("2020-01-05", "31/02/2020", "5.3.99", "n/a", "1/13/2000", "07-08-1990")


@_query(with_views(f""", w AS (SELECT record_id, CASE WHEN record_id % 6 < 5 THEN [{', '.join(f"'{x}'" for x in _IDS)}][1 + record_id % 6] ELSE survey_number END AS sn,
 CASE WHEN record_id % 7 < 6 THEN [{', '.join(f"'{x}'" for x in _DAYS)}][1 + record_id % 7] ELSE mutation_date END AS md FROM recs)
 SELECT record_id, 'ID_FORMAT' AS rule_code, 'warning' AS severity, sn || ' is not written as an identifier' AS message FROM w WHERE record_id % 6 IN (0, 1, 4)
 UNION ALL SELECT record_id, 'DATE_FORMAT', 'error', md || ' is no date' FROM w WHERE record_id % 7 IN (0, 1, 3, 4)"""))
def ill_formed_values(spark, d):
    """Identifiers and dates that are not written as such."""
    pick = lambda values, by, column: F.coalesce(F.get(F.array(*map(F.lit, values)), (F.col("record_id") % by).cast("int")), F.col(column))
    r = R.records(spark, d).withColumns({"survey_number": pick(_IDS, 6, "survey_number"), "mutation_date": pick(_DAYS, 7, "mutation_date")})
    return rules.issues(r, AS_OF).where("rule_code IN ('ID_FORMAT', 'DATE_FORMAT')").select("record_id", "rule_code", "severity", "message")


@_query(with_views("SELECT field_name, weight, required, count(*) FILTER (value <> '') AS n_filled, count(*) FILTER (value = '') AS n_blank FROM flds JOIN (VALUES " + ", ".join(f"('{k}', {w}::DOUBLE, {str(r).lower()})" for k, (w, r) in R.FIELDS.items()) + ") s(field_name, weight, required) USING (field_name) GROUP BY ALL"))
def schema_coverage(spark, d):
    """The schema's fields with how many records fill them."""
    schema = spark.createDataFrame([(k, w, r) for k, (w, r) in R.FIELDS.items()], "field_name string, weight double, required boolean")
    filled = R.fields(spark, d).groupBy("field_name").agg(F.count_if(F.col("value") != "").alias("n_filled"), F.count_if(F.col("value") == "").alias("n_blank"))
    return filled.join(F.broadcast(schema), "field_name")


@_query(with_views("SELECT document_id, document_id % 5 IN (0, 1, 3) AS taken FROM docs"))
def file_types(spark, d):
    """Uploads whose type is taken."""
    ends = F.get(F.array(F.lit(".pdf"), F.lit(".x.JPEG"), F.lit(".exe"), F.lit(".tiff"), F.lit("pdf")), (F.col("document_id") % 5).cast("int"))
    return R.uploads(spark, d).select("document_id", files.allowed(F.concat(F.lit("scan"), ends)).alias("taken"))


@_query(with_views("""SELECT record_id, CASE record_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Irrigated Land' ELSE 'mixed Use of ' || village END AS value, CASE record_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 ELSE 0.75 END AS quality FROM recs"""))
def free_texts(spark, d):
    """Free text of a field, with the hints of its kind."""
    k = F.col("record_id") % 3
    text = F.when(k == 0, " Not  available ").when(k == 1, ": IRRIGATED  LAND -").otherwise(F.concat(F.lit("mixed Use of "), "village"))
    got = X.parse_free_text(text, X.LAND_HINTS, 120)
    return R.records(spark, d).select("record_id", got["value"].alias("value"), got["quality"].alias("quality"))
