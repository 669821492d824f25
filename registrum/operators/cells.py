"""Table cells by the names of their columns, and their merge with what the lines gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Column headers (normalised) and the fields they stand for; area columns with their units, the finest first.
HEADERS = {"survey no": "survey_number", "survey number": "survey_number", "s no": "survey_number", "sno": "survey_number", "khasra no": "khasra_number", "khata no": "khata_number", "patta no": "khata_number", "patta number": "khata_number", "owner name": "owner_name", "father s name": "father_name", "fathers name": "father_name", "father name": "father_name"}
AREAS = {"cents": "cent", "ares": "are", "hectares": "hectare"}
BLANK = ("", "-", "--", "---", "—")


def header(x: Column) -> Column:
    """A header as it is compared: lower case, all but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(X.text_or_empty(x)), "[^a-z0-9]+", " "))


def cell_fields(cells: DataFrame) -> DataFrame:
    """cells: doc_id, row (0: headers), col, text, conf (0 to 1). The best value of each field of a document by confidence and
    quality; of a row's area columns the finest counts. doc_id, field, value, conf."""
    names = {**HEADERS, **{k: f"area:{i}:{u}" for i, (k, u) in enumerate(AREAS.items())}}
    fields = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    heads = cells.where("row = 0").select("doc_id", "col", fields[header(F.col("text"))].alias("name")).where("name IS NOT NULL")
    body = cells.where("row > 0").withColumn("text", F.trim(X.text_or_empty(F.col("text")))).where(~F.col("text").isin(*BLANK))
    met = body.join(heads, ["doc_id", "col"])
    kind = F.create_map(*[F.lit(x) for kv in X.KINDS.items() for x in kv])[F.col("name")]
    plain = met.where("name NOT LIKE 'area:%'").withColumn("got", X.parse_value(kind, F.col("text"))).where("got.value <> '' AND got.quality > 0")
    plain = plain.select("doc_id", "row", "col", F.col("name").alias("field"), F.col("got.value").alias("value"), F.round(F.col("conf") * F.col("got.quality"), 4).alias("conf"))
    parts = F.split("name", ":")
    sized = met.where("name LIKE 'area:%'").withColumn("number", F.regexp_extract("text", r"[0-9.]+", 0)).where("number <> ''")
    sized = sized.groupBy("doc_id", "row").agg(F.min_by(F.struct("number", parts[2].alias("unit"), "conf", "col"), parts[1]).alias("a"))
    both = F.explode(F.array(F.struct(F.lit("plot_area").alias("field"), F.col("a.number").alias("value")), F.struct(F.lit("area_unit").alias("field"), F.col("a.unit").alias("value"))))
    sized = sized.select("doc_id", "row", F.col("a.col").alias("col"), both.alias("f"), F.round("a.conf", 4).alias("conf")).select("doc_id", "row", "col", "f.field", "f.value", "conf")
    first = F.max_by(F.struct("value", "conf"), F.struct("conf", -F.col("row"), -F.col("col")))
    return plain.unionByName(sized).groupBy("doc_id", "field").agg(first.alias("b")).select("doc_id", "field", "b.*")


def merged(fields: DataFrame, cells: DataFrame) -> DataFrame:
    """Both: doc_id, field, value, conf. The cell's value where the lines have none, or a less sure one."""
    c = cells.select("doc_id", "field", F.col("value").alias("c_value"), F.col("conf").alias("c_conf"))
    wins = F.col("c_conf").isNotNull() & (F.col("conf").isNull() | (F.col("c_conf") > F.col("conf")))
    return fields.join(c, ["doc_id", "field"], "full").select("doc_id", "field", F.when(wins, F.col("c_value")).otherwise(F.col("value")).alias("value"), F.when(wins, F.col("c_conf")).otherwise(F.col("conf")).alias("conf"), wins.alias("from_table"))
