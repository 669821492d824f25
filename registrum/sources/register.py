"""The register's tables as views over the driver's star schema: documents, records and the long field table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Canonical fields that the views fill, their confidence weight, and whether they are required.
FIELDS = {"owner_name": (1.0, True), "survey_number": (1.0, True), "khasra_number": (0.8, False), "plot_area": (1.0, True), "area_unit": (0.4, False), "village": (1.0, True), "district": (1.0, True), "state": (0.7, False), "pincode": (0.4, False), "mutation_date": (0.5, False)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation and region are fixed tables of 25 and 5 rows, so broadcasting them is bounded."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a document without its place."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "PROCESSED").when(F.col("o_orderstatus") == "O", "UPLOADED").otherwise("FAILED")
    return table(spark, sf_dir, "orders").select(k.alias("document_id"), status.alias("status"), ((k % 997) / F.lit(997.0)).alias("ocr_confidence"), (k % 7 + 1).alias("page_count"), F.col("o_orderdate").alias("uploaded_at"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(places(spark, sf_dir)), c["c_nationkey"] == F.col("n_nationkey"))
    status = F.when(F.col("o_orderstatus") == "F", "PROCESSED").when(F.col("o_orderstatus") == "O", "UPLOADED").otherwise("FAILED")
    return rows.select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("scan-"), "o_orderkey", F.lit(".pdf")).alias("original_name"), F.col("r_name").alias("state_name"), F.col("n_name").alias("district_name"), status.alias("status"), ((F.col("o_orderkey") % 997) / F.lit(997.0)).alias("ocr_confidence"), (F.col("o_orderkey") % 7 + 1).alias("page_count"), F.col("o_orderdate").alias("uploaded_at"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for nine of ten documents; every eleventh lacks its owner, every thirteenth its area."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    rows = o.where(k % 10 != 0).join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(places(spark, sf_dir)), c["c_nationkey"] == F.col("n_nationkey"))
    return rows.select(
        k.alias("record_id"),
        F.when(k % 11 == 0, "").otherwise(F.col("c_name")).alias("owner_name"),
        F.concat("o_custkey", F.lit("/"), "c_nationkey").alias("survey_number"),
        F.when(k % 3 == 0, F.concat(F.lit("K"), (k % 5000).cast("string"))).otherwise("").alias("khasra_number"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).cast("double").alias("plot_area"),
        F.when(k % 4 == 0, "acre").when(k % 17 == 0, "chain").otherwise("hectare").alias("area_unit"),
        F.col("c_mktsegment").alias("village"),
        F.col("n_name").alias("district"),
        F.when(k % 19 == 0, "EUROPE").otherwise(F.col("r_name")).alias("state"),
        F.when(k % 5 == 0, (k % 100000).cast("string")).otherwise((100000 + k % 900000).cast("string")).alias("pincode"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("mutation_date"),
        ((k % 991) / F.lit(991.0)).alias("overall_confidence"),
        F.when(k % 3 == 0, "VERIFIED").when(k % 7 == 0, "REJECTED").otherwise("PENDING").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table: a row for each record and field; blanks and low confidence need review."""
    r = records(spark, sf_dir)
    names = list(FIELDS)
    text = {"plot_area": F.when(F.col("plot_area").isNotNull(), F.format_string("%.2f", "plot_area"))}  # areas with two places
    long = r.select("record_id", *[F.coalesce(text.get(n, F.col(n).cast("string")), F.lit("")).alias(n) for n in names]).unpivot("record_id", names, "field_name", "value")
    confidence = ((F.col("record_id") * 31 + F.length("field_name") * 7) % 101) / F.lit(101.0)
    source = F.when(F.col("record_id") % 23 == 0, "manual").otherwise("ocr")
    return long.withColumn("confidence", confidence).withColumn("source", source).withColumn("needs_review", (F.col("value") == "") | (F.col("confidence") < 0.75))


#: The same views for the SQL side, as common table expressions.
SQL = """
pl AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
docs AS (SELECT o_orderkey AS document_id, 'scan-' || o_orderkey || '.pdf' AS original_name, r_name AS state_name, n_name AS district_name,
  CASE o_orderstatus WHEN 'F' THEN 'PROCESSED' WHEN 'O' THEN 'UPLOADED' ELSE 'FAILED' END AS status, (o_orderkey % 997) / 997.0::DOUBLE AS ocr_confidence,
  o_orderkey % 7 + 1 AS page_count, o_orderdate AS uploaded_at FROM orders JOIN customer ON o_custkey = c_custkey JOIN pl ON c_nationkey = n_nationkey),
recs AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE c_name END AS owner_name, o_custkey || '/' || c_nationkey AS survey_number,
  CASE WHEN o_orderkey % 3 = 0 THEN 'K' || (o_orderkey % 5000) ELSE '' END AS khasra_number, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS plot_area,
  CASE WHEN o_orderkey % 4 = 0 THEN 'acre' WHEN o_orderkey % 17 = 0 THEN 'chain' ELSE 'hectare' END AS area_unit, c_mktsegment AS village, n_name AS district,
  CASE WHEN o_orderkey % 19 = 0 THEN 'EUROPE' ELSE r_name END AS state,
  CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 100000)::VARCHAR ELSE (100000 + o_orderkey % 900000)::VARCHAR END AS pincode,
  strftime(o_orderdate, '%d/%m/%Y') AS mutation_date, (o_orderkey % 991) / 991.0::DOUBLE AS overall_confidence,
  CASE WHEN o_orderkey % 3 = 0 THEN 'VERIFIED' WHEN o_orderkey % 7 = 0 THEN 'REJECTED' ELSE 'PENDING' END AS status, o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN pl ON c_nationkey = n_nationkey WHERE o_orderkey % 10 <> 0),
flds AS (SELECT *, CASE WHEN record_id % 23 = 0 THEN 'manual' ELSE 'ocr' END AS source, (value = '' OR confidence < 0.75) AS needs_review FROM (
  SELECT record_id, field_name, value, ((record_id * 31 + length(field_name) * 7) % 101) / 101.0::DOUBLE AS confidence FROM (
    SELECT record_id, unnest(['owner_name','survey_number','khasra_number','plot_area','area_unit','village','district','state','pincode','mutation_date']) AS field_name,
           unnest([owner_name, survey_number, khasra_number, coalesce(printf('%.2f', plot_area), ''), area_unit, village, district, state, pincode, mutation_date]) AS value FROM recs)))"""
