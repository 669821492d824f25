"""Files in and out: page images and texts, CSV and JSON of the register, appended audit rows, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file types that uploads may have, and the most pages of one document that are processed.
TYPES = ("pdf", "jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")
MAX_PAGES, MAX_DETAIL = 20, 2000


def allowed(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*TYPES)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files: path, length, content, modificationTime; other types are left out before content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(allowed(F.col("path")))


def capped_pages(pages: DataFrame, most: int = MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """pages: document_id, page_number from 1. The pages processed, and page_count and processed_page_count of each
    document (the cap is a feature: the true count is kept)."""
    counts = pages.groupBy("document_id").agg(F.count("*").alias("page_count"), F.count_if(F.col("page_number") <= most).alias("processed_page_count"))
    return pages.where(F.col("page_number") <= most), counts


#: Titles of the exported columns.
EXPORT = {"record_id": "ID", "owner_name": "Owner Name", "survey_number": "Survey Number", "khasra_number": "Khasra Number", "plot_area": "Plot Area", "area_unit": "Area Unit", "village": "Village / Mauza", "district": "District", "state": "State", "pincode": "PIN Code", "mutation_date": "Mutation Date", "status": "Status"}


def export_rows(records: DataFrame) -> DataFrame:
    """The register as it is exported: titled columns, blanks for null and zero, confidence in percent."""
    text = lambda c: F.when(F.col(c).isNull() | (F.col(c).cast("string").isin("0", "0.0")), "").otherwise(F.col(c).cast("string"))
    return records.select(*[text(c).alias(t) for c, t in EXPORT.items() if c in records.columns], F.round(F.col("overall_confidence") * 100, 1).alias("Confidence %"))


def write_csv(records: DataFrame, path: str) -> None:
    export_rows(records).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def record_json(records: DataFrame, fields: DataFrame, issues: DataFrame) -> DataFrame:
    """record_id, json: each record with its fields and issues nested. Both children are gathered before they are
    joined, so their counts do not multiply."""
    f = fields.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("field_name", "value", "confidence", "source", "needs_review"))).alias("fields"))
    i = issues.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("severity", "rule_code", "field_name"))).alias("issues"))
    all_ = records.join(f, "record_id", "left").join(i, "record_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(all_.schema[c].dataType)).alias(c)
    return all_.select("record_id", F.to_json(F.struct(*[F.col(c) for c in records.columns], empty("fields"), empty("issues"))).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def audit_rows(events: DataFrame) -> DataFrame:
    """action, object_type, object_id, user_label, detail (cut to 2,000 characters), created_at."""
    return events.select("action", "object_type", F.col("object_id").cast("string").alias("object_id"), F.coalesce("user_label", F.lit("system")).alias("user_label"), F.substring(F.coalesce("detail", F.lit("")), 1, MAX_DETAIL).alias("detail"), "created_at")


def append_audit(events: DataFrame, path: str) -> None:
    audit_rows(events).write.mode("append").parquet(path)


def upserted(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with rows in place of those of the same key."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def ocr_words(responses: DataFrame) -> DataFrame:
    """responses: doc_id, body (JSON of a remote engine: regions > lines > words, texts under text, source or target,
    confidence 0 to 1 or to 100, boxes as x, y, w, h or x1 to y2). A row for each word; other shapes give none."""
    word = "struct<text:string,source:string,target:string,confidence:double,x:double,y:double,w:double,h:double,x1:double,y1:double,x2:double,y2:double>"
    body = F.from_json("body", f"struct<regions:array<struct<lines:array<struct<words:array<{word}>>>>>>")
    rows = responses.select("doc_id", F.posexplode(body["regions"]).alias("block", "r")).select("doc_id", "block", F.posexplode("r.lines").alias("line", "l")).select("doc_id", "block", "line", F.posexplode("l.words").alias("pos", "q"))
    c = F.coalesce("q.confidence", F.lit(0.9))
    return rows.select("doc_id", "block", "line", "pos", F.coalesce("q.text", "q.source", "q.target").alias("text"), (F.when(c > 1, c / 100).otherwise(c) * 100).alias("conf"), F.coalesce("q.x", "q.x1").alias("x"), F.coalesce("q.y", "q.y1").alias("y"), F.coalesce("q.w", F.expr("q.x2 - q.x1")).alias("w"), F.coalesce("q.h", F.expr("q.y2 - q.y1")).alias("h")).where("text <> ''")
