"""Pages to documents, attempts at a page, and the life of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states of a document.
UPLOADED, PROCESSING, PROCESSED, FAILED = "UPLOADED", "PROCESSING", "PROCESSED", "FAILED"


def first_result(attempts: DataFrame) -> DataFrame:
    """attempts: page_id, step, engine, text (null: the engine gave nothing), error. For each page the first engine by step that
    gave a text, its text, and the log of all steps up to it; engine is null where none did."""
    good = F.min(F.when(F.col("text").isNotNull(), F.col("step")))
    chosen = F.min_by(F.struct("engine", "text"), F.when(F.col("text").isNotNull(), F.struct("step", "engine")))
    steps = F.sort_array(F.collect_list(F.struct("step", F.concat("engine", F.lit(": "), F.when(F.col("text").isNotNull(), "ok").otherwise(F.coalesce("error", F.lit("nothing")))).alias("said"))))
    out = attempts.groupBy("page_id").agg(good.alias("at"), chosen.alias("c"), steps.alias("steps"))
    tried = F.filter("steps", lambda s: F.col("at").isNull() | (s["step"] <= F.col("at")))
    return out.select("page_id", F.when(F.col("at").isNotNull(), F.col("c.engine")).alias("engine"), F.when(F.col("at").isNotNull(), F.col("c.text")).alias("text"), F.transform(tried, lambda s: s["said"]).alias("log"))


def merged(pages: DataFrame) -> DataFrame:
    """pages: document_id, page_number, text, confidence. A row for each document: texts by page, joined by line ends, the mean
    of the pages' confidences (each page counts once), and how many pages there are. Null texts are empty."""
    rows = F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    out = pages.groupBy("document_id").agg(rows.alias("rows"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_pages"))
    return out.select("document_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"), "confidence", "n_pages")


def after_processing(documents: DataFrame, results: DataFrame) -> DataFrame:
    """documents: document_id, status, log; results: document_id, text, error. Documents with a result are PROCESSED, with an
    error FAILED, others stay as they are; the error is kept for the row, and each step is appended to the log."""
    out = documents.join(results.select("document_id", "text", "error", F.lit(True).alias("done")), "document_id", "left")
    status = F.when(F.col("done").isNull(), F.col("status")).when(F.col("error").isNotNull(), FAILED).otherwise(PROCESSED)
    steps = F.when(F.col("done").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit(PROCESSING), F.when(F.col("error").isNotNull(), F.concat(F.lit(f"{FAILED}: "), "error")).otherwise(PROCESSED)))
    return out.select("document_id", status.alias("status"), F.coalesce("error", F.lit("")).alias("error"), logged(F.col("log"), steps).alias("log"))


def logged(log: Column, steps: Column) -> Column:
    """A log with steps appended; a null log is empty."""
    return F.concat(F.coalesce(log, F.array().cast("array<string>")), steps)
