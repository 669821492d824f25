"""The register on streams. Each transformation takes a streaming or a batch DataFrame, so tests and backfills run the
same plan; state is bounded by watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract

UPLOAD = "doc_id long, text string, original_name string, file_size long, user_label string, uploaded_at timestamp"


def uploads(spark: SparkSession, path: str, schema: str = UPLOAD, files: int = 100) -> DataFrame:
    """New Parquet files of a folder, so many a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def without_running(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """An upload of the same name, size and user is taken once while the first may still run."""
    keys = ["original_name", "file_size", "user_label"]
    if rows.isStreaming:
        return rows.withWatermark("uploaded_at", delay).dropDuplicatesWithinWatermark(keys)
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct("uploaded_at", "doc_id")).alias("r"))
    return first.select("r.*")


def counts_by_window(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Events by type in tumbling or sliding windows of ts; rows later than the delay are left out of a stream."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """A user's visits: events no further apart than the gap."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def extract_to(path: str, labels: list | None = None, gazetteer: list | DataFrame = (), memory: Callable[[SparkSession], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the fields of a batch's documents, written under its batch id, so that a batch which runs again
    replaces its own rows. The memory is read anew for each batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        known = memory(batch.sparkSession) if memory else None
        extract.extract_text(batch.select("doc_id", "text"), labels, gazetteer, known).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run


def start_extraction(rows: DataFrame, path: str, checkpoint: str, **parts) -> StreamingQuery:
    return without_running(rows).writeStream.foreachBatch(extract_to(path, **parts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
