"""Tables that are kept by key: rows lie in partitions by a hash of their key, and a change rewrites the partitions of
its keys only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import kept


class KeyedTable:
    """A Parquet table at ``path`` with a partition column ``bucket``, the hash of the key modulo ``buckets``.

    Each partition holds one row more, with a null key, so that a partition of which all rows go is still overwritten; reads
    leave it out. Batches that were applied are listed beside the table, so a batch that comes again does nothing. One that was
    cut off half way is applied again from the start: replacing the rows of the same keys twice gives what once gives.
    One writer at a time. Rows with a null key are refused.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.columns = T.StructType.fromDDL(schema).fieldNames()
        self.schema = T.StructType.fromDDL(f"{schema}, bucket int")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _no_null(self, rows: DataFrame) -> DataFrame:
        wrong = F.array_join(F.array(*[F.lit(c) for c in self.key]), ", ")
        named = F.array(*[F.col(c).isNull() for c in self.key])
        return rows.where(F.when(F.exists(named, lambda x: x), F.raise_error(F.concat(F.lit("a key is null: "), wrong)).cast("boolean")).otherwise(True))

    def _write(self, rows: DataFrame, touched: list[int]) -> None:
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
        rows = self._no_null(rows.select(*self.columns)).withColumn("bucket", self.bucket()).unionByName(marks, allowMissingColumns=True)
        # a partition's rows are dealt to a task by bucket; AQE splits a bucket that is too large for one
        out = rows.hint("rebalance", "bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """All rows anew."""
        self._write(rows, list(range(self.buckets)))

    def read(self) -> DataFrame:
        return self._all().where(f"`{self.key[0]}` IS NOT NULL").select(*self.columns)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in keys.select(self.bucket().alias("bucket")).distinct().collect())  # as many as there are buckets, at most

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; other partitions than theirs are not read."""
        part = self._all().where(F.col("bucket").isin(self._touched(keys)) & F.col(self.key[0]).isNotNull())
        return part.join(keys.select(*self.key).distinct(), self.key, "left_semi").select(*self.columns)

    def applied(self, batch_id: int) -> bool:
        log = self.spark.createDataFrame([], "batch_id long") if not self._has_log() else self.spark.read.schema("batch_id long").parquet(self._log())
        return not log.where(F.col("batch_id") == batch_id).isEmpty()

    def _log(self) -> str:
        return f"{self.path}_batches"

    def _has_log(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._log())
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch_id: int | None = None) -> list[int]:
        """The partitions of some keys anew: change is given all their rows and gives what goes in, which may differ in the rows
        of these keys only; gives the partitions that were written. Made twice, a change must give what once gives."""
        if batch_id is not None and self.applied(batch_id):
            return []
        touched = self._touched(keys)
        if touched:
            # a dynamic overwrite stages its files and takes the old ones away when all are written, so they are read meanwhile
            self._write(change(self._all().where(F.col("bucket").isin(touched) & F.col(self.key[0]).isNotNull()).select(*self.columns)), touched)
        if batch_id is not None:
            self.spark.createDataFrame([(batch_id,)], "batch_id long").write.mode("append").parquet(self._log())
        return touched

    def replace(self, keys: DataFrame, rows: DataFrame, batch_id: int | None = None) -> list[int]:
        """Rows in place of all those of the keys; gives the partitions that were written. Keys without rows lose theirs."""
        if batch_id is not None and self.applied(batch_id):
            return []
        keys = kept(keys.select(*self.key).distinct())
        new = rows.join(keys, self.key, "left_semi").select(*self.columns)
        return self.rewrite(keys, lambda old: old.join(keys, self.key, "left_anti").select(*self.columns).unionByName(new), batch_id)

    def upsert(self, rows: DataFrame, batch_id: int | None = None) -> list[int]:
        """Rows in place of those of the same keys."""
        rows = kept(self._no_null(rows.select(*self.columns)))
        return self.replace(rows, rows, batch_id)
