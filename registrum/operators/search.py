"""Substring search over many rows: a stored table of trigrams leaves few rows to look at.

A text of three characters or more can only stand in a row that holds all of its trigrams. ``build`` stores the rows in ranges
of their key and, beside them, the trigrams of the searched columns in ranges of trigram and key, so that Parquet's
statistics skip what a search does not need; a trigram that very many rows hold spans several files. ``search`` reads
the postings of the text's rarest trigrams, keeps the keys that have all, reads these rows and looks for the text itself.
The result is what a scan gives. Texts shorter than a trigram are scanned for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut
from .filters import any_holds

#: Trigrams of a text that are looked up, the rarest of it; keys that are named in a filter, beyond which they are joined.
LOOKED_UP, NAMED = 4, 1000
#: Distinct trigrams of a text that are counted to find the rarest.
COUNTED = 64


def trigrams(columns: list[str]) -> Column:
    """The distinct trigrams of the columns in lower case; none of them spans two columns."""

    def of(c: str) -> Column:
        low = F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[of(c) for c in columns])))


class SubstringIndex:
    """Rows and trigrams under ``path``. key is a column of distinct values without nulls; columns are those searched."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: list[str]):
        self.spark, self.path, self.key, self.columns = spark, path.rstrip("/"), key, columns

    def build(self, rows: DataFrame, partitions: int | None = None) -> None:
        """Stores rows and trigrams anew. partitions: files of each, by default as many as the session's shuffles have."""
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(n, self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.path}/rows")
        grams = rows.select(self.key, F.explode(trigrams(self.columns)).alias("gram"))
        grams.repartitionByRange(n, "gram", self.key).sortWithinPartitions("gram", self.key).write.mode("overwrite").parquet(f"{self.path}/grams")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def candidates(self, text: str) -> DataFrame | None:
        """Keys of the rows that hold the rarest trigrams of the text; None where it is too short to say."""
        low = text.strip().lower()
        grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})[:COUNTED]
        if not grams:
            return None
        postings = self.spark.read.parquet(f"{self.path}/grams")
        counts = {r["gram"]: r["count"] for r in postings.where(F.col("gram").isin(grams)).groupBy("gram").count().collect()}  # COUNTED at most
        rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:LOOKED_UP]
        met = postings.where(F.col("gram").isin(rarest)).groupBy(self.key).agg(F.count("*").alias("n"))
        return met.where(F.col("n") == len(rarest)).select(self.key)

    def search(self, text: str) -> DataFrame:
        """The rows of which a searched column holds the text, in any case; all rows where it is blank."""
        found = self.candidates(text)
        rows = self.rows()
        if found is not None:
            found = cut(found)
            few = found.limit(NAMED + 1).collect()
            rows = rows.where(F.col(self.key).isin([r[0] for r in few])) if len(few) <= NAMED else rows.join(found, self.key, "left_semi")
        return rows.where(any_holds(self.columns, text))
