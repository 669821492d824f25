"""Deep pages of ordered lists: a list is sorted once by ranges and stored; a page is then read from the range that holds it,
wherever in the list it is, instead of sorting and dropping all rows before it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class OrderedList:
    """A list under ``path``: rows in partitions ``part`` by range, each with its place ``at`` in the partition, and beside them how
    many rows each partition has. order: column names, a leading minus for descending; they must end in one of distinct
    values. Nulls come first in ascending order, last in descending."""

    def __init__(self, spark: SparkSession, path: str, order: list[str]):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    def _by(self) -> list[Column]:
        return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in self.order]

    def build(self, rows: DataFrame, partitions: int | None = None) -> None:
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.repartitionByRange(n, *self._by()).sortWithinPartitions(*self._by())
        placed = placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
        placed.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rows")
        counts = self._rows(placed.schema.json()).groupBy("part").agg(F.count("*").alias("n")).withColumn("schema", F.lit(None).cast("string"))
        # the rows' schema stands with the counts, as an empty list has no file to tell it
        head = self.spark.createDataFrame([(-1, 0, placed.schema.json())], "part int, n long, schema string")
        counts.unionByName(head).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts")

    def _counts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/counts")

    def _rows(self, schema: str | None = None) -> DataFrame:
        schema = schema or self._counts().where("part = -1").first()["schema"]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(f"{self.path}/rows")

    def begins(self) -> list[tuple[int, int, int]]:
        """(part, rows before it, rows in it) of each partition, in order."""
        out, before = [], 0
        for r in self._counts().where("part >= 0").orderBy("part").collect():  # a row for each partition
            out.append((r["part"], before, r["n"]))
            before += r["n"]
        return out

    def slice(self, first: int, size: int) -> DataFrame:
        """Rows first to first + size - 1 of the list, counted from 0, with their place ``rank`` from 1."""
        held = [(part, before) for part, before, n in self.begins() if before < first + size and before + n > first]
        rows = self._rows().where(F.col("part").isin([p for p, _ in held]))
        place = F.lit(-1).cast("long")
        near = F.lit(False)
        for part, before in held:  # a page spans as many partitions as it has rows, at most
            place = F.when(F.col("part") == part, F.col("at") + before).otherwise(place)
            near = near | ((F.col("part") == part) & F.col("at").between(first - before, first - before + size - 1))
        return rows.where(near).withColumn("rank", place + 1).drop("part", "at")

    def page(self, number: int, size: int = 20) -> DataFrame:
        """A page with its envelope, as ``filters.page`` gives it: count, page, pages; a number outside gives the nearest page."""
        count = sum(n for _, _, n in self.begins())
        pages = max(1, -(-count // size))
        number = min(max(number, 1), pages)
        return self.slice((number - 1) * size, size).withColumns({"count": F.lit(count).cast("long"), "page": F.lit(number).cast("long"), "pages": F.lit(pages).cast("long")})

    def after(self, key: dict, size: int = 20) -> DataFrame:
        """The rows that follow the one whose order columns have the values of key; none where there is no such row."""
        here = self._rows()
        for c in self.order:
            name = c.removeprefix("-")
            here = here.where(F.col(name).isNull() if key[name] is None else F.col(name) == F.lit(key[name]))
        found = here.select("part", "at").first()
        if found is None:
            return self.slice(0, 0)
        before = {part: b for part, b, _ in self.begins()}[found["part"]]
        return self.slice(before + found["at"] + 1, size)
