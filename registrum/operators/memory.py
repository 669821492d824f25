"""Correction memory: what officers changed, looked up exactly, then by similarity; how corrections are learned and
how a verification changes records. The memory is a reference table that officers fill by hand."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normal
from ..sources.shared import cut, kept

#: Least similarity of a suggestion and of a correction worth learning, least length of both texts.
SUGGEST_FROM, LEARN_FROM, SHORTEST = 0.88, 0.55, 3


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which Spark has no function for."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def not_known(values: DataFrame, memory: DataFrame) -> DataFrame:
    """Values that are not themselves corrections of their field."""
    good = memory.select("field_name", normal(F.col("corrected_value")).alias("key")).distinct()
    return values.withColumn("key", normal(F.col("value"))).join(good, ["field_name", "key"], "left_anti").drop("key")


def suggest_exact(values: DataFrame, memory: DataFrame) -> DataFrame:
    """values: field_name, value. The first correction (least id) of the same field and normalised text; an exact
    match comes before the test whether the value is itself a correction."""
    keyed = memory.withColumn("key", normal(F.col("raw_value"))).groupBy("field_name", "key").agg(F.min_by("corrected_value", "id").alias("suggestion"))
    return values.withColumn("key", normal(F.col("value"))).join(keyed, ["field_name", "key"]).where(normal(F.col("suggestion")) != F.col("key")).drop("key")


def _pieces_of(n: Column, least: float) -> Column:
    """Into how many pieces a raw text of n characters is cut: one more than characters may stay without partner."""
    longest = F.floor(n * ((2 - least) / least) + 1e-9)
    return (F.floor((n + longest) * (1 - least) + 1e-9) + 1).cast("int")


def suggest_fuzzy(values: DataFrame, memory: DataFrame, least: float = SUGGEST_FROM) -> DataFrame:
    """The most similar raw value of the same field. Of texts with a and b characters that are alike, at most
    (1 - least) * (a + b) characters have no partner in the other; each spoils one piece of the raw text at most, so
    one of the pieces stands whole in the value. Pieces are the key of the join; texts too short for them share the
    empty piece."""
    m = memory.select("field_name", "id", F.col("corrected_value").alias("suggestion"), normal(F.col("raw_value")).alias("raw"))
    m = m.groupBy("field_name", "raw").agg(F.min_by("suggestion", "id").alias("suggestion"), F.min("id").alias("id"))
    n = F.length("raw")
    count = _pieces_of(n, least)
    at = lambda i: F.floor(i * n / count).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("raw"), at(i) + 1, at(i + 1) - at(i)))
    m = m.withColumn("piece", F.explode(F.array_distinct(F.when(count > n, F.array(F.lit(""))).otherwise(pieces))))
    v = values.select("field_name", "value").distinct().withColumn("key", normal(F.col("value")))
    k = F.length("key")
    lengths = F.sequence(F.ceil(k * (least / (2 - least)) - 1e-9).cast("int"), F.floor(k * ((2 - least) / least) + 1e-9).cast("int"))
    sizes = lambda a: F.when(_pieces_of(a, least) > a, F.array(F.lit(0))).otherwise(F.array(F.floor(a / _pieces_of(a, least)).cast("int"), F.ceil(a / _pieces_of(a, least)).cast("int")))
    v = v.withColumn("size", F.explode(F.array_distinct(F.flatten(F.transform(lengths, sizes))))).where(F.col("size") <= k)
    parts = F.transform(F.sequence(F.lit(1), k - F.col("size") + 1), lambda i: F.substring(F.col("key"), i, F.col("size")))
    v = v.withColumn("piece", F.explode(F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(parts))))
    pairs = v.join(m, ["field_name", "piece"]).where(F.abs(n - k) <= F.greatest(F.lit(3), F.floor(k * 0.3)))
    pairs = pairs.where(2 * F.least(n, k) >= least * (n + k)).select("field_name", "value", "key", "raw", "suggestion", "id").distinct()
    pairs = pairs.withColumn("score", ratio("key", "raw")).where(F.col("score") >= least)
    return pairs.groupBy("field_name", "value").agg(F.max_by("suggestion", F.struct("score", -F.col("id"))).alias("suggestion"), F.max("score").alias("score"))


def bump(memory: DataFrame, used: DataFrame) -> DataFrame:
    """times_applied grown by the uses of each (field_name, corrected_value)."""
    counts = used.groupBy("field_name", "corrected_value").agg(F.count("*").alias("uses"))
    return memory.join(counts, ["field_name", "corrected_value"], "left").withColumn("times_applied", F.col("times_applied") + F.coalesce("uses", F.lit(0))).drop("uses")


def learnable(corrections: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """corrections: field_name, raw_value, corrected_value. Those worth remembering: of a learnable field, both long
    enough, different, and alike enough to be a misreading rather than other data."""
    c = corrections.where(F.col("field_name").isin(*fields)).select("field_name", "raw_value", "corrected_value").distinct()
    c = c.select("field_name", normal(F.col("raw_value")).alias("raw_value"), F.trim(F.regexp_replace(F.coalesce("corrected_value", F.lit("")), r"\s+", " ")).alias("corrected_value"))
    c = c.where((F.length("raw_value") >= SHORTEST) & (F.length("corrected_value") >= SHORTEST) & (F.col("raw_value") != normal(F.col("corrected_value")))).distinct()
    # kept, as the filter would else go below the distinct and compare the texts of every row
    return kept(c).where(ratio("raw_value", normal(F.col("corrected_value"))) >= LEARN_FROM)


def record_corrections(memory: DataFrame, corrections: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The memory with new corrections appended. Their ids follow the greatest there is, one by one in the order of their texts,
    so reruns agree and a correction learnt later comes after. The order is made by ranges and the ranges' counts."""
    key = ["field_name", "raw_value", "corrected_value"]
    new = learnable(corrections, fields).join(memory.select(*key), key, "left_anti")
    placed = cut(new.repartitionByRange(*key).sortWithinPartitions(*key).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row for each partition
    begins = [memory.agg(F.max("id")).first()[0] or 0]
    for part in range(max(counts, default=-1)):
        begins.append(begins[-1] + counts.get(part, 0))
    numbered = placed.withColumn("id", F.get(F.lit(begins), F.col("part")) + F.col("at") + 1).drop("part", "at")
    return memory.unionByName(numbered.withColumn("times_applied", F.lit(0).cast("long")), allowMissingColumns=True)


def changed_fields(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """fields: record_id, field_name, value; edits the same with what the officer wrote. The change set: old and new."""
    e = edits.select("record_id", "field_name", F.trim(F.coalesce("value", F.lit(""))).alias("new_value"))
    return fields.join(e, ["record_id", "field_name"]).where("coalesce(value, '') <> new_value").select("record_id", "field_name", F.coalesce("value", F.lit("")).alias("old_value"), "new_value")


def verified_fields(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Field rows after a verification: changed ones are manual, of confidence 0.97, and need no review."""
    change = changed_fields(fields, edits).select("record_id", "field_name", "new_value")
    hit = F.col("new_value").isNotNull()
    out = fields.join(change, ["record_id", "field_name"], "left")
    sets = {"value": F.coalesce("new_value", "value"), "confidence": F.when(hit, 0.97).otherwise(F.col("confidence")), "source": F.when(hit, "manual").otherwise(F.col("source")), "needs_review": ~hit & F.col("needs_review")}
    return out.withColumns(sets).drop("new_value")
