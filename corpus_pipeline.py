"""The corpus pipeline: each stage takes what the one before kept.

In each stage extra columns go along, whatever their names; empty tables give empty tables; repeated rows are rows of their
own but for near duplicates, of which they are. What nulls, empty texts and ties lead to is said of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from registrum.llm import mixing, ngram_join, packing, substring_dedup, toxicity
from registrum.llm.common import cut


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go: a score of 0.7 or more. Null and empty texts have the score of a text without
    any telling word and stay; rows that share a doc_id are each judged by their text."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group that five-word shingles link at a similarity of 0.8; of several texts of that id
    one. Texts without words all stay; rows without an id are not linked, of those with one text one stays."""
    return ngram_join.keep_one(docs, 5, 80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a document of smaller doc_id has are cut out, judged on the stage's input; what is left of a text is
    joined by one space and n_chars recounted, documents of which nothing is left go. Null and empty texts stay, rows without
    an id neither give nor lose words."""
    return substring_dedup.strip_substrings(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, 3, 1 and 2 by turns, null the last source: words of a text may come twice, or in part.
    Null and empty texts have no word to be drawn and go; rows are drawn each by itself, without an id too."""
    return mixing.mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the permitted lengths, best fit: a row for each piece of a text with its bin, as packing.pack says. Null and empty texts
    take no room; ties go by id."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
