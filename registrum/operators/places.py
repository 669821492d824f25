"""Places that a text names: a gazetteer of any size as a table, met by the text's word sequences.

The names of districts are joined to the sequences of one word, two words and so on that a line holds, up to the longest name's
words; the pairs that meet are then held to the name itself with its marks and word edges. So neither the plan nor a line's
work grows with the gazetteer. States are few: they travel as one array, and count wherever they stand, in a word too.
Of several names the first of the gazetteer counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States that a gazetteer may have; they are looked for one by one in each line.
MOST_STATES = 1000
#: Fixed value: names that are looked for inside of a line's row, one by one; more are joined.
MOST_FEW = 100
_WORD, _ENDS = r"(?U)\w+", r"(?U)^\w(.*\w)?$"
PLACES = "place long, state string, district string"


def gazetteer_table(spark: SparkSession, gazetteer: list[tuple[str, str]]) -> DataFrame:
    """place (the order), state, district."""
    return spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(gazetteer)], PLACES)


def _first(names: DataFrame) -> DataFrame:
    return names.where("name <> ''").groupBy("name").agg(F.min("place").alias("place"))


def few(gazetteer: DataFrame) -> tuple[list, list] | None:
    """States and districts, (place, name, lower-case name) by rank, where there are at most MOST_FEW of each; else None. Both as
    states_named and districts_named take them."""
    out = []
    for kind, fits in (("state", F.lit(True)), ("district", F.col("low").rlike(_ENDS))):
        names = _first(gazetteer.select(F.col(kind).alias("name"), "place")).withColumn("low", F.lower("name")).where(fits)
        rows = names.orderBy("place", "name").limit(MOST_FEW + 1).collect()
        if len(rows) > MOST_FEW:
            return None
        out.append([(r["place"], r["name"], r["low"]) for r in rows])
    return out[0], out[1]


def districts_named(lines: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """lines: doc_id, page, line, low (lower case). doc_id, page, line, place, name: the first district that each line names, as words
    of their own. Names are taken that begin and end with a letter or digit."""
    names = _first(gazetteer.select(F.col("district").alias("name"), "place")).withColumn("low_name", F.lower("name"))
    words = F.regexp_extract_all("low_name", F.lit(_WORD), F.lit(0))
    names = names.withColumn("key", F.array_join(words, " ")).withColumn("n", F.size(words)).where(F.col("low_name").rlike(_ENDS))
    longest = names.agg(F.max("n")).first()[0] or 0
    if not longest:
        return lines.select("doc_id", "page", "line", F.lit(0).cast("long").alias("place"), F.lit("").alias("name")).limit(0)
    held = lines.select("doc_id", "page", "line", "low", F.regexp_extract_all("low", F.lit(_WORD), F.lit(0)).alias("words")).where(F.size("words") > 0)
    count = F.size("words")
    sequences = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), count)), lambda n: F.transform(F.sequence(F.lit(0), count - n), lambda i: F.array_join(F.slice("words", i + 1, n), " "))))
    met = held.select("doc_id", "page", "line", "low", F.explode(F.array_distinct(sequences)).alias("key")).join(names, "key")
    met = met.where(F.regexp_like("low", F.concat(F.lit(r"(?U)\b\Q"), "low_name", F.lit(r"\E\b"))))
    return met.groupBy("doc_id", "page", "line").agg(F.min(F.struct("place", "name")).alias("p")).select("doc_id", "page", "line", "p.place", "p.name")


def states_named(lines: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The same for states, wherever in a line they stand."""
    names = _first(gazetteer.select(F.col("state").alias("name"), "place"))
    few = names.limit(MOST_STATES + 1).collect()
    if len(few) > MOST_STATES:
        raise ValueError(f"a gazetteer may have {MOST_STATES} states")
    kind = T.StructType.fromDDL("states array<struct<place:bigint,name:string,low:string>>")
    one = lines.sparkSession.createDataFrame([(sorted((r["place"], r["name"], r["name"].lower()) for r in few),)], kind)
    hit = F.get(F.filter("states", lambda s: F.col("low").contains(s["low"])), F.lit(0))
    rows = lines.select("doc_id", "page", "line", "low").join(F.broadcast(one)).withColumn("p", hit).where("p IS NOT NULL")  # one row of MOST_STATES names
    return rows.select("doc_id", "page", "line", "p.place", "p.name")


def lower_text(words: Column) -> Column:
    return F.lower(F.array_join(F.transform(words, lambda w: w["text"]), " "))
