"""Words, lines and labels: text to geometry, rows and columns, interval selection, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The synthetic page grid.
CHAR_W, LINE_STEP, FIRST_Y, HEIGHT = 10, 38, 40, 26
#: Unicode ranges by script, in the order that settles ties.
SCRIPTS = {"hin": r"[\x{0900}-\x{097F}]", "ben": r"[\x{0980}-\x{09FF}]", "pan": r"[\x{0A00}-\x{0A7F}]", "guj": r"[\x{0A80}-\x{0AFF}]", "tam": r"[\x{0B80}-\x{0BFF}]", "tel": r"[\x{0C00}-\x{0C7F}]", "kan": r"[\x{0C80}-\x{0CFF}]", "mal": r"[\x{0D00}-\x{0D7F}]"}


def begins_of_words(raw: str | Column, marks: tuple[str, ...] = (" ",)) -> Column:
    """Where the words of a line begin, cut at each mark (one character): from the marks' places, one step for each character."""
    after = F.transform(F.split(raw, ""), lambda c, i: F.when(c.isin(*marks), i + 1))
    return F.concat(F.array(F.lit(0)), F.filter(after, lambda i: i.isNotNull()))


def words_of(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A row for each word with its place on the grid: id, line, pos, text, x, y, w, h."""
    lines = docs.select(id_column, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    # a word's column is the length of the line before it: known inside the row, so nothing is shuffled
    parts = F.split("raw", " ")
    words = lines.select(id_column, "line", F.posexplode(F.arrays_zip(parts.alias("text"), begins_of_words("raw").alias("at"))).alias("pos", "w"))
    placed = words.select(id_column, "line", "pos", F.col("w.text").alias("text"), (F.col("w.at") * CHAR_W).cast("long").alias("x"))
    return placed.where("text <> ''").select(id_column, "line", "pos", "text", "x", (F.col("line") * LINE_STEP + FIRST_Y).cast("long").alias("y"), (F.length("text") * CHAR_W).cast("long").alias("w"), F.lit(HEIGHT).cast("long").alias("h"))


def lines_of(words: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Words to lines, by x: id, line, text, n_words."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"])
    return words.groupBy(id_column, "line").agg(F.array_join(ordered, " ").alias("text"), F.count("*").alias("n_words"))


def detect_script(text: Column) -> Column:
    """The script with most characters, from three on and not fewer than Latin ones; else eng."""
    counts = F.array(*[F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, (s, p) in enumerate(SCRIPTS.items())])
    best = F.array_max(counts)
    return F.when((best["n"] >= 3) & (best["n"] >= F.regexp_count(text, F.lit(r"[A-Za-z]"))), best["s"]).otherwise("eng")


def non_overlapping(hits: Column) -> Column:
    """Greedy choice from an array of (rank, start, end): the least rank first, none that overlaps a chosen one."""
    empty = F.filter(hits, lambda _: F.lit(False))
    return F.aggregate(F.array_sort(hits), empty, lambda kept, h: F.when(F.exists(kept, lambda k: (k["start"] < h["end"]) & (h["start"] < k["end"])), kept).otherwise(F.array_append(kept, h)))


def iou(a: str, b: str) -> Column:
    """Overlap of boxes in columns a and b (x, y, w, h) over their union."""
    c = F.col
    dx = F.greatest(F.lit(0), F.least(c(f"{a}.x") + c(f"{a}.w"), c(f"{b}.x") + c(f"{b}.w")) - F.greatest(c(f"{a}.x"), c(f"{b}.x")))
    dy = F.greatest(F.lit(0), F.least(c(f"{a}.y") + c(f"{a}.h"), c(f"{b}.y") + c(f"{b}.h")) - F.greatest(c(f"{a}.y"), c(f"{b}.y")))
    union = c(f"{a}.w") * c(f"{a}.h") + c(f"{b}.w") * c(f"{b}.h") - dx * dy
    return F.when(union > 0, dx * dy / union).otherwise(F.lit(0.0))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered list. The order must end in a unique column."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def gamma(mean: Column) -> Column:
    """The exponent that brings a page's mean brightness (0 to 255) to the middle."""
    return F.greatest(F.lit(0.4), F.least(F.lit(2.8), F.log(F.greatest(F.lit(0.05), F.least(F.lit(0.95), mean / 255.0))) / F.log(F.lit(0.5))))
