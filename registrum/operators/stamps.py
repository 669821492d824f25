"""Stamps: choice among detected boxes, overlap with words, the stamp rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wording that stands for a stamp or for a digital document, the overlap that counts, the most boxes a
#: page can plausibly have, the overlap of boxes that are one.
TERMS = ("signature", "signed", "lekhpal", "certified", "certify", "certificate", "attest", "attested", "seal", "लेखपाल", "प्रमाणित", "हस्ताक्षर", "मुहर", "सत्यापित")
DIGITAL = ("digitally signed", "e-services", "eservices", "reference number", "2d barcode", "tamil nadu", "patta", "section 10")
OVERLAP, MOST, SAME = 0.15, 5, 0.4
#: Side of the grid squares by which boxes and words meet.
CELL = 256


def inter(a: Column, b: Column) -> Column:
    """Common area of two boxes (x, y, w, h)."""
    side = lambda at, size: F.greatest(F.lit(0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
    return side("x", "w") * side("y", "h")


def iou(a: Column, b: Column) -> Column:
    both = inter(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def box(x: Column) -> Column:
    """A box given as x, y, w, h or as x1, y1, x2, y2 (null where the other form is used)."""
    return F.struct(F.coalesce(x["x"], x["x1"]).alias("x"), F.coalesce(x["y"], x["y1"]).alias("y"), F.coalesce(x["w"], x["x2"] - x["x1"]).alias("w"), F.coalesce(x["h"], x["y2"] - x["y1"]).alias("h"))


def plausible(boxes: Column) -> Column:
    """Boxes by falling area, without those that overlap a larger one; none at all where too many stay."""
    big = F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct((-b["w"] * b["h"]).alias("area"), b.alias("b")))), lambda r: r["b"])
    kept = F.aggregate(big, F.filter(boxes, lambda _: F.lit(False)), lambda held, b: F.when(F.exists(held, lambda k: iou(k, b) >= SAME), held).otherwise(F.array_append(held, b)))
    return F.when(F.size(kept) > MOST, F.filter(boxes, lambda _: F.lit(False))).otherwise(kept)


def _cells(box_: Column) -> Column:
    """The grid squares that a box touches."""
    span = lambda at, size: F.sequence(F.floor(box_[at] / CELL), F.floor((box_[at] + box_[size]) / CELL))
    return F.flatten(F.transform(span("x", "w"), lambda i: F.transform(span("y", "h"), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def overlapped(stamps: DataFrame, words: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """stamps: page_id, nth, x, y, w, h; words: page_id, x, y, w, h. For each stamp that covers words: n_words. Boxes
    meet by grid square, so the overlap join is an equi-join; a pair counts in the square of its common corner only."""
    s = stamps.select("page_id", "nth", F.struct("x", "y", "w", "h").alias("s"))
    s = s.withColumn("cell", F.explode(_cells(F.col("s"))))
    w = words.select("page_id", F.struct("x", "y", "w", "h").alias("b"))
    w = w.withColumn("cell", F.explode(_cells(F.col("b"))))
    a, b = F.col("s"), F.col("b")
    corner = (F.floor(F.greatest(a["x"], b["x"]) / CELL) == F.col("cell.i")) & (F.floor(F.greatest(a["y"], b["y"]) / CELL) == F.col("cell.j"))
    hit = (iou(a, b) > overlap) | (inter(a, b) / F.greatest(b["w"] * b["h"], F.lit(1)) > overlap)
    return s.join(w, ["page_id", "cell"]).where(corner & hit).groupBy("page_id", "nth").agg(F.count("*").alias("n_words"))


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def issues(pages: DataFrame, stamps: DataFrame, words: DataFrame, require: bool = True) -> DataFrame:
    """pages: page_id, text. Rows of page_id, rule_code, severity, message."""
    row = lambda rule, severity, message: (F.lit(rule).alias("rule_code"), F.lit(severity).alias("severity"), message.alias("message"))
    counts = stamps.groupBy("page_id").agg(F.count("*").alias("n"))
    many = counts.where("n >= 3").select("page_id", *row("STAMP_MULTIPLE", "warning", F.concat(F.col("n").cast("string"), F.lit(" stamps on one page: which of them holds must be settled"))))
    covered = overlapped(stamps, words).where("n_words >= 3").select("page_id", *row("STAMP_OVERLAP", "error", F.format_string("three words or more lie under stamp %d and may be unreadable", F.col("nth") + 1)))
    out = many.unionByName(covered)
    if require:
        low = F.lower(F.coalesce("text", F.lit("")))
        bare = pages.where(~_any(low, TERMS) & ~_any(low, DIGITAL)).join(counts, "page_id", "left_anti")
        out = out.unionByName(bare.select("page_id", *row("STAMP_MISSING", "error", F.lit("neither a stamp nor any word of a signature or certificate was found"))))
    return out
