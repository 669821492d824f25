"""Page quality: the level that routes a page, its reasons and its score, from the page's measures; which page and
language result is kept. Measures: short_side, dark_pct, bright_pct, contrast, blur, noise, skew, edge_density."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Bounds of the measures; every one is a setting."""

    min_width: int = 900
    dark_pct: float = 0.35
    bright_pct: float = 0.55
    contrast: float = 45.0
    blur: float = 90.0
    noise: float = 12.0
    skew: float = 1.5
    edge_low: float = 0.01
    edge_high: float = 0.22


def _clean(m: Limits) -> Column:
    c = F.col
    return (c("blur") >= m.blur) & (c("contrast") >= m.contrast) & (c("noise") <= m.noise) & (c("dark_pct") < 0.12) & (c("bright_pct") > 0.40) & (c("short_side") >= int(m.min_width * 0.9))


def level(m: Limits = Limits()) -> Column:
    """minimal, moderate or heavy. Each heavy sign outranks each moderate one; very few edges take heavy back, very
    many set it again; a clean digital page is minimal whatever else is measured."""
    c, skew = F.col, F.abs(F.col("skew"))
    heavy = (c("short_side") < int(m.min_width * 0.8)) | (c("dark_pct") > m.dark_pct) | ((c("bright_pct") > m.bright_pct) & (c("contrast") < m.contrast)) | (c("blur") < m.blur * 0.6) | (c("noise") > m.noise * 1.5) | (skew > m.skew * 2)
    moderate = (c("contrast") < m.contrast) | (c("blur") < m.blur) | (c("noise") > m.noise) | (skew > m.skew)
    return F.when(_clean(m), "minimal").when(c("edge_density") > m.edge_high, "heavy").when(heavy, F.when(c("edge_density") < m.edge_low, "moderate").otherwise("heavy")).when(moderate, "moderate").otherwise("minimal")


def score(m: Limits = Limits()) -> Column:
    """The product of what each measure and the resolution cost, 0 to 1."""
    c, one = F.col, F.lit(1.0)
    share = lambda x, of: F.when(x >= of, one).otherwise(F.greatest(F.lit(0.4), x / of))
    noise = F.when(c("noise") <= m.noise, one).otherwise(F.greatest(F.lit(0.4), m.noise / F.greatest(c("noise"), one)))
    q = share(c("contrast"), m.contrast) * share(c("blur"), m.blur) * noise * F.greatest(F.lit(0.5), 1.0 - c("dark_pct") * 0.6) * F.greatest(F.lit(0.5), 1.0 - F.greatest(F.lit(0.0), c("bright_pct") - 0.5))
    return F.greatest(F.lit(0.0), F.least(one, q * F.greatest(F.lit(0.0), F.least(one, c("short_side") / float(m.min_width)))))


def plainly_clean() -> Column:
    """Whether a page looks made by a computer, where no level is measured. Its six bounds."""
    c = F.col
    return (c("blur") >= 90.0) & (c("contrast") >= 40.0) & (c("noise") <= 14.0) & (c("dark_pct") < 0.15) & (c("bright_pct") > 0.35) & (c("short_side") >= 700)


def with_stamp(level_: Column, stamped: Column) -> Column:
    """A stamped page gets at least the moderate chain."""
    return F.when(stamped & (level_ == "minimal"), "moderate").otherwise(level_)


def needs_rescue(word_count: Column, avg_conf: Column) -> Column:
    return (word_count < 8) | ((word_count < 25) & (avg_conf < 0.20))


def kept_attempt(word_count: str, avg_conf: str, order: str, what: str) -> Column:
    """Aggregate: of a page's attempts the one with most words, then confidence, then the first."""
    return F.max_by(what, F.struct(F.col(word_count), F.col(avg_conf), -F.col(order)))


def language_score(avg: Column, n_words: Column, n_script: Column, mismatch: Column) -> Column:
    """What ranks the result of each language; mismatch: an English result under another language's code."""
    return avg + 0.15 * F.least(n_words, F.lit(100)) + 0.35 * F.least(n_script, F.lit(100)) - F.when(mismatch, 8.0).otherwise(0.0)
