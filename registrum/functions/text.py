"""Text normalisation and typed parsers as Column expressions; all but ``nfkc`` stays in the JVM.

Parsers take text in NFKC form (see ``normalised``). Null counts as empty; a parser that finds nothing gives an empty
value of quality 0."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Look-alikes of OCR and the letter or mark each stands for, character by character.
LOOKALIKES = ("0158692|!@$£¢€§©—–“”’", "olsbggzllasecesc--\"\"'")
#: Hectares in one unit.
HECTARES = {"hectare": 1.0, "acre": 0.404686, "sq.m": 0.0001, "sq.ft": 0.0000092903, "sq.yd": 0.00008361, "bigha": 0.2529, "biswa": 0.0126, "guntha": 0.0101, "cent": 0.00405, "are": 0.01, "kanal": 0.05059, "marla": 0.00253, "ground": 0.0223}
#: Patterns of units, the first that matches counts.
UNIT_PATTERNS = {
    "hectare": r"hect?ares?|hectr?es?|\bhect?\b|\bha\b|\bhe\b|हेक्टेयर|हेक्टर|হেক্টর|ஹெக்டேர்|హెక్టార్|ഹെക്ടർ|ಹೆಕ್ಟೇರ್|હેક્ટર|ਹੈਕਟੇਅਰ",
    "acre": r"acres?|\bac\b|एकड़|एकड|ஏக்கர்|একর|ఎకరం|ఎకరాలు|ഏക്കർ|ಎಕರೆ|એકર|ਏਕੜ",
    "sq.ft": r"sq\.?\s*ft\b|sq\.?\s*feet|square\s*fe?e?t|sqft|वर्ग\s*फीट|বর্গফুট|சதுர அடி|చదరపు అడుగులు|ચોરસ ફૂટ",
    "sq.m": r"sq\.?\s*m(?:tr|eters?|etres?)?\b|square\s*met(?:er|re)s?|वर्ग\s*मीटर",
    "sq.yd": r"sq\.?\s*y(?:d|ards?)\b|square\s*yards?|गज",
    "cent": r"cents?\b|சென்ட்|சент|సెంటు|സെന്റ്|ಸೆಂಟ್",
    "bigha": r"bighas?\b|बीघा",
    "biswa": r"bisw?as?\b|बिसवा",
    "guntha": r"gunthas?\b|guntas?\b|गुंठा",
    "kanal": r"kanals?\b|कनाल",
    "marla": r"marlas?\b|मरला",
    "ground": r"grounds?\b",
    "are": r"\bares?\b|आर",
}


def _any_unit(parts: list[str]) -> str:
    """One pattern for all units; a look at the first letter spares most places of a text the list of names."""
    latin, others = [p for p in parts if p.isascii()], [p for p in parts if not p.isascii()]
    firsts = "".join(sorted({p.removeprefix(r"\b")[0] for p in latin}))
    return rf"(?i)(?=[{firsts}])(?:{'|'.join(latin)})|(?=[\x{{0900}}-\x{{0DFF}}])(?:{'|'.join(others)})"


_UNIT_NAMES = [p for pattern in UNIT_PATTERNS.values() for p in re.split(r"\|(?![^(]*\))", pattern)]
#: Any unit, and any unit whatever stands beside it: without the second no part of a text holds the first.
ANY_UNIT, ANY_UNIT_LETTERS = _any_unit(_UNIT_NAMES), _any_unit([p.replace(r"\b", "") for p in _UNIT_NAMES])
#: Patterns of the typed values, words that no value is, and hints.
NUMBER = r"\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?"
DATE_DMY = r"\b(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{2,4})\b"
DATE_YMD = r"\b(\d{4})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{1,2})\b"
DATE_D_MONTH = r"\b(\d{1,2})\s*(?:st|nd|rd|th)?[\s\-,]+([A-Za-z]{3,9})[\s\-,]+(\d{2,4})\b"
DATE_MONTH_D = r"\b([A-Za-z]{3,9})[\s\-,]+(\d{1,2})(?:st|nd|rd|th)?[\s\-,]+(\d{2,4})\b"
PLOT = r"\b(?:[A-Za-z]{1,4}[-/])?\d+[A-Za-z]{0,2}(?:\s*[/-]\s*\d+[A-Za-z]{0,2}|\s*[/-]\s*[A-Za-z]{1,2}\b){0,3}"
PIN = r"\b([1-9]\d{2}\s?\d{3})\b"
PIN_ALONE = rf"(?<!\d/){PIN}(?!\s*/\s*\d)"
JUNK = r"(?i)^(?:n/?a|nil|none|-+|not\s*available|value|particulars|details)$"
HEADING = r"(?i)government\s+of|department\s+of|office\s+of|revenue\s+code|form\s+no|prescribed|record\s+of\s+rights|extract|certificate"
NAME_TOKEN = r"^[A-Za-zऀ-෿‌‍][A-Za-zऀ-෿‌‍.'’\-]*$"
STOP_VALUES = "office government department form code revenue tehsildar collector signature seal date value कार्यालय शासन विभाग सरकार तहसीलदार पटवारी हस्ताक्षर मुहर एकल संयुक्त सिंचित असिंचित कृषि आवासीय single joint irrigated agricultural residential".split()
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
LAND_HINTS = "irrigated unirrigated dry wet nanjai punjai agricultural agriculture residential commercial barren waste forest orchard garden industrial govt government सिंचित असिंचित कृषि आवासीय बंजर".split()
OWNERSHIP_HINTS = "single joint individual co-owner coowner government trust company institutional एकल संयुक्त सरकारी व्यक्तिगत".split()


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once."""
    return F.transform(F.array(x), body)[0]


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for."""
    return x.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def text_or_empty(x: Column) -> Column:
    """Strings are never null in the register: null is ''."""
    return F.coalesce(x, F.lit(""))


def normal(x: Column) -> Column:
    """Lower case, white space collapsed, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text_or_empty(x), r"\s+", " ")))


def fold(x: Column) -> Column:
    """Letters and digits only, lower-cased, look-alike digits as letters: the key that labels are matched by."""
    return F.regexp_replace(F.translate(F.lower(text_or_empty(x)), *LOOKALIKES), r"[^\p{L}\p{N}]", "")


def clean(x: Column) -> Column:
    """A value as it is stored: separators around it gone, inner white space single."""
    return F.btrim(F.regexp_replace(F.translate(text_or_empty(x), "|_", "  "), r"\s{2,}", " "), F.lit(" \t:;,-–—.=~*<>\"'`/\\"))


def smart_case(x: Column) -> Column:
    """Title case where the whole text is in one case."""
    return F.when((x == F.upper(x)) | (x == F.lower(x)), F.initcap(x)).otherwise(x)


def found(value: Column, quality: Column | float, unit: Column | None = None) -> Column:
    """What each parser returns: value string, quality double, unit string."""
    quality = quality if isinstance(quality, Column) else F.lit(quality)
    return let(text_or_empty(value), lambda v: F.struct(v.alias("value"), F.when(v == "", 0.0).otherwise(quality).cast("double").alias("quality"), (F.lit("") if unit is None else text_or_empty(unit)).alias("unit")))


def parse_plot_id(x: Column) -> Column:
    """An identifier after an optional 'no', with tight separators; quality 0.8 when it starts with a letter, 0.4 where
    only the cleaned text can be given; nothing without a digit."""

    def parse(t: Column) -> Column:
        hit = F.regexp_replace(F.regexp_extract(t, PLOT, 0), r"\s*([/-])\s*", "$1")
        value = F.when(~t.rlike(r"\p{Nd}"), "").when(hit != "", F.trim(hit)).otherwise(F.substring(clean(t), 1, 40))
        return found(value, F.when(hit == "", 0.4).when(hit.rlike(r"^\s*\d"), 1.0).otherwise(0.8))

    return let(F.regexp_replace(F.trim(text_or_empty(x)), r"(?i)^\s*(?:no|number|nos)\b[.:\s]*", ""), parse)


def plot_id(x: Column) -> Column:
    """The identifier alone; null without a digit."""
    return F.nullif(parse_plot_id(x)["value"], F.lit(""))


def pin_code(x: Column, pattern: str = PIN) -> Column:
    """Six digits, the first not 0, with or without a space in the middle; else null. By PIN_ALONE not those that a stroke ties
    to another number, as in an identifier."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text_or_empty(x), pattern, 1), " ", ""), F.lit(""))


def area_unit(x: Column) -> Column:
    """The first unit, in the order of the list, that the text names; else null."""

    def of(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for unit, pattern in reversed(UNIT_PATTERNS.items()):
            out = F.when(low.rlike(pattern), unit).otherwise(out)
        return F.when(low.rlike(ANY_UNIT), out)

    return let(F.lower(text_or_empty(x)), of)


def parse_area(x: Column, require_unit: bool = False) -> Column:
    """(value double, unit, quality) of the first number above 0 and below 1e8, null without one. Its unit stands in the
    24 characters after it, or in those of the 16 before it that follow the number before. '1 25 acre' is 1.25."""
    def parse(t: Column) -> Column:
        parts = F.arrays_zip(F.regexp_extract_all(t, F.lit(rf"({NUMBER})"), F.lit(1)).alias("number"), F.regexp_extract_all(t, F.lit(rf"(?:{NUMBER})(?=([\s\S]{{0,24}}))"), F.lit(1)).alias("after"), F.split(t, NUMBER).alias("before"))
        rows = F.transform(parts, lambda p: F.struct(F.regexp_replace(p["number"], ",", "").cast("double").alias("value"), F.coalesce(area_unit(p["after"]), area_unit(F.right(p["before"], F.lit(16))), F.lit("")).alias("unit")))
        fits = F.filter(rows, lambda r: (r["value"] > 0) & (r["value"] < 1e8) & ((r["unit"] != "") if require_unit else F.lit(True)))
        return let(F.get(fits, F.lit(0)), lambda r: F.when(r.isNotNull(), F.struct(r["value"].alias("value"), r["unit"].alias("unit"), F.when(r["unit"] != "", 1.0).otherwise(0.6).alias("quality"))))

    t = text_or_empty(x)
    got = let(F.when(t.rlike(ANY_UNIT), F.regexp_replace(t, r"\b(\d{1,3})\s+(\d{2})\s*(?=[A-Za-zऀ-෿])", "$1.$2 ")).otherwise(t), parse)
    return F.when(t.rlike(ANY_UNIT_LETTERS), got) if require_unit else got


def area_value(x: Column) -> Column:
    return parse_area(x)["value"]


def hectares(value: Column, unit: Column) -> Column:
    """Unknown units count as hectares."""
    return value * F.coalesce(F.create_map(*[F.lit(y) for x in HECTARES.items() for y in x])[F.coalesce(F.nullif(unit, F.lit("")), F.lit("hectare"))], F.lit(1.0))


def short_number(v: Column) -> Column:
    """A positive double to six significant digits without trailing zeros, as C prints %g."""

    def show(e: Column) -> Column:
        scale = F.pow(F.lit(10.0), F.lit(5) - e)
        digits = lambda r: F.regexp_replace(F.regexp_replace(r.cast("decimal(30,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        plain = F.rint(v * scale) / scale
        wide = F.concat(digits(F.rint(v / F.pow(F.lit(10.0), e) * 1e5) / 1e5), F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("int").cast("string"), 2, "0"))
        return F.when((e >= 6) | (e < -4), wide).otherwise(digits(plain))

    exponent = F.floor(F.log10(v))
    return let(exponent + (F.rint(v / F.pow(F.lit(10.0), exponent) * 1e5) >= 1e6).cast("int"), show)


def _day(d: Column, m: Column, y: Column) -> Column:
    year = F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    fits = m.between(1, 12) & d.between(1, 31) & year.between(1850, 2100)
    return F.when(fits, F.format_string("%02d/%02d/%04d", d, m, year))


def parse_date(x: Column) -> Column:
    """The text's date as DD/MM/YYYY, '' without one: Y-M-D, D/M/Y (month and day change places where only that
    fits), '12 May 2024', 'May 12 2024'. The calendar is not consulted."""

    def parse(t: Column) -> Column:
        number = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit("")).cast("int")
        month = lambda p, g: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(F.regexp_extract(t, p, g), 1, 3))), F.lit(0)).cast("int")

        def of(d: Column, m: Column, y: Column, swaps: bool = False) -> Column:  # the three numbers are read once
            day = lambda p: F.coalesce(_day(p["d"], p["m"], p["y"]), F.when(p["d"].between(1, 12), _day(p["m"], p["d"], p["y"]))) if swaps else _day(p["d"], p["m"], p["y"])
            return let(F.struct(d.alias("d"), m.alias("m"), y.alias("y")), day)

        iso = of(number(DATE_YMD, 3), number(DATE_YMD, 2), number(DATE_YMD, 1))
        plain = of(*(number(DATE_DMY, g) for g in (1, 2, 3)), swaps=True)
        named = of(number(DATE_D_MONTH, 1), month(DATE_D_MONTH, 2), number(DATE_D_MONTH, 3))
        american = of(number(DATE_MONTH_D, 2), month(DATE_MONTH_D, 1), number(DATE_MONTH_D, 3))
        return F.when(t.rlike(r"\d"), F.coalesce(iso, plain, named, american, F.lit(""))).otherwise("")

    return let(text_or_empty(x), parse)


def date_parts(x: Column) -> Column:
    """A stored date (D/M/Y with '/', '-' or '.') as a day; null for any other text and where there is no such day.
    Years below 50 are of this century, others below 100 of the last."""
    form = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$"
    t = F.trim(text_or_empty(x))
    y = F.nullif(F.regexp_extract(t, form, 3), F.lit("")).cast("int")
    year = F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y)
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.regexp_extract(t, form, 2), 2, "0"), F.lpad(F.regexp_extract(t, form, 1), 2, "0")).try_cast("date")


def parse_name(x: Column, most: int = 5) -> Column:
    """A person or place: tokens up to the first that is no name, at most so many; needs three letters."""
    t = F.regexp_replace(F.regexp_replace(clean(x), r"(?i)^(?:shri|sri|smt|mr|mrs|ms|thiru|tmt)\.?\s+", ""), r"(?i)\b(?:s/o|w/o|d/o)\b.*$", "")

    def tokens(t: Column) -> Column:
        return F.when((t == "") | t.rlike(JUNK) | t.rlike(HEADING), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(t, r"\s+"), lambda w: F.btrim(w, F.lit(",;|"))), lambda w: w != ""))

    def take(ws: Column) -> Column:
        one = F.array_position(F.transform(ws, lambda w: F.length(w)), 1)
        bad = lambda w, i: ~w.rlike(NAME_TOKEN) | F.lower(w).isin(STOP_VALUES) | ((F.length(w) == 1) & (i + 1 > one))
        first_bad = F.coalesce(F.array_min(F.transform(ws, lambda w, i: F.when(bad(w, i), i))), F.lit(1 << 30))

        def until(stop: Column) -> Column:
            kept = F.least(stop, F.size(ws), F.lit(most))
            quality = F.when(stop < most, 0.7).otherwise(1.0) * F.when(kept > 4, 0.8).otherwise(1.0)
            named = let(F.array_join(F.slice(ws, F.lit(1), kept), " "), lambda v: F.when(F.length(F.regexp_replace(v, r"[^\p{L}]", "")) >= 3, F.substring(smart_case(v), 1, 120)))
            return found(named, quality)

        return let(first_bad, until)

    return let(let(F.trim(t), tokens), take)


def parse_free_text(x: Column, hints: list[str] | None = None, most: int = 160) -> Column:
    """Cleaned text, cut to a length; quality 1 where it holds a hint, else 0.75."""

    def parse(t: Column) -> Column:
        hinted = F.lit(False)
        for h in hints or []:
            hinted = hinted | F.lower(F.substring(t, 1, most)).contains(h)
        return found(F.when(~t.rlike(JUNK) & ~t.rlike(HEADING), smart_case(F.substring(t, 1, most))), F.when(hinted, 1.0).otherwise(0.75))

    return let(clean(x), parse)


def parse_document_id(x: Column) -> Column:
    """A document's number: what stands before a date, at most 40 characters."""

    def parse(t: Column) -> Column:
        return found(F.when(~t.rlike(JUNK), F.substring(t, 1, 40)), F.when(t.rlike(r"\d"), 1.0).otherwise(0.5))

    return let(F.regexp_replace(clean(F.split(text_or_empty(x), r"(?i)\b(?:date|dated|dt)\b|दिनांक", 2)[0]), r"(?i)^(?:no|number)\b[.:\s]*", ""), parse)


#: How the values of the canonical fields are read.
KINDS = {"owner_name": "name", "father_name": "name", "survey_number": "id", "subdivision_number": "id", "khasra_number": "id", "khata_number": "id", "mutation_number": "docid", "registration_number": "docid", "plot_area": "area", "area_unit": "unit", "pincode": "pin", "address": "text", "village": "place", "tehsil": "place", "district": "place", "state": "place", "land_classification": "land", "ownership_type": "ownership", "mutation_date": "date", "registration_date": "date"}


def parse_value(kind: Column, x: Column) -> Column:
    """The value of a text by kind: name, place, id, docid, area, unit, pin, date, land, ownership, else free text."""

    def parse(t: Column) -> Column:
        area = let(parse_area(t), lambda a: found(F.when(a.isNotNull(), short_number(a["value"])), a["quality"], a["unit"]))
        by_kind = {"name": parse_name(t), "place": parse_name(t, 4), "id": parse_plot_id(t), "docid": parse_document_id(t), "area": area, "unit": found(area_unit(t), 1.0), "pin": found(pin_code(t), 1.0), "date": found(parse_date(t), 1.0), "land": parse_free_text(t, LAND_HINTS, 120), "ownership": parse_free_text(t, OWNERSHIP_HINTS, 120)}
        out = parse_free_text(t, None, 300)
        for name, value in by_kind.items():
            out = F.when(kind == name, value).otherwise(out)
        return out

    return let(x, parse)


#: How many characters of each field a record stores.
LENGTHS = {"owner_name": 200, "father_name": 200, "survey_number": 120, "subdivision_number": 60, "khasra_number": 120, "khata_number": 120, "area_unit": 32, "village": 120, "tehsil": 120, "district": 120, "state": 120, "pincode": 10, "address": 300, "land_classification": 160, "ownership_type": 80, "mutation_number": 60, "mutation_date": 20, "registration_number": 60, "registration_date": 20}


def stored(field: str) -> Column:
    """A field's value as a record stores it: null as empty, cut to the field's length."""
    return F.substring(text_or_empty(F.col(field)), 1, LENGTHS[field])


def conf_class(x: Column) -> Column:
    return F.when(x >= 0.85, "ok").when(x >= 0.60, "warn").otherwise("bad")
