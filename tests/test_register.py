"""The register's queries against their SQL, and the parsers against known values."""

import datetime
import os
import random
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from registrum.functions import text as X
from registrum.operators import cells, extract, layout, memory, rules, stamps
from registrum.plans import queries as Q
from registrum.sources import files, shared

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return c


def _plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{v:.8g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df, found = Q.queries()[name](spark, SF), duck.sql(Q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [list(found.columns).index(c) for c in columns]
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.parametrize(("text", "day"), [("05/03/2021", datetime.date(2021, 3, 5)), ("5-3-49", datetime.date(2049, 3, 5)), ("5.3.50", datetime.date(1950, 3, 5)), ("2021-03-05", None), ("31/02/2021", None), ("none", None), (None, None)])
def test_stored_dates(spark, text, day):
    assert spark.createDataFrame([(text,)], "t string").select(X.date_parts(F.col("t"))).first()[0] == day


DATES = {"Dated 05/03/2021": "05/03/2021", "5-3-49": "05/03/2049", "on 2021.3.5": "05/03/2021", "03/25/2020": "25/03/2020", "12th May, 2024": "12/05/2024", "Mar 3 99": "03/03/1999", "31/02/2021": "31/02/2021", "1/2": "", None: ""}


def test_dates_in_text(spark):
    rows = spark.createDataFrame([(t,) for t in DATES], "t string").select("t", X.parse_date(F.col("t")).alias("day")).collect()
    assert {r.t: r.day for r in rows} == DATES


def test_parsers(spark):
    row = spark.createDataFrame([("No. 123 / 4A", "2,500.5 sq ft", "PIN 221 206.")], "a string, b string, c string").select(X.plot_id(F.col("a")), X.area_value(F.col("b")), X.area_unit(F.col("b")), X.pin_code(F.col("c"))).first()
    assert tuple(row) == ("123/4A", 2500.5, "sq.ft", "221206")


def test_rules(spark):
    rows = spark.createDataFrame([(1, "", "12/3", "", 900000.0, "hectare", "v", "d", "1234", "31/02/2020"), (2, "o", "12/3", "", 1.0, "acre", "v", "d", "600100", "01/01/1990")], "record_id long, owner_name string, survey_number string, khasra_number string, plot_area double, area_unit string, village string, district string, pincode string, mutation_date string")
    found = {(r.record_id, r.rule_code) for r in rules.issues(rows, "2000-01-01").collect()}
    assert found == {(1, "REQUIRED_FIELD"), (1, "AREA_RANGE"), (1, "PINCODE_FORMAT"), (1, "DATE_FORMAT")}


def test_boxes_and_intervals(spark):
    df = spark.sql("SELECT struct(0 AS x, 0 AS y, 10 AS w, 10 AS h) AS a, struct(5 AS x, 0 AS y, 10 AS w, 10 AS h) AS b, array(struct(1 AS rank, 0 AS start, 3 AS end), struct(2 AS rank, 2 AS start, 5 AS end), struct(3 AS rank, 3 AS start, 4 AS end)) AS hits")
    overlap, kept = df.select(layout.iou("a", "b"), layout.non_overlapping(F.col("hits"))).first()
    assert overlap == pytest.approx(1 / 3)
    assert [k["rank"] for k in kept] == [1, 3]


def test_extraction(spark):
    text = "Owner Name : Ramesh Kumar\nSurvey No : 123/4A\nVillage : Rampur\nArea : 2.5 acre\nPIN 221206"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (None, text)], "doc_id long, text string")
    rows = extract.extract_text(docs).collect()
    found = {(r.doc_id, r.field_name): r.value for r in rows if r.value}
    assert {k: v for k, v in found.items() if k[1] != "area_unit"} == {(1, "owner_name"): "Ramesh Kumar", (1, "survey_number"): "123/4A", (1, "village"): "Rampur", (1, "plot_area"): "2.5", (1, "pincode"): "221206"}
    assert found[1, "area_unit"] == "acre"
    assert sorted((r.doc_id, r.field_name) for r in rows) == sorted((d, f) for d in (1, 2, 3) for f in extract.FIELDS)
    assert all(r.needs_review and r.confidence == 0.0 for r in rows if not r.value)


def brute_label(tokens, label):
    """Likeness of folded tokens to a label, by the rules as they are stated."""
    words, window = [w for w in map(plain_fold, label.split()) if w], "".join(tokens)
    folded = plain_fold(label)
    like = lambda a, b: SequenceMatcher(None, a, b).ratio()
    if window == folded:
        return 1.0
    scores, same = [0.0], len(words) > 1 and len(words) == len(tokens)
    if (len(words) == 1 or same) and abs(len(folded) - len(window)) <= max(2, int(len(folded) * extract.LENGTH_SLACK)):
        x = like(window, folded)
        if x >= extract.LIKE_BY_LENGTH.get(len(folded), extract.LIKE_LONG):
            scores.append(x * (extract.LONGER if len(window) - len(folded) >= 2 else 1))
    if same:
        each = [like(a, b) for a, b in zip(tokens, words, strict=True)]
        if min(each) >= extract.LIKE_WORD and sum(each) / len(each) >= extract.LIKE_WORDS:
            scores.append(sum(each) / len(each) * extract.BY_WORD)
    return max(scores)


def plain_fold(text):
    return "".join(c for c in text.lower().translate(str.maketrans(*X.LOOKALIKES)) if c.isalnum())


def test_label_search_equals_brute_force(spark):
    texts = ["Owner Name", "Ownr Nmae", "Survy No", "Vilage", "Registratlon Number", "Distrct", "xyz", "Khata Holdr Nam", "Dstrict Vilage", "PinCode:"]
    lines = extract.lines_of(extract.words_of_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    found = extract.windows(lines, 30).where("NOT glued")
    got = {(r.key, r.field): r.score * r.weight for r in extract.label_matches(found, extract.label_table(spark, extract.lexicon())).collect()}
    want = {}
    for key in {r.key for r in found.collect()}:
        for field, label, weight in extract.lexicon():
            score = brute_label(key.split(" "), label) if plain_fold(label) else 0.0
            if score:
                want[key, field] = max(want.get((key, field), 0.0), score * weight)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in got)


@pytest.mark.parametrize("least", [0.55, 0.8, 0.88])
def test_similar_corrections_equal_brute_force(spark, least):
    known = [(i, "village", raw, raw.title()) for i, raw in enumerate(["rampur", "rampura", "ram", "a", "sitapur khurd", "shahpur", "shahapur", "new  town", "rampur", "x" * 250])] + [(20, "district", "rampur", "Rampur District")]
    values = ["Rampur", "Ramqur", "Rmapur", "sitapurkhurd", "Sitapr Khurdd", "Shahapvr", "newtown", "ra", "b", "", "x" * 240 + "y", "Rampur"]
    got = {r.value: (r.suggestion, r.score) for r in memory.suggest_fuzzy(spark.createDataFrame([("village", v) for v in values], "field_name string, value string"), spark.createDataFrame(known, "id long, field_name string, raw_value string, corrected_value string"), least).collect()}
    want = {}
    for value in values:
        key = " ".join(value.lower().split())
        for i, field, raw, corrected in known:
            raw = " ".join(raw.lower().split())
            score = SequenceMatcher(None, key, raw).ratio()
            if field == "village" and score >= least and abs(len(raw) - len(key)) <= max(3, int(len(key) * 0.3)) and (score, -i) > want.get(value, ((0.0, 0), ""))[0]:
                want[value] = ((score, -i), corrected)
    assert {v: s for v, (s, _) in got.items()} == {v: c for v, (_, c) in want.items()}
    assert all(got[v][1] == pytest.approx(want[v][0][0]) for v in got)


UNITS = {"2 হেক্টর": "hectare", "2 ஏக்கர்": "acre", "2 ఎకరాలు": "acre", "2 ಎಕರೆ": "acre", "2 એકર": "acre", "2 ਏਕੜ": "acre", "2 സെന്റ്": "cent", "2 சதுர அடி": "sq.ft", "2 बीघा": "bigha"}


def test_units_of_other_scripts(spark):
    rows = spark.createDataFrame([(t,) for t in UNITS], "t string").select("t", X.area_unit(X.nfkc(F.col("t"))).alias("u")).collect()
    assert {r.t: r.u for r in rows} == UNITS


def test_plausible_stamps(spark):
    """The larger of two boxes that overlap stays; where too many stay, none is a stamp."""
    r = random.Random(3)
    pages = [[(r.randrange(400), r.randrange(400), r.randrange(20, 200), r.randrange(20, 200)) for _ in range(r.randrange(8))] for _ in range(60)] + [[(100 * k, 0, 50, 50) for k in range(stamps.MOST + 1)]]

    def shared(a, b):
        both = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return both / (a[2] * a[3] + b[2] * b[3] - both)

    def brute(boxes):
        kept = []
        for b in sorted(boxes, key=lambda b: (-b[2] * b[3], b)):
            if all(shared(k, b) < stamps.SAME for k in kept):
                kept.append(b)
        return kept if len(kept) <= stamps.MOST else []

    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, boxes array<struct<x:int,y:int,w:int,h:int>>")
    found = {p.page_id: [tuple(b) for b in p.kept] for p in rows.select("page_id", stamps.plausible(F.col("boxes")).alias("kept")).collect()}
    assert found == {k: brute(boxes) for k, boxes in enumerate(pages)}
    assert found[60] == [] and any(len(x) < len(p) for x, p in zip(found.values(), pages, strict=False))


def test_a_unit_without_an_area_is_blank(spark):
    docs = spark.createDataFrame([(1, "Area : 2.5 acre"), (2, "Unit : acre"), (3, "Area : acre")], "doc_id long, text string")
    found = {(r.doc_id, r.field_name): r.value for r in extract.extract_text(docs, [*extract.lexicon(), ("area_unit", "unit", 1.0)]).collect()}
    assert found[1, "area_unit"] == "acre" and found[1, "plot_area"] == "2.5"
    assert found[2, "area_unit"] == found[2, "plot_area"] == "" and found[3, "area_unit"] == ""


def test_file_types(spark):
    names = {"a.PDF": True, "b.x.jpg": True, "c": False, "pdf": False, "d.exe": False, "e.": False, "f.webp": True}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", files.allowed(F.col("n")).alias("ok")).collect()
    assert {r.n: r.ok for r in rows} == names


def test_words_of_a_long_line(spark):
    words = ["", "ab", "é", "𝒳y", "", "x" * 30] * 4000
    rows = layout.words_of(spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "doc_id long, text string")).orderBy("pos").collect()
    at, want = 0, []
    for k, w in enumerate(words):
        if w:
            want.append((k, w, at * layout.CHAR_W))
        at += len(w) + 1
    assert [(r.pos, r.text, r.x) for r in rows] == want


def test_identifiers_of_any_length(spark):
    texts = ["1234567/3", "12-1234567", "K12345678A"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.plot_id(F.col("t")).alias("id")).collect()
    assert {r.t: r.id for r in rows} == {"1234567/3": "1234567/3", "12-1234567": "12-1234567", "K12345678A": "K12345678A"}
    table = [(1, 0, 0, "Survey No.", 0.9), (1, 1, 0, "1234567/3", 0.8)]
    found = cells.cell_fields(spark.createDataFrame(table, "doc_id long, row int, col int, text string, conf double")).collect()
    assert [(r.field, r.value) for r in found] == [("survey_number", "1234567/3")]


def test_an_identifier_is_no_pin_code(spark):
    """Six digits before or after a stroke belong to an identifier; alone they are a PIN code without its label."""
    docs = spark.createDataFrame([(1, "Survey No : 164999/7"), (2, "Survey No : 7/164999"), (3, "Rampur 600 100"), (4, "Rampur-600100")], "doc_id long, text string")
    found = {(r.doc_id, r.field_name): r.value for r in extract.extract_text(docs).where("value <> ''").collect()}
    assert found == {(1, "survey_number"): "164999/7", (2, "survey_number"): "7/164999", (3, "pincode"): "600100", (4, "pincode"): "600100"}


def test_any_unit_is_the_list_of_units(spark):
    """The quick pattern finds what the list of patterns finds, and no part of a text holds a unit that its letters deny."""
    r = random.Random(4)
    parts = ["12", "acre", "acreage", "Ha", "ha", "hazel", "share", "are", "sq. ft", "sqmtr", "एकड़", "आर", "வர்க்", "சதுர அடி", " ", "-", "x"]
    texts = ["".join(r.choices(parts, k=r.randrange(1, 6))) for _ in range(500)]
    plain = "(?i)" + "|".join(X.UNIT_PATTERNS.values())
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(t.rlike(plain).alias("plain"), t.rlike(X.ANY_UNIT).alias("quick"), F.substring(t, 1, 7).rlike(plain).alias("of_part"), t.rlike(X.ANY_UNIT_LETTERS).alias("letters")).collect()
    assert all(r.plain == r.quick and (r.letters or not r.of_part) for r in rows)


def test_windows_are_kept_compressed(spark):
    """What the label search keeps takes less room than the checkpoint it was before."""
    texts = [(k, f"SurveyNo:{k}/7\nRegistration No : REG-{k}") for k in range(3000)]
    found = extract.windows(extract.lines_of(extract.words_of_text(spark.createDataFrame(texts, "doc_id long, text string"))), 30)
    size = lambda folder: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)
    folder = shared.shared_folder(spark).removeprefix("file:")
    begin = size(folder)
    table = shared.kept(found)
    columns = size(folder) - begin
    held = shared.cut(found)
    assert sorted(map(str, table.collect())) == sorted(map(str, held.collect()))
    assert 3 * columns < size(folder) - begin - columns
