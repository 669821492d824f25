"""Places in text by a gazetteer of any size."""

import random
import re

import pytest

from registrum.operators import extract, places


def brute(low, gazetteer):
    states, districts = list(dict.fromkeys(s for s, _ in gazetteer if s)), list(dict.fromkeys(d for _, d in gazetteer if d))
    state = next((s for s in states if s.lower() in low), None)
    return state, next((d for d in districts if re.search(r"\b" + re.escape(d.lower()) + r"\b", low)), None)


@pytest.mark.parametrize("parts", [1, 3])
def test_places_equal_brute_force(spark, parts):
    r = random.Random(5)
    gazetteer = [("Goa", "North Goa"), ("Goa", "South Goa"), ("Bihar", "Gaya"), ("Bihar", "East Champaran"), ("Tamil Nadu", "The Nilgiris"), ("Odisha", "Y.S.R"), ("Odisha", "Gaya"), ("", ""), ("Kerala", "Palakkad-East"), ("केरल", "पालक्काड")]
    words = ["north", "goa", "Goalpara", "gaya", "gayaji", "east", "champaran", "the", "nilgiris", "tamil", "nadu", "y.s.r", "(gaya)", "bihar,", "palakkad-east", "palakkad", "पालक्काड", "केरल", "xyz", "south-goa", "south goa"]
    texts = [" ".join(r.choices(words, k=r.randrange(0, 7))) for _ in range(200)]
    lines = spark.createDataFrame([(k, 1, 0, t.lower()) for k, t in enumerate(texts)], "doc_id long, page int, line int, low string").repartition(parts)
    table = places.gazetteer_table(spark, gazetteer)
    states = {r.doc_id: r.name for r in places.states_named(lines, table).collect()}
    districts = {r.doc_id: r.name for r in places.districts_named(lines, table).collect()}
    for k, t in enumerate(texts):
        assert (states.get(k), districts.get(k)) == brute(t.lower(), gazetteer), t


def test_a_large_gazetteer(spark):
    """20,000 places: the plan is as large as with two, and each text finds its own."""
    table = places.gazetteer_table(spark, [(f"State {k % 30:02}", f"Place {k:05} Nagar") for k in range(20_000)])
    docs = spark.createDataFrame([(k, f"situated in place {k * 7:05} nagar of that land") for k in range(50)], "doc_id long, text string")
    found = extract.extract_text(docs, gazetteer=table)
    assert {r.doc_id: r.value for r in found.where("field_name = 'district'").collect()} == {k: f"Place {k * 7:05} Nagar" for k in range(50)}
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    lines = extract.lines_of(extract.words_of_text(docs))
    assert size(extract.fallbacks(lines, table)) < 1.1 * size(extract.fallbacks(lines, places.gazetteer_table(spark, [("A", "Place B Nagar"), ("C", "D")])))


def test_empty_and_too_many(spark):
    docs = spark.createDataFrame([(1, "gaya")], "doc_id long, text string")
    none = extract.extract_text(docs, gazetteer=places.gazetteer_table(spark, [("", "")]))
    assert none.where("value <> ''").count() == 0
    lines = spark.createDataFrame([(1, 1, 0, "gaya")], "doc_id long, page int, line int, low string")
    with pytest.raises(ValueError, match="states"):
        places.states_named(lines, places.gazetteer_table(spark, [(f"s{k}", "d") for k in range(places.MOST_STATES + 1)]))
