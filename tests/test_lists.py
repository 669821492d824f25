"""Finding things: words in nested JSON, substring search, deep pages, the dashboard."""

import functools
import json
import random

import pytest
from pyspark.sql import functions as F

from registrum.operators import dashboard
from registrum.operators.filters import any_holds
from registrum.operators.paging import OrderedList
from registrum.operators.search import SubstringIndex
from registrum.sources import json_walk


def number(x, otherwise):
    try:
        return otherwise if isinstance(x, bool) else float(x)
    except (TypeError, ValueError):
        return otherwise


def brute_box(raw):
    points = raw if isinstance(raw, list) else (raw.get("vertices") or raw.get("points") or []) if isinstance(raw, dict) else []
    if not points and isinstance(raw, dict) and raw:
        x, y = (number(raw.get(f"{c}1", raw.get(c, 0)), 0) for c in "xy")
        far = {c: (raw.get(f"{c}2") or near) - near for c, near in (("x", x), ("y", y))}
        return tuple(int(v) for v in (x, y, raw.get("w", raw.get("width", far["x"])), raw.get("h", raw.get("height", far["y"]))))
    at = [(p.get("x", 0), p.get("y", 0)) if isinstance(p, dict) else tuple(p[:2]) for p in points if isinstance(p, dict) or isinstance(p, list) and len(p) >= 2]
    if not at:
        return (0, 0, 0, 0)
    xs, ys = zip(*at, strict=True)
    return tuple(int(v) for v in (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)))


def brute_words(node, out):
    if isinstance(node, list):
        for x in node:
            brute_words(x, out)
    elif isinstance(node, dict):
        inner = next((node[k] for k in json_walk.CONTAINERS if node.get(k)), None)
        if inner:
            return brute_words(inner, out)
        text = next((node[k] for k in json_walk.TEXTS if node.get(k)), "")
        text = text.strip() if isinstance(text, str) else json.dumps(text)
        if text:
            c = number(next((node[k] for k in json_walk.CONFIDENCES if k in node), 0.9), 0.9)
            out.append((text, pytest.approx(max(0.0, min(1.0, c / 100 if c > 1 else c))), *brute_box(node.get("boundingBox") or node.get("bbox"))))
    return out


def leaf(r):
    box = r.choice([None, {}, {"x": r.randrange(50), "y": 3, "w": 5, "height": 7}, {"x1": 4, "y1": 5, "x2": 44, "y2": 15}, {"vertices": [{"x": 9, "y": 2}, {"x": 3}, {"y": 8, "x": 5}]}, {"points": [[1, 2], [30, 4], [7]]}, [[3, 4], [1, 9]], {"vertices": []}])
    node = {r.choice(["text", "source", "target"]): r.choice(["खसरा", " word ", "", None, 12, "x"]), r.choice(["confidence", "conf"]): r.choice([0.5, 1, 87, 250, -1, None, "0.25", "high"]), r.choice(["bbox", "boundingBox"]): box}
    return node | r.choice([{}, {"words": []}, {"regions": None}, {"target": "other"}])


def tree(r, depth):
    if depth == 0:
        return leaf(r)
    inner = [tree(r, depth - 1) for _ in range(r.randrange(4))]
    return r.choice([inner, {r.choice(json_walk.CONTAINERS): inner, "text": "kept if empty"}, {"lines": inner, "regions": []}, {"words": tree(r, depth - 1)}])


def test_words_of_json_equal_a_walk(spark):
    r = random.Random(3)
    bodies = [tree(r, k % 6) for k in range(60)] + [{"pipelineResponse": [{"output": tree(r, 3)}]}, {"output": tree(r, 2)}, {"pipelineResponse": tree(r, 2)}, {"pipelineResponse": [{"output": []}], "output": leaf(r)}]

    def start(b):
        if isinstance(b, dict) and isinstance(b.get("pipelineResponse"), list) and b["pipelineResponse"] and isinstance(b["pipelineResponse"][0], dict) and "output" in b["pipelineResponse"][0]:
            return b["pipelineResponse"][0]["output"]
        return (b.get("output") or b.get("pipelineResponse") or b) if isinstance(b, dict) else b

    rows = [(k, json.dumps(b)) for k, b in enumerate(bodies)] + [(900, None), (901, "{no json"), (902, "[]"), (903, "3"), (None, json.dumps({"text": "a"}))]
    found = json_walk.words_of_json(spark.createDataFrame(rows, "doc_id long, body string").repartition(3))
    got = {}
    for w in sorted(found.collect(), key=lambda w: (w.doc_id or -1, w.path)):
        got.setdefault(w.doc_id, []).append((w.text, w.confidence, w.x, w.y, w.w, w.h))
    want = {k: words for k, b in enumerate(bodies) if (words := brute_words(start(b), []))} | {None: [("a", 0.9, 0, 0, 0, 0)]}
    assert got == want
    texts = {r.doc_id: r.text for r in json_walk.text_of_json(found).collect()}
    assert texts == {k: "\n".join(w[0] for w in words) for k, words in want.items()}


def test_scale_and_empty_table(spark):
    body = json.dumps({"text": "a", "bbox": {"x": 20, "y": 10, "w": 8, "h": 6}})
    (w,) = json_walk.words_of_json(spark.createDataFrame([(1, body)], "doc_id long, body string"), scale=2.0).collect()
    assert (w.x, w.y, w.w, w.h) == (10, 5, 4, 3)
    assert json_walk.words_of_json(spark.createDataFrame([], "doc_id long, body string")).count() == 0


def register(n=3000):
    r = random.Random(1)
    name = lambda: "".join(r.choice("abcdeÄß ") for _ in range(r.randrange(0, 9)))
    return [(k, r.choice([None, name()]), f"{r.randrange(900)}/{r.randrange(40)}", "needle in a haystack" if k == 1717 else name()) for k in range(n)]


def rows_read(df):
    """What the scans of a DataFrame that ran gave, from the plan's metrics."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getName() else plan]
    while stack:
        p = stack.pop()
        if "QueryStage" in p.getClass().getName():
            stack.append(p.plan())
        if "FileSourceScan" in p.getClass().getName():
            total += p.metrics().apply("numOutputRows").value()
        kids = p.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return total


def test_search_equals_a_scan(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(register(), "id long, owner string, plot string, village string")
    index = SubstringIndex(spark, str(tmp_path / "i"), "id", ["owner", "plot", "village"])
    index.build(df.repartition(5), 6)
    for text in ("needle", "HAYSTACK", "/12", "12/3", "abc", "ab", "", "ä", "e a", "ss", "no such thing", "1", "needle in a haystack"):
        assert sorted(r.id for r in index.search(text).collect()) == sorted(r.id for r in df.where(any_holds(["owner", "plot", "village"], text)).collect())
    found = index.search("haystack")
    assert [r.id for r in found.collect()] == [1717]
    assert rows_read(found) <= 3000 / 5  # one file of six holds it
    monkeypatch.setattr("registrum.operators.search.NAMED", 1)
    assert index.search("12/3").count() == df.where("contains(plot, '12/3')").count()
    index.build(df.limit(0), 2)
    assert index.search("abc").count() == 0


@pytest.mark.parametrize("order", [["a", "k"], ["-a", "-k"], ["-a", "k"]])
def test_pages_equal_an_ordered_scan(spark, tmp_path, order):
    r = random.Random(2)
    rows = [(k, r.choice([None, 1, 2, 3, 50]), "x") for k in range(997)]
    sign = lambda c: -1 if c.startswith("-") else 1
    want = [k for k, a, _ in sorted(rows, key=lambda row: (sign(order[0]) * (-1 if row[1] is None else row[1]), sign(order[1]) * row[0]))]
    listed = OrderedList(spark, str(tmp_path / "l"), order)
    listed.build(spark.createDataFrame(rows, "k long, a long, v string").repartition(4), 5)
    for number in (1, 2, 17, 49, 50, 51, -3):
        page = sorted(listed.page(number, 20).collect(), key=lambda x: x["rank"])
        at = min(max(number, 1), 50)
        assert [x["k"] for x in page] == want[(at - 1) * 20 : at * 20]
        assert {(x["count"], x["page"], x["pages"]) for x in page} == {(997, at, 50)}
        assert [x["rank"] for x in page] == list(range((at - 1) * 20 + 1, (at - 1) * 20 + 1 + len(page)))
    first, last = listed.page(1, 20), listed.page(50, 20)
    assert len(first.collect()) == 20 and len(last.collect()) == 17
    assert rows_read(first) <= 300 and rows_read(last) <= 300
    by_id = {k: a for k, a, _ in rows}
    for place in (0, 400, 990, 996):
        key = {"k": want[place], "a": by_id[want[place]]}
        assert [x["k"] for x in sorted(listed.after(key, 10).collect(), key=lambda x: x["rank"])] == want[place + 1 : place + 11]
    assert listed.after({"k": -1, "a": 1}).count() == 0


def test_empty_list(spark, tmp_path):
    listed = OrderedList(spark, str(tmp_path / "l"), ["k"])
    listed.build(spark.createDataFrame([], "k long"), 2)
    assert listed.page(3).count() == 0


def test_dashboard_scans_each_table_once(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(50).select(F.col("id").alias("document_id"), F.when(F.col("id") % 3 == 0, "PROCESSED").otherwise("FAILED").alias("status"), F.lit("eng").alias("detected_language"), F.when(F.col("id") % 2 == 0, "Goa").alias("state_name"), F.lit("2024-05-01").cast("timestamp").alias("uploaded_at")).write.parquet(path)
    out = dashboard.documents(spark.read.parquet(path))
    found = {(r.series, r.label, r.measure): r.value for r in out.collect()}
    assert rows_read(out) == 50
    assert found["total", None, "documents"] == 50 and found["total", None, "processed_pct"] == 34.0
    assert found["state", "Goa", "n"] == 25 and found["state", "Goa", "processed"] == 9
    assert found["month", "2024-05", "n"] == 50 and ("state", "", "n") not in found
    none = {(r.series, r.measure): r.value for r in dashboard.documents(spark.read.parquet(path).limit(0)).collect()}
    assert none == {("total", "documents"): 0.0, ("total", "processed"): 0.0, ("total", "failed"): 0.0, ("total", "processed_pct"): 0.0}


def test_levels_are_entered_inside_of_a_row(spark, monkeypatch):
    """As many levels as LEVELS take one round (a round each before); deeper documents are walked to their end."""
    rounds, kept = [], json_walk.kept
    monkeypatch.setattr(json_walk, "kept", lambda df: rounds.append(1) or kept(df))

    def nested(depth):
        return json.dumps(functools.reduce(lambda inner, _: {"lines": [inner]}, range(depth), {"text": "a"}))

    for depth, most in ((1, 1), (3, 1), (2 * json_walk.LEVELS + 1, 3)):
        rounds.clear()
        words = json_walk.words_of_json(spark.createDataFrame([(1, nested(depth))], "doc_id long, body string")).collect()
        assert [w.text for w in words] == ["a"]
        assert len(rounds) <= most, depth
