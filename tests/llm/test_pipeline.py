"""The corpus pipeline, stage by stage against brute force and as a whole, on odd rows."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P

KIND = "doc_id long, text string, lang string, source string, n_chars long, row long, spans string"


def shingles(text, n=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def rows_of(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    passage = " ".join(r.choices(words, k=60))
    texts = [" ".join(r.choices(words, k=r.randrange(20, 150))) for _ in range(70)]
    texts += [f"{a} {passage} {b}" for a, b in zip(texts[:8], texts[20:28], strict=True)]
    texts += [" ".join([*t.split()[:-1], "changed"]) for t in texts[30:36]] + texts[40:44] + [texts[44].upper()]
    texts += [None, "", "  ", "one", "one", "zorb quendle idiot " * 9]
    rows = [(k, t, "en", r.choice(["a", "b", None]), len(t or ""), k, "clash") for k, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None, 1, "x"), (None, None, None, "a", None, 1, "x"), (5, texts[50], "en", "b", 7, 2, "y"), (5, texts[51] + " own", "en", "b", 7, 2, "y"), rows[10], rows[10]]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows_of(), KIND).repartition(3).write.parquet(str(path / "documents.parquet"))
    labels = [(k, 1, int("idiot" in (t or ""))) for k, t, *_ in rows_of() if k is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_clean(spark, docs, folder):
    left = P.clean(spark, docs, folder)
    assert left.columns == docs.columns
    before, after = Counter(plain(docs)), Counter(plain(left))
    assert not after - before  # rows are taken whole
    gone = before - after
    assert all("idiot" in r[1] for r in gone)


def test_near_duplicates(spark, docs, folder):
    left = P.near_duplicates(spark, docs, folder)
    assert left.columns == docs.columns
    rows, kept = plain(docs), Counter(plain(left))
    assert not kept - Counter(rows)
    sets = list({shingles(r[1]) for r in rows if r[0] is not None} - {frozenset()})
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    of = {s: g for s, g in zip(sets, group, strict=True)}
    least = {}
    for r in rows:
        if r[0] is not None and shingles(r[1]):
            g = of[shingles(r[1])]
            least[g] = min(r[0], least.get(g, r[0]))
    stayed = Counter((of[shingles(r[1])], r[0]) for r in kept.elements() if r[0] is not None and shingles(r[1]))
    assert stayed == Counter((g, d) for g, d in least.items())
    assert sum(1 for r in kept.elements() if not shingles(r[1])) == sum(1 for r in rows if not shingles(r[1]))
    assert [r[1] for r in kept if r[0] is None and r[1]] == [r[1] for r in rows if r[0] is None and r[1]]


def test_substrings(spark, docs, folder):
    first = {}
    rows = plain(docs)
    for d, text, *_ in rows:
        w = (text or "").split()
        for i in range(len(w) - 49):
            if d is not None:
                first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    want = []
    for r in rows:
        w, gone = (r[1] or "").split(), set()
        for i in range(len(w) - 49):
            if r[0] is not None and first[tuple(w[i : i + 50])] < r[0]:
                gone.update(range(i, i + 50))
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1]
        if not gone or text:
            want.append((r[0], text, r[2], r[3], len(text) if gone else r[4], *r[5:]))
    left = P.substrings(spark, docs, folder)
    assert left.columns == docs.columns
    assert plain(left) == sorted(want, key=repr)


def test_mix(spark, docs, folder):
    left = P.mix(spark, docs, folder)
    assert left.columns == docs.columns
    size, mixed = Counter(), Counter()
    for r in plain(docs):
        size[r[0], r[3]] += len((r[1] or "").split())
    for r in plain(left):
        mixed[r[0], r[3]] += len((r[1] or "").split())
    assert set(mixed) <= set(size)
    assert all(n <= 2 * size[k] for k, n in mixed.items())
    assert 0.8 < sum(mixed.values()) / (1.5 * sum(size.values())) < 1.1


def test_stages_follow_one_another(spark, folder):
    assert [name for name, _ in P.STAGES] == ["toxicity", "near_duplicates", "substrings", "mix", "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    packed = P.pack(spark, docs, folder)
    found = P.run(spark, folder)
    assert found.columns == packed.columns
    assert found.count() == packed.count() > 0


def test_empty_tables(spark, folder, docs):
    none = docs.limit(0)
    for name, stage in P.STAGES:
        left = stage(spark, none, folder)
        assert left.count() == 0
        assert name == "pack" or left.columns == docs.columns
