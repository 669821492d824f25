"""Links between distinct sets, by n-gram lists and by SuperMinHash, against brute force; rows that share an id."""

import random

import numpy as np
import pytest

from registrum.llm import ngram_join, superminhash

KIND = "doc_id long, text string, component_id string, keys int, kept int, row long"


def shingles(text, n):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, n, t):
    """(doc_id, size, component_id) of each row; rows of one id each go with their own set."""
    group = {}

    def root(s):
        while group.setdefault(s, s) != s:
            s = group[s]
        return s

    sets = list({shingles(text, n) for d, text in rows if d is not None} - {frozenset()})
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if 100 * len(a & b) >= t * len(a | b):
                group[root(a)] = root(b)
    least = {}
    for d, text in rows:
        if d is not None and (s := shingles(text, n)):
            least[root(s)] = min(d, least.get(root(s), d))
    return sorted(((d, len(s), None if d is None else least[root(s)] if s else d) for d, text in rows for s in [shingles(text, n)]), key=repr)


def rows_of(seed, n=160):
    r = random.Random(seed)
    words = [f"W{i}" for i in range(300)]
    base = [r.choices(words, k=r.choice([4, 9, 30, 80, 200])) for _ in range(12)]
    out = []
    for i in range(n):
        text = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
            text[r.randrange(len(text))] = f"x{r.randrange(40)}"
        out.append((r.randrange(-20, 120), " ".join(text)))
    out += [(None, out[0][1]), (None, None), (200, None), (201, ""), (202, " \t "), (203, "one"), (204, "ONE"), (205, "one two"), (206, "one two")]
    long = r.choices(words, k=25_000)
    return [*out, (300, " ".join(long)), (301, " ".join(long[:24_990])), *out[:4]]


def found_by(kind, docs, n, t):
    if kind == "lists":
        return ngram_join.ngram_jaccard(docs, n, t)[0]
    return superminhash.near_duplicates(docs, n, t)


@pytest.mark.parametrize("kind", ["lists", "minhash"])
@pytest.mark.parametrize(("n", "t", "parts"), [(3, 85, 3), (3, 90, 1), (5, 80, 5)])
def test_equals_brute_force(spark, kind, n, t, parts):
    rows = rows_of(n + t)
    docs = spark.createDataFrame([(d, x, "s", 1, 2, 3) for d, x in rows], KIND).repartition(parts)
    found = found_by(kind, docs, n, t).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute(rows, n, t)
    if kind == "minhash":
        assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.doc_id is not None)


@pytest.mark.parametrize("kind", ["lists", "minhash"])
def test_rows_of_one_id(spark, kind):
    a, b = " ".join(f"a{k}" for k in range(90)), " ".join(f"b{k}" for k in range(90))
    rows = [(1, a), (5, a + " z"), (5, b), (9, b + " y")]
    for parts in (1, 2, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found_by(kind, docs, 3, 85).collect()) == [(1, 88, 1), (5, 88, 5), (5, 89, 1), (9, 89, 5)]
        assert sorted((r.doc_id, r.text) for r in ngram_join.keep_one(docs, 3, 85).collect()) == [(1, a), (5, b)]


@pytest.mark.parametrize("kind", ["lists", "minhash"])
def test_long_lists(spark, monkeypatch, kind):
    monkeypatch.setattr(ngram_join, "LONG", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "FANOUT", 5)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 2)
    r, rows = random.Random(5), []
    base = [f"b{i}" for i in range(60)]
    for k in range(60):
        text = list(base)
        for _ in range(r.randint(0, 4)):
            text[r.randrange(60)] = f"n{r.random()}"
        rows.append((k // 2, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in found_by(kind, docs, 3, 90).collect()), key=repr) == brute(rows, 3, 90)


def test_empty_table(spark):
    assert superminhash.near_duplicates(spark.createDataFrame([], KIND)).collect() == []


def one_by_one(grams, slots):
    """A set's signature with a permutation for each n-gram and no early stop."""
    out = [2**64 - 1] * slots
    for g in grams.tolist():
        place = list(range(slots))
        for level in range(slots):
            drawn = int(superminhash.mix(np.array([(g + (level + 1) * int(superminhash._STEP)) % 2**64], np.uint64))[0])
            other = level + int(superminhash.mix(np.array([drawn ^ int(superminhash._STEP)], np.uint64))[0]) % (slots - level)
            place[level], place[other] = place[other], place[level]
            out[place[level]] = min(out[place[level]], level << 56 | drawn >> 8)
    return out


def test_signatures(monkeypatch):
    monkeypatch.setattr(superminhash, "PIECE", 7)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, k).astype(np.uint64)) for k in (0, 1, 2, 5, 30, 0, 90)]
    assert superminhash.signatures(sets, 16).tolist() == [one_by_one(s, 16) for s in sets]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    for n in (6, 60, 600):
        grams, errors = r.integers(0, 2**63, (200, n + n // 2)).astype(np.uint64), []
        for row in grams:
            x, y = superminhash.signatures([np.sort(row[:n]), np.sort(row[n // 2 :])], 64)
            errors.append((x == y).mean() - 1 / 3)
        assert abs(np.mean(errors)) < 0.02
        assert np.var(errors) < (0.8 if n < 64 else 1.3) * (2 / 9) / 64  # independent hashes have this variance


def test_bands_miss_few():
    for t in (50, 80, 85, 90, 99):
        rows = superminhash.rows_for(t)
        assert (1 - (t / 100) ** rows) ** (superminhash.SLOTS // rows) <= superminhash.MISSED
    assert superminhash.rows_for(100) == superminhash.SLOTS
