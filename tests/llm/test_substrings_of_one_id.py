"""Substring dedup where rows share a doc_id, against brute force."""

import random

import pytest

from registrum.llm import substring_dedup


def brute(rows, window):
    """doc_id, n_words, kept of each row: a window goes where a smaller doc_id has it in any of its texts."""
    first = {}
    for d, text in rows:
        words = (text or "").split()
        for i in range(len(words) - window + 1):
            if d is not None:
                w = tuple(words[i : i + window])
                first[w] = min(d, first.get(w, d))
    out = []
    for d, text in rows:
        words = (text or "").split()
        gone = set()
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(words), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def same(spark, rows, window, parts):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, text_hash int, spans string").repartition(parts)
    found = substring_dedup.dedup_substrings(docs, window)
    assert sorted(((r.doc_id, r.n_words, r.kept) for r in found.collect()), key=repr) == brute(rows, window)
    left = sorted(((r.doc_id, " ".join((r.text or "").split())) for r in substring_dedup.strip_substrings(docs, window).collect()), key=repr)
    assert left == sorted(((d, k) for d, n, k in brute(rows, window) if k or not n), key=repr)


@pytest.mark.parametrize("parts", [1, 3])
def test_texts_keep_their_own_words(spark, parts):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    same(spark, [(1, a), (5, a), (5, b), (6, a + " " + c), (6, d), (6, d), (7, d), (None, a), (8, None)], 50, parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    r = random.Random(seed)
    passages = [" ".join(f"p{k}w{i}" for i in range(r.randrange(8, 40))) for k in range(12)]
    rows = [(r.randrange(30), " ".join(r.choice(passages) if r.random() < 0.5 else f"own{r.random()}" for _ in range(r.randrange(1, 12)))) for _ in range(80)]
    same(spark, rows + rows[:5], 10, 4)
