"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest

from registrum.llm import periodic_runs as P

KIND = "doc_id long, text string, runs string, start int, h int, words string"


def brute(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length, piece = j - i + q, w[i : j + q]
            if length >= max(least, 2 * q) and not any(piece[p:] == piece[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(r):
    k = r.choice([1, 2, 3, 5, 50])
    out = [b"%d" % r.randrange(k) for _ in range(r.randrange(0, 90))]
    if r.random() < 0.6:
        out += out[: r.randrange(1, 20)] * r.randrange(1, 6) + out[: r.randrange(5)]
    return out


@pytest.mark.parametrize("least", [4, 7, 12])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for _ in range(500):
        words = words_of(r)
        assert P.runs_of(words, least) == brute(words, least)


@pytest.mark.parametrize("listed", [0, 1000])
def test_either_way_of_listing_lags(monkeypatch, listed):
    monkeypatch.setattr(P, "LISTED", listed)
    r = random.Random(1)
    for _ in range(300):
        words = words_of(r)
        assert P.runs_of(words) == brute(words)


def test_long_texts():
    r = random.Random(2)
    assert P.runs_of([b"a"] * 30_000) == [(0, 30_000, 1)]
    body = [b"%d" % r.randrange(10**9) for _ in range(9000)]
    assert P.runs_of(body + body + body[:5]) == [(0, 18_005, 9000)]


def expected(doc, text):
    words = (text or "").encode().split()
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(((-m, s, q) for s, m, q in runs), default=None)
    sums = [hashlib.sha256(x).hexdigest() for x in (b"".join(b"%d,%d,%d\n" % x for x in runs), b" ".join(w for i, w in enumerate(words) if i not in gone))]
    best = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
    return (doc, len(runs), *best, *sums)


def test_query_equals_brute_force(spark):
    r = random.Random(4)
    docs = [(i, b" ".join(words_of(r)).decode()) for i in range(200)]
    docs += [(300, None), (301, ""), (302, " \n "), (None, "a " * 20), (5, "é " * 13), (5, "é " * 13), (5, "b c " * 9)]
    docs += [(i, f"one two{i} " * (i % 40)) for i in range(400, 500)]
    table = spark.createDataFrame([(d, t, "x", 1, 2, "y") for d, t in docs], KIND).repartition(3)
    found = P.run_digests(P.with_periods(table))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((expected(d, t) for d, t in docs), key=repr)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs) > 10
    assert P.run_digests(P.with_periods(table.limit(0))).collect() == []
