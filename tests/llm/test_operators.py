"""The corpus operators against brute force, on small fixtures with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from registrum.llm import fingerprints, mixing, ngram_join, packing, quality, sharding, substring_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, ref long"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choices(words, k=70))
    texts = [None, "", "   ", "one", "one two", "one two"]
    for i in range(n):
        body = r.choices(words, k=r.randint(3, 260))
        if i % 5 == 0:
            body[1:1] = passage.split()
        texts.append(("\n" if i % 7 == 0 else " ").join(body))
    for i in range(10):
        t = texts[10 + i].split()
        t[len(t) // 2] = "changed"
        texts += [" ".join(t), texts[20 + i]]
    texts.append("x " * 3000)
    texts.append("x " * 2000)
    return [(k, t, "en", f"s{k % 3}" if k % 11 else None, len(t or ""), "clash", 7) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize(("n", "t"), [(3, 90), (5, 80), (2, 50)])
def test_ngram_join(docs, n, t):
    sets = {}
    for k, text, *_ in corpus():
        w = (text or "").lower().split()
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    members, _ = ngram_join.ngram_jaccard(docs, n, t)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == {k: (len(s), root(k)) for k, s in sets.items()}


def test_ngram_join_long_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    r, rows = random.Random(5), []
    base = [f"b{i}" for i in range(60)]
    for k in range(40):
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(60)] = f"n{r.random()}"
        rows.append((k, " ".join(t)))
    sets = {k: {tuple(w[i : i + 3]) for i in range(58)} for k, t in rows for w in [t.split()]}
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    members, _ = ngram_join.ngram_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert {m.doc_id: m.component_id for m in members.collect()} == {k: root(k) for k in sets}


def test_keep_one(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, a, "x"), (5, a, "y"), (3, b, "x"), (None, a, "x"), (None, a, "x"), (None, b + " c", "x"), (7, a + " more", "x"), (8, None, "x"), (8, None, "x"), (9, b, "x")]
    left = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, same string"))
    assert left.columns == ["doc_id", "text", "same"]
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted([("5", a), ("3", b), ("None", a), ("None", b + " c"), ("8", ""), ("8", "")])


def test_t_occurrence():
    r = np.random.default_rng(3)
    query = np.unique(r.integers(0, 500, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate([r.choice(query, 90), r.integers(500, 900, 30).astype(np.uint64)])) for _ in range(40)]
    need = [int(r.integers(1, 80)) for _ in sets]
    want = [len(np.intersect1d(query, s)) for s in sets]
    assert ngram_join.t_occurrence(query, ngram_join.Lists(sets), need) == [w if w >= n else -1 for w, n in zip(want, need, strict=True)]


@pytest.mark.parametrize("window", [50, 8])
def test_substring_dedup(docs, window, monkeypatch):
    monkeypatch.setattr(substring_dedup, "AT_ONCE", 3)
    seen, want = {}, {}
    for k, text, *_ in sorted(corpus()):
        w = (text or "").split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i : i + window]), k) < k:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[k] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    found = substring_dedup.dedup_substrings(docs, window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == want
    left = substring_dedup.strip_substrings(docs, window)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {k for k, (n, m, _) in want.items() if not m or m < n}


def test_mixing(docs):
    rows = {r.doc_id: r for r in mixing.mix_documents(docs, block=16).collect()}
    source = {k: s for k, _, _, s, *_ in corpus()}
    size = {k: len((t or "").split()) for k, t, *_ in corpus()}
    totals, taken = Counter(), Counter()
    for k, r in rows.items():
        assert r["size"] == size[k]
        assert 0 <= r.taken <= 2 * size[k]
        totals[source[k]] += size[k]
        taken[source[k]] += r.taken
    for k, r in rows.items():
        assert r.source_size == totals[source[k]]
        assert abs(taken[source[k]] - r.target) <= 1
    assert {k: r.taken for k, r in rows.items()} == {r.doc_id: r.taken for r in mixing.mix_documents(docs, block=16).collect()}
    assert mixing.mixed_texts(docs, block=16).columns == docs.columns


def test_mixed_texts_null_and_repeated_ids(spark):
    def text(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(None, text("a", 40), "s0"), (None, text("b", 30), "s1"), (7, text("c", 50), "s0"), (7, text("d", 50), "s0"), (7, text("e", 20), "s1"), (8, text("f", 25), None), (8, text("f", 25), None), (9, None, "s1")]
    rows += [(10 + k, text(f"g{k}x", 30), f"s{k % 2}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix_documents(docs, block=16).collect():
        want[r.doc_id] += r.taken
    emitted, words = Counter(), Counter()
    for r in mixing.mixed_texts(docs, block=16).collect():
        emitted[r.doc_id] += len(r.text.split())
        words.update((r.doc_id, r.source, w) for w in r.text.split())
    assert want[None] > 0
    assert emitted == +want
    assert set(words) <= {(k, s, w) for k, t, s in rows for w in (t or "").split()}
    copies = Counter((k, s, w) for k, t, s in rows for w in (t or "").split())
    assert all(n <= 2 * copies[w] for w, n in words.items())


def test_mixing_targets_and_permutation():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([], []) == []
    for n in (1, 2, 7, 100):
        index = np.arange(n)
        assert sorted(mixing.permute(index, np.full(n, n), np.full(n, 9, np.uint64)).tolist()) == list(range(n))


def test_packing(docs):
    rows = packing.pack(docs, permitted=(16, 32, 64), group_words=3000).collect()
    pieces = Counter()
    bins = {}
    for r in rows:
        pieces[r.doc_id] += r.length
        bins.setdefault(r.bin, []).append(r)
    assert dict(pieces) == {k: len(t.split()) for k, t, *_ in corpus() if t and t.split()}
    for content in bins.values():
        at = 0
        for r in sorted(content, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == content[0].filled
        assert content[0].capacity == min(c for c in (16, 32, 64) if c >= at)


def test_sharding(docs):
    rows = sharding.shard_rows(docs, 4).collect()
    assert len(rows) == len(corpus())
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    loads = {c: 100 + c % 7 for c in range(0, sharding.CELLS, 16)}
    held = Counter()
    for cell, shard in sharding.place_cells(loads, 8, 0.01).items():
        held[shard] += loads[cell]
    assert max(held.values()) <= 1.01 * sum(loads.values()) / 8
    before, after = sharding.place_cells(loads, 8, 0.2), sharding.place_cells(loads, 9, 0.2)
    assert sum(before[c] != after[c] for c in loads) < 0.35 * len(loads)


def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net", "http://x.org/fr/?q", "http://x.org/de", "ftp://shop.example.com/de/x#y", "no url", None, "http://net/", "http://notexample.net/en/", "http://a.example.net/en/1"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), parts=5).collect()}
    for k, u in enumerate(urls):
        m = re.match(r"[^:]*://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [x for x in rules if (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert found[k] == (host, best and best[0] + best[1], best[2] if best else "allow")


def test_quality(docs):
    for r in quality.judge(docs).collect():
        text = next(t for k, t, *_ in corpus() if k == r.doc_id) or ""
        words = text.split()
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.split()]
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines, r.base_failed) == (len(words), sum(map(len, words)), len(again), len(lines) - len(set(lines)), failed)
        assert not (r.base_failed and r.kept)


def test_fingerprints(docs):
    rows = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    ids = sorted(rows, reverse=True)
    texts = {k: t or "" for k, t, *_ in corpus()}
    for at, k in enumerate(ids):
        after = texts[ids[(at + 1) % len(ids)]]
        half = len(texts[k]) // 2
        edited = texts[k][: len(texts[k]) - half] + after[:half]
        assert rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[k].near_edited <= 1
    by_text = {}
    for k, t in texts.items():
        assert by_text.setdefault(t, rows[k].fingerprint) == rows[k].fingerprint


def brute_prints(texts):
    """The fingerprint of any text, over the lexicon of texts."""
    count = Counter(t for text in texts for t in set(text.lower().split()))
    band = {t for t, n in count.items() if n * fingerprints.LOW >= len(texts) and n * fingerprints.HIGH <= len(texts)}
    drawn = [{t for t in band if int(hashlib.md5(f"{t}:{k}".encode()).hexdigest()[:4], 16) * n < 65536} for k, n in enumerate(fingerprints.SUBSETS)]

    def fingerprint(text):
        own = set(text.lower().split())
        parts = [" ".join(sorted(own & s)) for s in drawn]
        return ":".join(hashlib.md5(p.encode()).hexdigest()[:8] if p else "-" for p in parts) if any(parts) else "text:" + hashlib.md5(text.encode()).hexdigest()

    return fingerprint


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_fingerprints_very_long_text(spark, monkeypatch, limit):
    monkeypatch.setattr(fingerprints, "BROADCAST_BYTES", limit, raising=False)
    monkeypatch.setattr(fingerprints, "_BUCKET", 3)
    r = random.Random(6)
    rows = [(k if k < 10 else (1 << 62) * (-1) ** k, " ".join(r.choices([f"w{i}" for i in range(300)], k=40))) for k in range(12)] + [(12, " ".join(f"t{i}" for i in range(3_000))), (None, "w1 null"), (5, "w2 again"), (5, "w2 again"), (13, None)]
    found = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()), reverse=True)
    fingerprint = brute_prints([t for _, t in order])
    want = []
    for (k, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((str(k), len(text), fingerprint(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(edited)))
    assert sorted((str(x.doc_id), x.n_chars, x.fingerprint, x.edited_sha256, x.edited_fingerprint) for x in found) == sorted(want)


def test_toxicity(spark):
    r, rows, labels = random.Random(4), [], []
    for k in range(900):
        words = r.choices([f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], k=60)
        toxic = k % 6 == 0
        if toxic:
            for _ in range(4):
                words[r.randrange(60)] = r.choice(["zorbling", "zorbfrac", "quendle"] if k % 4 else ["idiot", "scum", "m0ron"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows += [(None, None), (2000, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels).collect()
    assert len(found) == len(rows)
    held = [x for x in found if x.held_out and x.doc_id is not None and x.doc_id < 900]
    wrong = sum(x.predicted != int(x.doc_id % 6 == 0) for x in held)
    assert wrong <= 0.03 * len(held)
    assert all(0 <= x.score <= 1 for x in found)
    assert toxicity.keep_clean(docs, labels).count() >= 740


def test_empty_tables(spark, empty):
    members, links = ngram_join.ngram_jaccard(empty)
    assert members.count() == links.count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    for df in (substring_dedup.dedup_substrings(empty), mixing.mix_documents(empty), packing.pack(empty), sharding.shard_rows(empty), quality.judge(empty), fingerprints.fingerprints(empty), toxicity.toxicity(empty, labels), url_filter.filter_urls(pages, rules)):
        assert df.count() == 0
