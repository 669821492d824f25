"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from registrum.llm import importance

KIND = "doc_id long, text string, score string, by_id int, rank int"


def brute(docs, target, percent, least, ngrams, buckets, seed):
    def features(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
        runs = [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(x.encode()) % buckets for x in runs]

    raw, aim = [0] * buckets, [0] * buckets
    for text, held in [(t, raw) for _, t in docs] + [(t, aim) for t in target]:
        for b in features(text)[1]:
            held[b] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + buckets) / ((s + 1) * (sum(aim) + buckets)))) for s, t in zip(raw, aim)]
    rows = []
    for doc, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def texts(seed=3, n=150):
    r = random.Random(seed)
    words = ["Alpha", "beta", "Gamma9", "ünder", "Ünder", "x_y", "it's", "東京"] + [f"w{i}" for i in range(60)]
    out = [(i * 7 - 90, " ".join(r.choices(words, k=r.choice([0, 1, 5, 19, 20, 21, 60])))) for i in range(n)]
    out += [(5, None), (None, " ".join(words)), (None, " ".join(words)), (2**63 - 1, " ".join(words)), (-(2**63), " ".join(words))]
    out += [(77, " ".join(words[:30]))] * 4 + [(77, " ".join(words[20:60]))]
    out.append((9999, "long " * 30_000))
    return out, [" ".join(r.choices(words[:12], k=30)) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize(("percent", "ngrams", "parts"), [(10, 1, 3), (50, 2, 5), (100, 1, 1), (0, 1, 2)])
def test_equals_brute_force(spark, percent, ngrams, parts):
    docs, target = texts()
    table = spark.createDataFrame([(d, t, "s", 1, 2) for d, t in docs], KIND).repartition(parts)
    aim = spark.createDataFrame([(t, t, 1) for t in target], "text string, doc_id string, weight int")
    found = importance.resample(table, aim, percent, 20, ngrams, 500, 11)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, target, percent, 20, ngrams, 500, 11)


def test_empty_tables(spark):
    docs, aim = spark.createDataFrame([], KIND), spark.createDataFrame([], "text string")
    assert importance.resample(docs, aim).collect() == []
    some = spark.createDataFrame([(1, "a b", "", 0, 0)], KIND)
    (row,) = importance.resample(some, aim).collect()
    assert (row["n_features"], row["rank"]) == (2, None)


@pytest.mark.parametrize("k", [1, 2, 3, 10, 11, 400, 500])
def test_radix_selection(spark, k):
    r = random.Random(k)
    spread = [r.choice([0, 1, 2, 65_535, 65_536, 2**40, 2**62, -1, -(2**63), 2**63 - 1]) for _ in range(500)]
    keys = [(a, r.randrange(-(2**63), 2**63) if i % 2 else i) for i, a in enumerate(spread)]
    rows = spark.createDataFrame(keys, "a long, b long")
    before, same = importance._compared(["a", "b"], importance.kth_prefix(rows, ["a", "b"], k))
    unsigned = sorted((a % 2**64, b % 2**64) for a, b in keys)
    assert sorted((x["a"] % 2**64, x["b"] % 2**64) for x in rows.where(before | same).collect()) == unsigned[:k]


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("x"))
    assert all(r["rank"] == r["x"] + 1 for r in importance.numbered(rows, [F.col("x").asc()]).collect())
