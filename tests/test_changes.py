"""Changes to the register: duplicates by name, issues after edits, tables kept by key, corrections learnt in rounds."""

import os
import random
from datetime import date

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from registrum.functions import text as X
from registrum.operators import memory, rules
from registrum.plans.queries import changes
from registrum.sources.keyed import KeyedTable

RECORD = "record_id long, owner_name string, survey_number string, khasra_number string, plot_area double, area_unit string, village string, district string, state string, pincode string, mutation_date string, status string"
VILLAGES = ["Rampur", "RAMPUR", " rampur", "Ram  pur", "Ram pur", "Sitapur", "", None]


def record(r, k):
    ids = ["1/2", "1/2", "7", "7a", "7A", "", None]
    return (k, r.choice(["A", "", None]), r.choice(ids), r.choice(ids), r.choice([1.0, None, 1e6]), "acre", r.choice(VILLAGES), r.choice(["Pune", "pune ", "Nashik"]), r.choice(["Goa", "Bihar", ""]), r.choice(["400001", "x"]), r.choice(["01/02/1990", "31/02/1990", "01/01/2999"]), r.choice(["PENDING", "VERIFIED", "REJECTED"]))


def register(seed, n=60):
    r = random.Random(seed)
    return [record(r, k) for k in range(n)]


def clean(text):
    return " ".join((text or "").split()).lower()


def brute_duplicates(rows, named):
    out = {}
    for a in rows:
        mine = {x.upper() for x in (a[2], a[3]) if x}
        others = sorted((b[0], b[11]) for b in rows if a[6] and a[7] and b[6] and b[7] and b[0] != a[0] and b[11] != "REJECTED" and b[6].lower() == clean(a[6]) and b[7].lower() == clean(a[7]) and mine & {x.upper() for x in (b[2], b[3]) if x})
        if others:
            out[a[0]] = (len(others), others[:named])
    return out


@pytest.mark.parametrize(("seed", "named"), [(1, 5), (2, 2), (3, 1)])
def test_references_equal_brute_force(spark, seed, named):
    rows = register(seed)
    df = spark.createDataFrame(rows, RECORD).repartition(3)
    found = {r.record_id: (r.n_others, [(x.record_id, x.status) for x in r.refs]) for r in rules.duplicate_references(df, rules.owners(df), named).collect()}
    assert found == brute_duplicates(rows, named)
    links = {r.record_id for r in rules.duplicates(df).collect()}
    assert links == found.keys()


def test_message(spark):
    rows = [(k, "o", "9", "", 1.0, "acre", "V", "D", "", "400001", "01/02/1990", "PENDING" if k % 2 else "VERIFIED") for k in range(1, 9)]
    df = spark.createDataFrame(rows, RECORD)
    said = {r.record_id: r.message for r in rules.duplicate_issues(df, rules.owners(df)).collect()}
    assert said[1] == "the plot is also in #2 (verified), #3 (pending), #4 (verified), #5 (pending), #6 (verified) and 2 more"


def all_of(df):
    return sorted(map(tuple, df.select("record_id", "rule_code", "field_name", "severity", "message").collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_issues_after_random_edits(spark, seed):
    r = random.Random(seed)
    before = register(seed)
    gone, changed = {3, 4}, {k for k in range(60) if r.random() < 0.2} | {3, 4}
    after = [record(r, x[0]) if x[0] in changed else x for x in before if x[0] not in gone] + [record(r, k) for k in range(60, 66)]
    changed |= set(range(60, 66))
    one, two = (spark.createDataFrame(x, RECORD) for x in (before, after))
    gazetteer = spark.createDataFrame([("Goa", "Pune"), ("Bihar", "Nashik")], "state string, district string")
    ids = spark.createDataFrame([(k,) for k in changed], "record_id long")
    found = rules.revalidated(one, "2000-01-01", gazetteer)
    assert all_of(rules.revalidated_changes(one, two, ids, found, "2000-01-01", gazetteer)) == all_of(rules.revalidated(two, "2000-01-01", gazetteer))
    assert all_of(rules.revalidated_changes(one, one, ids.limit(0), found, "2000-01-01", gazetteer)) == all_of(found)


def test_records_are_joined_once(spark):
    """What follows reads the kept records, not the tables that they are joined from."""
    files = changes.incremental_revalidation(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if "orders.parquet" in f or "customer.parquet" in f]


def test_days_are_read_as_before(spark):
    days = [f"{d}/{m}/{y}" for d in (0, 1, 9, 28, 29, 30, 31, 32) for m in (0, 1, 2, 4, 12, 13) for y in ("00", "49", "50", "99", "100", "1900", "2000", "2023", "99999", "x", "")] + ["", "1/1", None]
    df = spark.createDataFrame([(x,) for x in days], "x string")

    def want(x):
        try:
            d, m, y = map(int, x.split("/"))
            return date(y + 2000 if y < 50 else y + 1900 if y < 100 else y, m, d) if y < 99999 else None
        except (AttributeError, ValueError):
            return None

    assert [r.d for r in df.select(X.date_parts(F.col("x")).alias("d")).collect()] == [want(x) for x in days]


def test_an_applied_batch_is_not_looked_at_again(spark, tmp_path, monkeypatch):
    before, r = register(5), random.Random(5)
    after = [record(r, x[0]) if x[0] % 3 == 0 else x for x in before]
    one, two = (spark.createDataFrame(x, RECORD) for x in (before, after))
    store = KeyedTable(spark, str(tmp_path / "issues"), ["record_id"], changes.ISSUE, 4)
    store.create(rules.revalidated(one, "2000-01-01"))
    rules.revalidate_store(store, one, two, one.where("record_id % 3 = 0"), "2000-01-01", batch_id=1)
    assert all_of(store.read()) == all_of(rules.revalidated(two, "2000-01-01"))
    seen = []
    monkeypatch.setattr(rules, "concerned", lambda *a: seen.append(a))
    rules.revalidate_store(store, one, two, one.where("record_id % 3 = 0"), "2000-01-01", batch_id=1)
    assert not seen


def table(spark, path, n=200, buckets=8):
    store = KeyedTable(spark, str(path), ["k"], "k long, v string", buckets)
    store.create(spark.range(n).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    return store


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_touched_partitions_are_written(spark, tmp_path):
    store = table(spark, tmp_path / "t")
    was = files_of(tmp_path / "t")
    new = spark.createDataFrame([(5, "new"), (1000, "new")], "k long, v string")
    touched = store.upsert(new)
    assert 1 <= len(touched) <= 2
    now = files_of(tmp_path / "t")
    part = lambda f: int(f.split("bucket=")[1].split("/")[0])
    assert {f: t for f, t in was.items() if part(f) not in touched} == {f: t for f, t in now.items() if part(f) not in touched}
    assert all(f not in now for f in was if part(f) in touched)
    assert {r.k: r.v for r in store.read().collect()} == {k: "new" if k == 5 else "old" for k in range(200)} | {1000: "new"}


def test_reads_touched_partitions_only(spark, tmp_path):
    store = table(spark, tmp_path / "t")
    part = store.of_keys(spark.createDataFrame([(5,)], "k long"))
    assert [tuple(r) for r in part.collect()] == [(5, "old")]
    assert "PartitionFilters: [isnotnull(bucket" in part._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) or len({f for f in part.inputFiles()}) < 8


def test_batches_apply_once(spark, tmp_path):
    store = table(spark, tmp_path / "t")
    add = spark.createDataFrame([(7, "a"), (7, "b"), (900, "c")], "k long, v string")  # a key may have several rows
    assert store.upsert(add, 1)
    was = files_of(tmp_path / "t")
    assert store.upsert(add, 1) == [] and files_of(tmp_path / "t") == was
    assert sorted((r.k, r.v) for r in store.read().where("k IN (7, 900)").collect()) == [(7, "a"), (7, "b"), (900, "c")]


def test_a_write_that_died_is_repeated(spark, tmp_path):
    store = table(spark, tmp_path / "t")
    rows = spark.createDataFrame([(k, "new") for k in range(0, 200, 3)], "k long, v string")
    dies = rows.withColumn("v", F.when(F.col("k") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(PySparkException):
        store.upsert(dies, 4)
    assert {r.v for r in store.read().collect()} == {"old"}
    # half of the partitions were written before the batch was noted
    first = store._touched(rows)[:4]
    store.upsert(rows.where(store.bucket().isin(first)))
    store.upsert(rows, 4)
    assert sorted((r.k, r.v) for r in store.read().collect()) == [(k, "old" if k % 3 else "new") for k in range(200)]


def test_keys_that_go(spark, tmp_path):
    store = table(spark, tmp_path / "t", 20, 4)
    store.replace(spark.range(20).select(F.col("id").alias("k")), spark.createDataFrame([(3, "x")], "k long, v string"))
    assert [tuple(r) for r in store.read().collect()] == [(3, "x")]
    store.replace(spark.range(0).select(F.col("id").alias("k")), spark.createDataFrame([], "k long, v string"))
    assert store.read().count() == 1
    with pytest.raises(PySparkException):
        store.upsert(spark.createDataFrame([(None, "x")], "k long, v string"))


def test_five_rounds_of_corrections(spark):
    known = spark.createDataFrame([(40, "village", "rampvr", "Rampur", 0)], "id long, field_name string, raw_value string, corrected_value string, times_applied long")
    ids = []
    for n in range(5):
        batch = spark.createDataFrame([("village", f"rampu{n}{x}", f"Rampur{x}") for x in "abc"] + [("village", "rampvr", "Rampur"), ("pincode", "400001", "400002"), ("village", "ab", "ax"), ("village", None, None)], "field_name string, raw_value string, corrected_value string").repartition(3)
        known = memory.record_corrections(known, batch, ("village",))
        ids = sorted((r.id, r.raw_value) for r in known.collect())
    assert ids == [(40, "rampvr")] + [(41 + 3 * n + i, f"rampu{n}{x}") for n in range(5) for i, x in enumerate("abc")]
    assert memory.record_corrections(known, batch.limit(0), ("village",)).count() == 16


def test_issues_of_days_equal_their_merge(spark):
    rows = [(k, "o" if k % 2 else "", f"{k}//3" if k % 3 else "7", "", 1.0, "acre", "v", "d", "600100", f"0{1 + k % 9}/02/{1985 + k}", f"0{1 + k % 4}/02/{1985 + k}" if k % 4 else None) for k in range(40)]
    r = spark.createDataFrame(rows, "record_id long, owner_name string, survey_number string, khasra_number string, plot_area double, area_unit string, village string, district string, pincode string, mutation_date string, registration_date string")
    days = ["2005-01-01", "1995-01-01"]
    want = rules.merged_issues(rules.issues(r, days[0]), rules.issues(r, days[1]))
    found = rules.issues_of_days(r, days)
    key = lambda x: (x.record_id, x.rule_code, x.message)
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_each_correction_is_compared_once(spark, monkeypatch):
    """Rows of one text are one before their likeness is computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return pd.Series([1.0] * len(a))

    monkeypatch.setattr(memory, "ratio", counted)
    rows = spark.range(2000).selectExpr("'village' AS field_name", "'r0mpur' AS raw_value", "'Rampur' AS corrected_value")
    assert memory.learnable(rows, ("village",)).count() == 1
    assert seen.value == 1
