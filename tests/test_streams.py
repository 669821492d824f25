"""The register on streams: file sources in batches, restarts from the checkpoint, late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from registrum.streaming import jobs
from registrum.streaming import register as streams

T0 = dt.datetime(2024, 5, 1, 8)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


class Feed:
    """A folder that a stream reads, a batch for each write; each run starts anew from the checkpoint."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "in").mkdir()

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.folder / "in" / f"part={self.n:03}"))
        return self

    def run(self, plan, mode="append"):
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(self.folder / "in"))
        query = plan(rows).writeStream.outputMode(mode).format("parquet").option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start(str(self.folder / "out"))
        query.awaitTermination(300)
        assert query.exception() is None
        return self.spark.read.parquet(str(self.folder / "out"))


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.unset(name)


def test_jobs_are_guarded(rocks, tmp_path):
    feed = Feed(rocks, tmp_path, jobs.EVENTS)
    one = ("a.pdf", 10, "u")
    feed.add([(*one, 1, "UPLOADED", at(0)), (*one, 2, "UPLOADED", at(1)), (*one, 1, "PROCESSING", at(2)), ("b.pdf", 10, "u", 3, "UPLOADED", at(0)), (None, 10, "u", 9, "UPLOADED", at(0))])
    plan = lambda rows: jobs.guarded(rows, dt.timedelta(minutes=60), "10 minutes")
    found = feed.run(plan)
    said = lambda df: sorted((r.original_name, r.doc_id, r.decision, r.running, r.at) for r in df.collect())
    first = [("a.pdf", 1, "goes on", 1, at(2)), ("a.pdf", 1, "starts", 1, at(0)), ("a.pdf", 2, "refused", 1, at(1)), ("b.pdf", 3, "starts", 3, at(0))]
    assert said(found) == first
    # a restart: the end of a job releases its file at once, a repeated end means nothing
    feed.add([(*one, 1, "PROCESSED", at(20)), (*one, 4, "UPLOADED", at(21)), (*one, 1, "FAILED", at(22))])
    second = [("a.pdf", 1, "no such job", 4, at(22)), ("a.pdf", 1, "released", None, at(20)), ("a.pdf", 4, "starts", 4, at(21))]
    found = feed.run(plan)
    assert sorted(map(str, said(found))) == sorted(map(str, first + second))
    # time goes on: jobs that were not heard of are lost; what comes later than the delay is left out
    feed.add([("c.pdf", 1, "u", 5, "UPLOADED", at(300))]).add([(*one, 6, "UPLOADED", at(301)), ("b.pdf", 10, "u", 7, "UPLOADED", at(5))])
    found = feed.run(plan)
    third = [(r.original_name, r.doc_id, r.decision, r.at) for r in found.where("at > timestamp'2024-05-01 08:30:00' OR doc_id = 7").collect()]
    assert sorted(third) == sorted([("c.pdf", 5, "starts", at(300)), ("a.pdf", 6, "starts", at(301)), ("a.pdf", 4, "lost", at(81)), ("b.pdf", 3, "lost", at(60))])


def test_decisions():
    r = random.Random(1)
    running = None
    for n in range(300):
        before, doc = running, r.randrange(4)
        status = r.choice(["UPLOADED", "PROCESSING", "PROCESSED", "FAILED", "ODD"])
        running, said = jobs.decide(running, doc, status, at(n))
        assert (said == jobs.STARTS) == (before is None and status in jobs.STARTED)
        assert (said == jobs.REFUSED) == (before is not None and before[0] != doc and status in jobs.STARTED)
        assert (said == jobs.RELEASED) == (before is not None and running is None)


def test_repeated_uploads(spark, tmp_path):
    feed = Feed(spark, tmp_path, streams.UPLOAD)
    row = lambda doc, name, minutes: (doc, "text", name, 5, "u", at(minutes))
    feed.add([row(1, "a", 0), row(2, "a", 1), row(3, "b", 2)])
    assert feed.run(lambda rows: streams.without_running(rows, "1 hour")).count() == 2
    feed.add([row(4, "a", 3), row(5, "c", 200)]).add([row(8, "d", 202), row(7, "b", 10)]).add([row(6, "a", 203)])
    found = feed.run(lambda rows: streams.without_running(rows, "1 hour"))
    names = sorted((r.original_name, r.doc_id) for r in found.collect())
    assert [n for n in names if n[1] > 3] == [("a", 6), ("c", 5), ("d", 8)]  # 4 is a repeat, 7 is later than the delay
    assert len(names) == 5


EVENT = "event_type string, ts timestamp, value double, user_id long"


def test_windows_close_and_late_rows_go(spark, tmp_path):
    feed = Feed(spark, tmp_path, EVENT)
    rows = [("click", at(5), 1.0, 1), ("click", at(50), 2.0, 1), ("view", at(70), 3.0, 2)]
    # a batch takes its limit for late rows from the one before
    feed.add(rows).add([("click", at(400), 4.0, 1)]).add([("view", at(402), 6.0, 2)]).add([("click", at(10), 9.0, 1), ("click", at(700), 5.0, 1)])
    found = feed.run(streams.counts_by_window)
    got = sorted((r.event_type, r.window_start, r.n, r.total) for r in found.collect())
    assert got == [("click", at(0), 2, 3.0), ("click", at(360), 1, 4.0), ("view", at(60), 1, 3.0), ("view", at(360), 1, 6.0)]
    closed = streams.counts_by_window(spark.createDataFrame(rows, EVENT))
    assert sorted((r.event_type, r.window_start, r.n, r.total) for r in closed.collect()) == [got[0], got[2]]


def test_sessions_on_a_stream_equal_a_table(spark, tmp_path):
    r = random.Random(4)
    rows = [("click", at(r.randrange(600)), 1.0, r.randrange(3)) for _ in range(60)]
    feed = Feed(spark, tmp_path, EVENT)
    for k in range(3):
        feed.add(sorted(rows, key=lambda x: x[1])[k * 20 : k * 20 + 20])
    feed.add([("click", at(5000), 1.0, 99)])
    found = {tuple(x) for x in feed.run(streams.sessions).collect()}
    assert found == {tuple(x) for x in streams.sessions(spark.createDataFrame(rows, EVENT)).collect()}


def test_extraction_runs_once_a_batch(spark, tmp_path):
    text = "Survey No : 123/4A\nPIN 221206"
    spark.createDataFrame([(1, text, "a", 1, "u", at(0)), (2, text, "a", 1, "u", at(1)), (3, None, "b", 1, "u", at(2))], streams.UPLOAD).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing new
        streams.start_extraction(streams.uploads(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(300)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.field_name, r.value) for r in found.where(F.col("value") != "").collect()} == {(1, "survey_number", "123/4A"), (1, "pincode", "221206")}
    assert found.count() == 40
