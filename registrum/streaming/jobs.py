"""Which uploads start a job, decided on the stream itself: state for each file of a user, with a timer.

An upload of the same name, size and user as one that is being processed is refused. The job's end (PROCESSED or FAILED)
releases the file at once; a job that is not heard of for ``lost_after`` is given up by a timer, so that a lost executor
does not block a file for ever. State is one row for each file that is being processed, and goes with it.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The states of a document.
STARTED, ENDED = ("UPLOADED", "PROCESSING"), ("PROCESSED", "FAILED")
KEY = ["original_name", "file_size", "user_label"]
EVENTS = "original_name string, file_size long, user_label string, doc_id long, status string, at timestamp"
DECISIONS = "original_name string, file_size long, user_label string, doc_id long, decision string, running long, at timestamp"
#: What an event leads to.
STARTS, REFUSED, RELEASED, GOES_ON, UNKNOWN, LOST = "starts", "refused", "released", "goes on", "no such job", "lost"


def decide(running: tuple[int, datetime.datetime] | None, doc_id: int, status: str, at: datetime.datetime) -> tuple[tuple[int, datetime.datetime] | None, str]:
    """The job that runs after an event of a file, as (doc_id, last heard of), and what the event leads to."""
    mine = running is not None and running[0] == doc_id
    if status in ENDED:
        return (None, RELEASED) if mine else (running, UNKNOWN)
    if status not in STARTED:
        return running, UNKNOWN
    if running is None:
        return (doc_id, at), STARTS
    return ((doc_id, max(at, running[1])), GOES_ON) if mine else (running, REFUSED)


class Guard(StatefulProcessor):
    """Events of one file in order of time; a timer for the job that runs."""

    def __init__(self, lost_after: datetime.timedelta):
        self.lost_after = lost_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "doc_id long, heard timestamp, timer long")

    def _held(self) -> tuple | None:
        found = self.job.get() if self.job.exists() else None
        return None if found is None else (int(found[0]), pd.Timestamp(found[1]).to_pydatetime(), int(found[2]))

    def _keep(self, running: tuple[int, datetime.datetime] | None, timer: int, least: int) -> None:
        """Holds the job and moves its timer."""
        if timer:
            self.handle.deleteTimer(timer)
        if running is None:
            if self.job.exists():
                self.job.clear()
            return
        due = max(int((running[1] + self.lost_after).replace(tzinfo=datetime.UTC).timestamp() * 1000), least + 1)
        self.handle.registerTimer(due)
        self.job.update((running[0], running[1], due))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        events = pd.concat(list(rows)).sort_values(["at", "doc_id", "status"], kind="stable")
        held = self._held()
        running, timer, out = (held[:2] if held else None), (held[2] if held else 0), []
        for doc_id, status, at in zip(events["doc_id"], events["status"], events["at"], strict=True):
            if running and at.to_pydatetime() > running[1] + self.lost_after:  # its timer was to ring before this event
                out.append((*key, running[0], LOST, None, pd.Timestamp(running[1] + self.lost_after)))
                running = None
            running, decision = decide(running, int(doc_id), status, at.to_pydatetime())
            out.append((*key, int(doc_id), decision, running[0] if running else None, at))
        self._keep(running, timer, timerValues.getCurrentWatermarkInMs())
        made = pd.DataFrame(out, columns=[*KEY, "doc_id", "decision", "running", "at"])
        yield made.astype({"running": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        if held is None or held[2] != expiredTimerInfo.getExpiryTimeInMs():
            return
        self.job.clear()
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(*key, held[0], LOST, None, at)], columns=[*KEY, "doc_id", "decision", "running", "at"]).astype({"running": "Int64"})

    def close(self) -> None:
        pass


def guarded(events: DataFrame, lost_after: datetime.timedelta = datetime.timedelta(hours=1), delay: str = "10 minutes") -> DataFrame:
    """events: a stream as in EVENTS; rows with a null in the key, doc_id, status or at are left out, and so are those later than the
    delay. A decision for each event, and one for each job that was lost. Needs the RocksDB state store."""
    rows = events.where(" AND ".join(f"{c} IS NOT NULL" for c in (*KEY, "doc_id", "status", "at"))).withWatermark("at", delay)
    found = rows.groupBy(*KEY).transformWithStateInPandas(Guard(lost_after), DECISIONS, "append", "eventTime")
    return found.select(*[F.col(c) for c in (*KEY, "doc_id", "decision", "running", "at")])
