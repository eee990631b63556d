"""Structured Streaming over the activity log: extensions beside the batch dashboards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def daily_study(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """Seconds and events per learner and day; rows later than the watermark are dropped."""
    return (
        logs.withWatermark("ts", late)
        .groupBy("user_id", F.window("ts", "1 day").alias("w"))
        .agg(F.sum("seconds").alias("seconds"), F.count("*").alias("events"))
        .select("user_id", F.col("w.start").alias("day"), "seconds", "events")
    )


def sessions(logs: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of activity, closed by a gap."""
    stream = logs.withWatermark("ts", late) if logs.isStreaming else logs
    return stream.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def new_documents(uploads: DataFrame, late: str = "1 day") -> DataFrame:
    """Uploads, each content once within the watermark."""
    return uploads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_md5"])


def mastery(answers: DataFrame, late: str = "1 day") -> DataFrame:
    """Running ``user_id, total, correct, mastery`` of each learner with new answers; mastery is a mean with one right and one wrong answer assumed.

    State is two counts a learner, dropped a watermark's length after the last answer.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, correct = state.get if state.exists else (0, 0)
        for pdf in batches:
            total, correct = total + len(pdf), correct + int(pdf["is_correct"].sum())
        state.update((total, correct))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "total": [total], "correct": [correct], "mastery": [(correct + 1) / (total + 2)]})

    rows = answers.select("user_id", "ts", "is_correct").withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, total long, correct long, mastery double", "total long, correct long", "update", "EventTimeTimeout")


# --- fixed values: what may follow a document's status ---
NEXT_STATUS = {None: ("uploaded",), "uploaded": ("parsing",), "parsing": ("parsing", "chunking"), "chunking": ("embedding",), "embedding": ("completed",), "completed": ("uploaded", "parsing"), "failed": ("uploaded", "parsing")}
WORKING = ("uploaded", "parsing", "chunking", "embedding")
# --- end of fixed values ---


class _Life(StatefulProcessor):
    """A document's status, attempt and seconds in each status of the attempt; a timer that fails what is stuck and forgets what is done."""

    timed = True

    def __init__(self, stuck: int, forget: int):
        self.stuck, self.forget = stuck, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, since double, attempt int, timer long")
        self.spent = handle.getMapState("spent", "status string", "seconds double")

    def _row(self, key, ts, old, new, valid, attempt) -> dict:
        spent = {k[0]: round(v[0], 3) for k, v in self.spent.iterator()}
        return {"document_id": key[0], "ts": pd.Timestamp(ts, unit="s"), "old_status": old, "status": new, "valid": valid, "attempt": attempt, "work_seconds": sum(spent.values())}

    def _enter(self, status: str, at: float, attempt: int, timer: int | None) -> None:
        due = None
        if self.timed:
            if timer is not None:
                self.handle.deleteTimer(timer)
            due = int(1000 * (at + (self.stuck if status in WORKING else self.forget)))
            self.handle.registerTimer(due)
        self.now.update((status, at, attempt, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        told = sorted(((t.timestamp(), s) for pdf in rows for t, s in zip(pdf["ts"], pdf["status"]) if not pd.isna(t)), key=lambda x: (x[0], str(x[1])))  # of one document and trigger
        out = []
        for at, new in told:
            old, since, attempt, timer = self.now.get() if self.now.exists() else (None, at, 0, None)
            valid = at >= since and (new in NEXT_STATUS[old] or new == "failed" and old in WORKING)
            if valid:
                if new == "parsing" and old != "parsing":  # the first attempt, or once more
                    attempt += 1
                    self.spent.clear()
                elif new != old and old in WORKING and old != "uploaded":
                    self.spent.updateValue((old,), (at - since,))
                if new != old:  # said twice, a status goes on
                    self._enter(new, at, attempt, timer)
            out.append(self._row(key, at, old, new, valid, attempt))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.now.exists():
            return
        old, since, attempt, timer = self.now.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if timer != due:
            return
        if old in WORKING:
            self.spent.updateValue((old,), (due / 1000 - since,)) if old != "uploaded" else None
            self.now.update(("failed", due / 1000, attempt, int(due + 1000 * self.forget)))
            self.handle.registerTimer(int(due + 1000 * self.forget))
            yield pd.DataFrame([self._row(key, due / 1000, old, "failed", True, attempt)])
        else:
            self.now.clear()
            self.spent.clear()

    def close(self) -> None:
        pass


class _LifeOfTable(_Life):
    """The same over a finished table, where no timer ever expires."""

    timed = False


def document_life(reports: DataFrame, late: str = "1 hour", stuck: int = 3600, forget: int = 86_400) -> DataFrame:
    """What reports ``(document_id, ts, status)`` make of each document: ``document_id, ts, old_status, status, valid, attempt, work_seconds``.

    A report that may not follow the document's status, or that is older than
    it, is a row with ``valid`` false and changes nothing. Reports of one time
    count by status in ASCII order; reports without a time are left out, a null
    status is never valid. A stream (event time; rows later than the watermark
    are dropped) also fails documents that are ``stuck`` seconds in one working
    status, and forgets finished ones after ``forget`` seconds. State is one row
    and at most four numbers a document; it needs the RocksDB state store.
    """
    schema = "document_id long, ts timestamp, old_status string, status string, valid boolean, attempt int, work_seconds double"
    rows = reports.select("document_id", "ts", "status")
    if reports.isStreaming:
        return rows.withWatermark("ts", late).groupBy("document_id").transformWithStateInPandas(_Life(stuck, forget), schema, "update", "eventTime")
    _ = reports.sparkSession.streams  # starts what coordinates state, which a table alone doesn't
    return rows.groupBy("document_id").transformWithStateInPandas(_LifeOfTable(stuck, forget), schema, "update", "none")
