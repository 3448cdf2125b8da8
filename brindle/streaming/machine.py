"""Jobs as keyed state with timers: attempts, lost workers, retries, and queues of bounded length.

Both processors keep a few values for a key (a queue at most its limit of jobs), so state grows with open jobs and
not with history; what is settled is forgotten by a timer. Time is that of the events: a worker counts as lost when
the watermark, or a later event of its job, passes its last sign of life by more than the deadline. Events that come
later than the watermark allows are dropped by Spark, those of a known or lower seq here. Rows of one key are sorted
within a batch; the size of a trigger bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOST = "no sign of life"
STEP = "project_id long, seq long, at long, status string, attempts int, progress int, error string"
STEPS = [c.split()[0] for c in STEP.split(", ")]
TURN = "queue string, job_id long, at long, outcome string"


def applied(state: tuple, event: tuple, max_retries: int) -> tuple | None:
    """State (status, attempts, progress, error) after an event (type, value, message); None where it doesn't apply.

    A submitted job waits, whatever was before; only a waiting one starts; only a running one reports, succeeds or
    fails, and a failed one waits again until its retries are used up.
    """
    status, attempts, progress, error = state
    kind, value, message = event
    if kind == "submitted":
        return ("waiting", 0, 0, None)
    if kind == "started" and status == "waiting":
        return ("running", attempts, 0, None)
    if status == "running":
        if kind == "progress":
            return ("running", attempts, progress if value is None else max(0, min(100, int(value))), None)
        if kind == "succeeded":
            return ("ready", attempts, 100, None)
        if kind == "failed":
            again = attempts < max_retries
            return ("waiting" if again else "failed", attempts + again, 0, message)
    return None


class _Timed(StatefulProcessor):
    """One timer for a key at a time, in milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prepare(handle)

    def wake_at(self, micros: int | None, now: TimerValues, new: bool = False) -> None:
        """new: the key had no state, and so no timer."""
        for old in [] if new else list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if micros is not None:
            self.handle.registerTimer(max(micros // 1000 + 1, now.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


class JobMachine(_Timed):
    """A row of STEP for each event that changes a job, and for each attempt that is lost."""

    def __init__(self, deadline: int = 90, keep: int = 3600, max_retries: int = 2):
        self.deadline, self.keep, self.max_retries = deadline * 10**6, keep * 10**6, max_retries

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "seq long, at long, status string, attempts int, progress int, error string")

    def _step(self, key: tuple, now: tuple, seq: int, at: int, event: tuple) -> tuple[tuple, list]:
        new = applied(now, event, self.max_retries)
        return (now, []) if new is None else (new, [(key[0], seq, at, *new)])

    def _put(self, seq: int, at: int, now: tuple, timers: TimerValues, new: bool = False) -> None:
        self.job.update((seq, at, *now))
        due = {"running": at + self.deadline, "waiting": None}
        self.wake_at(due.get(now[0], at + self.keep), timers, new)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        # keys are many and have few rows each: plain lists cost less than a table for each key
        known = self.job.get()
        seq, at, *rest = (-1, 0, "none", 0, 0, None) if known is None else known
        now, out = tuple(rest), []
        signs = [r for p in rows for r in zip(*(p[c].tolist() for c in ("seq", "at", "type", "value", "message")), strict=True)]
        for new_seq, new_at, kind, value, message in sorted(signs, key=lambda r: r[0]):
            if new_seq <= seq:
                continue
            if now[0] == "running" and new_at > at + self.deadline:
                now, steps = self._step(key, now, seq, at + self.deadline, ("failed", None, LOST))
                out += steps
            seq, at = int(new_seq), int(new_at)
            now, steps = self._step(key, now, seq, at, (kind, None if pd.isna(value) else value, message if isinstance(message, str) else None))
            out += steps
        if seq >= 0:
            self._put(seq, at, now, timerValues, known is None)
        if out:
            yield pd.DataFrame(out, columns=STEPS)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        out, known = [], self.job.get()
        if known is not None:
            seq, at, *rest = known
            if rest[0] == "running":
                lost = at + self.deadline
                now, out = self._step(key, tuple(rest), seq, lost, ("failed", None, LOST))
                self._put(seq, lost, now, timerValues)
            else:
                self.job.clear()
        if out:
            yield pd.DataFrame(out, columns=STEPS)


class Admission(_Timed):
    """A row of TURN for each submitted job: admitted or rejected by the queue's length, and expired if nothing starts it in time."""

    def __init__(self, limit: int = 20, patience: int = 3600):
        self.limit, self.patience = limit, patience * 10**6

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "job_id long", "at long")

    def _left(self, until: int, waiting: dict, key: tuple) -> list:
        gone = sorted((at, j) for j, at in waiting.items() if at + self.patience < until)
        for _, j in gone:
            del waiting[j]
        return [(key[0], j, at + self.patience, "expired") for at, j in gone]

    def _read(self) -> dict:
        return {k[0]: v[0] for k, v in self.waiting.iterator()} if self.waiting.exists() else {}

    def _put(self, waiting: dict, before: dict, timers: TimerValues) -> None:
        for j in before.keys() - waiting.keys():
            self.waiting.removeKey((j,))
        for j, at in waiting.items():
            if before.get(j) != at:
                self.waiting.updateValue((j,), (at,))
        self.wake_at(min(waiting.values()) + self.patience if waiting else None, timers)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = self._read()
        waiting, out = dict(before), []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples(index=False):
            out += self._left(int(r.at), waiting, key)
            job = int(r.job_id)
            if r.type == "submitted" and job not in waiting:
                fits = len(waiting) < self.limit
                out.append((key[0], job, int(r.at), "admitted" if fits else "rejected"))
                if fits:
                    waiting[job] = int(r.at)
            elif r.type == "started":
                waiting.pop(job, None)
        self._put(waiting, before, timerValues)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TURN.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = self._read()
        waiting = dict(before)
        out = self._left(timerValues.getCurrentWatermarkInMs() * 1000, waiting, key)
        self._put(waiting, before, timerValues)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TURN.split(", ")])


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same context whose streams keep state in RocksDB, which timers need."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def job_steps(events: DataFrame, late: str = "10 minutes", **rules: int) -> DataFrame:
    """Steps of the jobs in a stream of events(project_id, seq, ts, type, value, message); rows without project, seq or ts are left out."""
    e = events.where("isnotnull(project_id) AND isnotnull(seq) AND isnotnull(ts)").withWatermark("ts", late).select("project_id", "seq", "ts", F.unix_micros("ts").alias("at"), "type", F.col("value").cast("double").alias("value"), "message")
    steps = e.groupBy("project_id").transformWithStateInPandas(JobMachine(**rules), STEP, "append", "eventTime")
    return steps.withColumn("at", F.timestamp_micros("at"))


def admissions(events: DataFrame, late: str = "10 minutes", **rules: int) -> DataFrame:
    """Turns of the jobs in a stream of events(queue, job_id, seq, ts, type); rows without queue, job_id or ts are left out."""
    e = events.where("isnotnull(queue) AND isnotnull(job_id) AND isnotnull(ts)").withWatermark("ts", late).select("queue", "job_id", "seq", "ts", F.unix_micros("ts").alias("at"), "type")
    turns = e.groupBy("queue").transformWithStateInPandas(Admission(**rules), TURN, "append", "eventTime")
    return turns.withColumn("at", F.timestamp_micros("at"))


def written(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over all that is there into Parquet files; a restart goes on from the checkpoint without repeating rows."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
