"""Job and queue state over several runs of a stream, against plain folds."""

import datetime as dt

import pytest

from brindle.streaming import machine

T0 = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
SHAPE = "project_id long, seq long, ts timestamp, type string, value double, message string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


class Stream:
    """A stream of files in one folder; every run sees the files that came since the last one."""

    def __init__(self, spark, folder, shape, build):
        self.spark, self.folder, self.shape, self.build, self.n = machine.stateful_session(spark), folder, shape, build, 0

    def run(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.shape).coalesce(1).write.parquet(f"{self.folder}/in/{self.n}")
        source = self.spark.readStream.schema(self.shape).parquet(f"{self.folder}/in/*")
        q = machine.written(self.build(source), f"{self.folder}/out", f"{self.folder}/ck")
        assert q.awaitTermination(120)
        return [tuple(r) for r in self.spark.read.parquet(f"{self.folder}/out").collect()]


@pytest.fixture
def jobs(spark, tmp_path):
    return Stream(spark, str(tmp_path), SHAPE, lambda e: machine.job_steps(e, "10 seconds", deadline=90, keep=200, max_retries=1).selectExpr("project_id", "seq", "unix_seconds(at) - unix_seconds(timestamp '2024-05-01 00:00:00Z')", "status", "attempts", "progress", "error"))


def test_steps_over_restarts(jobs):
    first = jobs.run([
        (1, 1, at(0), "submitted", None, None), (1, 2, at(1), "started", None, None), (1, 3, at(5), "progress", 140.0, None),
        (2, 1, at(0), "submitted", None, None), (2, 2, at(2), "started", None, None), (2, 3, at(3), "failed", None, "broken"), (2, 3, at(3), "failed", None, "broken"),
        (3, 1, at(0), "succeeded", None, None), (None, 4, at(0), "submitted", None, None), (4, 1, at(0), "submitted", None, None), (4, 2, at(1), "started", None, None),
    ])
    assert sorted(first, key=repr) == sorted([
        (1, 1, 0, "waiting", 0, 0, None), (1, 2, 1, "running", 0, 0, None), (1, 3, 5, "running", 0, 100, None),
        (2, 1, 0, "waiting", 0, 0, None), (2, 2, 2, "running", 0, 0, None), (2, 3, 3, "waiting", 1, 0, "broken"), (4, 1, 0, "waiting", 0, 0, None), (4, 2, 1, "running", 0, 0, None),
    ], key=repr)
    # state is there after a restart: a repeated seq is ignored, the retry is used up, and time passes for the others
    second = jobs.run([(2, 2, at(50), "succeeded", None, None), (2, 4, at(60), "started", None, None), (2, 5, at(61), "failed", None, "again"), (2, 6, at(62), "progress", 5.0, None), (4, 3, at(70), "succeeded", None, None)])
    new = [r for r in second if r not in first]
    assert sorted(new) == [(2, 4, 60, "running", 1, 0, None), (2, 5, 61, "failed", 1, 0, "again"), (4, 3, 70, "ready", 0, 100, None)]
    # the watermark passes the deadline of job 1, which has nothing to say
    third = jobs.run([(9, 1, at(120), "submitted", None, None)])
    assert [r for r in third if r not in second and r[0] == 1] == [(1, 3, 95, "waiting", 1, 0, machine.LOST)]
    # events before the watermark are dropped; a job that ended can be submitted again, also after its state is gone
    fourth = jobs.run([(9, 2, at(20), "started", None, None), (4, 4, at(500), "submitted", None, None)])
    assert [r for r in fourth if r not in third] == [(4, 4, 500, "waiting", 0, 0, None)]


def test_lost_between_events(jobs):
    rows = jobs.run([(1, 1, at(0), "submitted", None, None), (1, 2, at(1), "started", None, None), (1, 3, at(91), "progress", 7.0, None), (1, 4, at(182), "progress", 9.0, None)])
    assert sorted(rows)[2:] == [(1, 3, 91, "running", 0, 7, None), (1, 3, 181, "waiting", 1, 0, machine.LOST)]


def test_queue_is_bounded(spark, tmp_path):
    shape = "queue string, job_id long, seq long, ts timestamp, type string"
    s = Stream(spark, str(tmp_path), shape, lambda e: machine.admissions(e, "10 seconds", limit=2, patience=100).selectExpr("queue", "job_id", "unix_seconds(at) - unix_seconds(timestamp '2024-05-01 00:00:00Z')", "outcome"))
    first = s.run([("q", 1, 1, at(0), "submitted"), ("q", 2, 2, at(1), "submitted"), ("q", 3, 3, at(2), "submitted"), ("q", 1, 4, at(3), "started"), ("q", 4, 5, at(4), "submitted"), ("r", 5, 6, at(4), "submitted")])
    assert sorted(first) == [("q", 1, 0, "admitted"), ("q", 2, 1, "admitted"), ("q", 3, 2, "rejected"), ("q", 4, 4, "admitted"), ("r", 5, 4, "admitted")]
    second = s.run([("q", 6, 7, at(50), "submitted"), ("r", 5, 8, at(60), "started"), ("r", 7, 9, at(300), "submitted")])
    assert sorted(r for r in second if r not in first) == [("q", 2, 101, "expired"), ("q", 4, 104, "expired"), ("q", 6, 50, "rejected"), ("r", 7, 300, "admitted")]


def test_no_events(jobs):
    assert jobs.run([]) == []


def test_new_job_takes_three_calls():
    """Calls of the state store cost more than all else for a job; one without a change gives no table."""
    import pandas as pd

    calls = []

    class Noted:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (Noted() if name == "getValueState" else None)

        getCurrentWatermarkInMs = staticmethod(lambda: 0)  # noqa: N815

    job = machine.JobMachine()
    job.init(Noted())
    calls.clear()
    rows = lambda *kinds: iter([pd.DataFrame({"seq": [i], "at": [i], "type": [k], "value": [None], "message": [None]}) for i, k in enumerate(kinds)])
    steps = pd.concat(job.handleInputRows((7,), rows("submitted", "started", "other"), Noted()))
    assert calls == ["get", "update", "registerTimer"] and steps.status.tolist() == ["waiting", "running"]
    assert not list(job.handleInputRows((8,), rows("other"), Noted()))
