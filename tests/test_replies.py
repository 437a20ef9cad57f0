from __future__ import annotations

import random
import time

import pytest

from chargeframe.functions import jsontext
from chargeframe.streaming import replies as R

SESSION_DDL = "sessionID string, parsed_minutesAvailable double, parsed_kWhRequested double, revisionCount int"
REPLY_DDL = "sessionID string, content string, attempt int"
FIELDS = ["sessionID", "used_rules", *jsontext.REPLY_FIELDS]
LONG = 3_600_000


def reply(urgency, impact=', "grid_impact_proxy": "low"'):
    return f'[{{"urgency_score": {urgency}, "flexibility_index": 0.5, "habit_stability": 0.4{impact}}}]'


SESSIONS = [(f"s{i}", 30.0 * (i % 9), 4.0 * (i % 11), i % 5) for i in range(24)] + [(None, 60.0, 20.0, 1)]
REPLIES = [(f"s{i}", reply(i), 1) for i in range(0, 24, 2)]
REPLIES += [(f"s{i}", "no answer", 2) for i in range(0, 24, 4)] + [(f"s{i}", reply(50 + i), 3) for i in range(0, 24, 6)]
REPLIES += [(f"s{i}", reply(70 + i, ""), 4) for i in (0, 1, 2, 3)] + [("unknown", reply(5), 1), (None, reply(6), 1), ("s5", None, 1)]


class Landing:
    """Folders that files land in, and the job that reads them."""

    def __init__(self, spark, root, patience_ms, per_batch=None):
        self.spark, self.patience, self.per_batch = spark, patience_ms, per_batch
        self.sessions, self.replies, self.ticks, self.out, self.progress = (str(root / n) for n in ("s", "r", "t", "out", "progress"))
        for path, ddl in ((self.sessions, SESSION_DDL), (self.replies, REPLY_DDL), (self.ticks, "tick int")):
            spark.createDataFrame([], ddl).write.parquet(path)

    def land(self, sessions=(), replies=(), tick=False):
        for rows, path, ddl in ((sessions, self.sessions, SESSION_DDL), (replies, self.replies, REPLY_DDL), ([(1,)] if tick else (), self.ticks, "tick int")):
            if rows:
                self.spark.createDataFrame(list(rows), ddl).coalesce(1).write.mode("append").parquet(path)

    def run(self):
        def stream(path, ddl):
            reader = self.spark.readStream.schema(ddl).format("parquet")
            return (reader.option("maxFilesPerTrigger", self.per_batch) if self.per_batch else reader).load(path)

        R.stream_augment_replies(stream(self.sessions, SESSION_DDL), stream(self.replies, REPLY_DDL), self.out, self.progress,
                                 self.patience, ticks=stream(self.ticks, "tick int"))

    def versions(self):
        return self.spark.read.parquet(self.out)

    def result(self):
        return rows(R.augmented(self.spark.read.parquet(self.sessions), self.versions()))


def rows(df):
    return sorted(map(tuple, df.select(*FIELDS).collect()), key=str)


@pytest.fixture(scope="module")
def want(spark):
    texts = jsontext.extract_json_reply(spark.createDataFrame(REPLIES, REPLY_DDL))
    return rows(jsontext.merge_augmented(spark.createDataFrame(SESSIONS, SESSION_DDL), texts, order="attempt"))


@pytest.mark.parametrize("patience", [1, LONG])
@pytest.mark.parametrize("first", ["sessions", "replies"])
def test_order_of_arrival_does_not_matter(spark, tmp_path, want, first, patience):
    """Replies before and long after their sessions, with timers that ran out between or have not yet."""
    jobs = Landing(spark, tmp_path, patience)
    steps = [{"sessions": SESSIONS}, {"replies": REPLIES}]
    for step in steps if first == "sessions" else steps[::-1]:
        jobs.land(**step)
        jobs.run()
        time.sleep(0.01)
        jobs.land(tick=True)
        jobs.run()
    assert jobs.result() == want


def test_restarts_at_every_batch_border(spark, tmp_path, want):
    """Shuffled arrivals in six landings: one run over all files, file by file, and a run per landing."""
    mixed = [("sessions", s) for s in SESSIONS] + [("replies", r) for r in REPLIES]
    random.Random(3).shuffle(mixed)
    parts = [mixed[i::6] for i in range(6)]
    steps = [{"sessions": [r for k, r in p if k == "sessions"], "replies": [r for k, r in p if k == "replies"]} for p in parts]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    whole, stepped = Landing(spark, tmp_path / "a", 1, per_batch=1), Landing(spark, tmp_path / "b", 1)
    for step in steps:
        whole.land(**step)
        stepped.land(**step)
        stepped.run()
    whole.run()
    assert whole.result() == want
    assert stepped.result() == want
    before = stepped.versions().count()
    stepped.run()
    assert stepped.versions().count() == before


def test_versions(spark, tmp_path):
    """A waiting session is not given out; the timer gives the rules, a late reply replaces them, a worse one again."""
    jobs = Landing(spark, tmp_path, 1)
    jobs.land(sessions=[("a", 60.0, 20.0, 1), ("b", 60.0, 20.0, 1)], replies=[("b", reply(9), 1)])
    jobs.run()
    assert [tuple(r)[:3] for r in jobs.versions().collect()] == [("b", 1, False)]
    time.sleep(0.01)
    jobs.land(tick=True)
    jobs.run()
    jobs.land(replies=[("a", reply(7), 1)])
    jobs.run()
    jobs.land(replies=[("a", reply(7), 2)])
    jobs.run()
    jobs.land(replies=[("a", reply(8, ""), 3)])
    jobs.run()
    got = sorted(tuple(r)[:4] for r in jobs.versions().collect() if r["sessionID"] == "a")
    assert got == [("a", 1, True, "95"), ("a", 2, False, "7"), ("a", 3, True, "95")]


def test_long_patience_waits(spark, tmp_path):
    jobs = Landing(spark, tmp_path, LONG)
    jobs.land(sessions=SESSIONS)
    jobs.run()
    jobs.land(tick=True)
    jobs.run()
    assert jobs.versions().count() == 0
    assert all(r[1] for r in jobs.result()) and len(jobs.result()) == len(SESSIONS)


def test_sessions_of_a_bucket_are_one_call(spark, tmp_path, want, monkeypatch):
    """Calls go with the buckets, not with the sessions; each session of a bucket keeps its own timer and versions."""
    monkeypatch.setattr(R, "BUCKETS", 2)
    calls = spark.sparkContext.accumulator(0)
    step = R._step

    def counted(patience_ms):
        inner = step(patience_ms)

        def run(group, events, state):
            calls.add(1)
            yield from inner(group, events, state)

        return run

    monkeypatch.setattr(R, "_step", counted)
    jobs = Landing(spark, tmp_path, 1)
    jobs.land(sessions=SESSIONS[:20], replies=REPLIES[::2])
    jobs.run()
    time.sleep(0.01)
    jobs.land(sessions=SESSIONS[20:], replies=REPLIES[1::2])
    jobs.run()
    time.sleep(0.01)
    jobs.land(tick=True)
    jobs.run()
    assert 2 <= calls.value <= 6
    assert jobs.result() == want
    assert jobs.versions().groupBy("sessionID", "version").count().filter("count > 1").isEmpty()
