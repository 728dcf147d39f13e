import json
import os
import random
import time
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewell.operators import detectors
from tidewell.plans.rubric import Detector
from tidewell.streaming import stateful

NOON = datetime(2024, 3, 1, 12, tzinfo=UTC)
DAY = timedelta(days=1)
START = time.time() - 3_600


@pytest.fixture(params=[False, True], ids=["memory", "rocksdb"])
def store(spark, request):
    """Both kinds of state stores."""
    old = {k: spark.conf.get(k, None) for k in stateful.ROCKSDB}
    if request.param:
        for k, v in stateful.ROCKSDB.items():
            spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Feed:
    """A folder of files, each written once and read as a stream."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        folder.mkdir()

    def put(self, rows):
        self.n += 1
        draft = self.folder.parent / f"draft-{self.n}"
        draft.write_text("".join(json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in r.items()}) + "\n" for r in rows), encoding="utf-8")
        os.utime(draft, (START + self.n, START + self.n))  # files are read in order of time
        draft.rename(self.folder / f"{self.n:06d}.json")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder))


def state_rows(query):
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress]


def test_a_key_counts_once_through_restarts_and_is_forgotten_after_a_year(spark, tmp_path, store):
    feed = Feed(spark, tmp_path / "in", "event_key string, received_at timestamp, n int")
    told = []

    def run():
        out = stateful.once_by_key(feed.stream(), timedelta(days=365)).writeStream.option("checkpointLocation", str(tmp_path / "cursor"))
        q = out.foreachBatch(lambda df, _: told.extend((r["event_key"], r["n"]) for r in df.collect())).trigger(availableNow=True).start()
        return stateful.finish(q, 120)

    row = lambda key, days, n: {"event_key": key, "received_at": NOON + days * DAY, "n": n}
    feed.put([row("a", 0, 1), row("b", 0, 2), row("a", 0, 1)])
    feed.put([row("a", 1, 3), row("c", 1, 4), row(None, 1, 5), row(None, 1, 5)])
    run()
    feed.put([row("b", 180, 6), row("c", 180, 7)])
    run()
    assert sorted(told, key=repr) == [("a", 1), ("b", 2), ("c", 4), (None, 5)]
    feed.put([row("x", 370, 8)])  # a, b and c go with the batch after
    run()
    feed.put([row("a", 371, 9), row("x", 371, 10)])
    q = run()
    assert sorted(told[4:], key=repr) == [("a", 9), ("x", 8)]
    assert state_rows(q)[-1] == 2


def test_state_does_not_grow_with_the_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "event_key string, received_at timestamp")
    for k in range(12):
        feed.put([{"event_key": f"{k}-{i}", "received_at": NOON + k * 100 * DAY} for i in range(50)])
    out = stateful.once_by_key(feed.stream(), timedelta(days=365)).writeStream.option("checkpointLocation", str(tmp_path / "c"))
    rows = state_rows(stateful.finish(out.foreachBatch(lambda df, _: df.count()).trigger(availableNow=True).start(), 180))
    assert max(rows) <= 5 * 50 and rows[-1] <= 5 * 50


def test_rows_that_come_too_late_are_an_error(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "event_key string, received_at timestamp")
    for key, days in (("a", 0), ("b", 400), ("d", 401), ("c", 0)):
        feed.put([{"event_key": key, "received_at": NOON + days * DAY}])
    out = stateful.once_by_key(feed.stream(), timedelta(days=365)).writeStream.option("checkpointLocation", str(tmp_path / "c"))
    with pytest.raises(stateful.LateRows, match="1 rows"):
        stateful.finish(out.foreachBatch(lambda df, _: df.count()).trigger(availableNow=True).start(), 120)


SPECS = [Detector("two", "count_in_window", event="visit_*", window=timedelta(days=7), min=2), Detector("one", "count_in_window", event="sent", window=timedelta(hours=30), min=1), Detector("five", "count_in_window", event="*", window=timedelta(days=3), min=5)]


def at_clock(spark, events, clock):
    """What the batch detectors say at a clock."""
    df = spark.createDataFrame(events, "lead_id string, kind string, at timestamp")
    row = detectors.window_counts(df, "lead_id", SPECS, clock).collect()
    return {(r["lead_id"], s.name) for r in row for s in SPECS if r[f"d_{s.name}"]}


def play(events, spec, clock):
    """By counting at each moment at which something can change."""
    us = lambda t: round(t.timestamp() * 1e6)
    times = sorted(us(t) for _, kind, t in events if kind and (kind.lower().startswith(spec.event[:-1]) if spec.event.endswith("*") else kind.lower() == spec.event))
    window = int(spec.window / timedelta(microseconds=1))
    on, told = False, []
    for t in sorted({x for t in times for x in (t, t + window)}):
        now = sum(t - window < x <= t for x in times) >= spec.min
        if t <= us(clock) and now != on:
            told.append((now, t))
            on = now
    return told


def test_steps_equal_counting_at_each_moment():
    r = random.Random(2)
    for n in range(300):
        spec = Detector("d", "count_in_window", event="*", window=timedelta(microseconds=r.choice([3, 10, 25])), min=r.choice([1, 2, 3, 6]))
        events = [("s", "k", datetime.fromtimestamp(0, UTC) + timedelta(microseconds=r.randrange(100))) for _ in range(r.randrange(30))]
        times = [round(t.timestamp() * 1e6) for *_, t in events]
        clocks, told, state = sorted(r.randrange(140) for _ in range(4)), [], (np.zeros(0, np.int64), [], False)
        for clock, before in zip(clocks, [-1, *clocks], strict=False):
            fresh = [t for t in times if before < t <= clock]
            *state, new = stateful._steps(np.concatenate([state[0], np.array(fresh, np.int64)]), state[1], state[2], int(spec.window / timedelta(microseconds=1)), spec.min, clock)
            told += new
        assert told == play(events, spec, datetime.fromtimestamp(0, UTC) + timedelta(microseconds=clocks[-1])), n


def test_windows_on_a_stream_equal_the_batch_at_each_clock(spark, tmp_path, store):
    r = random.Random(4)
    feed = Feed(spark, tmp_path / "in", "lead_id string, kind string, at timestamp")
    events, path = [], str(tmp_path / "out")
    for day in range(0, 24, 6):  # restarts between, events out of order within a day
        some = [(r.choice(["ada", "bo", "cy", None, ""]), r.choice(["visit_home", "Visit_Pricing", "sent", "other", None]), NOON + day * DAY + timedelta(seconds=r.randrange(6 * 86_400))) for _ in range(60)]
        some += [("hot", "visit_home", NOON + day * DAY + timedelta(hours=k)) for k in range(60)]
        events += some
        feed.put([dict(zip(("lead_id", "kind", "at"), e, strict=True)) for e in some])
        stateful.to_table(stateful.window_changes(feed.stream(), "lead_id", SPECS), path, str(tmp_path / "cursor"))
    told = stateful.read_table(spark, path, stateful.CHANGES).cache()
    top = max(t for *_, t in events) - DAY
    named = [e for e in events if e[0]]
    for clock in [NOON + k * timedelta(hours=47, minutes=13) for k in range(1, 11)]:
        assert clock <= top
        assert {(x["subject"], x["detector"]) for x in stateful.held_at(told, clock).collect()} == at_clock(spark, named, clock)
    got = {}
    for x in told.orderBy("subject", "detector", "at").select("subject", "detector", "on", F.unix_micros("at")).collect():
        got.setdefault((x[0], x[1]), []).append((x[2], x[3]))
    assert got == {(s, d.name): w for s in ("ada", "bo", "cy", "hot") for d in SPECS if (w := play([e for e in named if e[0] == s], d, top))}


def test_boundaries_of_a_window_and_state_that_goes(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "lead_id string, kind string, at timestamp")
    spec = [Detector("seen", "count_in_window", event="visit", window=timedelta(days=7), min=1)]
    put = lambda who, t: feed.put([{"lead_id": who, "kind": "visit", "at": t}])
    put("old", NOON - 7 * DAY)
    put("young", NOON - 7 * DAY + timedelta(seconds=1))
    put("now", NOON)
    put("clock", NOON + 40 * DAY)
    put("clock", NOON + 80 * DAY)
    out = stateful.window_changes(feed.stream(), "lead_id", spec).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    q = stateful.finish(out.trigger(availableNow=True).start(), 180)
    told = stateful.read_table(spark, str(tmp_path / "out"), stateful.CHANGES)
    held = lambda t: {x["subject"] for x in stateful.held_at(told, t).collect()}
    assert held(NOON) == {"young", "now"} and held(NOON - timedelta(microseconds=1)) == {"old", "young"}
    assert held(NOON + 7 * DAY - timedelta(microseconds=1)) == {"now"} and held(NOON + 7 * DAY) == set()
    assert state_rows(q)[-1] == 1  # the clock's own last visit
    assert told.where("NOT on AND subject = 'now'").count() == 1  # no event of its own told it


def test_silence_is_told_once_and_cleared_by_the_next_event(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "kind string, received_at timestamp")
    told = []

    def start():
        out = stateful.silence(feed.stream(), timedelta(seconds=6)).writeStream.option("checkpointLocation", str(tmp_path / "c"))
        return out.foreachBatch(lambda df, _: told.extend((r["kind"], r["silent"]) for r in df.collect())).trigger(processingTime="500 milliseconds").start()

    def until(n, seconds=60):
        end = time.time() + seconds
        while len(told) < n and time.time() < end:
            time.sleep(0.3)

    feed.put([{"kind": "Sent", "received_at": NOON}, {"kind": "sent", "received_at": NOON - DAY}])
    q = start()
    until(1)
    assert told == [("sent", True)]
    time.sleep(8)
    assert told == [("sent", True)]  # once
    q.stop()
    q = start()  # state is in the checkpoint
    feed.put([{"kind": "sent", "received_at": NOON + DAY}])
    until(2)
    assert told == [("sent", True), ("sent", False)]
    until(3)
    assert told == [("sent", True), ("sent", False), ("sent", True)]
    q.stop()
