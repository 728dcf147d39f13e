"""Keyed streaming state: keys known for a time, trailing windows that events leave, kinds that fall silent.

Each needs a checkpoint and nothing else: state is a part of it, survives a restart, and is given up once time has passed it, so that it
grows with what is recent and not with the stream. Set ``ROCKSDB`` on the session to hold it off the heap.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.detectors import kind_matches
from tidewell.plans.rubric import Detector

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class LateRows(RuntimeError):
    """Rows came too late for the state that would have judged them, and Spark left them out."""


def _delay(length: timedelta) -> str:
    return f"{int(length.total_seconds() * 1000)} milliseconds"


def late_rows(query: StreamingQuery) -> int:
    """How many rows the query's recent batches left out as late."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def finish(query: StreamingQuery, timeout: int | None = None) -> StreamingQuery:
    """Wait for a query that takes what is there; raises ``LateRows`` rather than lose rows silently."""
    query.awaitTermination(timeout) if timeout else query.awaitTermination()
    if query.exception():
        raise query.exception()
    if late := late_rows(query):
        raise LateRows(f"{late} rows were older than the watermark")
    return query


# --- once by key ----------------------------------------------------------------------


def once_by_key(events: DataFrame, keep: timedelta, key: Sequence[str] = ("event_key",), arrived: str = "received_at") -> DataFrame:
    """The first row of each key in a stream; a key is known for ``keep`` after its arrival, by the newest arrival that was read, and then forgotten.

    Spark keeps a key until the watermark passes its time and the delay once more, and lets it go with the batch after, so the delay is half of ``keep``, which is also how far
    behind the newest an arrival may be (see ``finish``). A key is a row of state, whatever the number of its deliveries.
    """
    return events.withWatermark(arrived, _delay(keep / 2)).dropDuplicatesWithinWatermark(list(key))


# --- trailing windows ---------------------------------------------------------------------

CHANGES = "subject string, detector string, on boolean, at timestamp"
_STATE = "waiting binary, newest binary, on boolean"


def _steps(waiting: np.ndarray, newest: list[int], on: bool, window: int, least: int, clock: int) -> tuple[np.ndarray, list[int], bool, list[tuple[bool, int]]]:
    """Play events up to ``clock`` (microseconds) in order; returns the rest, the ``least`` newest times, whether it holds, and when that changed.

    At a clock t the events in (t - window, t] count, so the verdict holds from the event that makes them ``least`` until the oldest of the
    newest ``least`` leaves: these alone decide, however many there are.
    """
    waiting = np.sort(waiting)
    due, told = waiting[waiting <= clock].tolist(), []
    for t in due:
        if on and newest[0] + window < t:
            told.append((False, newest[0] + window))
            on = False
        newest = [*newest, t][-least:]
        if not on and len(newest) == least and newest[0] > t - window:
            told.append((True, t))
            on = True
    if on and newest[0] + window <= clock:
        told.append((False, newest[0] + window))
        on = False
    return waiting[len(due) :], [t for t in newest if t + window > clock] if not on else newest, on, told


def _window_step(specs: dict[str, tuple[int, int]]):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        subject, detector = key
        window, least = specs[detector]
        waiting, newest, on = state.get if state.exists else (b"", b"", False)
        times = [np.frombuffer(waiting, np.int64)]
        if not state.hasTimedOut:
            times += [f["at_us"].to_numpy(np.int64) for f in frames]
        clock = state.getCurrentWatermarkMs() * 1_000
        rest, kept, on, told = _steps(np.concatenate(times), np.frombuffer(newest, np.int64).tolist(), bool(on), window, least, clock)
        wakes = [int(rest[0])] if len(rest) else []
        if kept:
            wakes.append((kept[0] if on else kept[-1]) + window)
        if wakes:
            state.update((rest.astype(np.int64).tobytes(), np.array(kept, np.int64).tobytes(), on))
            state.setTimeoutTimestamp(max(-(-min(wakes) // 1_000), clock // 1_000 + 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame({"subject": subject, "detector": detector, "on": [o for o, _ in told], "at": pd.to_datetime([t for _, t in told], unit="us", utc=True)})

    return run


def window_changes(events: DataFrame, subject: str, detectors: Iterable[Detector], late: timedelta = timedelta(days=1)) -> DataFrame:
    """When ``count_in_window`` detectors begin and cease to hold, as a stream: ``subject, detector, on, at``.

    ``events`` is a stream with the subject, kind and at. An event waits until the watermark, ``late`` behind the newest, has passed
    it, so that what is told is final and in order: the last change at or before a clock says what a batch over all events says at this clock,
    for every clock up to the watermark. Subjects without a change since are never looked at again, and a verdict that ceases
    does so by a timer, without an event. State of a subject and detector is what waits and as many times as the detector asks for; it goes when the
    last of these leaves the window. Rows without a subject or time are left out, as are kinds that no detector watches.
    """
    specs = [d for d in detectors if d.kind == "count_in_window"]
    if not specs:
        raise ValueError("no detector counts events in a window")
    lengths = {d.name: (int(d.window / timedelta(microseconds=1)), d.min) for d in specs}
    hits = F.array_compact(F.array(*(F.when(kind_matches(d.event, F.col("kind")), F.lit(d.name)) for d in specs)))
    named = F.nullif(F.col(subject).cast("string"), F.lit(""))
    seen = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", _delay(late))
    rows = seen.select(named.alias("subject"), F.explode(hits).alias("detector"), "at", F.unix_micros("at").alias("at_us")).where("subject IS NOT NULL AND at IS NOT NULL")
    return rows.groupBy("subject", "detector").applyInPandasWithState(_window_step(lengths), CHANGES, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def held_at(changes: DataFrame, clock) -> DataFrame:
    """``subject, detector`` of the verdicts that hold at a clock, from the changes told so far."""
    last = changes.where(F.col("at") <= F.lit(clock)).groupBy("subject", "detector").agg(F.max_by("on", F.struct("at", "on")).alias("on"))
    return last.where("on").select("subject", "detector")


# --- silence ------------------------------------------------------------------------------

SILENCE = "kind string, silent boolean, last_received timestamp"


def _silence_step(quiet_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, silent = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            state.update((last, True))  # told once; no further timer
            told = True
        else:
            last = max([last, *(int(f["at_us"].max()) for f in frames if len(f))])
            state.update((last, False))
            state.setTimeoutDuration(quiet_ms)
            told = silent
        if told:
            now_silent = state.hasTimedOut
            yield pd.DataFrame({"kind": [key[0]], "silent": [now_silent], "last_received": pd.to_datetime([last], unit="us", utc=True)})

    return run


def silence(events: DataFrame, quiet: timedelta = timedelta(days=3)) -> DataFrame:
    """Kinds from which nothing came for ``quiet``, by the wall clock, as a stream: ``kind, silent, last_received``.

    A kind is told once when it falls silent, by a timer that needs no event, and once when it is heard again. ``events`` is a stream with kind
    and received_at; of a kind, the newest time is state, so a kind with a third of all events is one row of it.
    """
    rows = events.where("kind IS NOT NULL AND received_at IS NOT NULL").select(F.lower("kind").alias("kind"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("at_us"))
    return rows.groupBy("kind").applyInPandasWithState(_silence_step(int(quiet / timedelta(milliseconds=1))), SILENCE, "last long, silent boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


# --- tables of what a stream tells -------------------------------------------------------------


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take what is there and append it to a table of files, each batch once."""
    return finish(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
