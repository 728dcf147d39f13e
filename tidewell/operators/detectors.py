"""Signals over trailing event windows: one aggregation a subject kind."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.text import norm_text
from tidewell.plans.rubric import Detector

BUILT_IN = ("count_in_window", "first_seen", "change")
#: Registered kinds: name -> factory(params) of an aggregate column over a subject's events, given the clock.
_CUSTOM: dict[str, Callable[[dict, datetime], Column]] = {}


def register_detector(kind: str, factory: Callable[[dict, datetime], Column]) -> None:
    """Add a kind of detector: a boolean aggregate over the events of a subject."""
    if not kind or factory is None or kind in BUILT_IN or kind in _CUSTOM or kind in _SUBJECT:
        raise ValueError(f"detector kind {kind!r} is empty, taken, or has no factory")
    _CUSTOM[kind] = factory


class SubjectDetector:
    """A detector that reads all events of a subject in order of time; subclass it and register the subclass.

    One object judges one subject: ``step`` is given its events in runs, kinds in lower case beside times in microseconds, and keeps what it needs;
    ``fires`` is asked at the end. Equal times come in order of kind. Only small state belongs in it: a subject may have any number of events.
    """

    def __init__(self, params: dict, now: datetime):
        self.params, self.now = params, now

    def step(self, kinds: list[str], times: np.ndarray) -> None:
        raise NotImplementedError

    def fires(self) -> bool:
        raise NotImplementedError


_SUBJECT: dict[str, type[SubjectDetector]] = {}


def register_subject_detector(kind: str, detector: type[SubjectDetector]) -> None:
    """Add a kind of detector that is code over the ordered events of a subject."""
    if not kind or kind in BUILT_IN or kind in _CUSTOM or kind in _SUBJECT or not (isinstance(detector, type) and issubclass(detector, SubjectDetector)):
        raise ValueError(f"detector kind {kind!r} is empty, taken, or no SubjectDetector")
    _SUBJECT[kind] = detector


def subject_verdicts(events: DataFrame, entity: str, specs: Iterable[Detector], now: datetime) -> DataFrame:
    """``entity, d_<name>``: what registered subject detectors say, one row a subject that has events.

    Events are dealt by subject and sorted within tasks, and stream through them in batches, so a subject that has a third of all events is
    read run by run and never held; only its order needs one task. Events without a subject, kind or time are left out.
    """
    made = {s.name: (_SUBJECT[s.kind], s.params) for s in specs}
    kind = dict(events.dtypes)[entity]
    rows = events.select(F.col(entity).alias("subject"), F.lower("kind").alias("kind"), F.unix_micros(F.col("at").cast("timestamp")).alias("t")).where("subject IS NOT NULL AND kind IS NOT NULL AND t IS NOT NULL")
    rows = rows.where("subject != ''") if kind == "string" else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subject, judges = None, {}

        def verdict() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{entity: subject} | {f"d_{n}": bool(j.fires()) for n, j in judges.items()}], schema=pa.schema([(entity, batch_type), *((f"d_{n}", pa.bool_()) for n in made)]))

        batch_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch_type = batch.column(0).type
            names, kinds, times = batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.asarray(batch.column(2))
            lo = 0
            while lo < len(names):
                hi = lo
                while hi < len(names) and names[hi] == names[lo]:
                    hi += 1
                if names[lo] != subject:
                    if judges:
                        yield verdict()
                    subject, judges = names[lo], {n: d(params, now) for n, (d, params) in made.items()}
                for j in judges.values():
                    j.step(kinds[lo:hi], times[lo:hi])
                lo = hi
        if judges:
            yield verdict()

    return rows.repartition("subject").sortWithinPartitions("subject", "t", "kind").mapInArrow(run, ", ".join([f"`{entity}` {kind}", *(f"d_{n} boolean" for n in made)]))


def kind_matches(pattern: str, kind: Column) -> Column:
    """Equal, or starting with what stands before a last ``*``; case does not matter."""
    p, k = pattern.lower(), F.lower(kind)
    return F.startswith(k, F.lit(p[:-1])) if p.endswith("*") else k == p


def in_window(at: Column, window, now: datetime) -> Column:
    """In (now - window, now]."""
    return (at > F.lit(now - window)) & (at <= F.lit(now))


def window_counts(events: DataFrame, entity: str, specs: Iterable[Detector], now: datetime) -> DataFrame:
    """``entity`` and a boolean ``d_<name>`` for each count_in_window or registered detector.

    ``events`` has kind and at besides the entity. Only events younger than the longest window are read, a filter that reaches
    the scan; each detector is one conditional count of the same aggregation, so a hot entity
    is combined before the shuffle. Entities without such an event have no row; null entities are left out.
    """
    specs = list(specs)
    builtin = [s for s in specs if s.kind == "count_in_window"]
    seen = events.where(F.col(entity).isNotNull() & (F.col(entity) != "") if dict(events.dtypes)[entity] == "string" else F.col(entity).isNotNull())
    if builtin and len(builtin) == len(specs):
        seen = seen.where((F.col("at") > F.lit(now - max(s.window for s in builtin))) & (F.col("at") <= F.lit(now)))
    aggs = [(F.count_if(kind_matches(s.event, F.col("kind")) & in_window(F.col("at"), s.window, now)) >= s.min).alias(f"d_{s.name}") for s in builtin]
    for s in specs:
        if s.kind not in BUILT_IN:
            if s.kind not in _CUSTOM:
                raise ValueError(f'detector {s.name} has kind "{s.kind}", which is not registered')
            aggs.append(F.coalesce(_CUSTOM[s.kind](s.params, now), F.lit(False)).alias(f"d_{s.name}"))
    return seen.groupBy(entity).agg(*aggs)


def first_seen(events: DataFrame, entity: str) -> DataFrame:
    """The earliest time of each (entity, kind): what is kept of events for good."""
    return events.where(F.col(entity).isNotNull()).groupBy(entity, "kind").agg(F.min("at").alias("at"))


def first_seen_within(seen: DataFrame, entity: str, specs: Iterable[Detector], now: datetime) -> DataFrame:
    """``entity, d_<name>``: whether the first event ever of a kind lies within the window.

    ``seen`` is ``first_seen``'s frame (entity, kind, at), which outlives the events themselves.
    """
    specs = list(specs)
    first = {s.name: F.min(F.when(kind_matches(s.event, F.col("kind")), F.col("at"))) for s in specs}
    return seen.groupBy(entity).agg(*(F.coalesce(in_window(first[s.name], s.window, now), F.lit(False)).alias(f"d_{s.name}") for s in specs))


def fact_changes(facts: DataFrame, specs: Iterable[Detector], now: datetime, unicode: bool = True) -> DataFrame:
    """``domain, d_<name>``: whether a fact replaced a different one within the window.

    ``facts`` has domain, fact, value, at, previous (null if there was none). A first value is no change.
    """
    specs = list(specs)

    def fires(s: Detector) -> Column:
        new, old = norm_text(F.col("value"), unicode), norm_text(F.col("previous"), unicode)
        c = (F.col("fact") == s.fact) & (F.col("value") != "") & in_window(F.col("at"), s.window, now) & (new != old)
        if s.before is not None:
            c = c & (old == norm_text(F.lit(s.before), unicode))
        if s.after is not None:
            c = c & (new == norm_text(F.lit(s.after), unicode))
        return F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False)).alias(f"d_{s.name}")

    return facts.groupBy("domain").agg(*map(fires, specs))


def evaluate_detectors(specs: Iterable[Detector], events: DataFrame, seen: DataFrame, facts: DataFrame, entity: str, now: datetime, unicode: bool = True) -> DataFrame | None:
    """All detectors of one subject kind as one frame keyed by ``entity``; None if there are none."""
    specs = list(specs)
    parts = []
    if ordered := [s for s in specs if s.kind in _SUBJECT]:
        parts.append(subject_verdicts(events, entity, ordered, now))
    if counted := [s for s in specs if s.kind not in ("first_seen", "change") and s.kind not in _SUBJECT]:
        parts.append(window_counts(events, entity, counted, now))
    if firsts := [s for s in specs if s.kind == "first_seen"]:
        parts.append(first_seen_within(seen, entity, firsts, now))
    if changes := [s for s in specs if s.kind == "change"]:
        if entity != "domain":
            raise ValueError("change detectors watch companies")
        parts.append(fact_changes(facts, changes, now, unicode))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, entity, "full_outer")
    return out.select(entity, *(F.coalesce(f"d_{s.name}", F.lit(False)).alias(f"d_{s.name}") for s in specs))
