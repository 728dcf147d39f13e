import csv
import json
from datetime import UTC, datetime, timedelta

import pytest
from tidewell.operators import export
from tidewell.sources.csv_files import SourceError, headers_of, read_rows
from tidewell.sources.event_log import MAX_BODY, EventLog, LogShrank, store_body
from tidewell.sources.registry import Registry
from tidewell.sources.schema import TABLES
from tidewell.sources.store import Store, StoreError
from tidewell.streaming import intake, stateful

NOON = datetime(2024, 3, 1, 12, tzinfo=UTC)


# --- CSV ---------------------------------------------------------------------------


def test_csv_bom_ragged_blank_and_repeated_headers(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text('﻿Email,Full Name,Email,Notes\na@x.example,Ada,other@x.example,"one, two"\nb@x.example\n , ,,\nc@x.example,Cy,,"a\nb",extra\n', encoding="utf-8")
    rows, headers = read_rows(spark, str(path))
    assert headers == ["Email", "Full Name", "Notes"]
    assert [tuple(r) for r in rows.orderBy("Email").collect()] == [("a@x.example", "Ada", "one, two"), ("b@x.example", None, None), ("c@x.example", "Cy", "a\nb")]


def test_csv_without_lines_is_refused(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(SourceError):
        headers_of(spark, str(tmp_path / "none.csv"))


# --- the event log and its stream ---------------------------------------------------


def reply(mail, event="email_replied"):
    return "apollo_reply", json.dumps({"event": event, "contact_email": mail, "contact_stage": "Interested"})


def test_log_reads_after_a_cursor_and_sees_a_shrink(spark, tmp_path):
    log = EventLog(str(tmp_path))
    assert log.read(spark).count() == 0
    assert log.append([reply("a@x.example"), reply("b@x.example")], NOON) == [1, 2]
    assert log.append([reply("c@x.example")], NOON) == [3]
    assert [r["seq"] for r in log.read(spark, 1).orderBy("seq").collect()] == [2, 3]
    with pytest.raises(LogShrank):
        log.read(spark, 4)


def test_log_deletes_what_is_processed_and_old(spark, tmp_path):
    log = EventLog(str(tmp_path))
    log.append([reply("a@x.example")], NOON - timedelta(days=120))
    log.append([reply("b@x.example")], NOON - timedelta(days=100))
    log.append([reply("c@x.example")], NOON)
    assert log.delete_processed(1, NOON) == 1
    assert sorted(r["seq"] for r in log.read(spark).collect()) == [2, 3]
    assert log.append([reply("d@x.example")], NOON) == [4]


def test_bodies_are_stored_bounded():
    assert json.loads(store_body("no json")) == {"__not_json": True}
    assert json.loads(store_body("[1]")) == {"__not_json": True}
    long = store_body(json.dumps({"event": "email_sent", "text": "x" * 2 * MAX_BODY, "list": [1]}))
    assert len(long) <= MAX_BODY
    assert json.loads(long)["event"] == "email_sent"


def test_stored_bodies_hold_no_secret(spark, tmp_path):
    sent = {"event": "email_sent", "Secret": "k", "deep": [{"SECRET": 1, "note": "it is hunter22, yes", "hunter22": 2}], "n": 1.50}
    kept = json.loads(store_body(json.dumps(sent), ["hunter22", ""], ["secret"]))
    assert kept == {"event": "email_sent", "deep": [{"note": "it is [hidden], yes", "[hidden]": 2}], "n": 1.5}
    as_it_came = '{"event":  "email_sent", "n": 1.50}'
    assert store_body(as_it_came, ["hunter22"], ["secret"]) == as_it_came
    EventLog(str(tmp_path), ["hunter22"]).append([("apollo_reply", json.dumps(sent))], NOON)
    body = EventLog(str(tmp_path)).read(spark).first()["body"]
    assert "hunter22" not in body and "ecret" not in body


def test_stream_applies_each_event_once(spark, tmp_path):
    log, store = EventLog(str(tmp_path / "log")), Store(spark, str(tmp_path / "store"))
    batches, effects = [], []
    apply = intake.apply_to(store, lambda: NOON, lambda new: effects.append(sorted(r["email"] for r in new.collect())) or {})

    def counted(events, batch_id):
        batches.append(events.count())
        apply(events, batch_id)
        apply(events, batch_id)  # a batch may be given again

    def run():
        stateful.finish(intake.run_stream(spark, str(tmp_path / "log"), str(tmp_path / "cursor"), counted, unicode=False), 120)

    log.append([reply("a@x.example"), reply("A@x.example "), reply("b@x.example", "email_opened")], NOON)
    run()
    log.append([reply("a@x.example"), reply("c@x.example")], NOON + timedelta(hours=1))
    run()
    assert [n for n in batches if n] == [1, 1] and effects == [["a@x.example"], ["c@x.example"]]
    assert store.read("state").where("key = 'batch-of-events'").count() == 1


def test_silent_kinds(spark):
    last = spark.createDataFrame([("sent", NOON - timedelta(days=4)), ("replied", NOON)], "kind string, at timestamp").withColumnRenamed("at", "last_received")
    got = intake.silent_kinds(last, ["sent", "replied", "visit_pricing"], NOON)
    assert {r["kind"] for r in got.collect()} == {"sent", "visit_pricing"}


# --- the store ------------------------------------------------------------------------


def test_commits_are_whole_and_readers_keep_theirs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("state").count() == 0
    one = spark.createDataFrame([("k", "-0"), ("f", "=SUM(A1)"), ("z", "'01 "), ("n", "a\nb é \"q\"")], TABLES["state"].schema)
    assert store.commit({"state": one}) == 1
    assert store.commit({"state": one.limit(1)}) == 2
    assert sorted(map(tuple, store.read("state", 1).collect())) == sorted(map(tuple, one.collect()))
    assert store.read("state").count() == 1
    with pytest.raises(StoreError):
        store.commit({"state": one, "no such table": one})
    assert store.generation() == 2


def test_appends_keep_what_is_there_and_drop_what_is_too_old(spark, tmp_path, monkeypatch):
    from tidewell.sources import store as module

    monkeypatch.setattr(module, "MOST_PARTS", 3)
    s = Store(spark, str(tmp_path))
    row = lambda k, days: spark.createDataFrame([(k, NOON + timedelta(days=days), "r")], TABLES["seen_events"].schema)
    keys = lambda: sorted(r["event_key"] for r in s.read("seen_events").collect())
    s.commit({"seen_events": row("whole", 0)})
    s.commit({}, {"seen_events": row("a", 1)}, NOON)
    s.commit({}, {"seen_events": row("b", 300)}, NOON + timedelta(days=300))
    assert keys() == ["a", "b", "whole"] and len(s.manifest()["tables"]["seen_events"]) == 3
    s.commit({}, {"seen_events": row("c", 400)}, NOON + timedelta(days=400))
    assert keys() == ["b", "c", "whole"]
    s.commit({}, {"seen_events": row("d", 401)}, NOON + timedelta(days=401))
    assert keys() == ["b", "c", "d", "whole"] and len(s.manifest()["tables"]["seen_events"]) == 1
    s.vacuum(1)
    assert keys() == ["b", "c", "d", "whole"]


def test_of_two_writers_one_fails(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    row = spark.createDataFrame([("k", "v")], TABLES["state"].schema)
    b.generation = lambda: 0
    a.commit({"state": row})
    with pytest.raises(StoreError):
        b.commit({"state": row})


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for k in range(4):
        store.commit({"state": spark.createDataFrame([("k", str(k))], TABLES["state"].schema)})
    assert store.vacuum(keep=2) == 2
    assert store.read("state").first()["value"] == "3"
    assert store.read("state", 3).first()["value"] == "2"


def test_newer_schema_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.files.write(f"{tmp_path}/manifest-1.json", json.dumps({"version": 99, "tables": {}}))
    with pytest.raises(StoreError):
        store.read("state")


def test_one_run_holds_the_lease(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.acquire("one", 60)
    assert store.acquire("one", 60)
    assert not store.acquire("two", 60)
    store.release("two")
    assert not store.acquire("two", 60)
    store.release("one")
    assert store.acquire("two", -1)
    assert store.acquire("three", 60)


# --- sinks and plug-ins -----------------------------------------------------------------


def test_export_file_is_safe_sorted_and_private(spark, tmp_path):
    row = lambda i, name, day: ("list", i, f"{i}@x.example", None, name, "x.example", 12.5, "new", False, "why", NOON + timedelta(days=day), NOON)
    listed = spark.createDataFrame([row("b", "=HYPERLINK()", 2), row("a", "Ada", 1), row("c", None, 1)], export.TABLE_SCHEMA)
    path = tmp_path / "list.csv"
    assert export.write_csv(listed, str(path)) == 3
    lines = path.read_text().splitlines()
    assert lines[0] == ",".join(export.COLUMNS)
    assert [x.split(",")[0] for x in lines[1:]] == ["a", "c", "b"]
    assert "'=HYPERLINK()" in lines[3]
    assert ",12.5," in lines[1]
    assert path.stat().st_mode & 0o777 == 0o600
    long = spark.createDataFrame([row(f"p{k:04}", 'say "no",\nplease' if k % 2 else None, k % 7) for k in range(900)], export.TABLE_SCHEMA).repartition(6)
    assert export.write_csv(long, str(path)) == 900 and not list(tmp_path.glob("*draft*"))
    with path.open(newline="", encoding="utf-8") as f:
        read = list(csv.DictReader(f))
    assert [r["lead_id"] for r in read] == [f"p{k:04}" for k in sorted(range(900), key=lambda k: (k % 7, k))]
    assert {r["full_name"] for r in read} == {'say "no",\nplease', ""}
    assert export.write_csv(long.limit(0), str(path)) == 0 and path.read_text().strip() == ",".join(export.COLUMNS)


def test_registry_takes_a_name_once():
    r = Registry("source")
    r.add("csv", dict)
    assert r.make("csv", a=1) == {"a": 1}
    with pytest.raises(ValueError, match="twice"):
        r.add("csv", dict)
    with pytest.raises(ValueError, match="factory"):
        r.add("odd", None)
    with pytest.raises(KeyError, match="csv"):
        r.make("none")
