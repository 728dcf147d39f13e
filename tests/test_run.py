"""Runs over a store: files and events to ranked leads, lists and health."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewell.operators import status
from tidewell.plans.run import EventFile, Input, dry_run, explain_person, push_health, run
from tidewell.operators.events import RAW_SCHEMA
from tidewell.operators.routing import PUSH_SCHEMA
from tidewell.sources.schema import TABLES
from tidewell.sources.store import Store

NOON = datetime(2024, 3, 1, 12, tzinfo=UTC)
RUBRIC = """
version: 1
fields: { employeesband: { type: number } }
company:
  people: { count: { field: email, present: true } }
detectors:
  fresh: { kind: count_in_window, event: visit_pricing, window: 7d, min: 1 }
  busy: { kind: count_in_window, event: "visit_*", window: 7d, min: 2, subject: company }
derive:
  tier: { level: company, rules: [ { when: { field: company.people, gte: 2 }, then: big }, { else: small } ] }
score:
  account: [ { when: { field: tier, eq: big }, points: 10 }, { when: { detector: busy }, points: 5 } ]
  contact: [ { when: { field: title, eq: ceo }, points: 3 }, { when: { detector: fresh }, points: 4 } ]
conflicts: [ { field: title } ]
lanes:
  - { id: warm, kind: non-cold, priority: 9, push: "hubspot:contacts", when: { field: status, eq: replied_positive } }
  - { id: list, kind: export, priority: 1, push: "export:list", when: { field: tier, eq: big } }
"""


def visit(seq, mail, at, name="website_visited_Pricing", site="https://acme.example"):
    body = {"event": name, "contact": {"email": mail}, "account": {"website_url": site}, "visited_at": f"{at:%Y-%m-%dT%H:%M:%SZ}"}
    return (seq, at, "apollo_visit", json.dumps(body))


def reply(seq, mail, event="email_replied_positive"):
    return (seq, NOON - timedelta(hours=seq), "apollo_reply", json.dumps({"event": event, "contact_email": mail, "contact_stage": "Interested", "contact_name": "Dee Dee"}))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def inputs(spark, title="CEO"):
    a = spark.createDataFrame([("1", "ada@acme.example", title, "Ada"), ("2", "bob@acme.example", "CTO", "Bob"), ("3", "", "", "Nobody"), ("4", "cy@solo.example", "CEO", "Cy")], "Row string, Email string, Title string, `Full Name` string")
    b = spark.createDataFrame([("1", "ada@acme.example", "Founder", "https://www.linkedin.com/in/ada/")], "Row string, Email string, Title string, LinkedIn string")
    return [Input("sheet", a, ["Email", "Title", "Full Name"], ["Row"]), Input("crm", b, ["Email", "Title", "LinkedIn"], ["Row"], held=True)]


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW_SCHEMA)


def ranked(store):
    return {r["email"]: r for r in store.read("ranked").collect()}


def test_rows_and_events_become_ranked_leads_and_lists(spark, store):
    events = [visit(1, "bob@acme.example", NOON - timedelta(days=1)), visit(2, "bob@acme.example", NOON - timedelta(days=2)), visit(3, "", NOON - timedelta(days=1)), reply(4, "cy@solo.example"), reply(5, "dee@new.example", "email_sent"), (6, NOON, "apollo_reply", "{}")]
    assert run(store, RUBRIC, inputs(spark), NOON, raw(spark, events), watched=["sent", "visit_pricing", "visit_demo"], unicode=False) == 1
    got = ranked(store)
    assert set(got) == {"ada@acme.example", "bob@acme.example", "cy@solo.example", "dee@new.example"}
    ada, bob, cy, dee = (got[m] for m in sorted(got))
    assert (ada["account_score"], ada["contact_score"], ada["score"], ada["status"], ada["lane"]) == (15, 3, 18, "new", None)
    assert "blocked: sources disagree on title" in ada["reasons"] and ada["linkedin_url"] == "linkedin.com/in/ada"
    assert (bob["score"], bob["lane"], bob["derived"]) == (19, "list", {"tier": "big"})
    assert (cy["score"], cy["status"], cy["lane"], cy["derived"]) == (3, "replied_positive", "warm", {"tier": "small"})
    assert (dee["status"], dee["full_name"]) == ("contacted", "Dee Dee")
    listed = {r["email"]: r for r in store.read("exports").collect()}
    assert set(listed) == {"bob@acme.example"} and listed["bob@acme.example"]["do_not_contact"] is False
    health = {(r["kind"], r["key"]): r["value"] for r in store.read("health").collect()}
    assert health[("rows_refused", "sheet")] == "1" and health[("silent", "visit_demo")] == "never" and ("event_refused", "6") in health
    people = {r["lead_id"]: r for r in store.read("people").collect()}
    assert people[ada["lead_id"]]["held_at"] is not None and people[ada["lead_id"]]["conflicts"]["title"] == [("Founder", "crm")]
    assert people[cy["lead_id"]]["fields"]["company.domain"]["derived"] is True
    text = explain_person(store, " ADA@acme.example", unicode=False)
    assert len(text) == 1 and text[0].startswith("Ada (new)") and "tier: big" in text[0] and "score: 18" in text[0]
    assert explain_person(store, ada["lead_id"], unicode=False) == text and explain_person(store, "nobody@x.example", unicode=False) == []


def test_a_run_again_changes_nothing_and_later_rows_go_on(spark, store):
    events = [visit(1, "bob@acme.example", NOON - timedelta(days=1)), reply(4, "cy@solo.example")]
    run(store, RUBRIC, inputs(spark), NOON, raw(spark, events), unicode=False)
    before = {n: sorted(map(repr, store.read(n).collect())) for n in TABLES}
    run(store, RUBRIC, inputs(spark), NOON + timedelta(minutes=15), raw(spark, events), unicode=False)
    after = {n: sorted(map(repr, store.read(n).collect())) for n in TABLES}
    assert {n for n in TABLES if before[n] != after[n]} == set()
    # A changed row, a new event, and status by hand.
    over = spark.createDataFrame([(1, "bob@acme.example", "status", "blocked", "")], TABLES["overrides"].schema)
    store.commit({"overrides": over})
    late = [*events, reply(7, "ada@acme.example", "email_sent")]
    run(store, RUBRIC, inputs(spark, "Owner"), NOON + timedelta(days=20), raw(spark, late), unicode=False)
    got = ranked(store)
    assert got["ada@acme.example"]["status"] == "contacted"
    assert got["bob@acme.example"]["status"] == "blocked" and got["bob@acme.example"]["contact_score"] == 0
    people = {r["lead_id"]: r for r in store.read("people").collect()}
    ada = people[got["ada@acme.example"]["lead_id"]]
    assert ada["fields"]["title"]["value"] == "CEO" and {x["value"] for x in ada["conflicts"]["title"]} == {"Founder"}
    assert store.read("exports").where("email = 'bob@acme.example'").first()["do_not_contact"] is True


def test_merges_by_hand(spark, store):
    rows = spark.createDataFrame([("1", "old@acme.example", "", "Old"), ("2", "new@acme.example", "Boss", "New")], "Row string, Email string, Title string, `Full Name` string")
    given = [Input("sheet", rows, ["Email", "Title", "Full Name"], ["Row"])]
    store.commit({"overrides": spark.createDataFrame([(1, "new@acme.example", "same_as", "old@acme.example", "")], TABLES["overrides"].schema)})
    run(store, RUBRIC, given, NOON, unicode=False)
    run(store, RUBRIC, given, NOON + timedelta(minutes=15), unicode=False)
    got = store.read("ranked").collect()
    assert len(got) == 1
    people = {r["lead_id"]: r for r in store.read("people").collect()}
    kept = people[got[0]["lead_id"]]
    assert {p["merged_into"] for k, p in people.items() if k != got[0]["lead_id"]} == {got[0]["lead_id"]}
    assert kept["fields"]["title"]["value"] == "Boss" and got[0]["email"] == kept["fields"]["email"]["value"]


def test_rows_are_taken_in_chunks(spark, store):
    rows = spark.createDataFrame([(f"{k:03}", f"p{k}@acme.example") for k in range(10)], "Row string, Email string")
    for taken in (6, 10):
        run(store, RUBRIC, [Input("sheet", rows, ["Email"], ["Row"])], NOON, most_rows=6, unicode=False)
        assert store.read("applied_rows").count() == taken and store.read("ranked").count() == taken


def test_an_empty_run(spark, store):
    assert run(store, RUBRIC, [], NOON, unicode=False) == 1
    assert store.read("ranked").count() == 0 and store.read("health").count() == 0


def test_health_of_pushes(spark):
    row = lambda lead, state, at: (lead, "cold", "1", "cold", "d", state, "", "", None, None, 0, "why", at)
    p = spark.createDataFrame([row("a", "failed", NOON), row("b", "pending", NOON - timedelta(days=3)), row("c", "pending", NOON - timedelta(days=2)), row("d", "pending", NOON), row("gone", "failed", NOON)], PUSH_SCHEMA)
    people = spark.createDataFrame([("a", ""), ("gone", "a")], "lead_id string, merged_into string")
    got = {(r["kind"], r["key"]): r["value"] for r in push_health(p, people, NOON).collect()}
    assert got == {("push_failed", "a|cold|1"): "why", ("push_pending", ""): "2 since 2024-02-27T12:00:00.000Z"}


def test_deal_steps_of_others_hold_a_company(spark):
    people = spark.createDataFrame([("a", "x.example"), ("b", "x.example"), ("c", "y.example"), ("d", "")], "lead_id string, domain string")
    live = people.selectExpr("lead_id", "lead_id AS live_id")
    none = spark.createDataFrame([], "lead_id string, deal_stage string, deal_checked_at timestamp")
    step = lambda lead, lane, hours: (lead, lane, status.DEAL_STEP, "non-cold", status.DEAL_DEST, "done", "", "", NOON + timedelta(hours=hours), None, 0, "", NOON)
    holds = lambda rows, lane="", facts=none: {r["lead_id"] for r in status.deal_holds(people, facts, spark.createDataFrame(rows, PUSH_SCHEMA), live, lane).where("deal").collect()}
    assert holds([step("a", "warm", 1)]) == {"a", "b"}
    assert holds([step("a", "warm", 1)], "warm") == {"b"}
    assert holds([step("a", "warm", 1), step("b", "warm", 2)], "warm") == {"a", "b"}
    lost = spark.createDataFrame([("b", "lost", NOON + timedelta(hours=1.5))], none.schema)
    assert holds([step("a", "warm", 1)], "", lost) == set()
    assert holds([step("a", "warm", 1), step("b", "warm", 2)], "warm", lost) == {"a"}


PUSHED = RUBRIC.replace("lanes:\n", "limits: { max_pushes_per_run: 2, max_pushes_per_day: 3 }\nlanes:\n  - { id: deal, kind: non-cold, priority: 8, push: \"hubspot:deals\", when: { field: title, eq: boss } }\n  - { id: first, kind: cold, priority: 5, push: \"apollo:sequence/A\", when: { field: title, ne: nobody } }\n")


def people_rows(spark, n, title="Boss"):
    rows = spark.createDataFrame([(f"{k:02}", f"p{k}@c{k // 2}.example", title) for k in range(n)], "Row string, Email string, Title string")
    return [Input("sheet", rows, ["Email", "Title"], ["Row"])]


def test_retries_and_resubscriptions_act_once_and_the_ledger_is_repaired(spark, store):
    given = people_rows(spark, 3)
    over = spark.createDataFrame([(1, "p2@c1.example", "status", "unsubscribed", "")], TABLES["overrides"].schema)
    store.commit({"overrides": over})
    run(store, PUSHED, given, NOON, unicode=False)
    ids = {e: r["lead_id"] for e, r in ranked(store).items()}
    a, b, c = (ids[f"p{k}@c{k // 2}.example"] for k in range(3))
    outcome = lambda: {r["lead_id"]: r for r in store.read("outcomes").collect()}[c]
    assert (outcome()["unsubscribed_origin"], outcome()["unsubscribed_at"] is not None) == ("manual", True) and ranked(store)["p2@c1.example"]["status"] == "unsubscribed"
    step = lambda lead, lane, state, dest, intent="": (lead, lane, "s", "cold", dest, state, "", intent, None, NOON, 3, "no answer", NOON)
    pushes = [step(a, "first", "failed", "sequence/A"), step(b, "gone", "pending", "x"), step(c, "first", "pending", "sequence/A", "run-of-old")]
    over = spark.createDataFrame([(1, "*", "retry", "first", "t1"), (2, "p2@c1.example", "status", "resubscribe", "t1"), (3, "who@x.example", "retry", "", "t1")], TABLES["overrides"].schema)
    store.commit({"overrides": over, "pushes": spark.createDataFrame(pushes, PUSH_SCHEMA)})
    run(store, PUSHED, given, NOON + timedelta(hours=1), unicode=False)
    ledger = lambda: {(r["lead_id"], r["lane_id"]): r for r in store.read("pushes").collect()}
    now = ledger()
    assert (now[a, "first"]["state"], now[a, "first"]["attempts"]) == ("pending", 0)
    assert now[b, "gone"]["state"] == "cancelled" and now[c, "first"]["called_at"] == (NOON + timedelta(hours=1)).replace(tzinfo=None) and now[c, "first"]["intent_run"] == ""
    assert outcome()["unsubscribed_at"] is None and ranked(store)["p2@c1.example"]["status"] != "unsubscribed"
    assert store.read("applied_overrides").count() == 2  # nobody is called who@x.example
    failed = store.read("pushes").withColumn("state", F.when(F.col("lead_id") == a, "failed").otherwise(F.col("state")))
    opted = store.read("outcomes").withColumns({"unsubscribed_at": F.when(F.col("lead_id") == c, F.lit(NOON)).otherwise(F.col("unsubscribed_at")), "unsubscribed_origin": F.when(F.col("lead_id") == c, "manual").otherwise(F.col("unsubscribed_origin"))})
    store.commit({"pushes": failed, "outcomes": opted})
    run(store, PUSHED, given, NOON + timedelta(hours=2), unicode=False)
    assert ledger()[a, "first"]["state"] == "failed" and outcome()["unsubscribed_at"] is not None and store.read("applied_overrides").count() == 2


def test_a_plan_within_the_limits_and_a_dry_run_that_writes_nothing(spark, store):
    given = people_rows(spark, 6)
    dry = dry_run(store, PUSHED, given, NOON, unicode=False)
    assert dry["ranked"].where("change = 'new'").count() == 6 and dry["push_plan"].where("change = 'new'").count() == 3
    assert store.generation() == 0 and store.read("ranked").count() == 0
    run(store, PUSHED, given, NOON, unicode=False)
    got = store.read("push_plan").collect()
    assert sorted(r["reserve"] for r in got) == [False, False, True] and {r["lane_id"] for r in got} == {"deal"} and not any(r["free"] for r in got)
    assert {r["domain"] for r in store.read("enrichment_plan").collect()} == {"c0.example", "c1.example", "c2.example"}
    # Two were begun today, one of them has a deal step without a result: the day leaves one, and a colleague's deal step waits.
    ids = {e: r["lead_id"] for e, r in ranked(store).items()}
    step = lambda lead, state, called: (lead, "deal", "deal", "non-cold", "deals", state, "", "", called, NOON, 0, "", NOON)
    pushes = [step(ids["p0@c0.example"], "pending", NOON), step(ids["p2@c1.example"], "done", NOON)]
    store.commit({"pushes": spark.createDataFrame(pushes, PUSH_SCHEMA)})
    run(store, PUSHED, given, NOON + timedelta(hours=1), unicode=False)
    got = {(r["lead_id"], r["lane_id"]): r for r in store.read("push_plan").collect()}
    assert got[ids["p0@c0.example"], "deal"]["free"] and (ids["p1@c0.example"], "deal") not in got
    assert sum(not r["free"] and not r["reserve"] for r in got.values()) == 1
    assert {r["key"] for r in store.read("health").where("kind = 'deal_waits'").collect()} == {ids["p1@c0.example"]}


def test_files_of_events_and_polled_replies(spark, store):
    given = people_rows(spark, 2, "CEO")
    rows = spark.createDataFrame([("visit_pricing", "2024-02-28", "p0@c0.example"), ("visit_pricing", "2024-02-29T10:00:00Z", "p0@c0.example"), ("sent", "2024-02-29", "p1@c0.example"), ("visit_pricing", "soon", "p1@c0.example")], "event string, at string, email string")
    file = EventFile("visits", rows, ["event", "at", "email"])
    events = raw(spark, [reply(1, "p1@c0.example")])
    run(store, RUBRIC, given, NOON, events, unicode=False, event_files=[file], polling=True)
    got = ranked(store)
    assert got["p0@c0.example"]["contact_score"] == 7 and got["p0@c0.example"]["account_score"] == 15
    assert got["p1@c0.example"]["status"] == "new"  # the reply is polled, and the file may not report a send
    assert sorted(r["value"] for r in store.read("health").where("kind = 'event_rows_refused'").collect()) == ["1", "1"]
    assert store.read("window_events").count() == 2
    run(store, RUBRIC, given, NOON + timedelta(minutes=5), events, unicode=False, event_files=[file], polling=True)
    assert store.read("window_events").count() == 2
