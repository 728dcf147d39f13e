"""Keyed tables, chunks, retries, deals and stored bodies on odd rows."""

import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from tidewell.operators import events, identity, rows, status, tables
from tidewell.operators.routing import PUSH_SCHEMA
from tidewell.sources.event_log import MAX_BODY, store_body

NOON = datetime(2024, 3, 1, 12, tzinfo=UTC)


def test_upsert_takes_null_keys_as_equal_and_refuses_repeats(spark):
    old = spark.createDataFrame([(1, "a", "x"), (None, "b", "y")], "k int, old string, v string")
    got = tables.upsert(old, spark.createDataFrame([(None, None), (2, "new")], "k int, v string"), ["k"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(1, "a", "x"), (None, "b", None), (2, None, "new")]))
    with pytest.raises(tables.KeyConflict):
        tables.upsert(old, spark.createDataFrame([(3, "p"), (3, "q")], "k int, v string"), ["k"])


def test_append_refuses_held_and_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    assert tables.append(old, spark.createDataFrame([(2, "b")], "k int, v string"), ["k"]).count() == 2
    for bad in ([(1, "b")], [(2, "b"), (2, "c")]):
        with pytest.raises(tables.KeyConflict):
            tables.append(old, spark.createDataFrame(bad, "k int, v string"), ["k"])


@pytest.mark.parametrize("most", [1, 7, 40, 1_000])
def test_chunks_are_prefixes(spark, most):
    sizes = [(k, 1 + k * 7 % 5) for k in range(60)]
    got = {r["first_ord"] for r in rows.chunk(spark.createDataFrame(sizes, "first_ord long, rows long").repartition(5), most).collect()}
    want, upto = set(), 0
    for k, n in sizes:
        upto += n
        if upto <= most or k == 0:
            want.add(k)
    assert got == want


def test_live_leads_over_long_chains_and_cycles(spark):
    chain = [(f"a{k:03}", f"a{k + 1:03}") for k in range(300)] + [("a300", "")]
    cycle = [("c2", "c3"), ("c3", "c1"), ("c1", "c2"), ("b9", "c3"), ("self", "self"), ("lost", "nobody"), ("free", None)]
    got = {r["lead_id"]: (r["live_id"], r["cycle"]) for r in identity.live_leads(spark.createDataFrame(chain + cycle, "lead_id string, merged_into string")).collect()}
    assert all(got[f"a{k:03}"] == ("a300", False) for k in range(301))
    assert all(got[k] == ("c1", True) for k in ("c1", "c2", "c3", "b9"))
    assert got["self"] == ("self", False) and got["lost"] == ("lost", False) and got["free"] == ("free", False)


def test_live_leads_are_joined_without_broadcasts_over_any_graph(spark):
    r = random.Random(4)
    for n in (1, 7, 60):
        into = {f"p{k:02}": r.choice([None, "", "gone", *(f"p{j:02}" for j in range(n))]) if r.random() < 0.8 else None for k in range(n)}
        into |= {f"t{k:02}": f"t{k + 1:02}" for k in range(20)} | {"t20": "z1", "z1": "z2", "z2": "z0", "z0": "z1"}  # a long way into a cycle
        step = {a: b for a, b in into.items() if b in into and b != a}
        want = {}
        for a in into:
            passed = [a]
            while passed[-1] in step and step[passed[-1]] not in passed:
                passed.append(step[passed[-1]])
            round_ = passed[passed.index(step[passed[-1]]) :] if passed[-1] in step else []
            want[a] = (min(round_), True) if round_ else (passed[-1], False)
        out = identity.live_leads(spark.createDataFrame(list(into.items()), "lead_id string, merged_into string"))
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert {x["lead_id"]: (x["live_id"], x["cycle"]) for x in out.collect()} == want


def push(lead, lane, step="1", state="failed"):
    return (lead, lane, step, "cold", "d", state, "", "", None, None, 3, "bad", NOON)


def test_retries_name_leads_and_lanes(spark):
    p = spark.createDataFrame([push("a", "x"), push("a", "y"), push("b", "x"), push("b", "Y"), push("c", "x", state="done"), push("a", "x")], PUSH_SCHEMA)
    schema = "person string, lead_id string, action string, value string, hash string, invalid string"
    said = lambda *r: spark.createDataFrame(list(r), schema)
    none = spark.createDataFrame([], "row_hash string")
    pending = lambda o, a=none: sorted((r["lead_id"], r["lane_id"]) for r in status.retries(p, o, a, NOON).where("state = 'pending'").collect())
    assert pending(said(("a", "a", "retry", "X", "h1", None))) == [("a", "x"), ("a", "x")]
    assert pending(said(("*", None, "retry", "y", "h2", None))) == [("a", "y"), ("b", "Y")]
    assert len(pending(said(("*", None, "retry", "", "h3", None)))) == 5
    assert pending(said(("*", None, "retry", "", "h3", None)), spark.createDataFrame([("h3",)], "row_hash string")) == []
    out = status.retries(p, said(("a", "a", "retry", "", "h", None), ("a", "a", "retry", "x", "g", None)), none, NOON)
    assert out.columns == p.columns and out.count() == 6
    assert [r["attempts"] for r in out.where("lead_id = 'a'").collect()] == [0, 0, 0]


def test_last_deal_of_each_way(spark):
    schema = "ord long, kind string, at timestamp, received_at timestamp, lead_id string, domain string, attrs map<string,string>"
    e = [(1, "deal_open", NOON, NOON, None, "https://www.X.example/", {"deal_id": "1"}), (2, "deal_won", NOON, NOON, "a", None, {"deal_id": "2"}), (3, "visit", NOON, NOON, "c", None, {}), (4, "deal_lost", NOON, NOON, None, None, {"deal_id": "9"}), (5, "deal_open", NOON, NOON, None, None, {})]
    people = spark.createDataFrame([("a", "x.example"), ("b", "x.example"), ("c", ""), ("d", "y.example")], "lead_id string, domain string")
    old = spark.createDataFrame([("d", "9"), ("c", "")], "lead_id string, deal_id string")
    got = {r["lead_id"]: (r["deal_id"], r["deal_stage"]) for r in events.deals(spark.createDataFrame(e, schema), people, old).collect()}
    assert got == {"a": ("2", "won"), "b": ("2", "won"), "d": ("9", "lost")}


@pytest.mark.parametrize("fields", [{f"f{k}": "x" * 900 for k in range(70)}, {"event": "sent", "deep": {"a": "y" * 2 * MAX_BODY}}, {"é" * 9_000: 1, "k": [1], "t": "z" * MAX_BODY}])
def test_long_bodies_stay_json(fields):
    kept = store_body(json.dumps(fields))
    assert len(kept) <= MAX_BODY
    got = json.loads(kept)
    assert set(got) <= set(fields) and "__not_json" not in got
    if "event" in fields:
        assert got["event"] == "sent"


def test_short_ids_of_companies_with_many_leads_are_split(spark):
    """The leads of a hot company are dealt to several tasks when they meet their company's state."""
    from tidewell.plans.evaluate import evaluate
    from tidewell.plans.rubric import compile_rubric

    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        leads = spark.range(30_000).select(F.col("id").cast("string").alias("lead_id"), F.when(F.col("id") % 3 == 0, "hot.example").otherwise(F.concat(F.lit("d"), F.col("id") % 500)).alias("domain"), F.create_map(F.lit("note"), F.sha2(F.col("id").cast("string"), 256)).alias("fields"))
        rubric = compile_rubric("version: 1\ncompany: { n: { count: { field: note, present: true } } }\nscore: { account: [ { band: company.n, points: { 1: 1 } } ] }\nlanes: []\n", unicode=False)
        out = evaluate(rubric, leads)
        assert out.where("score = 1").count() == 30_000
        got = evaluate(rubric, leads)
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
