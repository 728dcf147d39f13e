"""Random histories of table changes and edits of Overrides, held against dictionaries."""

from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
from tidewell.operators import edits, status, tables

SCHEMA = "k string, n int, v string, at timestamp"
T0 = datetime(2024, 1, 1, tzinfo=UTC)
QUICK = settings(max_examples=12, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))

keys = st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None]))
rows = st.lists(st.tuples(keys, st.sampled_from(["x", "y", None]), st.sampled_from([None, *(T0 + timedelta(days=d) for d in range(4))])), max_size=4)
steps = st.lists(st.tuples(st.sampled_from(["upsert", "some", "append", "delete", "trim"]), rows, st.integers(0, 4)), min_size=2, max_size=5)


def frame(spark, given_rows):
    return spark.createDataFrame([(*k, v, at) for k, v, at in given_rows], SCHEMA)


def stored(df):
    return sorted(((r["k"], r["n"], r["v"], r["at"].replace(tzinfo=UTC) if r["at"] else None) for r in df.collect()), key=repr)


@QUICK
@given(history=steps)
def test_tables_equal_a_dictionary(spark, history):
    table, model = frame(spark, []), {}
    for what, given_rows, day in history:
        twice = len({k for k, *_ in given_rows}) < len(given_rows)
        new = frame(spark, given_rows)
        if what in ("upsert", "some"):
            part = new if what == "upsert" else new.drop("at")
            if twice:
                with pytest.raises(tables.KeyConflict):
                    tables.upsert(table, part, ["k", "n"])
                continue
            table = tables.upsert(table, part, ["k", "n"])
            for k, v, at in given_rows:
                model[k] = (v, at if what == "upsert" else model.get(k, (None, None))[1])
        elif what == "append":
            # A null key equals no key in an append's join, as in SQL; rows with one are told apart by the caller.
            if any(None in k for k, *_ in given_rows):
                continue
            if twice or any(k in model for k, *_ in given_rows):
                with pytest.raises(tables.KeyConflict):
                    tables.append(table, new, ["k", "n"])
                continue
            table = tables.append(table, new, ["k", "n"])
            model |= {k: (v, at) for k, v, at in given_rows}
        elif what == "delete":
            table = tables.delete(table, new, ["k", "n"])
            model = {k: r for k, r in model.items() if None in k or k not in {x for x, *_ in given_rows}}
        else:
            bound = T0 + timedelta(days=day)
            table = tables.trim(table, "at", F.lit(bound))
            model = {k: r for k, r in model.items() if r[1] is None or r[1] >= bound}
        table = spark.createDataFrame(table.collect(), SCHEMA)
        assert stored(table) == sorted(((*k, *r) for k, r in model.items()), key=repr)


PEOPLE = {"ada@x.example": "L1", "a2@x.example": "L1", "bo@x.example": "L2"}
edit_steps = st.lists(
    st.one_of(
        st.tuples(st.just("status"), st.sampled_from([*PEOPLE, "new@x.example"]), st.sampled_from(["blocked", "unsubscribed", "none", "resubscribe", "Replied_Positive "])),
        st.tuples(st.just("retry"), st.sampled_from(["*", "ada@x.example"]), st.sampled_from(["", "cold"])),
        st.tuples(st.just("distinct"), st.just("ada@x.example"), st.just("bo@x.example")),
    ),
    min_size=2,
    max_size=5,
)


@settings(QUICK, max_examples=6)
@given(history=edit_steps)
def test_edits_equal_a_list(spark, history):
    identities = spark.createDataFrame([(k, "email", lead, "s", T0) for k, lead in PEOPLE.items()], "key string, kind string, lead_id string, source_id string, first_seen_at timestamp")
    live = spark.createDataFrame([(x, x) for x in ("L1", "L2")], "lead_id string, live_id string")
    table, model = spark.createDataFrame([], "row int, person string, action string, value string, note string"), []
    who = lambda person: PEOPLE.get(person, person)
    for n, (what, person, value) in enumerate(history):
        now = T0 + timedelta(hours=n)
        resolved = status.resolve_overrides(table, identities, live, unicode=False)
        if what == "status":
            table = edits.set_status(table, resolved, person, PEOPLE.get(person), value, now)
            v = value.strip().lower()
            model = [r for r in model if not (r[1] == "status" and who(r[0]) == who(person) and (v not in ("none", "resubscribe") or r[2] != "resubscribe"))]
            new = None if v == "none" else (person, "status", v, f"{now:%Y-%m-%dT%H:%M:%SZ}" if v == "resubscribe" else "")
        elif what == "retry":
            table = edits.add_retry(table, now, person, value)
            new = (person, "retry", value, f"{now:%Y-%m-%dT%H:%M:%SZ}")
        else:
            table = edits.add_pair(table, "distinct", (person, PEOPLE[person]), (value, PEOPLE[value]))
            new = (person, "distinct", value, "")
        if new and new not in model:
            model.append(new)
        table = spark.createDataFrame(table.collect(), "row int, person string, action string, value string, note string")
        got = table.orderBy("row").collect()
        assert [tuple(r)[1:] for r in got] == model
        assert len({r["row"] for r in got}) == len(got)
