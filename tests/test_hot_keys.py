"""Keys that hold a third of all rows: plans without a single task or list, and results as of plain loops."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewell.operators import detectors, rows
from tidewell.plans.rubric import Detector

NOON = datetime(2024, 3, 1, 12, tzinfo=UTC)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_numbered_in_order_without_one_task(spark, monkeypatch):
    r = random.Random(1)
    data = [(r.choice([None, "a", "b", "b", "b"]), r.randrange(50), f"v{k}") for k in range(500)]
    df = spark.createDataFrame(data, "Key string, Num int, `A b` string").repartition(5)
    read = [tuple(x) for x in df.collect()]
    monkeypatch.setattr(rows, "running_sums", lambda df, by, cols, n=100, f=rows.running_sums: f(df, by, cols, n))
    got = rows.input_rows(df, "s", ["A b", "Key", "A b"], ["Key", "Num"], 3)
    assert "SinglePartition" not in plan_of(got)
    found = got.orderBy("ord").collect()
    assert [x["ord"] for x in found] == list(range(1, 501)) and {(x["source_id"], x["source_pos"]) for x in found} == {("s", 3)}
    assert [x["cols"]["A b"] for x in found] == [v for *_, v in sorted(read, key=lambda x: (x[0] is not None, x[0] or "", x[1]))]
    assert rows.input_rows(df, "s", ["Key"]).select("ord").distinct().count() == 500


def test_a_group_is_hashed_by_sums_whatever_its_order(spark):
    make = lambda ids: spark.createDataFrame([("s", "hot", i, 0, k) for k, i in enumerate(ids)], "source_id string, row_id string, raw string, source_pos int, ord long").withColumn("row_hash", F.sha2("raw", 256))
    h = lambda ids: rows.groups(make(ids)).first()["hash"]
    base = [f"{k}" for k in range(2_000)]
    assert h(base) == h(base[::-1]) != h(base[:-1] + ["x"])
    assert len({h(["a"]), h(["a", "a"]), h(["a", "a", "a"]), h(["b"]), h(["a", "b"])}) == 5
    assert h(["a"]) == make(["a"]).first()["row_hash"]
    plan = plan_of(rows.groups(make(base)))
    assert "collect_list" not in plan and "collect_set" not in plan and "partial_sum" in plan


class Gap(detectors.SubjectDetector):
    """Three visits in a row, none more than an hour after the one before."""

    batches = 0

    def __init__(self, params, now):
        super().__init__(params, now)
        self.last, self.run, self.found, self.longest = None, 0, False, 0

    def step(self, kinds, times):
        self.longest = max(self.longest, len(kinds))
        for kind, t in zip(kinds, times.tolist(), strict=True):
            if kind.startswith("visit"):
                self.run = self.run + 1 if self.last is not None and t - self.last <= 3_600_000_000 else 1
                self.last = t
                self.found |= self.run >= self.params.get("least", 3)

    def fires(self):
        if self.longest > 1_000:
            raise AssertionError("more than a batch was given at once")
        return self.found


def slow(events, least):
    out = {}
    for who in {e[0] for e in events if e[0]}:
        last, run, found = None, 0, False
        for _, kind, t in sorted((e for e in events if e[0] == who), key=lambda e: (e[2], e[1].lower())):
            if kind.lower().startswith("visit"):
                run = run + 1 if last is not None and t - last <= timedelta(hours=1) else 1
                last, found = t, found or run >= least
        out[who] = found
    return out


def test_detectors_of_users_read_hot_subjects_in_batches(spark):
    detectors.register_subject_detector("gap", Gap)
    with pytest.raises(ValueError):
        detectors.register_subject_detector("gap", Gap)
    with pytest.raises(ValueError):
        detectors.register_detector("gap", lambda params, now: F.lit(True))
    r = random.Random(6)
    events = [(r.choice(["ada", "bo", "cy", "di"]), r.choice(["Visit_x", "sent"]), NOON + timedelta(minutes=r.randrange(60_000))) for _ in range(700)]
    events += [("hot", "visit", NOON + timedelta(minutes=90 * k)) for k in range(6_000)]
    df = spark.createDataFrame([*events, (None, "visit", NOON), ("", "visit", NOON), ("ada", None, NOON), ("ada", "visit", None)], "lead_id string, kind string, at timestamp").repartition(4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        specs = [Detector("three", "gap"), Detector("five", "gap", params={"least": 5}), Detector("any", "count_in_window", event="visit*", window=timedelta(days=4_000), min=1)]
        got = {x["lead_id"]: x for x in detectors.evaluate_detectors(specs, df, None, None, "lead_id", NOON + timedelta(days=2_000)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for name, least in (("three", 3), ("five", 5)):
        assert {k: x[f"d_{name}"] for k, x in got.items()} == slow(events, least)
    assert got["hot"]["d_any"] and not got["hot"]["d_three"]


def test_rollups_over_leads_meet_no_company_first(spark):
    from tidewell import queries
    from tidewell.plans.evaluate import company_rollups, company_values, lead_values
    from tidewell.plans.rubric import compile_rubric

    rubric = compile_rubric(queries.RUBRIC, unicode=False)
    sf = "/root/testdata/sf0.001"
    lv = lead_values(rubric, queries.customers(spark, sf))
    cv = company_values(rubric, queries.nations(spark, sf))
    plan = plan_of(company_rollups(rubric, lv, cv))
    assert "Join" not in plan and "partial_max" in plan
    # A rollup that reads a fact of the company meets it, and is right.
    text = queries.RUBRIC.replace("  richest: { max: acctbal }\n", "  richest: { max: acctbal }\n  near_rich: { count: { all: [ { field: company.region, eq: ASIA }, { field: acctbal, gte: 0 } ] } }\n", 1)
    assert text != queries.RUBRIC
    mixed = compile_rubric(text, unicode=False)
    lv, cv = lead_values(mixed, queries.customers(spark, sf)), company_values(mixed, queries.nations(spark, sf))
    got = {r["domain"]: r for r in company_rollups(mixed, lv, cv).collect()}
    region = {r["domain"]: r["region"] for r in queries.nations(spark, sf).collect()}
    want = {}
    for r in queries.customers(spark, sf).collect():
        if r["domain"]:
            want[r["domain"]] = want.get(r["domain"], 0) + (region.get(r["domain"]) == "ASIA" and "acctbal" in r["fields"])
    assert {d: r["c_near_rich"] for d, r in got.items()} == want and sum(want.values()) > 0
    assert all(r["c_richest"] is not None for r in got.values())
