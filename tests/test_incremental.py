import random
from datetime import UTC, datetime

from pyspark.sql import functions as F
from tidewell.operators.components import connected_components, extend_components
from tidewell.plans.evaluate import evaluate
from tidewell.plans.incremental import ChangeLog, Inputs, changed_keys, update
from tidewell.plans.rubric import compile_rubric
from tidewell.storage import materialize

DAY = datetime(2024, 1, 1, tzinfo=UTC)


def rubric():
    from tidewell import queries

    return compile_rubric(queries.RUBRIC, unicode=False)


class World:
    """Leads, companies and signals as dictionaries, edited at random; a third of the leads are at one company."""

    def __init__(self, seed):
        self.r = random.Random(seed)
        self.leads = {f"l{k}": self.lead(k) for k in range(120)}
        self.companies = {f"n{k}.example": ("C", self.r.choice(["ASIA", "AFRICA"]), float(100 * k)) for k in range(12)}
        self.bought, self.errors = {"l1", "l5"}, {"n2.example"}

    def lead(self, k):
        domain = "n1.example" if k % 3 == 0 else self.r.choice([None, "", *(f"n{i}.example" for i in range(14))])
        fields = {"segment": self.r.choice(["BUILDING", "OTHER"]), "acctbal": str(self.r.randrange(10_000)), "nationno": "1"}
        return (domain, self.r.choice(["new", "replied_positive"]), fields)

    def edit(self):
        names = sorted(self.leads)
        self.leads[f"l{len(self.leads) + 1_000}"] = self.lead(1)
        del self.leads[self.r.choice(names[:60])]
        moved = self.r.choice(names[60:])
        self.leads[moved] = ("n7.example", "new", self.leads[moved][2])
        self.companies["n4.example"] = ("C", self.r.choice(["ASIA", "EUROPE"]), float(self.r.randrange(2_000)))
        self.bought ^= {self.r.choice(sorted(self.leads))}
        self.errors ^= {"n9.example"}

    def inputs(self, spark):
        leads = [(i, d, DAY, s, f) for i, (d, s, f) in self.leads.items()]
        frames = (
            spark.createDataFrame(leads, "lead_id string, domain string, first_seen_at timestamp, status string, fields map<string,string>"),
            spark.createDataFrame([(d, *c) for d, c in self.companies.items()], "domain string, name string, region string, employees double"),
            spark.createDataFrame([(i, True) for i in sorted(self.bought)], "lead_id string, d_buys boolean"),
            spark.createDataFrame([(d, True) for d in sorted(self.errors)], "domain string, d_errors boolean"),
        )
        return Inputs(*(materialize(f, "world") for f in frames))


def judged(i):
    return evaluate(rubric(), i.leads, i.companies, i.lead_signals, i.company_signals)


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_updates_equal_judging_all_again(spark, tmp_path):
    world = World(3)
    now = world.inputs(spark)
    log = ChangeLog(spark, str(tmp_path / "verdicts"))
    log.create(judged(now))
    by_lead = lambda df: {r["lead_id"]: repr(r) for r in df.select(*sorted(df.columns)).collect()}
    whole, old = None, by_lead(log.read())
    for k in range(3):
        world.edit()
        before, now = now, world.inputs(spark)
        delta = update(log, rubric(), before, now)
        whole = rows(judged(now))
        assert rows(log.read()) == whole
        # What is written is what differs, not what was looked at.
        new = by_lead(judged(now))
        assert sorted(r["lead_id"] for r in delta.collect()) == sorted(i for i in old | new if old.get(i) != new.get(i))
        old = new
        if k == 1:
            assert not log.compact(share=5.0) and log.compact(share=0.0) and rows(log.read()) == whole
    nothing = update(log, rubric(), now, now)
    assert nothing.count() == 0 and rows(log.read()) == whole


def test_named_changes_are_taken_as_they_are(spark, tmp_path):
    world = World(5)
    now = world.inputs(spark)
    log = ChangeLog(spark, str(tmp_path / "verdicts"))
    log.create(judged(now))
    world.leads["l2"] = ("n1.example", "new", {"segment": "BUILDING", "acctbal": "9999", "nationno": "1"})
    before, now = now, world.inputs(spark)
    named = spark.createDataFrame([("l2",)], "lead_id string")
    update(log, rubric(), before, now, named, spark.createDataFrame([], "domain string"))
    assert rows(log.read()) == rows(judged(now))


def test_changed_keys_tell_nulls_maps_and_absent_sides(spark):
    schema = "k string, v int, m map<string,string>"
    a = spark.createDataFrame([("same", 1, {"x": "1", "y": "2"}), ("null", None, None), ("gone", 1, None), ("other", 1, {"x": "1"}), (None, 1, None)], schema)
    b = spark.createDataFrame([("same", 1, {"y": "2", "x": "1"}), ("null", None, {}), ("new", 1, None), ("other", 1, {"x": "2"})], schema)
    got = {r["k"] for r in changed_keys(a, b, "k").collect()}
    assert got == {"null", "gone", "new", "other", None}
    assert {r["k"] for r in changed_keys(None, b, "k").collect()} == {"same", "null", "new", "other"}
    assert changed_keys(None, None, "k") is None


def test_components_extended_equal_all_edges_at_once(spark):
    r = random.Random(8)
    edges, labels = [], spark.createDataFrame([], "node long, component long")
    for k in range(4):
        batch = [(r.randrange(120), r.randrange(120)) for _ in range(18)] + [(None, 3), (5, 5)] + ([(200, 100 + i) for i in range(30)] if k == 2 else [])
        edges += batch
        delta = materialize(extend_components(labels, spark.createDataFrame(batch, "a long, b long")), "delta")
        assert delta.count() == delta.select("node").distinct().count()
        old = {x["node"]: x["component"] for x in labels.collect()}
        assert all(old.get(x["node"]) != x["component"] for x in delta.collect())  # only what changes
        labels = materialize(labels.join(delta.select("node"), "node", "left_anti").unionByName(delta), "labels")
        want = connected_components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, want.select("node", "component").collect()))
    assert extend_components(labels, labels.where(F.lit(False)).select(F.col("node").alias("a"), F.col("component").alias("b"))).count() == 0
