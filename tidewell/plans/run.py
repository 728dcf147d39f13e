"""One run over a store: rows and events in, ranked leads, lists and health out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from tidewell.functions import text as tx
from tidewell.operators import detectors, events as ev, export, facts as facts_, identity, routing, rows as rows_, status as status_, tables
from tidewell.operators.lookup import find_person, person_keys
from tidewell.operators.people import primary_keys, survivors_filled
from tidewell.plans.evaluate import evaluate
from tidewell.plans.rubric import Rubric, compile_rubric, render
from tidewell.sources.schema import FIELD, TABLES
from tidewell.sources.store import Store
from tidewell.storage import materialize
from tidewell.streaming.intake import keyed_events, rejects, silent_kinds

OTHERS = "array<struct<value:string,source_id:string>>"


@dataclass(frozen=True)
class Input:
    """Rows of a source: ``order`` columns give their order, ``by_name`` allows matching by company and name, ``held`` says that a vendor holds these people."""

    source_id: str
    rows: DataFrame
    headers: Sequence[str]
    order: Sequence[str] = ()
    by_name: bool = False
    channel: str = ""
    held: bool = False


@dataclass
class State:
    """The tables of a run as they grow."""

    store: Store
    rubric: Rubric
    now: datetime
    run_id: str
    unicode: bool

    def __post_init__(self):
        self.t = {name: self.store.read(name) for name in TABLES}

    @property
    def spark(self):
        return self.store.spark


@dataclass(frozen=True)
class EventFile:
    """Rows of a file that are events, see ``events.event_rows``."""

    source_id: str
    rows: DataFrame
    headers: Sequence[str]


def run(
    store: Store, rubric_text: str, inputs: Sequence[Input], now: datetime, raw_events: DataFrame | None = None, tab: tuple[DataFrame, list[str]] | None = None, most_rows: int = 2_000, watched: Sequence[str] = (), unicode: bool = True,
    event_files: Sequence[EventFile] = (), polling: bool = False, enrich_after: timedelta = timedelta(days=90), most_domains: int = 100,
) -> int:
    """Take in rows and events, match people, judge all leads and commit everything at once; returns the generation.

    ``raw_events`` has seq, received_at, kind and body; ``event_files`` are events too; ``tab`` is the Companies tab with its headers. Row groups that were applied at
    their present hash and events that were seen are passed over, so a run again with the same input changes
    nothing but times. At most ``most_rows`` source rows are taken; the next run goes on. A run that fails commits nothing.

    The ledger is repaired first, and retry and resubscribe rows act once. What is to be pushed and looked up is planned within the
    rubric's limits (``push_plan``, ``enrichment_plan``: companies not looked up for ``enrich_after``); the calls are the driver's. With ``polling``, replies that the receiver tells do nothing.
    """
    s, new = work(store, rubric_text, inputs, now, raw_events, tab, most_rows, watched, unicode, event_files, polling, enrich_after, most_domains)
    untouched = ("overrides", "applied_overrides", "events", "log", "state", "enrichment_tries", "seen_events")
    writes = {n: s.t[n].select(*s.spark.createDataFrame([], TABLES[n].schema).columns) for n in TABLES if n not in untouched}
    keys = new.select("event_key", F.lit(now).alias("first_received_at"), F.lit(s.run_id).alias("run_id"))
    appends = {name: df for name, df in (("seen_events", keys), ("applied_overrides", s.used)) if not df.isEmpty()}
    return store.commit(writes, appends, now)


def dry_run(store: Store, rubric_text: str, inputs: Sequence[Input], now: datetime, *args, **options) -> dict[str, DataFrame]:
    """What ``run`` would change, with its arguments, and nothing written to the store: ``ranked``, ``exports`` and ``push_plan``.

    Each has its key, ``change`` (new, gone, changed, same) and both sides of the columns that matter.
    """
    s, _ = work(store, rubric_text, inputs, now, *args, **options)
    row = lambda df: df.withColumn("row", F.concat_ws("|", "lane_id", "lead_id"))
    return {
        "ranked": tables.difference(store.read("ranked"), s.t["ranked"], "lead_id", ["email", "score", "status", "lane"]),
        "exports": tables.difference(row(store.read("exports")), row(s.t["exports"]), "row", ["email", "do_not_contact"]),
        "push_plan": tables.difference(row(store.read("push_plan")), row(s.t["push_plan"]), "row", ["dest", "free", "reserve"]),
    }


def work(
    store: Store, rubric_text: str, inputs: Sequence[Input], now: datetime, raw_events: DataFrame | None = None, tab: tuple[DataFrame, list[str]] | None = None, most_rows: int = 2_000, watched: Sequence[str] = (), unicode: bool = True,
    event_files: Sequence[EventFile] = (), polling: bool = False, enrich_after: timedelta = timedelta(days=90), most_domains: int = 100,
) -> tuple[State, DataFrame]:
    """A run up to its commit: the tables as they will be, and the new events."""
    s = State(store, compile_rubric(rubric_text, unicode), now, f"run-{int(now.timestamp())}", unicode)
    new = take_events(s, raw_events, event_files)
    picked, matched = take_rows(s, inputs, new, most_rows)
    keep_people(s, inputs, picked, matched)
    keep_company_facts(s, picked, matched, tab)
    live = identity.live_leads(s.t["people"])
    live = materialize(live, "live")
    s.t["person_keys"] = person_keys(live, s.t["identities"])
    keep_outcomes(s, new.where(~ev.suppressed(polling)), live)
    keep_ledger(s, live)
    leads, verdicts, routed = judge(s, inputs, live)
    s.t["ranked"] = ranked(s, leads, verdicts, routed)
    keep_lists(s, leads, verdicts, routed, live)
    plan(s, routed, live, enrich_after, most_domains)
    health(s, raw_events, event_files, leads, watched)
    return s, new


def file_events(s: State, files: Sequence[EventFile], good: bool) -> list[DataFrame]:
    """Events of files, or the rows that are none; they come after what the receiver took, in the order of their files."""
    out = []
    for k, f in enumerate(files, 1):
        e = ev.event_rows(f.rows, f.source_id, f.headers, s.now).withColumn("seq", F.monotonically_increasing_id() + (k << 52))
        if good:
            e = ev.normalize_keys(e.where("reject IS NULL").drop("reject"), s.unicode)
            out.append(e.withColumn("event_key", ev.event_key()))
        else:
            out.append(e.where("reject IS NOT NULL").select(F.concat(F.lit(f"{f.source_id}:"), "reject").alias("key")))
    return out


def take_events(s: State, raw: DataFrame | None, files: Sequence[EventFile] = ()) -> DataFrame:
    """New events in order (``ord``); their keys are remembered for a year."""
    raw = raw if raw is not None else s.t["events"]
    seen = tables.trim(s.t["seen_events"], "first_received_at", F.lit(s.now - TABLES["seen_events"].keep))
    events = keyed_events(raw, s.unicode)
    for f in file_events(s, files, True):
        events = events.unionByName(f)
    return materialize(ev.ordered(ev.first_arrivals(events, seen), "received_at", "seq"), "run-events")


def keep_ledger(s: State, live: DataFrame) -> None:
    """The ledger as the run finds it, what rows of Overrides ask for once, and opt-outs by hand."""
    said = materialize(status_.resolve_overrides(s.t["overrides"], s.t["identities"], live, s.unicode), "run-said")
    lanes = routing.lane_frame(s.spark, s.rubric.lanes)
    repaired = status_.repair_ledger(s.t["pushes"], s.t["people"].select("lead_id", "merged_into"), lanes, s.run_id, s.now)
    s.t["pushes"] = materialize(status_.retries(repaired, said, s.t["applied_overrides"], s.now), "run-pushes")
    manual = status_.manual_status(said)
    out = status_.resubscribe(s.t["outcomes"], said, manual, s.t["applied_overrides"], live)
    s.t["outcomes"] = materialize(status_.opt_outs_by_hand(out, manual, s.now), "run-outcomes")
    s.used = materialize(status_.used_up(said, s.t["applied_overrides"], s.run_id, s.now), "run-used")


def plan(s: State, routed: DataFrame, live: DataFrame, enrich_after: timedelta, most_domains: int) -> None:
    """What is to be pushed and which companies are to be looked up, within the limits."""
    limits = s.rubric.limits
    used = routing.pushes_today(s.t["pushes"], s.now, limits.timezone).first()["used"] or 0
    people = lead_domains(s).join(live.where("lead_id = live_id").select("lead_id"), "lead_id", "left_semi")
    s.waits = materialize(routing.deal_waits(s.t["pushes"], people, s.t["outcomes"], live), "run-waits")
    s.t["push_plan"] = materialize(routing.push_plan(routed, s.waits, used, limits.max_pushes_per_run, limits.max_pushes_per_day), "run-plan")
    s.t["enrichment_plan"] = facts_.due_domains(people, s.t["enrichment_tries"], s.now, enrich_after, most_domains)


def take_rows(s: State, inputs: Sequence[Input], events: DataFrame, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the groups that are due, what they were matched to); a group of refused rows is remembered without a lead."""
    people = ev.receiver_rows(events)
    parts = [rows_.normalize(people, ["contact_id", "email", "linkedin_url", "full_name", "title", "company", "domain"], unicode=s.unicode)]
    for pos, i in enumerate(inputs):
        parts.append(rows_.normalize(rows_.input_rows(i.rows, i.source_id, i.headers, i.order, pos), i.headers, s.rubric.aliases, s.unicode))
    every = parts[0].select("source_id", "source_pos", "ord", "row_id", "row_hash", "fields", "reject")
    for p in parts[1:]:
        every = every.unionByName(p.select(*every.columns))
    names = [i.source_id for i in inputs if i.by_name]
    every = materialize(identity.refusals(every, names), "run-rows")
    due = rows_.pending(rows_.groups(every), s.t["applied_rows"])
    mine = F.col("source_id") == rows_.RECEIVER
    due = materialize(rows_.chunk(due.where(~mine), most_rows).unionByName(due.where(mine)), "run-groups")
    picked = materialize(every.join(due.select("source_id", "row_id"), ["source_id", "row_id"], "left_semi"), "run-picked")
    known = s.t["people"].select("lead_id", F.explode("fields").alias("field", "f")).select("lead_id", "field", "f.value", "f.source_id")
    live = identity.live_leads(s.t["people"])
    matched = identity.match_rows(picked, s.t["identities"], s.t["applied_rows"].select("source_id", "row_id", "lead_id"), int(s.now.timestamp() * 1000), names, known, live, s.unicode)
    matched = materialize(matched, "run-matched")
    groups = matched.groupBy("source_id", "row_id").agg(F.first("lead_id").alias("lead_id"), F.bool_or("key_conflict").alias("odd"))
    old = s.t["applied_rows"].select("source_id", "row_id", F.col("lead_id").alias("old_lead"), "first_applied_at", "key_conflict_at")
    applied = due.join(groups, ["source_id", "row_id"], "left").join(old, ["source_id", "row_id"], "left").select(
        "source_id", "row_id", F.col("hash").alias("row_hash"), F.coalesce("lead_id", "old_lead").alias("lead_id"), F.coalesce("first_applied_at", F.lit(s.now)).alias("first_applied_at"), F.coalesce("key_conflict_at", F.when(F.col("odd"), F.lit(s.now))).alias("key_conflict_at"),
    )
    s.t["applied_rows"] = materialize(tables.upsert(s.t["applied_rows"], applied, ["source_id", "row_id"]), "run-applied")
    return picked, matched


def keep_people(s: State, inputs: Sequence[Input], picked: DataFrame, matched: DataFrame) -> None:
    """Identities, fields, conflicts and merges."""
    r = picked.join(matched, ["source_id", "row_id", "ord"])
    get = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(""))
    keys = F.array(F.struct(F.lit("email").alias("kind"), get("email").alias("key"), F.col("email_conflict").alias("odd")), F.struct(F.lit("linkedin").alias("kind"), get("linkedin_url").alias("key"), F.col("url_conflict").alias("odd")))
    brought = r.select("lead_id", "source_id", "at", F.explode(keys).alias("k")).where("k.key != '' AND NOT k.odd")
    first = brought.groupBy("k.key", "k.kind").agg(F.min_by(F.struct("lead_id", "source_id"), "at").alias("v")).select("key", "kind", "v.lead_id", "v.source_id", F.lit(s.now).alias("first_seen_at"))
    s.t["identities"] = materialize(s.t["identities"].unionByName(first.join(s.t["identities"].select("key"), "key", "left_anti")), "run-identities")

    stored = s.t["people"].select("lead_id", F.explode("fields").alias("field", "v"))
    known = stored.select("lead_id", "field", "v.value", "v.source_id")
    filled = identity.lead_fields(picked, matched, known).withColumn("v", F.struct("value", "source_id", F.lit(s.now).alias("at"), "derived").cast(FIELD))
    same = filled.join(stored.select("lead_id", "field", F.col("v").alias("old")), ["lead_id", "field"], "full_outer")
    long = same.select("lead_id", "field", F.when(F.col("v").isNull() | F.col("old.value").eqNullSafe(F.col("v.value")), F.col("old")).otherwise(F.col("v")).alias("v"))
    held = [i.source_id for i in inputs if i.held]
    born = matched.groupBy("lead_id").agg(F.bool_or(F.col("source_id").isin(held) if held else F.lit(False)).alias("held"))
    people = s.t["people"].drop("fields", "conflicts").join(born, "lead_id", "full_outer").select(
        "lead_id", F.coalesce("created_at", F.lit(s.now)).alias("created_at"), F.coalesce("held_at", F.when(F.col("held"), F.lit(s.now))).alias("held_at"), "merged_into", "first_seen",
    )

    # Sources that said something else than what was kept.
    told = r.select("lead_id", "source_id", F.explode("fields").alias("field", "value")).where("value != '' AND field NOT IN ('email', 'linkedin_url', 'company.domain')")
    odd = told.join(long, ["lead_id", "field"]).where("value != v.value AND source_id != v.source_id").select("lead_id", "field", F.struct("value", "source_id").alias("x"))
    before = s.t["people"].select("lead_id", F.explode("conflicts").alias("field", "xs")).select("lead_id", "field", F.explode("xs").alias("x"))
    each = odd.unionByName(before).groupBy("lead_id", "field").agg(F.array_sort(F.collect_set("x")).cast(OTHERS).alias("xs"))
    conflicts = each.groupBy("lead_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "xs")))).alias("conflicts"))

    # Merges by hand; the survivor's empty fields are filled.
    people = materialize(people, "run-people")
    said = status_.resolve_overrides(s.t["overrides"], s.t["identities"], identity.live_leads(people), s.unicode)
    said = said.where("action = 'same_as' AND invalid IS NULL AND lead_id IS NOT NULL AND other_id IS NOT NULL").select("lead_id", "other_id")
    merges = materialize(identity.merge_edges(people, said), "run-merges")
    people = people.drop("merged_into").join(people.select("lead_id", F.col("merged_into").alias("was")), "lead_id").join(merges, "lead_id", "left").withColumn("merged_into", F.coalesce("merged_into", "was")).drop("was")
    long = survivors_filled(long, merges, people)
    fields = long.groupBy("lead_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "v")))).alias("fields"))
    s.t["people"] = materialize(people.join(fields, "lead_id", "left").join(conflicts, "lead_id", "left"), "run-people")


def lead_domains(s: State) -> DataFrame:
    return s.t["people"].select("lead_id", F.coalesce(F.try_element_at("fields", F.lit("company.domain"))["value"], F.lit("")).alias("domain"))


def keep_company_facts(s: State, picked: DataFrame, matched: DataFrame, tab: tuple[DataFrame, list[str]] | None) -> None:
    own = F.try_element_at("fields", F.lit("company.domain"))
    r = picked.join(matched.select("source_id", "row_id", "ord", "lead_id"), ["source_id", "row_id", "ord"]).join(lead_domains(s).withColumnRenamed("domain", "lead_domain"), "lead_id")
    r = r.withColumn("row_domain", F.coalesce(own, tx.company_domain_of(F.try_element_at("fields", F.lit("email")))))
    out = facts_.apply_facts(s.t["company_facts"], facts_.input_facts(r, s.now).select("domain", "fact", "value"), "input", s.now)
    if tab is not None:
        out = facts_.apply_facts(out, facts_.tab_facts(tab[0], tab[1]), "companies_tab", s.now, owns_missing=True)
    s.t["company_facts"] = materialize(out, "run-facts")


def keep_outcomes(s: State, new: DataFrame, live: DataFrame) -> None:
    """What events did to leads, and what detectors keep of them."""
    e = materialize(ev.find_person(new, s.t["identities"], s.t["applied_rows"], live), "run-persons")
    people = live.where("lead_id = live_id").select("lead_id").join(lead_domains(s), "lead_id")
    old = s.t["outcomes"]
    done = ev.outcomes(e, ev.key_owners(e, s.t["identities"], s.t["applied_rows"]), old)
    deals = ev.deals(e, people, old.select("lead_id", "deal_id"))
    was = old.select("lead_id", "status", "status_at", *(F.col(c).alias(f"old_{c}") for c in ("deal_id", "deal_stage", "deal_checked_at")))
    out = done.join(deals, "lead_id", "full_outer").join(was, "lead_id", "full_outer")
    for c in ("deal_id", "deal_stage", "deal_checked_at"):
        out = out.withColumn(c, F.coalesce(c, f"old_{c}"))
    s.t["outcomes"] = materialize(out.drop("old_deal_id", "old_deal_stage", "old_deal_checked_at"), "run-outcomes")
    keep = TABLES["window_events"].keep
    s.t["window_events"] = materialize(tables.trim(s.t["window_events"].unionByName(ev.window_rows(e, s.now, keep)), "at", F.lit(s.now - keep)), "run-windows")
    at = e.withColumns({"at": ev.event_time(), "kind": F.lower("kind")})
    firsts = detectors.first_seen(at, "lead_id").unionByName(s.t["people"].select("lead_id", F.explode("first_seen").alias("kind", "at"))).groupBy("lead_id", "kind").agg(F.min("at").alias("at"))
    maps = firsts.groupBy("lead_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "at")))).alias("first_seen"))
    s.t["people"] = materialize(s.t["people"].drop("first_seen").join(maps, "lead_id", "left"), "run-people")
    company = at.join(lead_domains(s).withColumnRenamed("domain", "own"), "lead_id", "left").withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), F.nullif("own", F.lit(""))))
    s.t["company_first_seen"] = detectors.first_seen(company, "domain").unionByName(s.t["company_first_seen"]).groupBy("domain", "kind").agg(F.min("at").alias("at"))


def judge(s: State, inputs: Sequence[Input], live: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(live leads with status, verdicts, lanes per lead)."""
    spark, rubric = s.spark, s.rubric
    people = s.t["people"].join(live.where("lead_id = live_id").select("lead_id"), "lead_id", "left_semi").join(lead_domains(s), "lead_id")
    said = status_.resolve_overrides(s.t["overrides"], s.t["identities"], live, s.unicode)
    pushes = s.t["pushes"]
    family = status_.family_outcomes(s.t["outcomes"], live)
    at = people.select("lead_id", "domain")
    folded = status_.fold_status(at, family, status_.manual_status(said), status_.deal_holds(at, s.t["outcomes"], pushes, live), status_.cold_pushed_at(pushes, live))
    channels = spark.createDataFrame([(i.source_id, i.channel or i.source_id) for i in inputs], "source_id string, channel string")
    seen = identity.sources_seen(s.t["applied_rows"].select("lead_id", "source_id"), s.t["identities"].select("lead_id", "source_id"), live, channels)
    text = lambda n: F.try_element_at("fields", F.lit(n))["value"]
    apart = said.where("action = 'distinct' AND invalid IS NULL").select(F.col("lead_id").alias("a"), F.col("other_id").alias("b"))
    twins = identity.namesakes(people.select("lead_id", "domain", text("full_name").alias("full_name")), apart, s.unicode)
    twins = twins.unionByName(live.where("cycle").select(F.col("live_id").alias("lead_id"))).distinct().withColumn("duplicate", F.lit(True))
    leads = people.select("lead_id", "domain", F.col("created_at").alias("first_seen_at"), "held_at", text("full_name").alias("full_name"), text("title").alias("title"), F.map_keys(F.coalesce("conflicts", F.create_map().cast(f"map<string,{OTHERS}>"))).alias("conflict_fields"), F.transform_values("fields", lambda k, v: v["value"]).alias("fields"))
    leads = leads.join(primary_keys(s.t["people"], s.t["identities"], live), "lead_id", "left").join(folded, "lead_id").join(seen, "lead_id", "left").join(twins, "lead_id", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))
    leads = materialize(leads, "run-leads")

    w = s.t["window_events"].join(live.select("lead_id", "live_id"), "lead_id", "left").withColumn("lead_id", F.coalesce("live_id", "lead_id")).drop("live_id")
    w = w.join(at.withColumnRenamed("domain", "own"), "lead_id", "left").withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), F.nullif("own", F.lit(""))))
    lead_seen = s.t["people"].select("lead_id", F.explode("first_seen").alias("kind", "at")).join(live.select("lead_id", "live_id"), "lead_id").groupBy(F.col("live_id").alias("lead_id"), "kind").agg(F.min("at").alias("at"))
    fire = lambda subject, key, seen_: detectors.evaluate_detectors([d for d in rubric.detectors if d.subject == subject], w, seen_, s.t["company_facts"], key, s.now, s.unicode)
    companies = facts_.wide(s.t["company_facts"]).join(leads.where("domain != ''").groupBy("domain").agg(F.count(F.lit(1)).alias("leads_seen")), "domain", "full_outer")
    verdicts = materialize(evaluate(rubric, leads, companies, fire("lead", "lead_id", lead_seen), fire("company", "domain", s.t["company_first_seen"])), "run-verdicts")
    checked = leads.drop("domain", "status").join(verdicts.select("lead_id", "domain", "status", "score", "lanes", "blocked"), "lead_id")
    lanes = routing.lane_frame(spark, rubric.lanes)
    routed = materialize(routing.route(routing.lane_checks(checked, lanes, pushes, live)), "run-routed")
    return leads, verdicts, routed


def ranked(s: State, leads: DataFrame, verdicts: DataFrame, routed: DataFrame) -> DataFrame:
    """One row a live lead: who it is, what was derived, its scores and status, its lane, and why."""
    shown = [F.struct(F.lit(d.name).alias("k"), _shown(d.name, dict(verdicts.dtypes)[d.name]).alias("v")) for d in s.rubric.derive]
    derived = F.map_from_entries(F.array(*shown)) if shown else F.create_map().cast("map<string,string>")
    planned = routing.planned_lanes(routed)
    v = verdicts.join(planned, "lead_id", "left").join(leads.select("lead_id", "email", "linkedin_url", "full_name"), "lead_id")
    skipped = F.coalesce("skipped", F.array().cast("array<string>"))
    reasons = F.when(F.col("blocked").isNotNull(), F.concat("reasons", F.array(F.concat(F.lit("blocked: "), "blocked")))).otherwise(F.concat("reasons", skipped))
    return v.select(
        "lead_id", "email", "linkedin_url", "full_name", F.col("domain").alias("company_domain"), derived.alias("derived"), "account_score", "contact_score", "score", "status",
        F.when(F.col("blocked").isNull(), F.col("lane")).alias("lane"), F.array_join(reasons, "; ").alias("reasons"), "rubric_version",
    )


def _shown(name: str, kind: str):
    c = F.col(name)
    made = tx.format_number(c) if kind == "double" else tx.format_time(c) if kind == "timestamp" else c.cast("string")
    return F.coalesce(made, F.lit(""))


def keep_lists(s: State, leads: DataFrame, verdicts: DataFrame, routed: DataFrame, live: DataFrame) -> None:
    """New rows of export lanes, and the state of all rows."""
    who = leads.select("lead_id", "email", "linkedin_url", "full_name", F.col("domain").alias("company_domain"))
    why = verdicts.select("lead_id", F.array_join("reasons", "; ").alias("reasons"))
    cand = routed.where("kind = 'export' AND why IS NULL AND match_pos IS NOT NULL").select("lane_id", "lane_pos", "lead_id", "score").join(who, "lead_id").join(why, "lead_id")
    new = export.newly_listed(cand, s.t["exports"], live, s.rubric.limits.max_pushes_per_run, s.now)
    listed = materialize(s.t["exports"].unionByName(new.select(*s.t["exports"].columns)), "run-lists")
    fam = live.select("lead_id", "live_id")
    held = s.t["pushes"].where(routing.holds_cold()).join(fam, "lead_id").groupBy(F.col("live_id").alias("lead_id")).agg(F.min("lane_id").alias("cold_held"))
    open_ = s.t["pushes"].where("lane_kind = 'cold' AND state = 'pending'").join(fam, "lead_id").groupBy(F.col("live_id").alias("lead_id")).agg(F.min("lane_id").alias("cold_open"))
    x = leads.drop("status").join(verdicts.select("lead_id", "status", "lanes", "blocked"), "lead_id").join(held, "lead_id", "left").join(open_, "lead_id", "left")
    s.t["exports"] = export.refresh(listed, live, x, [lane.id for lane in s.rubric.lanes if lane.kind == "cold"], True, s.now)


def push_health(pushes: DataFrame, people: DataFrame, now: datetime, late: timedelta = timedelta(hours=24)) -> DataFrame:
    """``kind, key, value``: failed steps one by one, and how many wait for longer than ``late``, with the oldest; steps of merged leads do not count."""
    p = pushes.join(people.where("merged_into IS NOT NULL AND merged_into != ''").select("lead_id"), "lead_id", "left_anti")
    failed = p.where("state = 'failed'").select(F.lit("push_failed").alias("kind"), F.concat_ws("|", "lead_id", "lane_id", "step").alias("key"), F.col("last_error").alias("value"))
    since = F.coalesce("first_started_at", "updated_at")
    waits = p.where("state = 'pending'").select(since.alias("since")).where(F.col("since") < F.lit(now - late)).agg(F.count(F.lit(1)).alias("n"), F.min("since").alias("oldest")).where("n > 0")
    return failed.unionByName(waits.select(F.lit("push_pending").alias("kind"), F.lit("").alias("key"), F.concat(F.col("n").cast("string"), F.lit(" since "), tx.format_time(F.col("oldest"))).alias("value")))


def health(s: State, raw: DataFrame | None, files: Sequence[EventFile], leads: DataFrame, watched: Sequence[str]) -> None:
    """What a person should look at, one row a thing; rows that were there keep the time they were first seen."""
    row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), value.alias("value"))
    refused = s.t["applied_rows"].where("lead_id IS NULL")
    found = row(refused.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")), "rows_refused", "source_id", F.col("n").cast("string"))
    odd = s.t["applied_rows"].where("key_conflict_at IS NOT NULL").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    found = found.unionByName(row(odd, "key_conflicts", "source_id", F.col("n").cast("string")))
    found = found.unionByName(row(leads.where("duplicate"), "duplicate", "lead_id", F.lit("")))
    found = found.unionByName(row(leads.where("override_block IS NOT NULL"), "override_block", "lead_id", F.col("override_block")))
    found = found.unionByName(push_health(s.t["pushes"], s.t["people"], s.now))
    raw = raw if raw is not None else s.t["events"]
    found = found.unionByName(row(rejects(raw).where("reject IS NOT NULL"), "event_refused", "seq", F.col("reject")))
    for bad in file_events(s, files, False):
        found = found.unionByName(row(bad.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "event_rows_refused", "key", F.col("n").cast("string")))
    found = found.unionByName(row(s.waits, "deal_waits", "lead_id", F.lit("another lead at the company has a deal step without a result")))
    if watched:
        last = s.t["seen_events"].sparkSession.createDataFrame([], "kind string, last_received timestamp")
        got = ev.last_received(ev.parse_raw(raw).where("kind IS NOT NULL"), s.now)
        found = found.unionByName(row(silent_kinds(last.unionByName(got), list(watched), s.now), "silent", "kind", F.when(F.col("last_received").isNull(), "never").otherwise(tx.format_time(F.col("last_received")))))
    found = found.withColumn("value", tx.redact(F.col("value")))  # errors of vendors and bodies may quote what must not be shown
    old = s.t["health"].select("kind", "key", F.col("value").alias("was"), "first_seen_at", F.col("updated_at").alias("then"))
    j = found.join(old, ["kind", "key"], "left")
    s.t["health"] = j.select("kind", "key", "value", F.coalesce("first_seen_at", F.lit(s.now)).alias("first_seen_at"), F.when(F.col("was").eqNullSafe(F.col("value")), F.coalesce("then", F.lit(s.now))).otherwise(F.lit(s.now)).alias("updated_at"))


def explain_person(store: Store, key: str, unicode: bool = True) -> list[str]:
    """The ranked rows of whoever goes by ``key``: a lead id, an email or a profile URL; merged leads are followed.

    The key files and the ranked rows lie in ranges, so each is read where the key is. A store that was written without key files is scanned.
    """
    keys = store.read("person_keys") if "person_keys" in store.manifest()["tables"] else person_keys(identity.live_leads(store.read("people")), store.read("identities"))
    live = find_person(keys, key, unicode)
    out = []
    for r in store.read("ranked").where(F.col("lead_id").isin(*live)).orderBy("lead_id").collect():
        lines = [f"{r['full_name'] or r['email'] or r['lead_id']} ({r['status']})", *(f"{k}: {v or render(None)}" for k, v in sorted(r["derived"].items()))]
        lines.append(f"score: {render(r['score'])} (account {render(r['account_score'])}, contact {render(r['contact_score'])})")
        out.append("\n".join([*lines, f"lane: {r['lane'] or 'none'}", *(f"  - {x}" for x in (r["reasons"] or "").split("; ") if x), f"rubric: {r['rubric_version']}"]))
    return out
