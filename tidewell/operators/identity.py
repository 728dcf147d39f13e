"""Who is who: matching of rows to leads by keys, merges, namesakes."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions import text as tx
from tidewell.operators.components import connected_components
from tidewell.operators.rows import RECEIVER
from tidewell.storage import materialize


def lead_id_for(run_ms: int, key: Column) -> Column:
    """A version 7 UUID from the run's clock and a key: a replay of the run gives the same id."""
    h, ms = F.sha2(F.concat(F.lit(f"{run_ms}|"), key), 256), f"{run_ms & ((1 << 48) - 1):012x}"
    variant = F.substring(F.translate(F.substring(h, 4, 1), "0123456789abcdef", "89ab89ab89ab89ab"), 1, 1)
    return F.concat(F.lit(f"{ms[:8]}-{ms[8:]}-7"), F.substring(h, 1, 3), F.lit("-"), variant, F.substring(h, 5, 3), F.lit("-"), F.substring(h, 8, 12))


def _field(name: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(name)), F.lit(""))


def refusals(rows: DataFrame, by_name_sources: Iterable[str] = ()) -> DataFrame:
    """``rows`` with the reason in ``reject`` also for those that have no key their source may be matched by."""
    names = F.lit(False)
    for n in by_name_sources:
        names = names | (F.col("source_id") == n)
    keyless = (_field("email") == "") & (_field("linkedin_url") == "") & ~names
    return rows.withColumn("reject", F.coalesce("reject", F.when(keyless, F.lit("no email or profile URL, and this source is not matched by company and name"))))


def match_rows(
    rows: DataFrame, identities: DataFrame, applied: DataFrame, run_ms: int, by_name_sources: Iterable[str] = (), known_fields: DataFrame | None = None, live: DataFrame | None = None, unicode: bool = True
) -> DataFrame:
    """Match normalized rows to leads: ``source_id, row_id, ord, lead_key, lead_id, created, key_conflict, email_conflict, url_conflict, at``.

    ``rows`` comes from ``rows.normalize``; those that ``refusals`` refuses are passed over. ``identities`` has key, kind
    (email, linkedin), lead_id, source_id; ``applied`` source_id, row_id, lead_id; ``known_fields`` lead_id, field, value,
    source_id; ``live`` lead_id, live_id, by which stored leads are followed to those they were merged into.

    The rules. Rows of one source and row id are one group, which takes its turn where its first row stands and has
    one lead: the one it had before; else the owner of its first row's email; else, if that row has no email, the owner of its
    profile URL; else, where its source is matched by name, the only lead whose company and full name are the row's; else a new one.
    An email belongs to the first lead that brings it. So does a profile URL, among leads that have none yet. A row whose email or URL
    ends up with another lead is a conflict. A lead's company (stated, or else of its email) and name are the first it was given.

    How. Emails and groups need no turn by turn work: who first brings an email is an aggregate, and a group points at the group that
    owns its first email, which is an earlier one. Profile URLs are an aggregate too where no lead brings two and nobody is matched by name.
    Names that nobody with a URL goes by are settled by aggregates as well (``_by_name_alone``).
    Only leads that bring several URLs, and groups to be matched by a name that is tied to URLs, are settled in turn (``_take_turns``), a
    component of those that share URLs or names at a time, from one event a lead and key; of all others
    that bring one of their URLs only the first can matter. A URL or email that a large part of all rows hold is one event.
    A company and a name that a lead has from rows of different ids, tied by a URL that is settled in turn, are not asked for by name.
    """
    names = list(by_name_sources)
    own, name = _field("company.domain"), tx.normalize_name(_field("full_name"), unicode)
    base = refusals(rows, names).select("source_id", "row_id", "source_pos", "ord", _field("email").alias("email"), _field("linkedin_url").alias("url"), own.alias("own"), name.alias("name"), "reject")
    base = materialize(base, "person-rows")
    # A written table, so that the rows of one id that a large part of all rows have can be split in the join.
    first = materialize(base.groupBy("source_id", "row_id").agg(F.min(F.struct("source_pos", "ord")).alias("first")), "groups-first")
    place = lambda pos, ord_: F.concat_ws("|", F.lpad(F.col(pos).cast("string"), 10, "0"), F.lpad(F.col(ord_).cast("string"), 20, "0"))
    r = base.where("reject IS NULL").drop("reject").join(first, ["source_id", "row_id"])
    r = r.withColumn("domain", F.when(F.col("own") != "", F.col("own")).otherwise(F.coalesce(tx.company_domain_of(F.col("email")), F.lit(""))))
    r = r.withColumn("node", F.concat_ws("|", place("first.source_pos", "first.ord"), "source_id", "row_id"))
    r = materialize(r.withColumn("at", F.concat_ws("|", "node", place("source_pos", "ord"))).drop("first"), "person-turns")

    follow = (lambda df: df) if live is None else lambda df: df.join(live.select("lead_id", "live_id"), "lead_id", "left").withColumn("lead_id", F.coalesce("live_id", "lead_id")).drop("live_id")
    known = follow(identities.where("lead_id IS NOT NULL").select("kind", "key", "lead_id"))
    before = follow(applied.where("lead_id IS NOT NULL").select("source_id", "row_id", "lead_id")).dropDuplicates(["source_id", "row_id"])

    # Emails and groups.
    brought = r.where("email != ''").groupBy("email").agg(F.min_by("node", "at").alias("node"))
    emails = brought.join(known.where("kind = 'email'").select(F.col("key").alias("email"), F.col("lead_id").alias("held")), "email", "left")
    emails = materialize(emails, "emails")
    groups = r.groupBy("node", "source_id", "row_id").agg(F.min_by(F.struct("email", "url", "own", "name"), "at").alias("head"))
    groups = groups.join(before, ["source_id", "row_id"], "left").select("node", "source_id", "row_id", "lead_id", "head.*")
    up = emails.select("email", F.col("node").alias("owner"), "held")
    groups = groups.join(up, "email", "left").select(
        "node", "source_id", "row_id", "email", "url", "own", "name", F.coalesce("lead_id", "held").alias("stored"),
        F.when(F.coalesce("lead_id", "held").isNull() & (F.col("email") != ""), F.col("owner")).otherwise(F.col("node")).alias("parent"),
    )
    groups = materialize(groups, "groups")
    step = groups.where("parent != node").select("node", "parent")
    if not step.join(step.select(F.col("node").alias("parent")), "parent", "left_semi").isEmpty():
        roots = connected_components(step, "node", "parent").select("node", F.col("component").alias("root"))
    else:
        roots = step.select("node", F.col("parent").alias("root"))
    groups = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    top = groups.where("root = node").select("node", F.coalesce(F.concat(F.lit("lead:"), "stored"), "node").alias("entity"), (F.col("stored").isNull() & (F.col("email") == "")).alias("open"), F.concat_ws("|", "source_id", "row_id").alias("made"))
    groups = groups.select("node", "root", "source_id", "row_id", "url", "own", "name").join(top.withColumnRenamed("node", "root"), "root")
    groups = materialize(groups, "entities")

    # Profile URLs, and companies with names.
    held = known.where("kind = 'linkedin'").select(F.col("key").alias("url"), F.concat(F.lit("lead:"), "lead_id").alias("owner"))
    if known_fields is not None:
        stored = follow(known_fields.where("lead_id IS NOT NULL AND value != ''").select("lead_id", "field", "value")).withColumn("entity", F.concat(F.lit("lead:"), "lead_id"))
    else:
        stored = rows.sparkSession.createDataFrame([], "lead_id string, field string, value string, entity string")
    lines = r.join(groups.select("node", "entity", "open"), "node").select("entity", "open", "at", "url", "own", "domain", "name")
    by_name = F.col("source_id").isin(names) & (F.col("own") != "") & (F.col("name") != "") if names else F.lit(False)
    asks = groups.where(F.col("open") & (F.col("root") == F.col("node"))).select("entity", F.col("node").alias("at"), "url", F.when(by_name, F.concat_ws("\x1f", "own", "name")).alias("asked"))
    claims = lines.where("url != ''").groupBy("entity", "open", "url").agg(F.min("at").alias("at"))
    claims = materialize(claims, "url-claims")
    if names or not claims.isEmpty():
        owners, same = _profile_urls(claims, asks, lines, held, stored, bool(names), unicode)
    else:
        owners, same = held, held.select(F.col("url").alias("entity"), F.col("owner").alias("same")).limit(0)
    moved = groups.join(same, "entity", "left").withColumn("entity", F.coalesce("same", "entity")).drop("same")
    leads = moved.where("root = node").groupBy("entity").agg(F.min_by("made", "node").alias("made"))
    old = F.when(F.col("entity").startswith("lead:"), F.substring("entity", 6, 1 << 20))
    leads = leads.select("entity", F.coalesce(old, "made").alias("lead_key"), F.coalesce(old, lead_id_for(run_ms, F.col("made"))).alias("lead_id"), old.isNull().alias("created"))
    final = materialize(moved.select("node", "entity").join(leads, "entity"), "leads")

    # Each row with its lead, and whose its keys are.
    mail = materialize(emails.join(final.select("node", F.col("entity").alias("of")), "node").select("email", F.coalesce(F.concat(F.lit("lead:"), "held"), "of").alias("email_of")), "email-owners")
    urls = materialize(owners.join(same.select(F.col("entity").alias("owner"), "same"), "owner", "left").select("url", F.coalesce("same", "owner").alias("url_of")), "url-owners")
    out = r.select("source_id", "row_id", "ord", "at", "node", "email", "url").join(final, "node").join(mail, "email", "left").join(urls, "url", "left")
    odd = lambda key: (F.col(key) != "") & ~F.col(f"{key}_of").eqNullSafe(F.col("entity"))
    return out.select("source_id", "row_id", "ord", "lead_key", "lead_id", "created", (odd("email") | odd("url")).alias("key_conflict"), odd("email").alias("email_conflict"), odd("url").alias("url_conflict"), "at")


def lead_fields(rows: DataFrame, matched: DataFrame, known_fields: DataFrame | None = None) -> DataFrame:
    """``lead_id, field, value, source_id, derived``: what leads are filled with, the first value of each field in turn.

    ``rows`` are normalized, ``matched`` is what ``match_rows`` made of them; ``known_fields`` (lead_id, field, value, source_id) stay. Keys in
    conflict are not written. A lead without a stated company gets that of its first work email, marked ``derived``.
    The receiver may correct the email it gave itself: the last email that its group brought counts, unless
    another group of the lead is the receiver's too or goes by an address that would be replaced.
    """
    # A written table, as ``matched`` should be: rows are normalized and joined once, and not for each of the aggregates below.
    r = materialize(rows.select("source_id", "row_id", "ord", "fields").join(matched, ["source_id", "row_id", "ord"]), "matched-fields")
    skip = lambda k: ((k == "email") & F.col("email_conflict")) | ((k == "linkedin_url") & F.col("url_conflict"))
    long = r.select("lead_id", "source_id", "row_id", "at", "email_conflict", F.explode(F.map_filter("fields", lambda k, v: ~skip(k))).alias("field", "value")).where("value != ''")
    work = r.select("lead_id", "source_id", "at", tx.company_domain_of(_field("email")).alias("value")).where("value IS NOT NULL")
    given = long.select("lead_id", "field", "value", "source_id", F.lit(False).alias("derived"), F.struct(F.lit(1).alias("k"), "at").alias("o"))
    given = given.unionByName(work.select("lead_id", F.lit("company.domain").alias("field"), "value", "source_id", F.lit(True).alias("derived"), F.struct(F.lit(1).alias("k"), "at").alias("o")))
    if known_fields is not None:
        kept = known_fields.where("value != ''").select("lead_id", "field", "value", "source_id", F.lit(False).alias("derived"), F.struct(F.lit(0).alias("k"), F.lit("").alias("at")).alias("o"))
        given = given.unionByName(kept)
    # A row's own company goes before the one of its email.
    filled = given.groupBy("lead_id", "field").agg(F.min_by(F.struct("value", "source_id", "derived"), F.struct("o", "derived")).alias("v")).select("lead_id", "field", "v.*")
    mails = long.where("field = 'email'")
    groups = matched.groupBy("lead_id").agg(F.count_distinct(F.when(F.col("source_id") == RECEIVER, F.col("row_id"))).alias("receivers"))
    brought = mails.groupBy("lead_id", "value").agg(F.min(F.struct("at", "source_id", "row_id")).alias("by"))
    named = matched.select("lead_id", F.col("row_id").alias("value"), F.lit(True).alias("named")).distinct()
    steps = brought.where(F.col("by.source_id") == RECEIVER).join(groups.where("receivers = 1"), "lead_id").join(named, ["lead_id", "value"], "left")
    stop = F.min(F.when(F.col("named"), F.col("by.at")))
    last = steps.groupBy("lead_id").agg(stop.alias("stop"), F.min_by("value", "by.at").alias("first"), F.collect_list(F.struct(F.col("by.at").alias("at"), "value")).alias("all"))
    right = F.array_max(F.filter("all", lambda x: F.col("stop").isNull() | (x["at"] <= F.col("stop"))))["value"]
    fix = last.select("lead_id", F.lit("email").alias("field"), F.col("first").alias("value"), right.alias("right"))
    out = filled.join(fix, ["lead_id", "field", "value"], "left")
    return out.select("lead_id", "field", F.coalesce("right", "value").alias("value"), "source_id", "derived")


def _profile_urls(claims: DataFrame, asks: DataFrame, lines: DataFrame, held: DataFrame, stored: DataFrame, by_name: bool, unicode: bool) -> tuple[DataFrame, DataFrame]:
    """(url, owner) of all URLs, and (entity, same) of the open entities that are another lead."""
    by_aggregates = None
    if by_name:
        by_aggregates = _by_name_alone(claims, asks, lines, held, stored, unicode)
        asks = asks.join(by_aggregates.select("entity", F.lit(True).alias("__settled")), "entity", "left").withColumn("asked", F.when(F.col("__settled").isNull(), F.col("asked"))).drop("__settled")
        asks = materialize(asks, "name-asks-left")
    has = held.select(F.col("owner").alias("entity"), "url").unionByName(stored.where("field = 'linkedin_url'").select("entity", F.col("value").alias("url"))).distinct()
    several = claims.select("entity", "url").unionByName(has).distinct().groupBy("entity").count().where("count > 1").select("entity")
    hard = materialize(several.unionByName(asks.where("asked IS NOT NULL").select("entity")).distinct(), "in-turn")
    free = held.select("url").distinct()
    if hard.isEmpty():
        mine = claims.join(free, "url", "left_anti").groupBy("url").agg(F.min_by("entity", "at").alias("owner"))
        owners = held.unionByName(mine)
    else:
        shared = claims.join(hard, "entity", "left_semi").select("url").distinct()
        plain = claims.join(free, "url", "left_anti").join(shared, "url", "left_anti").groupBy("url").agg(F.min_by("entity", "at").alias("owner"))
        if by_name:  # what the rows of these give their lead can make it the one that is asked for
            hard = materialize(hard.unionByName(asks.join(shared, "url", "left_semi").select("entity")).distinct(), "in-turn")
            settled = held.join(shared, "url", "left_anti").unionByName(plain).withColumnRenamed("owner", "lead")
            joined = asks.join(hard, "entity", "left_anti").join(settled, "url").select("entity", "lead")
            lines = lines.join(joined, "entity", "left").withColumn("entity", F.coalesce("lead", "entity"))
        turns = claims.join(hard, "entity", "left_semi").select("entity", "url", "at")
        others = claims.join(hard, "entity", "left_anti").join(shared, "url", "left_semi").groupBy("url").agg(F.min_by("entity", "at").alias("entity"), F.min("at").alias("at"))
        none = F.lit(None).cast("string")
        event = lambda what, df, key: df.select(F.lit(what).alias("what"), "entity", "at", F.col(key).alias("key"), none.alias("other"))
        events = event("claim", turns, "url").unionByName(event("claim", others, "url"))
        events = events.unionByName(asks.join(hard, "entity", "left_semi").select(F.lit("ask").alias("what"), "entity", "at", F.col("url").alias("key"), F.col("asked").alias("other")))
        events = events.unionByName(event("held", held.join(shared, "url", "left_semi").select(F.col("owner").alias("entity"), F.lit("").alias("at"), "url"), "url"))
        edges = events.where("key != ''").select(F.concat(F.lit("e:"), "entity").alias("a"), F.concat(F.lit("u:"), "key").alias("b"))
        if by_name:
            fields = stored.where("field IN ('company.domain', 'full_name')").select("entity", F.lit("").alias("at"), F.when(F.col("field") == "company.domain", "domain").otherwise("name").alias("what"), F.when(F.col("field") == "full_name", tx.normalize_name(F.col("value"), unicode)).otherwise(F.col("value")).alias("key"))
            told = lines.select("entity", "at", F.explode(F.create_map(F.lit("domain"), "domain", F.lit("name"), "name")).alias("what", "key"))
            told = told.unionByName(fields).where("key != ''").groupBy("entity", "what").agg(F.min_by("key", "at").alias("key"), F.min("at").alias("at"))
            full = told.groupBy("entity").pivot("what", ["domain", "name"]).agg(F.first("key")).where("domain IS NOT NULL AND name IS NOT NULL").select("entity", F.concat_ws("\x1f", "domain", "name").alias("asked"))
            asked = asks.where("asked IS NOT NULL").select("asked").distinct()
            edges = edges.unionByName(full.join(asked, "asked", "left_semi").unionByName(asks.where("asked IS NOT NULL").select("entity", "asked")).select(F.concat(F.lit("e:"), "entity").alias("a"), F.concat(F.lit("n:"), "asked").alias("b")))
            events = events.unionByName(told.select("what", "entity", "at", "key", none.alias("other")))
        events = events.unionByName(event("has", has.withColumn("at", F.lit("")), "url"))
        part = materialize(connected_components(edges), "turns")
        of = part.where(part["node"].startswith("e:")).select(F.substring("node", 3, 1 << 20).alias("entity"), "component")
        settled = materialize(events.join(of, "entity").groupBy("component").applyInPandas(_take_turns, "url string, owner string, entity string, same string"), "settled")
        taken = settled.where("url IS NOT NULL").select("url", "owner")
        owners = held.unionByName(plain).unionByName(taken.join(free, "url", "left_anti"))
    owners = materialize(owners, "owners")
    same = asks.join(hard, "entity", "left_anti").where("url != ''").join(owners, "url").where("owner != entity").select("entity", F.col("owner").alias("same"))
    if not hard.isEmpty():
        turned = settled.where("entity IS NOT NULL").select("entity", "same")
        same = same.join(turned.select(F.col("entity").alias("same"), F.col("same").alias("further")), "same", "left").select("entity", F.coalesce("further", "same").alias("same")).unionByName(turned)
    if by_aggregates is not None:
        same = same.unionByName(by_aggregates.where("same IS NOT NULL").select("entity", "same"))
    return owners, materialize(same, "same")


def _first_told(lines: DataFrame, stored: DataFrame, unicode: bool) -> DataFrame:
    """``entity, asked, at``: the company and name that an entity was first given, and when it had both."""
    fields = stored.where("field IN ('company.domain', 'full_name')").select("entity", F.lit("").alias("at"), F.when(F.col("field") == "company.domain", "domain").otherwise("name").alias("what"), F.when(F.col("field") == "full_name", tx.normalize_name(F.col("value"), unicode)).otherwise(F.col("value")).alias("key"))
    told = lines.select("entity", "at", F.explode(F.create_map(F.lit("domain"), "domain", F.lit("name"), "name")).alias("what", "key")).unionByName(fields.select("entity", "at", "what", "key"))
    first = lambda what: F.min(F.when((F.col("what") == what) & (F.col("key") != ""), F.struct("at", "key")))
    both = told.groupBy("entity").agg(first("domain").alias("d"), first("name").alias("n")).where("d IS NOT NULL AND n IS NOT NULL")
    return both.select("entity", F.concat_ws("\x1f", "d.key", "n.key").alias("asked"), F.greatest("d.at", "n.at").alias("at"))


def _by_name_alone(claims: DataFrame, asks: DataFrame, lines: DataFrame, held: DataFrame, stored: DataFrame, unicode: bool) -> DataFrame:
    """``entity, same`` of the open entities that only a name can settle, ``same`` null where they are new: no turns, aggregates a company and name.

    A name that no entity with a profile URL goes by is touched by no URL, so who goes by it, and when, does not depend on the turns of others. Of a company and name
    the first to go by it, or to ask for it, is the lead; who asks after that is this lead, until a second lead goes by it, and new from then on.
    A name and company that a third of all rows have are a row here, and each of its rows meets this row in a join.
    """
    touched = claims.select("entity").unionByName(asks.where("url != ''").select("entity")).unionByName(held.select(F.col("owner").alias("entity"))).unionByName(stored.where("field = 'linkedin_url'").select("entity")).distinct()
    named = lines.select("entity", "name").unionByName(stored.where("field = 'full_name'").select("entity", tx.normalize_name(F.col("value"), unicode).alias("name")))
    urls = materialize(named.join(touched, "entity", "left_semi").select("name").distinct(), "names-with-urls")
    mine = asks.where("asked IS NOT NULL").select("entity", "at", "asked", F.substring_index("asked", "\x1f", -1).alias("name")).join(urls, "name", "left_anti")
    mine = materialize(mine.select("entity", "at", "asked"), "name-asks")
    told = _first_told(lines, stored, unicode).join(mine.select("asked").distinct(), "asked", "left_semi").join(mine.select("entity"), "entity", "left_anti")
    told = materialize(told, "name-calls")
    first = materialize(told.groupBy("asked").agg(F.min(F.struct("at", "entity")).alias("call")), "name-first-calls")
    second = told.join(first, "asked").where(F.col("entity") != F.col("call.entity")).groupBy("asked").agg(F.min("at").alias("second"))
    opened = mine.groupBy("asked").agg(F.min(F.struct("at", "entity")).alias("ask"))
    j = opened.join(first, "asked", "left").join(second, "asked", "left")
    ask_first = F.col("call").isNull() | (F.col("ask.at") < F.col("call.at"))
    lead = j.select("asked", F.when(ask_first, F.col("ask")).otherwise(F.col("call")).alias("lead"), F.when(ask_first, F.col("call.at")).otherwise(F.col("second")).alias("until"))
    lead = materialize(lead, "name-leads")
    joins = (F.col("at") > F.col("lead.at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    return materialize(mine.join(lead, "asked").select("entity", F.when(joins, F.col("lead.entity")).alias("same")), "name-settled")


def _take_turns(events: pd.DataFrame) -> pd.DataFrame:
    """One component's events in order: who ends up with which URL, and which open entity is another lead.

    ``held`` and ``has`` say what was stored; ``ask`` is the turn of an open entity (its URL, its company and name);
    ``claim`` brings a URL; ``domain`` and ``name`` give an entity what it may have none of yet.
    """
    rank = {"held": 0, "has": 0, "ask": 1, "domain": 2, "name": 2, "claim": 3}
    events = events.assign(rank=events["what"].map(rank)).sort_values(["at", "rank", "what", "entity", "key"])
    owner, has, same, told, called = {}, set(), {}, {}, {}
    new = []
    for what, entity, key, other in zip(events["what"], events["entity"], events["key"], events["other"], strict=True):
        if what == "ask":
            found = {owner[key]} if key in owner else called.get(other, set())
            if len(found) == 1:
                same[entity] = next(iter(found))
            continue
        lead = same.get(entity, entity)
        if what == "held":
            owner[key] = lead
            has.add(lead)
        elif what == "has":
            has.add(lead)
        elif what == "claim":
            if key not in owner and lead not in has:
                owner[key] = lead
                has.add(lead)
                new.append((key, lead, None, None))
        else:
            mine = told.setdefault(lead, {})
            if what not in mine:
                mine[what] = key
                if len(mine) == 2:
                    called.setdefault(mine["domain"] + "\x1f" + mine["name"], set()).add(lead)
    return pd.DataFrame([*new, *((None, None, a, b) for a, b in same.items())], columns=["url", "owner", "entity", "same"])


# --- merged leads ---------------------------------------------------------------


def live_leads(people: DataFrame) -> DataFrame:
    """``lead_id, live_id, cycle``: each lead's survivor through ``merged_into``.

    Pointers of merged leads are doubled, and a lead whose pointer stands on one that is not merged is settled and left out from then on.
    A round that settles none leaves only leads that are in, or lead into, a cycle, which counts as its smallest id and is flagged: they go on
    until no smaller id is passed and the pointers stand on cycles alone, that is on no fewer leads than a round before. A missing target ends the chain.
    The joins are told to merge: tables of ids are small as files and many times that once broadcast through the driver.
    """
    known = people.select(F.col("lead_id").alias("to"))
    step = people.select("lead_id", F.nullif("merged_into", F.lit("")).alias("to")).where("to != lead_id").join(known.hint("merge"), "to", "left_semi")
    step = materialize(step.select("lead_id", "to"), "merges")
    # ``least`` is the smallest of the leads that were passed, the first one included; ``open`` tells those that stand on a merged lead.
    merged = step.select(F.col("lead_id").alias("to"), F.lit(True).alias("open"))
    hop = step.join(merged.hint("merge"), "to", "left").select("lead_id", F.col("to").alias("live_id"), F.col("lead_id").alias("least"), F.coalesce("open", F.lit(False)).alias("open"))
    hop = materialize(hop, "live")
    settled, on, left = hop.where("NOT open"), hop.where("open"), hop.where("open").count()
    whole, ends = hop, None
    while left:
        further = whole.select(F.col("lead_id").alias("live_id"), F.col("live_id").alias("to"), F.col("least").alias("more"), F.col("open").alias("still"))
        new = on.join(further.hint("merge"), "live_id").select("lead_id", F.col("to").alias("live_id"), F.least("least", "more").alias("least"), F.col("still").alias("open"), (F.col("more") < F.col("least")).alias("lower"))
        new = materialize(new, "live")
        still, lower = new.agg(F.count_if("open"), F.count_if("lower")).first()
        if still < left:
            settled, on, left = settled.unionByName(new.where("NOT open").drop("lower")), new.where("open").drop("lower"), still
            whole = settled.unionByName(on)
            continue
        on = whole = new.drop("lower")
        before, ends = ends, on.select("live_id").distinct().count()
        if not lower and ends == before:
            break
    out = settled.select("lead_id", "live_id", F.lit(False).alias("cycle"))
    if left:
        least = on.select(F.col("lead_id").alias("live_id"), F.col("least").alias("round"))
        out = out.unionByName(on.select("lead_id", "live_id").join(least.hint("merge"), "live_id").select("lead_id", F.col("round").alias("live_id"), F.lit(True).alias("cycle")))
    out = people.select("lead_id").join(out.hint("merge"), "lead_id", "left")
    return out.select("lead_id", F.coalesce("live_id", "lead_id").alias("live_id"), F.coalesce("cycle", F.lit(False)).alias("cycle"))


def namesakes(people: DataFrame, distinct_pairs: DataFrame | None = None, unicode: bool = True) -> DataFrame:
    """``lead_id`` of live leads that share a company and full name with another, unless each such pair is marked distinct.

    ``people`` has lead_id, domain, full_name. Members of a group are counted against their marked pairs, not paired off: a lead with
    n - 1 distinct partners in its group of n is free.
    """
    p = people.select("lead_id", F.nullif("domain", F.lit("")).alias("domain"), F.nullif(tx.normalize_name(F.col("full_name"), unicode), F.lit("")).alias("name")).where("domain IS NOT NULL AND name IS NOT NULL")
    size = p.groupBy("domain", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    grouped = p.join(size, ["domain", "name"])
    if distinct_pairs is None:
        return grouped.select("lead_id")
    both = distinct_pairs.select("a", "b").unionByName(distinct_pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    other = grouped.select(F.col("lead_id").alias("b"), F.col("domain").alias("d2"), F.col("name").alias("n2"))
    marked = grouped.join(both, grouped["lead_id"] == both["a"]).join(other, "b").where("domain = d2 AND name = n2").groupBy("lead_id").agg(F.count(F.lit(1)).alias("k"))
    return grouped.join(marked, "lead_id", "left").where(F.coalesce("k", F.lit(0)) < F.col("n") - 1).select("lead_id")


def merge_edges(people: DataFrame, same_as: DataFrame) -> DataFrame:
    """``lead_id, merged_into`` after people's same_as rows ``(row, lead_id, other_id)``.

    Rows join leads whatever their order, so components give the same survivors as one row after another: the oldest (created_at,
    then id) lives on, and all others point at it directly.
    """
    old = people.where("merged_into IS NOT NULL AND merged_into != ''").select(F.col("lead_id").alias("a"), F.col("merged_into").alias("b"))
    comp = connected_components(same_as.select(F.col("lead_id").alias("a"), F.col("other_id").alias("b")).unionByName(old))
    members = people.join(comp, people["lead_id"] == comp["node"])
    oldest = members.groupBy("component").agg(F.min_by("lead_id", F.struct("created_at", "lead_id")).alias("survivor"))
    return members.join(oldest, "component").where("lead_id != survivor").select("lead_id", F.col("survivor").alias("merged_into"))


def sources_seen(applied: DataFrame, identities: DataFrame, live: DataFrame, channels: DataFrame) -> DataFrame:
    """``lead_id, sources_seen, receiver_only`` of each live lead: the channels of its family's rows and identities.

    ``channels`` has source_id, channel; a source that is not listed is its own channel.
    """
    seen = applied.select("lead_id", "source_id").unionByName(identities.select("lead_id", "source_id")).where("lead_id IS NOT NULL").distinct()
    seen = seen.join(live.select("lead_id", "live_id"), "lead_id").join(channels, "source_id", "left")
    return seen.groupBy(F.col("live_id").alias("lead_id")).agg(F.count_distinct(F.coalesce("channel", "source_id")).alias("sources_seen"), F.bool_and(F.col("source_id") == RECEIVER).alias("receiver_only"))


def leads_seen(people: DataFrame) -> DataFrame:
    """Live leads a company."""
    return people.where("(merged_into IS NULL OR merged_into = '') AND domain IS NOT NULL AND domain != ''").groupBy("domain").agg(F.count(F.lit(1)).alias("leads_seen"))
