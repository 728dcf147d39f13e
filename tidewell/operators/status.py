"""Statuses, overrides and the deal rule."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions import text as tx

# Statuses that people may set by hand, and the one that undoes an opt-out.
MANUAL_STATUSES = ("replied_positive", "replied_negative", "replied_neutral", "replied_unlabelled", "unsubscribed", "blocked")
RESUBSCRIBE = "resubscribe"
DEAL_STEP, DEAL_DEST = "deal", "deals"


def blocks_cold(status: Column) -> Column:
    return status.isin("deal", "unsubscribed", "blocked") | status.startswith("replied_")


def resolve_overrides(rows: DataFrame, identities: DataFrame, live: DataFrame, unicode: bool = True) -> DataFrame:
    """Rows (row, person, action, value, note) with the live leads they name: ``lead_id, other_id, action, value, hash, invalid``."""
    o = rows.select(
        "row", tx.normalize_person(F.coalesce("person", F.lit("")), unicode).alias("person"), F.lower(tx.trim(F.coalesce("action", F.lit("")))).alias("action"),
        tx.trim(F.coalesce("value", F.lit(""))).alias("value"), F.sha2(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in ("person", "action", "value", "note"))), 256).alias("hash"),
    )
    pair = F.col("action").isin("same_as", "distinct")
    o = o.withColumn("value", F.when(F.col("action") == "status", F.lower("value")).when(pair, tx.normalize_person(F.col("value"), unicode)).otherwise(F.col("value")))
    names = live.select(F.col("lead_id").alias("k"), "live_id").unionByName(identities.join(live, "lead_id").select(F.col("key").alias("k"), "live_id"))
    o = o.join(names.withColumnsRenamed({"k": "person", "live_id": "lead_id"}), "person", "left").join(names.withColumnsRenamed({"k": "value", "live_id": "other_id"}), "value", "left")
    invalid = (
        F.when((F.col("person") == "*") & (F.col("action") != "retry"), F.lit("only a retry row may be about everyone (*)"))
        .when((F.col("action") == "status") & ~F.col("value").isin(*MANUAL_STATUSES, RESUBSCRIBE), F.lit("no such status"))
        .when(pair & F.col("value").isin("", "*"), F.lit("the value names nobody else"))
        .when(~F.col("action").isin("status", "same_as", "distinct", "retry"), F.lit("no such action"))
    )
    return o.withColumns({"invalid": invalid, "other_id": F.when(pair, F.col("other_id"))})


def manual_status(overrides: DataFrame) -> DataFrame:
    """``lead_id, manual_status, override_block``: one status by hand, or why the rows block the lead."""
    o = overrides.where("lead_id IS NOT NULL")
    is_status = F.col("invalid").isNull() & (F.col("action") == "status") & (F.col("value") != RESUBSCRIBE)
    g = o.groupBy("lead_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("invalid").isNotNull(), F.col("row")))).alias("bad"),
        F.array_sort(F.collect_set(F.when(is_status, F.col("value")))).alias("values"),
        F.array_sort(F.collect_set(F.when(is_status, F.col("row")))).alias("rows"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    block = F.when(F.size("bad") > 0, F.concat(F.lit("Overrides rows that cannot be read: "), text("bad"))).when(F.size("values") > 1, F.concat(F.lit("Overrides rows that set different statuses: "), text("rows")))
    return g.select("lead_id", F.when(block.isNull() & (F.size("values") == 1), F.col("values")[0]).alias("manual_status"), block.alias("override_block"))


def family_outcomes(outcomes: DataFrame, live: DataFrame) -> DataFrame:
    """A live lead's history over all leads merged into it: ``lead_id, opted_out, reply, contacted_at``."""
    j = outcomes.join(live.select("lead_id", "live_id"), "lead_id")
    replied = F.nullif("reply_status", F.lit("")).isNotNull()
    return j.groupBy(F.col("live_id").alias("lead_id")).agg(
        F.bool_or(F.col("unsubscribed_at").isNotNull()).alias("opted_out"),
        F.max_by("reply_status", F.when(replied, F.struct("reply_at", F.col("lead_id") == F.col("live_id")))).alias("reply"),
        F.min("contacted_at").alias("contacted_at"),
    )


def cold_pushed_at(pushes: DataFrame, live: DataFrame) -> DataFrame:
    """``lead_id, pushed_at``: when the first cold push of a lead's family was complete, every step done."""
    c = pushes.where("lane_kind = 'cold'").groupBy("lead_id", "lane_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "done").alias("done"), F.max(F.when(F.col("state") == "done", F.col("updated_at"))).alias("last"))
    return c.where("n = done").join(live.select("lead_id", "live_id"), "lead_id").groupBy(F.col("live_id").alias("lead_id")).agg(F.min("last").alias("pushed_at"))


def deal_holds(people: DataFrame, outcomes: DataFrame, pushes: DataFrame, live: DataFrame, except_lane: str = "") -> DataFrame:
    """``lead_id, deal``: whether an open or won deal, or a called deal step that no later lookup has seen lost, holds at a lead's family or company.

    One aggregation by company and one by family, then two joins; the lead's own step in ``except_lane`` is left out.
    """
    fam = live.select("lead_id", "live_id")
    facts = outcomes.join(fam, "lead_id").select(F.col("live_id"), F.col("deal_stage").isin("open", "won").alias("open"), F.when(F.col("deal_stage") == "lost", F.col("deal_checked_at")).alias("lost_at"))
    steps = pushes.where((F.col("step") == DEAL_STEP) & (F.col("dest") == DEAL_DEST) & F.col("called_at").isNotNull())
    steps = steps.join(fam, "lead_id").select("live_id", "lead_id", "lane_id", "called_at")
    mine = facts.groupBy("live_id").agg(F.bool_or("open").alias("f_open"), F.max("lost_at").alias("f_lost"))
    at = people.select(F.col("lead_id").alias("live_id"), F.nullif("domain", F.lit("")).alias("domain"))
    company = facts.join(at, "live_id").where("domain IS NOT NULL").groupBy("domain").agg(F.bool_or("open").alias("c_open"), F.max("lost_at").alias("c_lost"))
    # Of the steps in ``except_lane`` a lead's own does not count: the last one, and the last of another lead than that one's, tell.
    in_lane = steps.join(at, "live_id").where("domain IS NOT NULL").withColumn("mine", F.col("lane_id") == except_lane)
    top = in_lane.groupBy("domain").agg(F.max(F.when(~F.col("mine"), F.col("called_at"))).alias("c_called_other"), F.max(F.when(F.col("mine"), F.struct("called_at", "lead_id"))).alias("c_lane"))
    second = in_lane.where("mine").join(top.select("domain", F.col("c_lane.lead_id").alias("holder")), "domain").where("lead_id != holder").groupBy("domain").agg(F.max("called_at").alias("c_second"))
    called_c = top.join(second, "domain", "left")
    called_f = steps.where((F.col("lane_id") != except_lane) | (F.col("lead_id") != F.col("live_id"))).groupBy("live_id").agg(F.max("called_at").alias("f_called"))
    j = at.join(mine, "live_id", "left").join(called_f, "live_id", "left").join(company, "domain", "left").join(called_c, "domain", "left")
    others = F.when(F.col("c_lane.lead_id") != F.col("live_id"), F.col("c_lane.called_at")).otherwise(F.col("c_second"))
    lost = F.greatest("f_lost", "c_lost")
    called = F.greatest("f_called", "c_called_other", others)
    deal = F.coalesce(F.col("f_open"), F.lit(False)) | F.coalesce(F.col("c_open"), F.lit(False)) | F.coalesce(called.isNotNull() & (lost.isNull() | (lost <= called)), F.lit(False))
    return j.select(F.col("live_id").alias("lead_id"), deal.alias("deal"))


def fold_status(people: DataFrame, family: DataFrame, manual: DataFrame, deals: DataFrame, pushed: DataFrame) -> DataFrame:
    """``lead_id, status, pushed_at``: the first rule that holds, of unsubscribed, blocked, by hand, deal, reply, contacted and new."""
    j = people.select("lead_id").join(family, "lead_id", "left").join(manual, "lead_id", "left").join(deals, "lead_id", "left").join(pushed, "lead_id", "left")
    status = (
        F.when(F.col("opted_out"), F.lit("unsubscribed"))
        .when(F.col("override_block").isNotNull(), F.lit("blocked"))
        .when(F.col("manual_status").isNotNull(), F.col("manual_status"))
        .when(F.col("deal"), F.lit("deal"))
        .when(F.col("reply").isNotNull(), F.col("reply"))
        .when(F.coalesce("contacted_at", "pushed_at").isNotNull(), F.lit("contacted"))
        .otherwise(F.lit("new"))
    )
    return j.select("lead_id", status.alias("status"), "pushed_at", "opted_out", "manual_status", "override_block", "deal", "contacted_at")


def repair_ledger(pushes: DataFrame, people: DataFrame, lanes: DataFrame, run_id: str, now: datetime) -> DataFrame:
    """The ledger as a run begins: calls of a broken run count as made, lanes that turned cold stay cold, steps that lost their lead or lane are cancelled.

    ``lanes`` has lane_id, kind, lane_dest; ``people`` lead_id, merged_into.
    """
    p = pushes.join(F.broadcast(lanes.select("lane_id", F.col("kind").alias("__kind"), F.col("lane_dest").alias("__dest"))), "lane_id", "left").join(people.select("lead_id", F.nullif("merged_into", F.lit("")).alias("__into")), "lead_id", "left")
    broken = F.coalesce((F.col("intent_run") != "") & (F.col("intent_run") != run_id), F.lit(False))
    called = F.when(broken, F.coalesce("called_at", F.lit(now))).otherwise(F.col("called_at"))
    intent = F.when(broken, F.lit("")).otherwise(F.col("intent_run"))
    uncalled = called.isNull() & (F.coalesce(intent, F.lit("")) == "")
    cold = F.when((F.col("__kind") == "cold"), F.lit("cold")).otherwise(F.col("lane_kind"))
    waits = F.col("state") == "pending"
    error = (
        F.when(waits & F.col("__into").isNotNull() & uncalled, F.lit("this lead became part of another"))
        .when(waits & F.col("__kind").isNull(), F.lit("there is no such lane any more"))
        .when(waits & (F.col("__dest") != F.col("dest")) & ~uncalled, F.lit("called already, and the lane now leads elsewhere"))
    )
    dest = F.when(waits & error.isNull() & (F.col("__dest") != F.col("dest")), F.col("__dest")).otherwise(F.col("dest"))
    changed = broken | error.isNotNull() | ~dest.eqNullSafe(F.col("dest")) | ~cold.eqNullSafe(F.col("lane_kind"))
    new = {"called_at": called, "intent_run": intent, "lane_kind": cold, "state": F.when(error.isNotNull(), F.lit("cancelled")).otherwise(F.col("state")), "last_error": F.coalesce(error, "last_error"), "dest": dest, "updated_at": F.when(changed, F.lit(now)).otherwise(F.col("updated_at"))}
    return p.withColumns(new).select(*pushes.columns)


def retries(pushes: DataFrame, overrides: DataFrame, applied: DataFrame, now: datetime) -> DataFrame:
    """Failed steps that a retry row names, which was not applied before, wait again; ``*`` names all leads, an empty lane all lanes."""
    rows = overrides.where("action = 'retry' AND invalid IS NULL AND (person = '*' OR lead_id IS NOT NULL)").join(applied.select(F.col("row_hash").alias("hash")), "hash", "left_anti")
    every = [r["v"] for r in rows.where("person = '*'").select(F.lower("value").alias("v")).distinct().collect()]
    named = rows.where("person != '*'").select("lead_id", F.lower("value").alias("v")).distinct()
    # Lanes are few: what rows say of them is an array, so that each push stays one row.
    mine = named.groupBy("lead_id").agg(F.collect_set("v").alias("__mine"))
    out = pushes.join(mine, "lead_id", "left")
    here = F.array(F.lit(""), F.lower("lane_id"))
    named_here = F.coalesce(F.arrays_overlap("__mine", here), F.lit(False))
    again = (F.col("state") == "failed") & (named_here | F.lit("" in every) | F.lower("lane_id").isin(every))
    new = {"state": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(""), "updated_at": F.lit(now)}
    return out.select(*(F.when(again, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in pushes.columns))


def resubscribe(outcomes: DataFrame, overrides: DataFrame, manual: DataFrame, applied: DataFrame, live: DataFrame) -> DataFrame:
    """Opt-outs by hand that a resubscribe row undoes; those from events and lookups stay, as does one that is still set by hand."""
    rows = overrides.where(f"action = 'status' AND value = '{RESUBSCRIBE}' AND invalid IS NULL AND lead_id IS NOT NULL").join(applied.select(F.col("row_hash").alias("hash")), "hash", "left_anti")
    free = rows.select(F.col("lead_id").alias("live_id")).distinct().join(manual.where("manual_status = 'unsubscribed'").select(F.col("lead_id").alias("live_id")), "live_id", "left_anti")
    named = live.join(free, "live_id", "left_semi").select("lead_id", F.lit(True).alias("__free"))
    clear = F.coalesce("__free", F.lit(False)) & (F.col("unsubscribed_origin") == "manual")
    cleared = {"unsubscribed_at": F.when(~F.coalesce(clear, F.lit(False)), F.col("unsubscribed_at")), "unsubscribed_origin": F.when(~F.coalesce(clear, F.lit(False)), F.col("unsubscribed_origin"))}
    return outcomes.join(named, "lead_id", "left").withColumns(cleared).select(*outcomes.columns)


def opt_outs_by_hand(outcomes: DataFrame, manual: DataFrame, now: datetime) -> DataFrame:
    """``outcomes`` with an opt-out, of origin manual, for leads that a row sets to unsubscribed and that have none yet."""
    named = manual.where("manual_status = 'unsubscribed'").select("lead_id", F.lit(True).alias("__by_hand")).distinct()
    out = outcomes.join(named, "lead_id", "full_outer")
    new = F.coalesce("__by_hand", F.lit(False)) & F.col("unsubscribed_at").isNull()
    return out.withColumns({"unsubscribed_origin": F.when(new, "manual").otherwise(F.col("unsubscribed_origin")), "unsubscribed_at": F.when(new, F.lit(now)).otherwise(F.col("unsubscribed_at"))}).select(*outcomes.columns)


def used_up(overrides: DataFrame, applied: DataFrame, run_id: str, now: datetime) -> DataFrame:
    """``row_hash, applied_at, run_id`` of the retry and resubscribe rows that a run has acted on: each acts once, and one about somebody unknown waits."""
    known = F.col("lead_id").isNotNull() | ((F.col("action") == "retry") & (F.col("person") == "*"))
    once = (F.col("action") == "retry") | ((F.col("action") == "status") & (F.col("value") == RESUBSCRIBE))
    done = overrides.where(F.col("invalid").isNull() & known & once).select(F.col("hash").alias("row_hash")).distinct()
    return done.join(applied.select("row_hash"), "row_hash", "left_anti").select("row_hash", F.lit(now).alias("applied_at"), F.lit(run_id).alias("run_id"))
