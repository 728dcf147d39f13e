"""Overrides as a person writes them: statuses, pairs and retries as changes to the table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions import text as tx
from tidewell.operators.status import MANUAL_STATUSES, RESUBSCRIBE

COLUMNS = ("row", "person", "action", "value", "note")


class EditError(ValueError):
    """An edit that the table must not hold."""


def known_as(person: str, primary: DataFrame, identities: DataFrame, live: DataFrame, unicode: bool = True) -> tuple[str, str | None]:
    """(how the table names a person, their live lead or None).

    A lead goes by its first email, else its profile URL, else its id (``primary`` is ``people.primary_keys``). Someone unknown goes by
    a usable email or a profile URL, so that a row can wait for them; anything else raises ``EditError``.
    """
    spark = identities.sparkSession
    asked = spark.createDataFrame([(person,)], "raw string").select(tx.normalize_person(F.col("raw"), unicode).alias("k"), tx.email_fault(tx.normalize_person(F.col("raw"), unicode)).alias("fault"), tx.trim(F.col("raw")).alias("id")).first()
    names = live.select(F.col("lead_id").alias("k"), "live_id").unionByName(identities.join(live, "lead_id").select(F.col("key").alias("k"), "live_id"))
    hit = names.where(F.col("k").isin(asked["k"], asked["id"])).select(F.col("live_id").alias("lead_id")).distinct().join(primary, "lead_id", "left").head(1)
    if hit:
        return hit[0]["email"] or hit[0]["linkedin_url"] or hit[0]["lead_id"], hit[0]["lead_id"]
    if "@" in asked["k"] and asked["fault"] is None or "linkedin." in asked["k"] and "@" not in asked["k"]:
        return asked["k"], None
    raise EditError(asked["fault"] or "nobody has this id; someone unknown goes by an email or a profile URL")


def _add(table: DataFrame, person: str, action: str, value: str, note: str = "") -> DataFrame:
    """One row more, behind the last; one that is there already is not added."""
    new = table.agg((F.coalesce(F.max("row"), F.lit(0)) + 1).cast("int").alias("row")).select("row", *(F.lit(v).alias(n) for n, v in zip(COLUMNS[1:], (person, action, value, note), strict=True)))
    return table.select(*COLUMNS).unionByName(new.join(table.select(*COLUMNS[1:]), list(COLUMNS[1:]), "left_anti").select(*COLUMNS))


def _of(resolved: DataFrame, key: str, lead: str | None) -> Column:
    return (F.col("lead_id") == lead) if lead else (F.col("person") == key)


def set_status(table: DataFrame, resolved: DataFrame, key: str, lead: str | None, value: str, now: datetime) -> DataFrame:
    """The table after a status was set by hand, taken away (``none``) or undone (``resubscribe``).

    ``resolved`` is ``status.resolve_overrides`` of the table. All status rows of the lead, under whichever key, give way; a resubscription
    that waits gives way to a status only.
    """
    v = value.strip().lower()
    if v not in (*MANUAL_STATUSES, "none", RESUBSCRIBE):
        raise EditError(f'"{value}" cannot be set by hand; {", ".join(MANUAL_STATUSES)}, none and {RESUBSCRIBE} can')
    goes = _of(resolved, key, lead) & (F.col("action") == "status")
    if v in ("none", RESUBSCRIBE):
        goes = goes & (F.col("value") != RESUBSCRIBE)
    rest = table.join(resolved.where(goes).select("row"), "row", "left_anti")
    if v == "none":
        return rest.select(*COLUMNS)
    return _add(rest, key, "status", v, f"{now:%Y-%m-%dT%H:%M:%SZ}" if v == RESUBSCRIBE else "")


def add_pair(table: DataFrame, action: str, a: tuple[str, str | None], b: tuple[str, str | None]) -> DataFrame:
    """The table with two people declared the same or distinct; each is (name, lead or None). Only known leads are merged."""
    if action not in ("same_as", "distinct"):
        raise EditError(f'"{action}" says nothing of two people')
    if a[0] == b[0] or (a[1] is not None and a[1] == b[1]):
        raise EditError("these are one person already")
    if action == "same_as" and None in (a[1], b[1]):
        raise EditError("a merge is for good, so both must be known")
    return _add(table, a[0], action, b[0])


def add_retry(table: DataFrame, now: datetime, person: str = "*", lane: str = "") -> DataFrame:
    """The table with failed steps asked to wait again, of one person or all, in one lane or all; each asking counts once."""
    return _add(table, person, "retry", lane.strip(), f"{now:%Y-%m-%dT%H:%M:%SZ}")
