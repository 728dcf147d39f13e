"""Families of leads: which keys stand first, and what a survivor takes over."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def primary_keys(people: DataFrame, identities: DataFrame, live: DataFrame) -> DataFrame:
    """``lead_id, email, linkedin_url`` of live leads: the address and profile URL by which a family is reached.

    What the live lead's fields say, if an identity of the family has it; else the live lead's own oldest identity, else the
    oldest of a lead merged into it. A family without a key of a kind has null.
    """
    said = people.select("lead_id", *(F.try_element_at("fields", F.lit(n))["value"].alias(n) for n in ("email", "linkedin_url")))
    k = identities.join(live.select("lead_id", "live_id"), "lead_id").join(said.withColumnRenamed("lead_id", "live_id"), "live_id")
    rank = lambda said_: F.struct(F.when(F.col("key") == F.col(said_), 0).otherwise(1), F.when(F.col("lead_id") == F.col("live_id"), 0).otherwise(1), "lead_id", "first_seen_at", "key")
    pick = lambda kind, said_: F.min_by("key", F.when(F.col("kind") == kind, rank(said_)))
    return k.groupBy(F.col("live_id").alias("lead_id")).agg(pick("email", "email").alias("email"), pick("linkedin", "linkedin_url").alias("linkedin_url"))


def survivors_filled(fields: DataFrame, merges: DataFrame, people: DataFrame) -> DataFrame:
    """``lead_id, field, v`` with what merged leads give their survivors: only fields that these lack, of the oldest lead that has one."""
    given = fields.join(merges.select("lead_id", F.col("merged_into").alias("to")), "lead_id").join(people.select("lead_id", "created_at"), "lead_id")
    first = given.groupBy(F.col("to").alias("lead_id"), "field").agg(F.min_by("v", F.struct("created_at", F.col("lead_id"))).alias("v"))
    return fields.unionByName(first.join(fields.select("lead_id", "field"), ["lead_id", "field"], "left_anti").select("lead_id", "field", "v"))
