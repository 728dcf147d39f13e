"""Verdicts kept up to date: what a change reaches is judged again, and only what differs is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.operators import tables
from tidewell.plans.evaluate import evaluate
from tidewell.plans.rubric import Rubric
from tidewell.storage import materialize


@dataclass(frozen=True)
class Inputs:
    """What ``evaluate`` reads, at one moment; lead ids and domains are unique."""

    leads: DataFrame
    companies: DataFrame | None = None
    lead_signals: DataFrame | None = None
    company_signals: DataFrame | None = None


def _content(df: DataFrame, key: str) -> Column:
    """One text for a row's other columns, maps by their sorted entries."""
    kinds = dict(df.dtypes)
    parts = [F.array_sort(F.map_entries(c)).alias(c) if kinds[c].startswith("map") else F.col(c) for c in sorted(df.columns) if c != key]
    return F.sha2(F.to_json(F.struct(*parts, F.lit(1).alias("__row"))), 256)


def changed_keys(before: DataFrame | None, after: DataFrame | None, key: str) -> DataFrame | None:
    """The keys whose row came, went or differs; two rows without a row on one side are the same. None where both sides are absent."""
    sides = [df for df in (before, after) if df is not None]
    if not sides:
        return None
    empty = sides[0].limit(0)
    b, a = (df.select(key, _content(df, key).alias(name)) for df, name in ((before if before is not None else empty, "b"), (after if after is not None else empty, "a")))
    return b.join(a, key, "full_outer").where(~F.col("b").eqNullSafe(F.col("a"))).select(key)


def _union(frames: list[DataFrame | None]) -> DataFrame:
    found = [f for f in frames if f is not None]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


@dataclass(frozen=True)
class Reached:
    """Keys that a change reaches, as written tables."""

    leads: DataFrame  # leads that changed themselves
    domains: DataFrame  # companies of these, before and after, and companies that changed


def reached(before: Inputs, after: Inputs, leads: DataFrame | None = None, domains: DataFrame | None = None) -> Reached:
    """What differs between two inputs, or what is said to (``leads``, ``domains``), carried on from leads to their companies."""
    if leads is None:
        leads = _union([changed_keys(before.leads, after.leads, "lead_id"), changed_keys(before.lead_signals, after.lead_signals, "lead_id")])
    if domains is None:
        domains = _union([before.leads.select("domain").limit(0), changed_keys(before.companies, after.companies, "domain"), changed_keys(before.company_signals, after.company_signals, "domain")])
    leads = materialize(leads, "reached-leads")
    theirs = [i.leads.join(leads, "lead_id", "left_semi").select("domain") for i in (before, after)]
    domains = _union([domains, *theirs]).where("domain IS NOT NULL AND domain != ''")
    return Reached(leads, materialize(domains, "reached-domains"))


def rejudge(rubric: Rubric, verdicts: DataFrame, after: Inputs, what: Reached) -> DataFrame:
    """The changes (insert, update, delete, with the row) that turn ``verdicts`` into those of ``after``.

    A lead's verdict rests on itself, its company and all leads of that company. So the leads that changed, and all leads of the companies
    they reach, are found by semi-joins and judged, and a verdict that comes out as before is no change. Leads of other
    companies are read by key only.
    """
    at_company = after.leads.join(what.domains, "domain", "left_semi")
    alone = after.leads.where("domain IS NULL OR domain = ''").join(what.leads, "lead_id", "left_semi")
    leads = materialize(at_company.unionByName(alone), "rejudged-leads")
    ids = _union([leads.select("lead_id"), what.leads])
    by_domain = lambda df: None if df is None else df.join(what.domains, "domain", "left_semi")
    signals = None if after.lead_signals is None else after.lead_signals.join(ids, "lead_id", "left_semi")
    new = evaluate(rubric, leads, by_domain(after.companies), signals, by_domain(after.company_signals))
    old = verdicts.join(ids, "lead_id", "left_semi")
    return tables.changes(old, new.select(*old.columns), ["lead_id"])


class ChangeLog:
    """A keyed table as a base and the changes since, one folder a generation; a generation writes the rows that changed.

    ``read`` lays the newest change of each key over the base. ``compact`` writes a new base when the changes have grown to a share of it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "lead_id"):
        self.spark, self.path, self.key = spark, path, key

    def create(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/base-0")
        self._point(0, 0)

    def _point(self, base: int, generation: int) -> None:
        row = self.spark.createDataFrame([(base, generation)], "base int, generation int")
        row.write.mode("overwrite").parquet(f"{self.path}/head-{generation}")

    def _head(self) -> tuple[int, int]:
        heads = self.spark.read.option("recursiveFileLookup", True).schema("base int, generation int").parquet(f"{self.path}/head-*")
        return tuple(heads.orderBy(F.desc("generation"), F.desc("base")).first())

    def changes(self) -> DataFrame | None:
        """All changes since the base, with their generation."""
        base, generation = self._head()
        parts = [self.spark.read.parquet(f"{self.path}/changes-{g}").withColumn("generation", F.lit(g)) for g in range(base + 1, generation + 1)]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self) -> DataFrame:
        base, _ = self._head()
        rows, since = self.spark.read.parquet(f"{self.path}/base-{base}"), self.changes()
        if since is None:
            return rows
        last = since.groupBy(self.key).agg(F.max_by(F.struct("change", *(c for c in rows.columns if c != self.key)), "generation").alias("r"))
        rest = rows.join(last.select(self.key), self.key, "left_anti")
        return rest.unionByName(last.where("r.change != 'delete'").select(self.key, *(F.col(f"r.{c}").alias(c) for c in rows.columns if c != self.key)).select(*rows.columns))

    def append(self, changes: DataFrame) -> int:
        """Write one generation; returns its rows. It counts once the head names it."""
        base, generation = self._head()
        at = f"{self.path}/changes-{generation + 1}"
        changes.write.mode("overwrite").parquet(at)
        self._point(base, generation + 1)
        return self.spark.read.parquet(at).count()

    def compact(self, share: float = 0.25) -> bool:
        """A new base, if the changes since the last one are above ``share`` of its rows."""
        base, generation = self._head()
        since = self.changes()
        if since is None or since.count() <= share * self.spark.read.parquet(f"{self.path}/base-{base}").count():
            return False
        self.read().write.mode("overwrite").parquet(f"{self.path}/base-{generation}")
        self._point(generation, generation)
        return True


def update(log: ChangeLog, rubric: Rubric, before: Inputs, after: Inputs, leads: DataFrame | None = None, domains: DataFrame | None = None) -> DataFrame:
    """Judge what changed between two inputs and append it to the log; returns the changes as written.

    ``leads`` and ``domains`` name what changed where the caller knows; else all keys of both inputs are compared.
    """
    delta = rejudge(rubric, log.read(), after, reached(before, after, leads, domains))
    log.append(delta)
    return log.changes().where(F.col("generation") == log._head()[1]).drop("generation")
