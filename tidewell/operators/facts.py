"""Company facts by origin: the people-owned tab over enrichment over input rows."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from tidewell.functions import text as tx

# Who may replace whom.
ORIGINS = {"input": 0, "enrichment": 1, "companies_tab": 2}
FACTS = "domain string, fact string, value string, origin string, at timestamp, previous string, previous_origin string, previous_at timestamp"
# Input columns that speak about a company.
INPUT_FACTS = {"company.name": "name", "company.employees": "employees", "company.funding_stage": "funding_stage", "company.region": "region"}


def input_facts(rows: DataFrame, now: datetime) -> DataFrame:
    """The first value of each company fact among input rows, in order: ``domain, fact, value, origin, at``.

    ``rows`` has lead_domain (of the row's lead), row_domain, source_pos, ord and fields. A row that names another company than
    its lead's says nothing about it.
    """
    r = rows.where("lead_domain IS NOT NULL AND lead_domain != '' AND (row_domain IS NULL OR row_domain = '' OR row_domain = lead_domain)")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("fact"), F.try_element_at("fields", F.lit(c)).alias("value")) for c, f in INPUT_FACTS.items())))
    long = r.select(F.col("lead_domain").alias("domain"), F.struct("source_pos", "ord").alias("o"), each.alias("x")).where("x.value IS NOT NULL AND x.value != ''")
    return long.groupBy("domain", F.col("x.fact").alias("fact")).agg(F.min_by("x.value", "o").alias("value")).withColumns({"origin": F.lit("input"), "at": F.lit(now)})


def tab_facts(tab: DataFrame, headers: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """The Companies tab as ``domain, fact, value``; of several rows of a domain the first (by ``row``) counts."""
    table = tx.header_table(aliases)
    domain_cols, facts = [], {}
    for h in sorted(headers):
        name = tx.resolve_header(h, table)
        if name == "company.domain":
            domain_cols.insert(0 if tx.squash(h) == "domain" else len(domain_cols), h)
        elif short := (name.removeprefix("company.") if name.startswith("company.") else tx.squash(h)):
            facts.setdefault(short, []).append(h)
    domain = F.coalesce(*(F.nullif(tx.normalize_domain(F.col(f"`{h}`")), F.lit("")) for h in domain_cols)) if domain_cols else F.lit(None).cast("string")
    values = F.array(*(F.struct(F.lit(n).alias("fact"), F.coalesce(*(tx.present(F.col(f"`{h}`")) for h in hs)).alias("value")) for n, hs in facts.items()))
    first = tab.select("row", domain.alias("domain"), values.alias("v")).where("domain IS NOT NULL").groupBy("domain").agg(F.min_by("v", "row").alias("v"))
    return first.select("domain", F.explode("v").alias("x")).where("x.value IS NOT NULL").select("domain", "x.fact", "x.value")


def apply_facts(current: DataFrame, new: DataFrame, origin: str, now: datetime, owns_missing: bool = False) -> DataFrame:
    """``current`` after an origin's facts, as one outer join on (domain, fact).

    A lower origin never replaces a higher one's value; input fills only what is empty. A changed value moves the old one to
    ``previous``; the same value is taken over by a higher origin without counting as a change. With ``owns_missing`` a
    fact of this origin that it no longer gives moves to ``previous`` too, and value becomes null.
    """
    n = new.select("domain", "fact", F.col("value").alias("__v"))
    j = current.join(n, ["domain", "fact"], "full_outer")
    rank = lambda c: F.coalesce(tx.lookup(ORIGINS, c), F.lit(-1))
    has = F.col("value").isNotNull() & (F.col("value") != "")
    may = ~has | ((F.lit(ORIGINS[origin]) >= rank(F.col("origin"))) & (F.lit(origin) != "input"))
    given = F.col("__v").isNotNull()
    same = has & (F.col("value") == F.col("__v"))
    sets = given & may & ~same
    takes = given & same & (F.lit(ORIGINS[origin]) > rank(F.col("origin")))
    drops = F.lit(owns_missing) & ~given & has & (F.col("origin") == origin)
    moves = (sets & has) | drops
    return j.select(
        "domain", "fact",
        F.when(sets, F.col("__v")).when(drops, F.lit(None)).otherwise(F.col("value")).alias("value"),
        F.when(sets | takes, F.lit(origin)).when(drops, F.lit(None)).otherwise(F.col("origin")).alias("origin"),
        F.when(sets, F.lit(now)).when(drops, F.lit(None)).otherwise(F.col("at")).alias("at"),
        F.when(moves, F.col("value")).otherwise(F.col("previous")).alias("previous"),
        F.when(moves, F.col("origin")).otherwise(F.col("previous_origin")).alias("previous_origin"),
        F.when(moves, F.col("at")).otherwise(F.col("previous_at")).alias("previous_at"),
    )


def answers(current: DataFrame, found: DataFrame, now: datetime) -> DataFrame:
    """``current`` after look-ups: ``found`` has domain, not_found, fact, value.

    A company that was not found keeps what it has. A fact with a value is written unless the Companies tab says something; one
    with an empty value is known to be unusable, so what was stored moves to ``previous``; a fact that is not named stays. A
    fact named ``company.x`` wins over one named ``x``.
    """
    f = found.where("NOT not_found AND fact IS NOT NULL").select("domain", F.regexp_replace("fact", "^company\\.", "").alias("fact"), F.startswith("fact", F.lit("company.")).alias("exact"), F.coalesce(tx.trim(F.col("value")), F.lit("")).alias("value"))
    f = f.where("fact NOT IN ('', 'domain')").groupBy("domain", "fact").agg(F.max_by("value", F.struct("exact", "value")).alias("value"))
    out = apply_facts(current, f.where("value != ''"), "enrichment", now)
    gone = f.where("value = ''").select("domain", "fact", F.lit(True).alias("__gone"))
    j = out.join(gone, ["domain", "fact"], "left")
    clear = F.coalesce("__gone", F.lit(False)) & F.col("value").isNotNull() & (F.col("origin") != "companies_tab")
    moved = {f"previous{x}": F.when(clear, F.col(c)).otherwise(F.col(f"previous{x}")) for x, c in (("", "value"), ("_origin", "origin"), ("_at", "at"))}
    emptied = {c: F.when(~clear, F.col(c)) for c in ("value", "origin", "at")}
    return j.withColumns({**moved, **emptied}).select(*out.columns)


def wide(facts: DataFrame) -> DataFrame:
    """One row a company for the rubric: ``domain, name, region, funding_stage, employees, extra``."""
    m = facts.where("value IS NOT NULL AND value != ''").groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("fact", "value"))).alias("extra"))
    get = lambda f: F.try_element_at("extra", F.lit(f))
    return m.select("domain", get("name").alias("name"), get("region").alias("region"), get("funding_stage").alias("funding_stage"), get("employees").try_cast("double").alias("employees"), "extra")


def due_domains(lead_domains: DataFrame, attempts: DataFrame, now: datetime, max_age: timedelta, most: int, personal: Iterable[str] = tx.PERSONAL_PROVIDERS) -> DataFrame:
    """The first ``most`` domains whose facts are due: never tried ones, then the least recently tried, then by name.

    ``attempts`` has domain and tried_at. A top-k over the union of both, not a sort of it.
    """
    all_ = lead_domains.select("domain").unionByName(attempts.select("domain")).where("domain IS NOT NULL AND domain != ''").distinct()
    all_ = all_.where(~F.col("domain").isin(*personal)).join(attempts.groupBy("domain").agg(F.max("tried_at").alias("tried_at")), "domain", "left")
    return all_.where(F.col("tried_at").isNull() | (F.col("tried_at") <= F.lit(now - max_age))).orderBy(F.asc_nulls_first("tried_at"), "domain").limit(most)


def strongest_deal(deals: DataFrame) -> DataFrame:
    """One deal a company: won before open before lost, then one that is stored, then the newest."""
    rank = tx.lookup({"won": 0, "open": 1, "lost": 2}, F.col("stage"))
    best = F.struct(F.coalesce(rank, F.lit(9)), F.when(F.col("stored"), 0).otherwise(1), -F.coalesce(F.unix_micros("updated_at"), F.lit(0)), F.col("deal_id"))
    return deals.groupBy("domain").agg(F.min_by(F.struct("deal_id", "stage", "updated_at"), best).alias("d")).select("domain", "d.*")
