"""A rubric over leads and companies as one lazy plan."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions import text as tx
from tidewell.functions.values import SPARK_TYPES, typed, unparsed
from tidewell.plans.rubric import Derive, FieldType, Rollup, Rubric, ScoreRule, render, signed
from tidewell.storage import materialize

#: Columns of the leads frame besides ``lead_id``; any that is missing counts as null.
LEAD_COLUMNS = {
    "domain": "string", "first_seen_at": "timestamp", "status": "string", "fields": "map<string,string>", "email": "string", "linkedin_url": "string",
    "full_name": "string", "title": "string", "sources_seen": "long", "receiver_only": "boolean", "conflict_fields": "array<string>",
}
COMPANY_COLUMNS = {"name": "string", "region": "string", "funding_stage": "string", "employees": "double", "leads_seen": "long", "extra": "map<string,string>"}


def _complete(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def lead_values(rubric: Rubric, leads: DataFrame) -> DataFrame:
    """``lead_id, domain, first_seen_at, status, conflict_fields`` and one typed ``l_`` column for each name that is read."""
    leads = _complete(leads, LEAD_COLUMNS)
    reads = set(rubric.lead_reads()) | {r.field.name for r in rubric.rollups if r.field}
    cols = []
    for name in sorted(reads):
        kind = rubric.fields.get(name, FieldType()).kind
        if name == "sources_seen":
            value = F.coalesce(F.col(name), F.lit(0)).cast("double")
        elif name == "receiver_only":
            value = F.coalesce(F.col(name), F.lit(False))
        else:
            value = typed(F.try_element_at("fields", F.lit(name)), kind, rubric.unicode)
            if name in ("email", "linkedin_url", "full_name", "title"):
                value = F.coalesce(tx.present(F.col(name)), value)
        cols.append(value.alias(f"l_{name}"))
    domain = F.nullif("domain", F.lit("")).alias("domain")
    return leads.select("lead_id", domain, "first_seen_at", F.coalesce("status", F.lit("")).alias("status"), "conflict_fields", *cols)


def company_values(rubric: Rubric, companies: DataFrame) -> DataFrame:
    """``domain`` and one typed ``c_`` column for each fact that is read; an exact ``company.x`` key wins over ``x``."""
    companies = _complete(companies, COMPANY_COLUMNS)
    cols = []
    for name in rubric.company_reads():
        if name == "domain":
            continue
        if name in ("employees", "leads_seen"):
            value = F.col(name).cast("double")
        elif name in ("name", "region", "funding_stage"):
            value = tx.present(F.col(name))
        else:
            raw = F.coalesce(F.try_element_at("extra", F.lit(f"company.{name}")), F.try_element_at("extra", F.lit(name)))
            value = typed(raw, rubric.company_fields.get(name, FieldType()).kind, rubric.unicode)
        cols.append(value.alias(f"c_{name}"))
    return companies.select("domain", *cols)


def _rollup(r: Rollup) -> Column:
    if r.op == "any":
        out = F.bool_or(r.when.column())
    elif r.op == "all":
        out = F.bool_and(r.when.column())
    elif r.op == "count":
        out = F.count_if(r.when.column()).cast("double")
    elif r.op == "first":
        x = F.col(r.field.column)
        out = F.min_by(x, F.when(x.isNotNull(), F.struct("first_seen_at", "lead_id")))
    else:
        out = (F.max if r.op == "max" else F.min)(r.field.column)
    return out.alias(f"c_{r.name}")


def _derived(d: Derive) -> tuple[Column, Column]:
    """The value and the reason: the first rule that matches, else nothing."""
    value, why = F.lit(None).cast(SPARK_TYPES[d.type.kind]), F.lit(f"{d.name}: no value (no rule matched)")
    for i, ((_, v), when) in reversed(list(enumerate(zip(d.rules, d.conditions, strict=True)))):
        cause = f"rule {i + 1}: {when.text}" if when else "else"
        text = F.lit(f"{d.name}: no value ({cause})" if v is None else f"{d.name} = {render(v)} ({cause})")
        found = F.lit(v).cast(SPARK_TYPES[d.type.kind])
        value = F.when(when.column(), found).otherwise(value) if when else found
        why = F.when(when.column(), text).otherwise(why) if when else text
    return value, why


def _half(rules: list[ScoreRule], half: str) -> tuple[Column, list[Column]]:
    """The sum from left to right, so that doubles add up alike everywhere, and a reason or null for each rule."""
    total, reasons = F.lit(0.0), []
    for r in rules:
        if r.band is None:
            total = total + F.when(r.when.column(), F.lit(r.points)).otherwise(0.0)
            reasons.append(F.when(r.when.column(), F.lit(f"{signed(r.points)} {half}: {r.when.text}")))
            continue
        x = F.col(r.band.column)
        points, why = F.lit(0.0), F.lit(None).cast("string")
        for at, p in sorted(r.bands.items()):
            points = F.when(x >= at, F.lit(p)).otherwise(points)
            text = F.concat(F.lit(f"{signed(p)} {half}: {r.band.display} is "), tx.format_number(x), F.lit(f" (band {render(at)})"))
            why = F.when(x >= at, text if p else F.lit(None).cast("string")).otherwise(why)
        total = total + points
        reasons.append(why)
    return total, reasons


def _resolves(df: DataFrame, c: Column) -> bool:
    """Whether an aggregate reads columns of ``df`` only."""
    try:
        return bool(df.agg(c).columns)
    except AnalysisException:
        return False


def company_rollups(rubric: Rubric, lv: DataFrame, cv: DataFrame) -> DataFrame:
    """``domain`` and a ``c_`` column a rollup, one row a company that has leads.

    Rollups that read leads alone are aggregated before anything is joined, so that the leads of one company, were it a third of all, are combined
    where they are read. Only those that read facts or signals of the company meet these first, lead by lead.
    """
    here = lv.where("domain IS NOT NULL").withColumn("c_domain", F.col("domain"))
    alone = [r for r in rubric.rollups if _resolves(here, _rollup(r))]
    rest = [r for r in rubric.rollups if r not in alone]
    out = here.groupBy("domain").agg(*map(_rollup, alone)) if alone else here.select("domain").distinct()
    if rest:
        out = out.join(here.join(cv, "domain", "left").groupBy("domain").agg(*map(_rollup, rest)), "domain")
    return out


def company_state(rubric: Rubric, leads: DataFrame, companies: DataFrame | None = None, lead_detectors: DataFrame | None = None, company_detectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed leads, one row a company that has leads: facts, rollups and derived values as ``c_`` columns, ``account_score``, ``account_why``)."""
    lv = lead_values(rubric, leads)
    if lead_detectors is not None:
        lv = lv.join(lead_detectors, "lead_id", "left")
    for d in rubric.detectors:
        if d.subject != "company" and f"d_{d.name}" not in lv.columns:
            lv = lv.withColumn(f"d_{d.name}", F.lit(False))
    spark = leads.sparkSession
    cv = company_values(rubric, companies) if companies is not None else company_values(rubric, spark.createDataFrame([], "domain string"))
    if company_detectors is not None:
        cv = cv.join(company_detectors, "domain", "full_outer")
    for d in rubric.detectors:
        if d.subject == "company" and f"d_{d.name}" not in cv.columns:
            cv = cv.withColumn(f"d_{d.name}", F.lit(False))
    # Written tables, so that Spark can split the leads of a company that has a large part of them.
    if company_detectors is not None:
        cv = materialize(cv, "companies")
    state = company_rollups(rubric, lv, cv).join(cv, "domain", "left").withColumn("c_domain", F.col("domain"))
    for d in rubric.derive:
        if d.company:
            value, why = _derived(d)
            state = state.withColumns({f"why_{d.name}": why, f"c_{d.name}": value})
    account, account_why = _half(rubric.account, "account")
    state = state.withColumns({"account_score": account, "account_why": F.array_compact(F.array(*account_why)) if account_why else F.array().cast("array<string>"), "has_company": F.lit(True)})
    return lv, materialize(state, "company-state")


def evaluate(rubric: Rubric, leads: DataFrame, companies: DataFrame | None = None, lead_detectors: DataFrame | None = None, company_detectors: DataFrame | None = None) -> DataFrame:
    """One verdict a lead: ``lead_id, domain, status``, a column a derived name, ``account_score, contact_score, score,
    reasons, blocked, lanes, rubric_version``.

    ``leads`` has lead_id and any of LEAD_COLUMNS, ``companies`` domain and any of COMPANY_COLUMNS, the detector
    frames their key and a boolean ``d_<name>`` each. Only the fields that the rubric reads leave the maps. Rollups over leads
    are one aggregation by domain, combined before the shuffle; those that read facts of the company as well meet these first, and there
    a company is not split. Leads meet their company's state by domain, and a domain that holds a third of
    all leads is split by the adaptive skew join.

    Nulls: an absent value makes each comparison false; a null or empty domain is no company, with account score 0
    and no company values. Lead ids should be unique; repeated ones are each given a verdict.
    """
    lv, state = company_state(rubric, leads, companies, lead_detectors, company_detectors)
    facts = [c for c in state.columns if c.startswith(("c_", "d_"))]
    keep = ["domain", "account_score", "account_why", "has_company", *facts, *(f"why_{d.name}" for d in rubric.derive if d.company)]
    v = lv.join(state.select(*keep), "domain", "left")
    for d in rubric.derive:
        if not d.company:
            value, why = _derived(d)
            v = v.withColumns({f"why_{d.name}": why, f"l_{d.name}": value})
    contact, contact_why = _half(rubric.contact, "contact")
    none = F.array().cast("array<string>")
    here = F.coalesce("has_company", F.lit(False))
    reasons = F.concat(
        F.array_compact(F.array(*(F.col(f"why_{d.name}") for d in rubric.derive))) if rubric.derive else none,
        F.when(here, F.coalesce("account_why", none)).otherwise(F.array(F.lit("no company domain"))),
        F.array_compact(F.array(*contact_why)) if contact_why else none,
    )
    odd = F.filter(F.array(*map(F.lit, rubric.conflicts)), lambda f: F.array_contains(F.coalesce("conflict_fields", none), f)) if rubric.conflicts else none
    blocked = F.when(F.size(odd) > 0, F.concat(F.lit("sources disagree on "), F.array_join(odd, ", ")))
    lanes = [x for _, x in sorted(enumerate(rubric.lanes), key=lambda p: (-p[1].priority, p[0]))]
    matched = F.array_compact(F.array(*(F.when(x.when.column(), F.lit(x.id)) for x in lanes))) if lanes else none
    return v.select(
        "lead_id", "domain", "status",
        *(F.col(f"{'c' if d.company else 'l'}_{d.name}").alias(d.name) for d in rubric.derive),
        F.coalesce("account_score", F.lit(0.0)).alias("account_score"), contact.alias("contact_score"),
        (F.coalesce("account_score", F.lit(0.0)) + contact).alias("score"),
        reasons.alias("reasons"), blocked.alias("blocked"), matched.alias("lanes"), F.lit(rubric.version).alias("rubric_version"),
    )


def parse_warnings(rubric: Rubric, leads: DataFrame) -> DataFrame:
    """``field, type``: the typed fields of which some lead holds a value that does not parse."""
    kinds = {n: rubric.fields[n].kind for n in rubric.lead_reads() if n in rubric.fields and rubric.fields[n].kind in ("number", "date", "bool") and n not in ("sources_seen", "receiver_only")}
    if not kinds:
        return leads.sparkSession.createDataFrame([], "field string, type string")
    bad = leads.agg(*(F.bool_or(unparsed(F.try_element_at("fields", F.lit(n)), k)).alias(n) for n, k in kinds.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.lit(k).alias("type"), F.col(n).alias("bad")) for n, k in kinds.items())))
    return bad.select(rows.alias("r")).where("r.bad").select("r.field", "r.type")


def explain(rubric: Rubric, verdict: dict) -> str:
    """A verdict for a person to read."""
    lines = [f"{d.name}: {render(verdict[d.name])}" for d in rubric.derive]
    lines.append(f"score: {render(verdict['score'])} (account {render(verdict['account_score'])}, contact {render(verdict['contact_score'])})")
    lines += ["reasons:", *(f"  - {r}" for r in verdict["reasons"])] if verdict["reasons"] else []
    return "\n".join([*lines, f"rubric: {rubric.version}"]) + "\n"
