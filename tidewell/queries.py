"""One query an operator over the star tables, with the same result in DuckDB's SQL.

Leads are customers, companies are nations (domain ``n<key>.example``), events are ``events`` by user, and the clock
stands at 2024-01-31. All read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewell.functions import text as tx
from tidewell.functions.values import typed
from tidewell.operators import detectors, events as ev, export, facts, identity, routing, rows, status, tables
from tidewell.operators.lookup import find_people, person_keys, write_by_key
from tidewell.operators.components import connected_components, extend_components
from tidewell.plans.evaluate import company_state, evaluate
from tidewell.plans.incremental import Inputs, reached, rejudge
from tidewell.plans.rubric import Detector, compile_rubric
from tidewell.storage import materialize, work_path
from tidewell.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
NOW = datetime(2024, 1, 31, tzinfo=UTC)
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, one file or a folder of them, read as a stream of its files; a plain path would have to be a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def domain(key: str) -> Column:
    return F.concat(F.lit("n"), F.col(key).cast("string"), F.lit(".example"))


def text_map(**cols: Column) -> Column:
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in cols.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def utc(col: str) -> Column:
    return F.col(col).cast("timestamp")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leads; a negative balance is an absent one, customers of nation 0 have no company."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("lead_id"),
        F.when(F.col("c_nationkey") > 0, domain("c_nationkey")).alias("domain"),
        F.timestamp_seconds(F.lit(1_600_000_000) + (F.col("c_custkey") * 7919) % 100_000).alias("first_seen_at"),
        F.when(F.col("c_custkey") % 10 == 0, "contacted").when(F.col("c_custkey") % 10 == 1, "replied_positive").otherwise("new").alias("status"),
        text_map(segment=F.col("c_mktsegment"), acctbal=F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), nationno=F.col("c_nationkey")).alias("fields"),
        F.col("c_name").alias("full_name"),
        (F.col("c_custkey") % 4).alias("sources_seen"),
        (F.col("c_custkey") % 7 == 0).alias("receiver_only"),
        F.when(F.col("c_custkey") % 50 == 0, F.array(F.lit("segment"))).otherwise(F.array().cast("array<string>")).alias("conflict_fields"),
    )


_CUSTOMERS_SQL = """
    SELECT c_custkey::VARCHAR AS lead_id, c_custkey, CASE WHEN c_nationkey > 0 THEN 'n' || c_nationkey || '.example' END AS domain, c_nationkey,
           1600000000 + (c_custkey * 7919) % 100000 AS first_seen, c_mktsegment AS segment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS acctbal, c_name,
           CASE c_custkey % 10 WHEN 0 THEN 'contacted' WHEN 1 THEN 'replied_positive' ELSE 'new' END AS status,
           c_custkey % 4 AS sources_seen, c_custkey % 7 = 0 AS receiver_only
    FROM customer"""


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.select(domain("n_nationkey").alias("domain"), F.col("n_name").alias("name"), F.col("r_name").alias("region"), (F.col("n_nationkey") * 100).cast("double").alias("employees"))


RUBRIC = """
version: 1
fields:
  acctbal: { type: number }
  nationno: { type: number }
settings:
  top_segments: [building, machinery]
  near: [EUROPE, ASIA]
company:
  richest: { max: acctbal }
  poorest: { min: acctbal }
  builders: { count: { field: segment, eq: building } }
  any_rich: { any: { field: acctbal, gt: 9000 } }
  all_known: { all: { field: acctbal, present: true } }
  first_segment: { first: segment }
detectors:
  buys: { kind: count_in_window, event: purchase, window: 14d, min: 2 }
  errors: { kind: count_in_window, event: "err*", window: 30d, min: 5, subject: company }
derive:
  size:
    level: company
    rules:
    - when: { field: company.employees, lt: 300 }
      then: small
    - when: { all: [ { field: company.employees, lt: 1500 }, { field: company.any_rich, eq: true } ] }
      then: middle
    - else: large
  tier:
    level: company
    rules:
    - when: { field: size, eq: LARGE }
      then: 1
    - when: { any: [ { field: company.region, in: $near }, { detector: errors } ] }
      then: 2
    - when: { field: company.builders, gte: 1000000 }
      then: null
  rich:
    level: lead
    rules:
    - when: { field: acctbal, gte: 5000 }
      then: true
    - else: false
score:
  account:
    - { when: { field: tier, eq: 1 }, points: 40 }
    - { when: { field: company.region, in: $near }, points: 10 }
    - { band: company.builders, points: { 1: 5, 10: 10, 100: 20 } }
  contact:
    - { when: { field: rich, eq: true }, points: 20 }
    - { when: { field: segment, in: $top_segments }, points: 7 }
    - { when: { detector: buys }, points: 30 }
    - { when: { field: acctbal, missing: true }, points: -3 }
    - { band: sources_seen, points: { 2: 10, 3: 12 } }
conflicts:
  - { field: segment }
lanes:
  - { id: warm, kind: non-cold, priority: 30, push: "hubspot:deals", when: { field: status, eq: replied_positive } }
  - { id: cold-rich, kind: cold, priority: 20, push: "apollo:sequence/Rich", when: { all: [ { field: rich, eq: true }, { field: receiver_only, eq: false } ] } }
  - { id: cold-any, kind: cold, priority: 10, push: "apollo:sequence/Any", when: { all: [ { field: tier, lte: 2 }, { field: receiver_only, eq: false } ] } }
  - { id: list, kind: export, priority: 1, push: "export:list", when: { field: segment, not_in: $top_segments } }
"""


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the lead (a user) and the company that the user's number names."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("event_key"), F.col("user_id").cast("string").alias("lead_id"), F.concat(F.lit("n"), (F.col("user_id") % 25).cast("string"), F.lit(".example")).alias("domain"), F.col("event_type").alias("kind"), utc("ts").alias("at"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rubric = compile_rubric(RUBRIC, unicode=False)
    e = user_events(spark, sf_dir)
    lead = detectors.window_counts(e, "lead_id", [d for d in rubric.detectors if d.subject == "lead"], NOW)
    company = detectors.window_counts(e, "domain", [d for d in rubric.detectors if d.subject == "company"], NOW)
    return evaluate(rubric, customers(spark, sf_dir), nations(spark, sf_dir), lead, company)


_VERDICTS_SQL = f"""
    WITH l AS ({_CUSTOMERS_SQL}),
    n AS (SELECT 'n' || n_nationkey || '.example' AS domain, r_name AS region, n_nationkey * 100 AS employees FROM nation JOIN region ON n_regionkey = r_regionkey),
    buys AS (SELECT user_id::VARCHAR AS lead_id FROM events WHERE lower(event_type) = 'purchase' AND ts > TIMESTAMP '2024-01-17' AND ts <= TIMESTAMP '2024-01-31' GROUP BY user_id HAVING count(*) >= 2),
    errs AS (SELECT 'n' || (user_id % 25) || '.example' AS domain FROM events WHERE lower(event_type) LIKE 'err%' AND ts > TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1 HAVING count(*) >= 5),
    roll AS (SELECT domain, max(acctbal) AS richest, min(acctbal) AS poorest, count(*) FILTER (WHERE lower(segment) = 'building') AS builders, bool_or(coalesce(acctbal > 9000, false)) AS any_rich,
                    bool_and(acctbal IS NOT NULL) AS all_known, arg_min(segment, (first_seen, lead_id)) AS first_segment FROM l WHERE domain IS NOT NULL GROUP BY domain),
    c1 AS (SELECT roll.*, region, employees, errs.domain IS NOT NULL AS errors,
                  CASE WHEN employees < 300 THEN 'small' WHEN employees < 1500 AND any_rich THEN 'middle' ELSE 'large' END AS size FROM roll LEFT JOIN n USING (domain) LEFT JOIN errs USING (domain)),
    c2 AS (SELECT *, CASE WHEN size = 'large' THEN 1.0 WHEN coalesce(region IN ('EUROPE', 'ASIA'), false) OR errors THEN 2.0 END AS tier FROM c1),
    c AS (SELECT *, 0.0 + CASE WHEN tier = 1 THEN 40 ELSE 0 END + CASE WHEN region IN ('EUROPE', 'ASIA') THEN 10 ELSE 0 END
                 + CASE WHEN builders >= 100 THEN 20 WHEN builders >= 10 THEN 10 WHEN builders >= 1 THEN 5 ELSE 0 END AS account FROM c2),
    v AS (SELECT l.*, c.size, c.tier, c.region, c.builders, c.errors, c.employees, c.any_rich, c.richest, c.poorest, c.all_known, c.first_segment, c.domain IS NOT NULL AS has_company, coalesce(account, 0)::DOUBLE AS account_score, coalesce(acctbal >= 5000, false) AS rich, buys.lead_id IS NOT NULL AS bought
          FROM l LEFT JOIN c USING (domain) LEFT JOIN buys USING (lead_id)),
    w AS (SELECT *, (CASE WHEN rich THEN 20 ELSE 0 END + CASE WHEN lower(segment) IN ('building', 'machinery') THEN 7 ELSE 0 END + CASE WHEN bought THEN 30 ELSE 0 END
                 + CASE WHEN acctbal IS NULL THEN -3 ELSE 0 END + CASE WHEN sources_seen >= 3 THEN 12 WHEN sources_seen >= 2 THEN 10 ELSE 0 END)::DOUBLE AS contact_score,
                 CASE WHEN status = 'replied_positive' THEN 'warm' END AS lane1, CASE WHEN rich AND NOT receiver_only THEN 'cold-rich' END AS lane2,
                 CASE WHEN coalesce(tier <= 2, false) AND NOT receiver_only THEN 'cold-any' END AS lane3, CASE WHEN lower(segment) NOT IN ('building', 'machinery') THEN 'list' END AS lane4 FROM v)
"""


# --- typed values and text ---------------------------------------------------------


@query("""
    SELECT o_orderkey, o_totalprice AS price, epoch_us(date_trunc('day', o_orderdate)) AS day_us,
           CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS done FROM orders""")
def typed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    flag = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "0").otherwise("maybe")
    return o.select("o_orderkey", typed(F.col("o_totalprice").cast("string"), "number").alias("price"), F.unix_micros(typed(F.date_format("o_orderdate", "yyyy-MM-dd"), "date")).alias("day_us"), typed(flag, "bool", unicode=False).alias("done"))


@query(r"""
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^.*?://', ''), '[/?#].*$', ''), '^.*@', ''), ':[^:]*$', ''), '\.$', ''), '^www\.', '') AS host FROM pages""")
def normalize_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.normalize_domain(F.col("url")).alias("host"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '  ' || p_brand), '\s+', ' ', 'g')) AS name FROM part")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.normalize_name(F.concat(F.lit("  "), "p_name", F.lit("  "), "p_brand"), unicode=False).alias("name"))


@query(r"SELECT p_partkey, regexp_replace(lower(p_type || ' #' || p_brand), '[^a-z0-9]', '', 'g') AS header FROM part")
def squash_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.squash_header(F.concat("p_type", F.lit(" #"), "p_brand")).alias("header"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '''' || '=SUM(' || l_linestatus || ')' WHEN l_linenumber % 3 = 1 THEN '-' || l_linenumber ELSE '''' || '@' || l_returnflag END AS cell FROM lineitem""")
def csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    raw = F.when(n % 3 == 0, F.concat(F.lit("=SUM("), "l_linestatus", F.lit(")"))).when(n % 3 == 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(F.concat(F.lit("@"), "l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.csv_safe(raw).alias("cell"))


@query("""
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'linkedin.com/in/p' || c_custkey WHEN 1 THEN 'linkedin.com/in/p-' || c_custkey WHEN 2 THEN '' WHEN 3 THEN 'linkedin.com/pub/a/1/2/3' WHEN 4 THEN '' ELSE '' END AS key FROM customer""")
def canonical_linkedin(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey").cast("string"), F.col("c_custkey") % 6
    url = (
        F.when(n == 0, F.concat(F.lit(" HTTPS://uk.LinkedIn.com/in/P"), k, F.lit("/en?x=1")))
        .when(n == 1, F.concat(F.lit("//www.linkedin.com//in/p%2D"), k, F.lit("#top")))
        .when(n == 2, F.concat(F.lit("https://linkedin.com/company/"), k))
        .when(n == 3, F.lit("linkedin.com/pub/a/1/2/3/de"))
        .when(n == 4, F.concat(F.lit("https://notlinkedin.com/in/"), k))
        .otherwise(F.lit("N/A"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", tx.canonical_linkedin(url, unicode=False).alias("key"))


@query("""
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'the host of the email has no dot' WHEN 2 THEN 'the email is blank' WHEN 3 THEN 'the email has not the form of an address' ELSE 'there are several addresses in the email' END AS fault,
           CASE WHEN c_custkey % 5 = 0 AND c_custkey % 10 <> 0 THEN 'n' || c_nationkey || '.example' END AS domain FROM customer""")
def email_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_custkey") % 5
    host = F.when(k % 10 == 0, F.lit("gmail.com")).otherwise(domain("c_nationkey"))
    mail = F.when(n == 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@"), host)).when(n == 1, F.lit("ada@localhost")).when(n == 2, F.lit("")).when(n == 3, F.concat(F.lit("no address "), k.cast("string"))).otherwise(F.lit("a@b.example, c@d.example"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.email_fault(mail).alias("fault"), F.when(n == 0, tx.company_domain_of(mail)).alias("domain"))


@query("""
    SELECT p_partkey, sha256(encode('brand=' || p_brand || chr(0) || 'name=' || p_name || chr(0)) || unhex(sha256('email=email'))) AS hash FROM part""")
def row_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.row_hash(cols, {"email": "email"}).alias("hash"))


@query("""
    SELECT event_id, 'visit|' || length('visit_' || event_type) || ':visit_' || event_type || '|2:at|' || length('email:u' || user_id || '@x.example') || ':email:u' || user_id || '@x.example|24:' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS key FROM events""")
def event_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("visit_"), "event_type").alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x.example")).alias("email"), F.lit("").alias("linkedin_url"), F.lit("x.example").alias("domain"),
        utc("ts").alias("at"), utc("ts").alias("received_at"), F.lit("receiver").alias("origin"), F.create_map().cast("map<string,string>").alias("attrs"),
    )
    return e.select("event_id", ev.event_key().alias("key"))


@query("""
    SELECT event_id, CASE event_type WHEN 'view' THEN 'replied_unlabelled' WHEN 'click' THEN NULL WHEN 'purchase' THEN 'replied_positive' WHEN 'error' THEN 'replied_negative' ELSE 'unsubscribed' END AS status FROM events""")
def reply_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    label = F.when(t == "view", "something new").when(t == "click", "out_of_office").when(t == "purchase", " Willing_To_Meet ").when(t == "error", "none_of_the_above").otherwise("unsubscribe")
    return table(spark, sf_dir, "events").select("event_id", ev.reply_status(label, {"none_of_the_above": "replied_negative", "unsubscribe": "replied_neutral"}).alias("status"))


@query("""
    SELECT event_id, CASE WHEN event_type = 'view' THEN 'visit_pricing' WHEN event_type = 'purchase' THEN 'replied_positive' WHEN event_type = 'signup' THEN 'sent' END AS kind,
           CASE WHEN event_type = 'view' THEN CASE WHEN user_id % 3 = 0 THEN '' ELSE 'u' || user_id || '@x.example' END ELSE 'u' || user_id || '@x.example' END AS email,
           CASE WHEN event_type = 'view' THEN 'x' || (user_id % 7) || '.example' ELSE '' END AS domain, event_type = 'error' AS ignored FROM events""")
def parse_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    mail = F.concat(F.lit(" U"), u, F.lit("@X.example "))
    word = tx.lookup({"purchase": "email_replied_positive", "signup": "email_sent", "error": "email_bounced"}, t)
    reply = F.to_json(F.struct(F.coalesce(word, F.lit("email_opened")).alias("event"), mail.alias("contact_email"), F.lit("Interested").alias("contact_stage")))
    site = F.concat(F.lit("https://www.X"), (F.col("user_id") % 7).cast("string"), F.lit(".example/about"))
    visit = F.to_json(F.struct(F.lit("website_visited_Pricing").alias("event"), F.struct(F.when(F.col("user_id") % 3 != 0, mail).alias("email")).alias("contact"), F.struct(site.alias("website_url")).alias("account")))
    raw = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), utc("ts").alias("received_at"), F.when(t == "view", "apollo_visit").otherwise("apollo_reply").alias("kind"), F.when(t == "view", visit).otherwise(reply).alias("body"), t.alias("t"))
    out = ev.parse_raw(raw).join(raw.select("seq", "t"), "seq")
    return out.select(F.col("seq").alias("event_id"), "kind", "email", "domain", (F.col("ignored").isNotNull() & (F.col("t") == "error")).alias("ignored"))


# --- conditions --------------------------------------------------------------------


def flags(spark: SparkSession, leads: DataFrame, conditions: dict[str, str], head: str = "") -> DataFrame:
    """``lead_id`` and a boolean a condition."""
    blocks = "\n".join(f"  {n}:\n  - {{ when: {c}, then: true }}\n  - {{ else: false }}" for n, c in conditions.items())
    rubric = compile_rubric(f"version: 1\n{head}\nderive:\n{blocks}\nlanes: []\n", unicode=False)
    return evaluate(rubric, leads).select("lead_id", *conditions)


@query(f"""
    SELECT lead_id, coalesce(acctbal = 1234.5, false) AS eq_num, coalesce(acctbal <> 1234.5, false) AS ne_num, NOT coalesce(acctbal = 1234.5, false) AS not_eq, lower(segment) = 'building' AS eq_text,
           acctbal IS NOT NULL AS present, acctbal IS NULL AS missing, coalesce(acctbal < 1000, false) AS lt, coalesce(acctbal >= 1000, false) AS gte, coalesce(acctbal < 1000, false) OR status <> 'new' AS either FROM ({_CUSTOMERS_SQL})""")
def cond_eq_ne_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, customers(spark, sf_dir), {
        "eq_num": "{ field: acctbal, eq: 1234.5 }", "ne_num": "{ field: acctbal, ne: 1234.5 }", "not_eq": "{ not: { field: acctbal, eq: 1234.5 } }", "eq_text": "{ field: segment, eq: ' Building ' }",
        "present": "{ field: acctbal, present: true }", "missing": "{ field: acctbal, missing: true }", "lt": "{ field: acctbal, lt: 1000 }", "gte": "{ field: acctbal, gte: 1e3 }",
        "either": "{ any: [ { field: acctbal, lt: 1000 }, { field: status, ne: new } ] }",
    }, "fields: { acctbal: { type: number } }")


@query(f"""
    SELECT lead_id, lower(segment) IN ('building', 'machinery') AS in_list, lower(segment) NOT IN ('building', 'machinery') AS out_list, false AS in_none, true AS out_none, contains(lower(segment), 'house') AS has_house,
           lower(segment) IN ('building', 'machinery') AND NOT contains(lower(c_name), '7') AS every FROM ({_CUSTOMERS_SQL})""")
def cond_in_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, customers(spark, sf_dir), {
        "in_list": "{ field: segment, in: $two }", "out_list": "{ field: segment, not_in: [Building, MACHINERY] }", "in_none": "{ field: segment, in: [] }", "out_none": "{ field: segment, not_in: [] }", "has_house": "{ field: segment, contains: HOUSE }",
        "every": "{ all: [ { field: segment, in: $two }, { not: { field: full_name, contains: '7' } } ] }",
    }, "settings: { two: [building, machinery] }")


@query("""
    WITH o AS (SELECT o_orderkey::VARCHAR AS lead_id, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE -1 END AS r, o_orderpriority AS p FROM orders)
    SELECT lead_id, r < 1 AS below_high, r >= 1 AS from_high, p = '2-HIGH' AS is_high, p IN ('1-URGENT', '5-LOW') AS ends FROM o""")
def cond_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("lead_id"), text_map(level=F.regexp_replace("o_orderpriority", "-", " - ")).alias("fields"))
    head = "settings: { levels: [1-URGENT, 2 high, 3_medium] }\nfields: { level: { type: { ordered: levels } } }"
    return flags(spark, o, {"below_high": "{ field: level, lt: 2-HIGH }", "from_high": "{ field: level, gte: 2 HIGH }", "is_high": "{ field: level, eq: 2_high }", "ends": "{ field: level, in: [1urgent, 5-LOW] }"}, head)


@query(f"""
    SELECT lead_id, coalesce(acctbal > 100.0 AND acctbal / 2.0 < 2000.0, false) AS arith, starts_with(c_name, 'Customer#0000') AS named, status IN ('new', 'contacted') AS fresh, acctbal IS NOT NULL AS known, coalesce(acctbal < 0.0 OR status = 'new', false) AS absorb,
           length(segment) > 8 AS long, false AS wrong FROM ({_CUSTOMERS_SQL})""")
def cond_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flags(spark, customers(spark, sf_dir), {
        "arith": "{ expr: 'lead.acctbal > 100.0 && lead.acctbal / 2.0 < 2000.0' }", "named": "{ expr: 'lead.full_name.startsWith(\"Customer#0000\")' }", "fresh": "{ expr: 'status in [\"new\", \"contacted\"]' }", "known": "{ expr: 'has(lead.acctbal)' }",
        "absorb": "{ expr: 'lead.acctbal < 0.0 || status == \"new\"' }", "long": "{ expr: 'size(lead.segment) > 8' }", "wrong": "{ expr: 'lead.acctbal + 1 > 0.0' }",
    }, "fields: { acctbal: { type: number } }")


# --- the rubric --------------------------------------------------------------------


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rubric = compile_rubric(RUBRIC, unicode=False)
    return company_state(rubric, customers(spark, sf_dir), nations(spark, sf_dir))[1]


@query(f"{_VERDICTS_SQL} SELECT domain, any_rich, all_known, builders::DOUBLE AS builders FROM c")
def rollup_any_all_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("domain", F.col("c_any_rich").alias("any_rich"), F.col("c_all_known").alias("all_known"), F.col("c_builders").alias("builders"))


@query(f"{_VERDICTS_SQL} SELECT domain, richest, poorest, first_segment FROM c")
def rollup_max_min_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("domain", F.col("c_richest").alias("richest"), F.col("c_poorest").alias("poorest"), F.col("c_first_segment").alias("first_segment"))


@query(f"{_VERDICTS_SQL} SELECT lead_id, size, tier::DOUBLE AS tier, rich FROM w")
def derive_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("lead_id", "size", "tier", "rich")


@query(f"{_VERDICTS_SQL} SELECT lead_id, account_score, contact_score, account_score + contact_score AS score FROM w")
def score_points_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("lead_id", "account_score", "contact_score", "score")


def _yesterday(leads: DataFrame) -> DataFrame:
    """Leads before some changed: other segments, another company, some missing, some that are gone since."""
    k = F.col("lead_id").try_cast("long")  # Spark may carry these conditions on to ids that are no numbers
    old = leads.where(k % 211 != 0)
    old = old.withColumn("fields", F.when(k % 97 == 0, F.map_concat(F.map_filter("fields", lambda n, _: n != "segment"), F.create_map(F.lit("segment"), F.lit("OTHER")))).otherwise(F.col("fields")))
    old = old.withColumn("domain", F.when(k % 307 == 0, F.lit("n3.example")).otherwise(F.col("domain")))
    gone = leads.where(k % 401 == 0).withColumn("lead_id", F.concat(F.lit("gone-"), "lead_id"))
    return old.unionByName(gone)


@query(f"{_VERDICTS_SQL} SELECT lead_id, account_score, contact_score, account_score + contact_score AS score FROM w")
def incremental_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rubric = compile_rubric(RUBRIC, unicode=False)
    e, now = user_events(spark, sf_dir), customers(spark, sf_dir)
    signals = lambda subject, key: detectors.window_counts(e, key, [d for d in rubric.detectors if d.subject == subject], NOW)
    after = Inputs(now, nations(spark, sf_dir), materialize(signals("lead", "lead_id"), "lead-signals"), materialize(signals("company", "domain"), "company-signals"))
    before = Inputs(_yesterday(now), after.companies.where("region != 'ASIA'"), after.lead_signals, after.company_signals)
    old = materialize(evaluate(rubric, before.leads, before.companies, before.lead_signals, before.company_signals), "verdicts")
    delta = materialize(rejudge(rubric, old, after, reached(before, after)), "verdict-changes")
    kept = old.join(delta.select("lead_id"), "lead_id", "left_anti")
    return kept.unionByName(delta.where("change != 'delete'").select(*old.columns)).select("lead_id", "account_score", "contact_score", "score")


@query(f"""{_VERDICTS_SQL}
    SELECT lead_id, concat_ws('; ',
        CASE WHEN has_company THEN 'size = ' || size || CASE size WHEN 'small' THEN ' (rule 1: company.employees < 300)' WHEN 'middle' THEN ' (rule 2: company.employees < 1500 and company.any_rich = true)' ELSE ' (else)' END END,
        CASE WHEN has_company THEN CASE WHEN tier = 1 THEN 'tier = 1 (rule 1: size = LARGE)' WHEN tier = 2 THEN 'tier = 2 (rule 2: company.region in $near or errors fired)' ELSE 'tier: no value (no rule matched)' END END,
        CASE WHEN rich THEN 'rich = true (rule 1: acctbal >= 5000)' ELSE 'rich = false (else)' END,
        CASE WHEN NOT has_company THEN 'no company domain' END,
        CASE WHEN tier = 1 THEN '+40 account: tier = 1' END, CASE WHEN region IN ('EUROPE', 'ASIA') THEN '+10 account: company.region in $near' END,
        CASE WHEN builders >= 100 THEN '+20 account: company.builders is ' || builders || ' (band 100)' WHEN builders >= 10 THEN '+10 account: company.builders is ' || builders || ' (band 10)' WHEN builders >= 1 THEN '+5 account: company.builders is ' || builders || ' (band 1)' END,
        CASE WHEN rich THEN '+20 contact: rich = true' END, CASE WHEN lower(segment) IN ('building', 'machinery') THEN '+7 contact: segment in $top_segments' END, CASE WHEN bought THEN '+30 contact: buys fired' END,
        CASE WHEN acctbal IS NULL THEN '-3 contact: acctbal is missing' END,
        CASE WHEN sources_seen >= 3 THEN '+12 contact: sources_seen is 3 (band 3)' WHEN sources_seen >= 2 THEN '+10 contact: sources_seen is 2 (band 2)' END) AS reasons FROM w""")
def reasons_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("lead_id", F.array_join("reasons", "; ").alias("reasons"))


@query(f"{_VERDICTS_SQL} SELECT lead_id, concat_ws(',', lane1, lane2, lane3, lane4) AS lanes, CASE WHEN c_custkey % 50 = 0 THEN 'sources disagree on segment' END AS blocked FROM w")
def lanes_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("lead_id", F.array_join("lanes", ",").alias("lanes"), "blocked")


@query(f"{_VERDICTS_SQL} SELECT lead_id, account_score + contact_score AS score, row_number() OVER (ORDER BY account_score + contact_score DESC, lead_id)::INT AS place FROM w ORDER BY score DESC, lead_id LIMIT 100")
def ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = verdicts(spark, sf_dir).select("lead_id", "score").orderBy(F.desc("score"), "lead_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "lead_id")))


# --- detectors ---------------------------------------------------------------------


@query("""
    SELECT user_id::VARCHAR AS lead_id, count(*) FILTER (WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-17') >= 2 AS d_buys, count(*) FILTER (WHERE (event_type = 'view' OR event_type = 'click') AND event_type LIKE 'v%' AND ts > TIMESTAMP '2024-01-24') >= 3 AS d_views
    FROM events WHERE ts > TIMESTAMP '2024-01-17' AND ts <= TIMESTAMP '2024-01-31' GROUP BY user_id""")
def count_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [Detector("buys", "count_in_window", event="Purchase", window=timedelta(days=14), min=2), Detector("views", "count_in_window", event="v*", window=timedelta(days=7), min=3)]
    return detectors.window_counts(user_events(spark, sf_dir), "lead_id", specs, NOW)


@query("""
    WITH d(detector, pattern, length, least) AS (VALUES ('buys', 'purchase', INTERVAL 14 DAY, 2), ('views', 'v%', INTERVAL 7 DAY, 3)),
    e AS (SELECT user_id::VARCHAR AS subject, detector, ts, length, CASE least WHEN 2 THEN lag(ts, 1) OVER w ELSE lag(ts, 2) OVER w END AS oldest FROM events JOIN d ON lower(event_type) LIKE pattern WINDOW w AS (PARTITION BY user_id, detector ORDER BY ts)),
    i AS (SELECT subject, detector, ts, oldest + length AS stop FROM e WHERE oldest > ts - length),
    n AS (SELECT *, lag(stop) OVER w AS stop_before, lead(ts) OVER w AS ts_after FROM i WINDOW w AS (PARTITION BY subject, detector ORDER BY ts, stop)),
    c AS (SELECT subject, detector, true AS "on", ts AS t FROM n WHERE stop_before IS NULL OR stop_before < ts UNION ALL SELECT subject, detector, false, stop FROM n WHERE ts_after IS NULL OR ts_after > stop)
    SELECT subject, detector, "on", epoch_us(t) AS at_us FROM c WHERE t <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_window_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [Detector("buys", "count_in_window", event="Purchase", window=timedelta(days=14), min=2), Detector("views", "count_in_window", event="v*", window=timedelta(days=7), min=3)]
    e = stream(spark, sf_dir, "events").select(F.col("user_id").alias("lead_id"), F.col("event_type").alias("kind"), utc("ts").alias("at"))
    path = work_path(spark, "window-changes")
    stateful.to_table(stateful.window_changes(e, "lead_id", specs), f"{path}/rows", f"{path}/checkpoint")
    return stateful.read_table(spark, f"{path}/rows", stateful.CHANGES).select("subject", "detector", "on", F.unix_micros("at").alias("at_us"))


@query("SELECT DISTINCT user_id || '|' || event_type AS event_key FROM events")
def stream_once_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("event_key"), utc("ts").alias("received_at"))
    path = work_path(spark, "once-by-key")
    stateful.to_table(stateful.once_by_key(e, timedelta(days=365)), f"{path}/rows", f"{path}/checkpoint")
    return stateful.read_table(spark, f"{path}/rows", "event_key string, received_at timestamp").select("event_key")


class Sessions(detectors.SubjectDetector):
    """Whether ``least`` events follow each other with gaps of at most ``gap`` seconds, none of them of the kind that ends a session."""

    def __init__(self, params: dict, now: datetime):
        super().__init__(params, now)
        self.last, self.run, self.found = None, 0, False

    def step(self, kinds, times) -> None:
        for kind, t in zip(kinds, times.tolist(), strict=True):
            near = self.last is not None and t - self.last <= self.params["gap"] * 1_000_000
            self.run = 0 if kind == self.params["ends"] else self.run + 1 if near else 1
            self.last = t
            self.found |= self.run >= self.params["least"]

    def fires(self) -> bool:
        return self.found


detectors.register_subject_detector("session", Sessions)


@query("""
    WITH e AS (SELECT user_id, lower(event_type) AS kind, ts, lag(ts) OVER w AS before, lag(lower(event_type)) OVER w AS kind_before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, lower(event_type))),
    s AS (SELECT *, sum(CASE WHEN kind = 'error' OR kind_before = 'error' OR before IS NULL OR ts - before > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, kind ROWS UNBOUNDED PRECEDING) AS session FROM e),
    n AS (SELECT user_id, session, count(*) FILTER (WHERE kind <> 'error') AS n FROM s GROUP BY ALL)
    SELECT user_id::VARCHAR AS lead_id, max(n) >= 3 AS d_eager FROM n GROUP BY user_id""")
def custom_session_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = Detector("eager", "session", params={"gap": 43_200, "ends": "error", "least": 3})
    return detectors.evaluate_detectors([spec], user_events(spark, sf_dir), None, None, "lead_id", NOW)


@query("SELECT user_id::VARCHAR AS lead_id, coalesce(min(ts) FILTER (WHERE event_type = 'signup') > TIMESTAMP '2024-01-24' AND min(ts) FILTER (WHERE event_type = 'signup') <= TIMESTAMP '2024-01-31', false) AS d_new FROM events GROUP BY user_id")
def first_seen_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = detectors.first_seen(user_events(spark, sf_dir), "lead_id")
    return detectors.first_seen_within(seen, "lead_id", [Detector("new", "first_seen", event="signup", window=timedelta(days=7))], NOW)


@query("SELECT user_id::VARCHAR AS lead_id, event_type AS kind, epoch_us(min(ts)) AS at_us FROM events GROUP BY ALL")
def first_seen_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.first_seen(user_events(spark, sf_dir), "lead_id").select("lead_id", "kind", F.unix_micros("at").alias("at_us"))


@query("""
    SELECT 's' || s_suppkey AS domain, s_suppkey % 2 = 1 AND s_suppkey % 40 < 30 AND s_suppkey % 3 = 0 AS d_moved FROM supplier""")
def fact_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    at = F.lit(NOW) - F.make_dt_interval(days=(k % 40).cast("int"))
    f = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("domain"), F.lit("stage").alias("fact"), F.lit("Series B").alias("value"), at.alias("at"), F.when(k % 2 == 1, F.when(k % 3 == 0, "Seed").otherwise(" series b ")).alias("previous"))
    return detectors.fact_changes(f, [Detector("moved", "change", "company", fact="stage", window=timedelta(days=30), before="SEED")], NOW, unicode=False)


# --- identity ----------------------------------------------------------------------


def _person_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Orders (source 0) and customers (source 1) as rows about the customer."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    mail = lambda k: F.concat(F.lit("C"), F.col(k).cast("string"), F.lit("@N.example"))
    a = o.select(F.lit("orders").alias("source_id"), F.lit(0).alias("source_pos"), F.col("o_orderkey").alias("ord"), F.create_map(F.lit("E-mail Address"), mail("o_custkey"), F.lit("Segment"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(""), F.lit("Stage"), F.col("o_orderstatus")).alias("cols"))
    b = c.select(F.lit("customers").alias("source_id"), F.lit(1).alias("source_pos"), F.col("c_custkey").alias("ord"), F.create_map(F.lit("E-mail Address"), mail("c_custkey"), F.lit("Segment"), F.col("c_mktsegment"), F.lit("Stage"), F.lit("")).alias("cols"))
    return a.unionByName(b), ["E-mail Address", "Segment", "Stage"]


_PERSON_SQL = """
    p AS (SELECT 'orders' AS source_id, 0 AS pos, o_orderkey AS ord, 'c' || o_custkey || '@n.example' AS email, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS segment FROM orders
          UNION ALL SELECT 'customers', 1, c_custkey, 'c' || c_custkey || '@n.example', c_mktsegment FROM customer)"""


@query(f"""
    WITH {_PERSON_SQL}, f AS (SELECT email, arg_min(source_id, (pos, ord)) AS s FROM p GROUP BY email)
    SELECT source_id, email AS row_id, f.s || '|' || email AS lead_key, count(*)::BIGINT AS n FROM p JOIN f USING (email) GROUP BY ALL""")
def identity_email_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, headers = _person_rows(spark, sf_dir)
    known = spark.createDataFrame([], "key string, kind string, lead_id string, source_id string")
    applied = spark.createDataFrame([], "source_id string, row_id string, lead_id string")
    m = identity.match_rows(rows.normalize(r, headers, unicode=False), known, applied, run_ms=1_706_659_200_000)
    return m.groupBy("source_id", "row_id", "lead_key").agg(F.count(F.lit(1)).alias("n"))


_KEYS_SQL = """
    c AS (SELECT c_custkey AS k, 'c' || c_custkey || '@n.example' AS email, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN c_custkey - 1 ELSE c_custkey END AS u FROM customer),
    lead AS (SELECT k, email, u, CASE WHEN k % 5 = 0 THEN 'L' || k ELSE 'customers|' || email END AS lead_key FROM c),
    own AS (SELECT u, arg_min(lead_key, k) AS lead_key FROM lead WHERE u IS NOT NULL GROUP BY u),
    m AS (SELECT 'customers' AS source_id, l.email AS row_id, l.lead_key, l.u IS NOT NULL AND own.lead_key <> l.lead_key AS key_conflict FROM lead l LEFT JOIN own USING (u)
          UNION ALL SELECT 'orders', 'linkedin.com/in/c' || o_custkey, coalesce(own.lead_key, 'orders|linkedin.com/in/c' || o_custkey), false FROM orders LEFT JOIN own ON own.u = o_custkey WHERE o_orderpriority = '1-URGENT'
          UNION ALL SELECT 'orders', l.email, l.lead_key, false FROM orders JOIN lead l ON l.k = o_custkey WHERE o_orderpriority <> '1-URGENT')"""


def _keyed_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(normalized rows, stored identities, earlier rows): customers bring an email and most a profile URL, some that of the one before; orders
    come by email, urgent ones by profile URL alone. Every fifth customer's email is stored."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    mail = lambda k: F.concat(F.lit("c"), F.col(k).cast("string"), F.lit("@n.example"))
    url = lambda k: F.concat(F.lit("https://www.linkedin.com/in/c"), k.cast("string"), F.lit("/"))
    k, urgent = F.col("c_custkey"), F.col("o_orderpriority") == "1-URGENT"
    mine = F.when(k % 7 == 0, "").when(k % 11 == 0, url(k - 1)).otherwise(url(k))
    cells = lambda e, u, t: F.create_map(F.lit("email"), e, F.lit("LinkedIn URL"), u, F.lit("title"), t)
    a = c.select(F.lit("customers").alias("source_id"), F.lit(0).alias("source_pos"), k.alias("ord"), cells(mail("c_custkey"), mine, F.lit("")).alias("cols"))
    b = o.select(F.lit("orders").alias("source_id"), F.lit(1).alias("source_pos"), F.col("o_orderkey").alias("ord"), cells(F.when(urgent, "").otherwise(mail("o_custkey")), F.when(urgent, url(F.col("o_custkey"))).otherwise(""), F.col("o_orderstatus")).alias("cols"))
    known = c.select(F.when(k % 5 == 0, mail("c_custkey")).alias("key"), F.lit("email").alias("kind"), F.when(k % 5 == 0, F.concat(F.lit("L"), k.cast("string"))).alias("lead_id"), F.lit("old").alias("source_id"))
    applied = c.select(F.lit("customers").alias("source_id"), mail("c_custkey").alias("row_id"), F.when(k % 10 == 0, F.concat(F.lit("L"), k.cast("string"))).alias("lead_id"))
    return rows.normalize(a.unionByName(b), ["email", "LinkedIn URL", "title"], unicode=False), known, applied


@query(f"WITH {_KEYS_SQL} SELECT source_id, row_id, lead_key, key_conflict, count(*)::BIGINT AS n FROM m GROUP BY ALL")
def identity_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, known, applied = _keyed_rows(spark, sf_dir)
    m = identity.match_rows(r, known, applied, run_ms=1_706_659_200_000, unicode=False)
    return m.groupBy("source_id", "row_id", "lead_key", "key_conflict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH {_KEYS_SQL}, t AS (SELECT coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN coalesce(own.lead_key, 'orders|linkedin.com/in/c' || o_custkey) END, lead.lead_key) AS lead_key, o_orderkey, o_orderstatus, o_orderpriority = '1-URGENT' AS urgent, o_custkey
                             FROM orders LEFT JOIN own ON own.u = o_custkey JOIN lead ON lead.k = o_custkey),
    g AS (SELECT *, min(o_orderkey) OVER (PARTITION BY urgent, o_custkey) AS turn FROM t)
    SELECT lead_key, 'title' AS field, arg_min(o_orderstatus, (turn, o_orderkey)) AS value FROM g GROUP BY lead_key
    UNION ALL SELECT lead_key, 'email', email FROM lead
    UNION ALL SELECT lead_key, 'linkedin_url', 'linkedin.com/in/c' || u FROM own
    UNION ALL SELECT DISTINCT 'orders|linkedin.com/in/c' || o_custkey, 'linkedin_url', 'linkedin.com/in/c' || o_custkey FROM orders LEFT JOIN own ON own.u = o_custkey WHERE o_orderpriority = '1-URGENT' AND own.u IS NULL
    UNION ALL SELECT lead_key, 'company.domain', 'n.example' FROM lead""")
def lead_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, known, applied = _keyed_rows(spark, sf_dir)
    m = materialize(identity.match_rows(r, known, applied, run_ms=1_706_659_200_000, unicode=False), "matches")
    keys = m.select("lead_id", "lead_key").distinct()
    return identity.lead_fields(r, m).join(keys, "lead_id").select("lead_key", "field", "value")


@query(f"""
    WITH {_PERSON_SQL}, s AS (SELECT * FROM p WHERE segment IS NOT NULL AND segment <> ''), k AS (SELECT email, arg_min(segment, (pos, ord)) AS kept, arg_min(source_id, (pos, ord)) AS kept_source FROM s GROUP BY email),
    x AS (SELECT email, count(DISTINCT segment) AS odd FROM s JOIN k USING (email) WHERE segment <> kept AND source_id <> kept_source GROUP BY email)
    SELECT email, kept AS segment, kept_source AS source, coalesce(odd, 0)::BIGINT AS others FROM k LEFT JOIN x USING (email)""")
def fill_if_empty_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, headers = _person_rows(spark, sf_dir)
    n = rows.normalize(r, headers, unicode=False).select(F.col("fields")["email"].alias("email"), F.try_element_at("fields", F.lit("segment")).alias("segment"), "source_id", "source_pos", "ord")
    kept = rows.fill_first(n, "email", ["segment"], ["source_pos", "ord"]).where("segment IS NOT NULL")
    odd = rows.conflicts(n, "email", ["segment"], ["source_pos", "ord"])
    return kept.join(odd, "email", "left").select("email", F.col("segment.value").alias("segment"), F.col("segment.source_id").alias("source"), F.coalesce(F.size(F.try_element_at("conflicts", F.lit("segment"))), F.lit(0)).cast("long").alias("others"))


@query("""
    WITH a AS (SELECT o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 'web' WHEN 'O' THEN 'web' ELSE o_orderstatus END AS ch, o_orderstatus = 'P' AS recv FROM orders)
    SELECT k::VARCHAR AS lead_id, count(DISTINCT ch)::BIGINT AS sources_seen, bool_and(recv) AS receiver_only FROM a GROUP BY k""")
def sources_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("lead_id"), F.when(F.col("o_orderstatus") == "P", rows.RECEIVER).otherwise(F.col("o_orderstatus")).alias("source_id"))
    live = o.select("lead_id", F.col("lead_id").alias("live_id")).distinct()
    channels = spark.createDataFrame([("F", "web"), ("O", "web")], "source_id string, channel string")
    return identity.sources_seen(o.where("source_id != 'F'"), o.where("source_id = 'F'"), live, channels)


@query("SELECT 'n' || c_nationkey || '.example' AS domain, count(*)::BIGINT AS leads_seen FROM customer WHERE c_custkey % 11 <> 0 GROUP BY c_nationkey")
def leads_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return identity.leads_seen(c.select(F.col("c_custkey").cast("string").alias("lead_id"), domain("c_nationkey").alias("domain"), F.when(F.col("c_custkey") % 11 == 0, "x").alias("merged_into")))


@query("""
    SELECT p_partkey::VARCHAR AS lead_id, CASE WHEN p_partkey % 100 BETWEEN 95 AND 98 THEN p_partkey - p_partkey % 100 + 95 WHEN p_partkey % 100 < 90 THEN p_partkey - p_partkey % 10 ELSE p_partkey END::VARCHAR AS live_id,
           p_partkey % 100 BETWEEN 95 AND 98 AS cycle FROM part""")
def live_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to nine merges, each part into the one before it, back to a multiple of ten; one a hundred names a part that is not there, three are a cycle, and one leads into it."""
    k = F.col("p_partkey")
    into = F.when((k % 100 < 90) & (k % 10 != 0), k - 1).when(k % 100 == 91, F.lit(-1)).when((k % 100 == 95) | (k % 100 == 96), k + 1).when(k % 100 == 97, k - 2).when(k % 100 == 98, k - 3)
    return identity.live_leads(table(spark, sf_dir, "part").select(k.cast("string").alias("lead_id"), into.cast("string").alias("merged_into")))


@query("""
    SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN (CASE WHEN c_custkey % 5 = 0 AND p IS NOT NULL THEN p ELSE c_custkey END)::VARCHAR END AS lead_id
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT c_custkey AS p FROM customer) ON p = o_custkey - 1""")
def person_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each order names, by email, profile URL or id, over written key files; every fifth customer is merged into the one before, and orders of every seventh name nobody."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.cast("string").alias("lead_id"), F.when(k % 5 == 0, (k - 1).cast("string")).alias("merged_into"))
    email = c.select(F.concat(F.lit("c"), "lead_id", F.lit("@acme.example")).alias("key"), "lead_id")
    url = c.select(F.concat(F.lit("linkedin.com/in/c"), "lead_id").alias("key"), "lead_id")
    path = work_path(spark, "person-keys")
    write_by_key(person_keys(materialize(identity.live_leads(c), "live"), email.unionByName(url)), path, "key")
    who, n = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 3
    raw = F.when(F.col("o_custkey") % 7 == 0, F.concat(F.lit("nobody"), who, F.lit("@acme.example")))
    raw = raw.when(n == 0, F.concat(F.lit(" C"), who, F.lit("@Acme.example"))).when(n == 1, F.concat(F.lit("https://www.linkedin.com/in/C"), who, F.lit("/?trk=x"))).otherwise(who)
    return find_people(spark.read.parquet(path), table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")), "raw", unicode=False).select("o_orderkey", "lead_id")


@query("SELECT s_suppkey::VARCHAR AS lead_id, (s_suppkey - s_suppkey % 4)::VARCHAR AS merged_into FROM supplier WHERE s_suppkey % 4 <> 0")
def same_as_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that tie each supplier to the next within fours, and some that name nobody; the oldest of each four survives."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    people = s.select(k.cast("string").alias("lead_id"), F.timestamp_seconds(k).alias("created_at"), F.lit(None).cast("string").alias("merged_into"))
    return identity.merge_edges(people, s.select(k.cast("string").alias("lead_id"), F.when(k % 4 != 0, (k - 1).cast("string")).alias("other_id")))


@query("""
    WITH p AS (SELECT s_suppkey, s_nationkey, s_suppkey % 3 AS n FROM supplier), g AS (SELECT s_nationkey, n FROM p GROUP BY ALL HAVING count(*) > 1)
    SELECT s_suppkey::VARCHAR AS lead_id FROM p JOIN g USING (s_nationkey, n)""")
def namesake_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return identity.namesakes(s.select(F.col("s_suppkey").cast("string").alias("lead_id"), domain("s_nationkey").alias("domain"), F.concat(F.lit(" Name  "), (F.col("s_suppkey") % 3).cast("string")).alias("full_name")), unicode=False)


@query("""
    WITH g AS (SELECT o_custkey, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT *, sum(n) OVER (ORDER BY first ROWS UNBOUNDED PRECEDING) AS upto FROM g)
    SELECT o_custkey::VARCHAR AS row_id, n::BIGINT AS rows FROM r WHERE upto <= 500 OR upto = n""")
def ingest_chunk_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("row_id")).agg(F.min("o_orderkey").alias("first_ord"), F.count(F.lit(1)).alias("rows"))
    return rows.chunk(g, 500).select("row_id", "rows")


# --- events, outcomes, status -------------------------------------------------------


@query("""
    WITH e AS (SELECT event_type AS source_id, (user_id % 50)::VARCHAR AS row_id, sha256(event_id::VARCHAR) AS h, event_id FROM events)
    SELECT source_id, row_id, CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(concat_ws('|', count(*), sum(('0x' || h[1:16])::UBIGINT), sum(('0x' || h[17:32])::UBIGINT), sum(('0x' || h[33:48])::UBIGINT), sum(('0x' || h[49:64])::UBIGINT))) END AS hash, min(event_id) AS first, count(*)::BIGINT AS rows
    FROM e GROUP BY source_id, row_id""")
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), (F.col("user_id") % 50).cast("string").alias("row_id"), F.sha2(F.col("event_id").cast("string"), 256).alias("row_hash"), F.lit(0).alias("source_pos"), F.col("event_id").alias("ord"))
    return rows.groups(e).select("source_id", "row_id", "hash", F.col("first_ord.ord").alias("first"), "rows")


@query("""
    SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS ord, s_name AS name FROM supplier""")
def input_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return rows.input_rows(s, "suppliers", ["s_name"], ["s_acctbal", "s_suppkey"]).select("ord", F.col("cols")["s_name"].alias("name"))


@query("""
    WITH e AS (SELECT event_id, ts, user_id || '|' || event_type AS event_key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r, user_id FROM events)
    SELECT event_key, event_id FROM e WHERE r = 1 AND user_id % 5 <> 0""")
def event_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("event_key"), "event_id", utc("ts").alias("received_at"), F.col("event_id").alias("seq"), "user_id")
    seen = e.where("user_id % 5 = 0").select("event_key").distinct()
    return ev.first_arrivals(e, seen).select("event_key", "event_id")


def _outcome_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as sends, purchases as positive replies, clicks as replies, errors of some users as opt-outs."""
    e = table(spark, sf_dir, "events")
    kind = tx.lookup({"signup": "sent", "purchase": "replied_positive", "click": "replied"}, F.col("event_type"))
    kind = F.when((F.col("event_type") == "error") & (F.col("user_id") % 9 == 0), "unsubscribed").otherwise(kind)
    return e.select(F.col("event_id").cast("string").alias("event_key"), F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("lead_id"), kind.alias("kind"), utc("ts").alias("at"), utc("ts").alias("received_at"), F.create_map().cast("map<string,string>").alias("attrs")).where("kind IS NOT NULL")


_OUTCOMES_SQL = """
    e AS (SELECT event_id, ts, user_id::VARCHAR AS lead_id, CASE event_type WHEN 'signup' THEN 'sent' WHEN 'purchase' THEN 'replied_positive' WHEN 'click' THEN 'replied_neutral' WHEN 'error' THEN CASE WHEN user_id % 9 = 0 THEN 'unsubscribed' END END AS kind FROM events),
    o AS (SELECT lead_id, min(ts) FILTER (WHERE kind = 'unsubscribed') AS unsub, arg_max(kind, (ts, event_id)) FILTER (WHERE kind LIKE 'replied%') AS reply, max(ts) FILTER (WHERE kind LIKE 'replied%') AS reply_at, min(ts) FILTER (WHERE kind = 'sent') AS contacted
          FROM e WHERE kind IS NOT NULL GROUP BY lead_id)"""


@query(f"WITH {_OUTCOMES_SQL} SELECT lead_id, epoch_us(unsub) AS unsub_us, reply, epoch_us(reply_at) AS reply_us, epoch_us(contacted) AS contacted_us FROM o")
def outcome_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "event_key string, lead_id string")
    o = ev.outcomes(_outcome_events(spark, sf_dir), none)
    return o.select("lead_id", F.unix_micros("unsubscribed_at").alias("unsub_us"), F.col("reply_status").alias("reply"), F.unix_micros("reply_at").alias("reply_us"), F.unix_micros("contacted_at").alias("contacted_us"))


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    people = c.select(F.col("c_custkey").cast("string").alias("lead_id"), domain("c_nationkey").alias("domain"))
    live = people.select("lead_id", F.col("lead_id").alias("live_id"))
    o = ev.outcomes(_outcome_events(spark, sf_dir), spark.createDataFrame([], "event_key string, lead_id string"))
    o = o.withColumns({"deal_stage": F.when(F.col("lead_id") == "7", "open"), "deal_checked_at": F.lit(NOW)})
    k = F.col("c_custkey")
    manual = c.where(k % 20 == 0).select(k.cast("string").alias("lead_id"), F.when(k % 40 == 0, "replied_negative").alias("manual_status"), F.when(k % 40 != 0, "conflicting status rows 1, 2").alias("override_block"))
    pushes = spark.createDataFrame([], routing.PUSH_SCHEMA)
    deals = status.deal_holds(people, o, pushes, live)
    return status.fold_status(people, status.family_outcomes(o, live), manual, deals, status.cold_pushed_at(pushes, live))


@query(f"""
    WITH {_OUTCOMES_SQL}, d AS (SELECT c_nationkey FROM customer WHERE c_custkey = 7 AND EXISTS (SELECT 1 FROM o WHERE lead_id = '7'))
    SELECT c_custkey::VARCHAR AS lead_id, CASE WHEN unsub IS NOT NULL THEN 'unsubscribed' WHEN c_custkey % 20 = 0 AND c_custkey % 40 <> 0 THEN 'blocked' WHEN c_custkey % 40 = 0 THEN 'replied_negative'
           WHEN c_nationkey IN (SELECT c_nationkey FROM d) THEN 'deal' WHEN reply IS NOT NULL THEN reply WHEN contacted IS NOT NULL THEN 'contacted' ELSE 'new' END AS status
    FROM customer LEFT JOIN o ON o.lead_id = c_custkey::VARCHAR""")
def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).select("lead_id", "status")


@query("""
    WITH d AS (SELECT o_custkey, bool_or(o_orderstatus = 'P') AS open, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS lost FROM orders GROUP BY o_custkey),
    s AS (SELECT o_custkey, max(o_orderdate) AS called FROM orders WHERE o_orderkey % 500 = 0 GROUP BY o_custkey),
    n AS (SELECT c_nationkey, bool_or(coalesce(open, false)) AS c_open, max(lost) AS c_lost, max(called) AS c_called FROM customer LEFT JOIN d ON d.o_custkey = c_custkey LEFT JOIN s ON s.o_custkey = c_custkey GROUP BY c_nationkey)
    SELECT c_custkey::VARCHAR AS lead_id, c_open OR coalesce(c_called IS NOT NULL AND (c_lost IS NULL OR c_lost <= c_called), false) AS deal FROM customer JOIN n USING (c_nationkey)""")
def deal_rule_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    people = c.select(F.col("c_custkey").cast("string").alias("lead_id"), domain("c_nationkey").alias("domain"))
    live = people.select("lead_id", F.col("lead_id").alias("live_id"))
    stage = tx.lookup({"P": "open", "F": "lost"}, F.col("o_orderstatus"))
    out = o.select(F.col("o_custkey").cast("string").alias("lead_id"), stage.alias("deal_stage"), utc("o_orderdate").alias("deal_checked_at"))
    calls = o.where("o_orderkey % 500 = 0").select(F.col("o_custkey").cast("string").alias("lead_id"), F.lit("warm").alias("lane_id"), F.lit("deal").alias("step"), F.lit("deals").alias("dest"), utc("o_orderdate").alias("called_at"))
    return status.deal_holds(people, out, calls, live, except_lane="none")


@query("""
    WITH p AS (SELECT c_custkey AS k, 'n' || c_nationkey || '.example' AS domain FROM customer),
    e AS (SELECT o_orderkey AS ord, o_custkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'n' || o_custkey % 25 || '.example' WHEN 1 THEN p.domain END AS domain, o_orderkey % 3 = 1 AS named, CASE o_orderstatus WHEN 'F' THEN 'lost' WHEN 'O' THEN 'open' ELSE 'won' END AS stage
          FROM orders LEFT JOIN p ON p.k = o_custkey),
    d AS (SELECT domain, max(ord) AS ord FROM e WHERE domain IS NOT NULL GROUP BY domain), i AS (SELECT k, max(ord) AS ord FROM e GROUP BY k), n AS (SELECT k, max(ord) AS ord FROM e WHERE named GROUP BY k),
    r AS (SELECT p.k, greatest(d.ord, n.ord, CASE WHEN p.k % 2 = 0 THEN i.ord END) AS ord FROM p LEFT JOIN d USING (domain) LEFT JOIN i USING (k) LEFT JOIN n USING (k))
    SELECT r.k::VARCHAR AS lead_id, 'd' || e.k AS deal_id, e.stage AS deal_stage FROM r JOIN e USING (ord)""")
def deal_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is an event of its customer's deal: a third name a company, a third a lead, the rest only the deal, which every second customer has stored."""
    k = F.col("o_orderkey")
    stage = tx.lookup({"F": "deal_lost", "O": "Deal_Open"}, F.col("o_orderstatus"))
    e = table(spark, sf_dir, "orders").select(
        k.alias("ord"), F.coalesce(stage, F.lit("deal_won")).alias("kind"), utc("o_orderdate").alias("at"), utc("o_orderdate").alias("received_at"), F.when(k % 3 == 1, F.col("o_custkey").cast("string")).alias("lead_id"),
        F.when(k % 3 == 0, F.concat(F.lit("https://www.N"), (F.col("o_custkey") % 25).cast("string"), F.lit(".example/"))).alias("domain"), F.create_map(F.lit("deal_id"), F.concat(F.lit("d"), F.col("o_custkey").cast("string"))).alias("attrs"),
    )
    c = table(spark, sf_dir, "customer")
    people = c.select(F.col("c_custkey").cast("string").alias("lead_id"), domain("c_nationkey").alias("domain"))
    old = c.select(F.col("c_custkey").cast("string").alias("lead_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("d"), F.col("c_custkey").cast("string"))).alias("deal_id"))
    return ev.deals(e, people, old).select("lead_id", "deal_id", "deal_stage")


# --- routing and export -------------------------------------------------------------


def _pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ledger rows: the order's customer is not needed, the part stands for the lead."""
    x = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    state = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "F", "done").otherwise("pending")
    return x.select(
        F.col("l_orderkey").cast("string").alias("lead_id"), F.when(n % 2 == 0, "cold-rich").otherwise("warm").alias("lane_id"), n.cast("string").alias("step"), F.when(n % 2 == 0, "cold").otherwise("non-cold").alias("lane_kind"), F.lit("x").alias("dest"),
        state.alias("state"), F.lit("").alias("vendor_id"), F.lit("").alias("intent_run"), F.lit(None).cast("timestamp").alias("called_at"), F.when(n == 1, utc("l_shipdate")).alias("first_started_at"), F.lit(0).alias("attempts"), F.lit("").alias("last_error"), utc("l_shipdate").alias("updated_at"),
    )


@query("""
    WITH p AS (SELECT l_orderkey::VARCHAR AS lead_id, CASE WHEN l_linenumber % 2 = 0 THEN 'cold-rich' ELSE 'warm' END AS lane_id, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'done' ELSE 'pending' END AS s FROM lineitem)
    SELECT lead_id, lane_id, CASE WHEN bool_or(s = 'failed') THEN 'stuck' WHEN bool_and(s = 'done') THEN 'complete' ELSE 'callable' END AS push_state, bool_or(l_linenumber = 1) AS started FROM p GROUP BY ALL""")
def ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.push_states(_pushes(spark, sf_dir)).select("lead_id", "lane_id", "push_state", "started")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 2 = 0 AND (l_returnflag = 'R' OR l_linestatus = 'F'))")
def cold_once_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _pushes(spark, sf_dir).where(routing.holds_cold()).select(F.col("lead_id").cast("long").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(held, "o_orderkey", "left_semi")


@query("SELECT c_custkey::VARCHAR AS lead_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') ORDER BY lead_id LIMIT 200")
def unlisted_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 customers in id order that the list does not name yet; the others' orders are on it, or on another list."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    cand = c.select(F.lit("list").alias("lane_id"), F.lit(0).alias("lane_pos"), F.col("c_custkey").cast("string").alias("lead_id"), *(F.lit("").alias(n) for n in ("email", "linkedin_url", "full_name", "company_domain", "reasons")), F.lit(0.0).alias("score"))
    listed = o.select(F.when(F.col("o_orderstatus") == "P", "list").otherwise("other").alias("lane_id"), F.col("o_custkey").cast("string").alias("lead_id"))
    live = c.select(F.col("c_custkey").cast("string").alias("lead_id"), F.col("c_custkey").cast("string").alias("live_id"))
    return export.newly_listed(cand, listed, live, 200, NOW).select("lead_id")


@query("""
    WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey - o_custkey % 10 ORDER BY o_custkey % 10 = 0 DESC, o_orderdate, o_custkey::VARCHAR, o_orderkey) AS k FROM orders)
    SELECT o_orderkey, k = 1 AS keeper FROM r""")
def export_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of ten customers; ties of one customer's orders on a day go to the smaller order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey")
    listed = o.select("o_orderkey", F.lit("list").alias("lane_id"), k.cast("string").alias("lead_id"), (F.unix_micros(utc("o_orderdate")) + F.col("o_orderkey") * 0).alias("__t"), F.struct(utc("o_orderdate").alias("d"), k.cast("string").alias("l"), F.col("o_orderkey").alias("o")).alias("first_listed_at"))
    live = o.select(k.cast("string").alias("lead_id"), (k - k % 10).cast("string").alias("live_id")).distinct()
    return export.keepers(listed, live).select("o_orderkey", "keeper")


_ROUTE_SQL = f"""{_VERDICTS_SQL},
    led AS (SELECT l_orderkey::VARCHAR AS lead_id, CASE WHEN l_linenumber % 2 = 0 THEN 'cold-rich' ELSE 'warm' END AS lane_id, bool_or(l_returnflag = 'R') AS stuck, bool_and(l_returnflag <> 'R' AND l_linestatus = 'F') AS complete,
                   bool_or(l_linenumber = 1) AS started, bool_or(l_returnflag <> 'R' AND l_linestatus <> 'F') AS open, bool_or(l_linenumber % 2 = 0 AND (l_returnflag = 'R' OR l_linestatus = 'F')) AS holds FROM lineitem GROUP BY ALL),
    m AS (SELECT lead_id, score, status, email_ok, c_custkey, x.lane_id, x.kind, x.priority, x.pos, x.hit FROM (SELECT *, account_score + contact_score AS score, true AS email_ok FROM w),
          LATERAL (VALUES ('warm', 'non-cold', 30, 0, lane1 IS NOT NULL), ('cold-rich', 'cold', 20, 1, lane2 IS NOT NULL), ('cold-any', 'cold', 10, 2, lane3 IS NOT NULL), ('list', 'export', 1, 3, lane4 IS NOT NULL)) AS x(lane_id, kind, priority, pos, hit)),
    h AS (SELECT lead_id, bool_or(holds) AS rich_held FROM led WHERE lane_id = 'cold-rich' GROUP BY lead_id),
    j AS (SELECT m.*, coalesce(stuck, false) AS stuck, coalesce(complete, false) AS complete, coalesce(started, false) AS started, coalesce(open, false) AND kind = 'cold' AS is_open, coalesce(holds, false) AS holds, coalesce(rich_held, false) AS rich_held
          FROM m LEFT JOIN led USING (lead_id, lane_id) LEFT JOIN h USING (lead_id) WHERE hit OR (kind = 'cold' AND coalesce(open, false))),
    y AS (SELECT *, CASE WHEN c_custkey % 50 = 0 THEN 'conflict' WHEN NOT hit THEN 'no match' WHEN kind = 'cold' AND (status LIKE 'replied%') THEN 'status' WHEN kind = 'cold' AND lane_id <> 'cold-rich' AND rich_held THEN 'held' END AS why FROM j),
    z AS (SELECT *, kind = 'cold' AND CASE WHEN why IS NOT NULL THEN is_open AND holds ELSE stuck OR complete END AS stops, kind = 'cold' AND why IS NULL AND NOT stuck AND NOT complete AS wins FROM y),
    q AS (SELECT *, coalesce(max((stops OR wins)::INT) OVER (PARTITION BY lead_id ORDER BY (kind <> 'cold')::INT, (NOT is_open)::INT, (NOT (is_open AND holds))::INT, priority DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS ended FROM z),
    t AS (SELECT *, CASE WHEN kind = 'cold' THEN wins AND NOT ended WHEN kind = 'non-cold' THEN why IS NULL AND NOT complete AND NOT stuck ELSE false END AS taken FROM q)
"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rubric = compile_rubric(RUBRIC, unicode=False)
    v = verdicts(spark, sf_dir).withColumns({"email": F.concat(F.lit("c"), "lead_id", F.lit("@n.example")), "opted_out": F.lit(False), "override_block": F.lit(None).cast("string"), "duplicate": F.lit(False), "deal": F.lit(False), "held_at": F.lit(None).cast("timestamp"), "contacted_at": F.lit(None).cast("timestamp")})
    v = v.withColumn("domain", F.coalesce("domain", F.lit("none.example")))
    live = v.select("lead_id", F.col("lead_id").alias("live_id"))
    leads = v.select("lead_id", "domain", "email", "status", "score", "lanes", "blocked", "opted_out", "override_block", "duplicate", "deal", "held_at", "contacted_at")
    mine = _pushes(spark, sf_dir)
    return routing.route(routing.lane_checks(leads, routing.lane_frame(spark, rubric.lanes), mine, live))


@query(f"{_ROUTE_SQL} SELECT lead_id, lane_id, kind, started AS free, score::DOUBLE AS score FROM t WHERE taken AND kind = 'cold'")
def one_cold_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).where("taken AND kind = 'cold'").select("lead_id", "lane_id", "kind", "free", "score")


@query(f"""{_ROUTE_SQL}, fresh AS (SELECT * FROM t WHERE taken AND NOT started ORDER BY (kind = 'cold')::INT, priority DESC, score DESC, lead_id, lane_id LIMIT 50)
    SELECT lead_id, lane_id FROM t WHERE taken AND started UNION ALL SELECT lead_id, lane_id FROM fresh""")
def push_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All retries and the first 50 new pushes: the budget is what the operator is for."""
    return routing.budget(_routed(spark, sf_dir).where("taken"), 50).select("lead_id", "lane_id")


@query("""
    WITH f AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS lane, min(l_shipdate) FILTER (WHERE l_linenumber = 1) AS t FROM lineitem GROUP BY ALL)
    SELECT count(*)::BIGINT AS used FROM f WHERE t::DATE = DATE '1995-03-15'""")
def pushes_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.pushes_today(_pushes(spark, sf_dir), datetime(1995, 3, 15, 12, tzinfo=UTC), "UTC")


@query(f"""
    WITH {_OUTCOMES_SQL}, s AS (SELECT c_custkey, c_nationkey, unsub, reply, contacted, CASE WHEN unsub IS NOT NULL THEN 'unsubscribed' WHEN c_custkey % 20 = 0 AND c_custkey % 40 <> 0 THEN 'blocked' WHEN c_custkey % 40 = 0 THEN 'replied_negative'
           WHEN c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 7 AND EXISTS (SELECT 1 FROM o WHERE lead_id = '7')) THEN 'deal' WHEN reply IS NOT NULL THEN reply WHEN contacted IS NOT NULL THEN 'contacted' ELSE 'new' END AS status,
           c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 7 AND EXISTS (SELECT 1 FROM o WHERE lead_id = '7')) AS deal FROM customer LEFT JOIN o ON o.lead_id = c_custkey::VARCHAR)
    SELECT c_custkey::VARCHAR AS lead_id, CASE WHEN unsub IS NOT NULL THEN 'has opted out' WHEN c_custkey % 20 = 0 AND c_custkey % 40 <> 0 THEN 'held back by hand: conflicting status rows 1, 2' WHEN status = 'blocked' THEN 'held back by hand'
           WHEN deal THEN 'a deal at the company is running or won' WHEN status LIKE 'replied%' THEN 'stands at ' || status WHEN contacted IS NOT NULL THEN 'was written to before' WHEN c_custkey % 3 = 0 THEN 'is for cold lane cold-any' END AS why FROM s""")
def do_not_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _statuses(spark, sf_dir).withColumns({"duplicate": F.lit(False), "blocked": F.lit(None).cast("string"), "cold_held": F.lit(None).cast("string"), "cold_open": F.lit(None).cast("string"), "lanes": F.when(F.col("lead_id").cast("long") % 3 == 0, F.array(F.lit("list"), F.lit("cold-any"))).otherwise(F.array(F.lit("list")))})
    return s.select("lead_id", export.do_not_contact_reason(["cold-rich", "cold-any"]).alias("why"))


# --- facts --------------------------------------------------------------------------


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("domain"), F.lit("region").alias("fact"), F.concat(F.lit("r"), (k % 3).cast("string")).alias("value"), F.when(k % 2 == 0, "input").otherwise("companies_tab").alias("origin"), F.lit(NOW - timedelta(days=9)).alias("at"),
        none.alias("previous"), none.alias("previous_origin"), F.lit(None).cast("timestamp").alias("previous_at"),
    )


@query("""
    SELECT 's' || s_suppkey AS domain, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 4 THEN 'r' || s_suppkey % 5 ELSE 'r' || s_suppkey % 3 END AS value,
           CASE WHEN s_suppkey % 2 = 1 THEN 'companies_tab' WHEN s_suppkey % 5 = 4 THEN 'input' ELSE 'enrichment' END AS origin, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 5 <> 4 AND s_suppkey % 5 <> s_suppkey % 3 THEN 'r' || s_suppkey % 3 END AS previous FROM supplier""")
def fact_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment replaces what input gave, not what people wrote."""
    k = F.col("s_suppkey")
    new = table(spark, sf_dir, "supplier").where(k % 5 != 4).select(F.concat(F.lit("s"), k.cast("string")).alias("domain"), F.lit("region").alias("fact"), F.concat(F.lit("r"), (k % 5).cast("string")).alias("value"))
    return facts.apply_facts(_facts(spark, sf_dir), new, "enrichment", NOW).select("domain", "value", "origin", "previous")


@query("SELECT 's' || s_suppkey AS domain, CASE WHEN s_suppkey % 2 = 0 THEN 'r' || s_suppkey % 3 WHEN s_suppkey % 3 = 0 THEN 'new' END AS value, CASE WHEN s_suppkey % 2 = 1 THEN 'r' || s_suppkey % 3 END AS previous FROM supplier")
def companies_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tab that kept every third odd company and changed it; what it dropped moves to previous."""
    k = F.col("s_suppkey")
    tab = table(spark, sf_dir, "supplier").where((k % 2 == 1) & (k % 3 == 0)).select(k.alias("row"), F.concat(F.lit("https://www.S"), k.cast("string"), F.lit("/")).alias("Website"), F.lit(" new ").alias("Country"))
    now = facts.apply_facts(_facts(spark, sf_dir), facts.tab_facts(tab, ["Website", "Country"]), "companies_tab", NOW, owns_missing=True)
    return now.select("domain", "value", "previous")


@query("""
    WITH a AS (SELECT o_custkey AS k, max(o_orderdate) FILTER (WHERE o_orderpriority <> '5-LOW') AS t FROM orders GROUP BY 1), d AS (SELECT c_custkey AS k FROM customer UNION SELECT k FROM a)
    SELECT 'd' || d.k || '.example' AS domain FROM d LEFT JOIN a USING (k) WHERE t IS NULL OR t <= TIMESTAMP '1998-07-01' ORDER BY t NULLS FIRST, 'd' || d.k || '.example' LIMIT 60""")
def due_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next 60 companies to look up: the limit is the budget. Attempts without a time do not count."""
    name = lambda c: F.concat(F.lit("d"), F.col(c).cast("string"), F.lit(".example"))
    lead = table(spark, sf_dir, "customer").select(name("c_custkey").alias("domain"))
    tried = table(spark, sf_dir, "orders").select(name("o_custkey").alias("domain"), F.when(F.col("o_orderpriority") != "5-LOW", utc("o_orderdate")).alias("tried_at"))
    return facts.due_domains(lead, tried, datetime(1998, 7, 31, tzinfo=UTC), timedelta(days=30), 60).select("domain")


@query("""
    WITH d AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS r, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS s, o_orderdate FROM orders),
    x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY r, s, o_orderdate DESC, o_orderkey::VARCHAR) AS k FROM d)
    SELECT o_custkey::VARCHAR AS domain, o_orderkey::VARCHAR AS deal_id FROM x WHERE k = 1""")
def strongest_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    d = o.select(F.col("o_custkey").cast("string").alias("domain"), F.col("o_orderkey").cast("string").alias("deal_id"), tx.lookup({"P": "won", "O": "open", "F": "lost"}, F.col("o_orderstatus")).alias("stage"), (F.col("o_orderkey") % 10 == 0).alias("stored"), utc("o_orderdate").alias("updated_at"))
    return facts.strongest_deal(d).select("domain", "deal_id")


# --- table changes ------------------------------------------------------------------


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") >= 0).alias("good"))
    old = c.where("c_custkey % 3 != 0")
    new = c.where("c_custkey % 3 != 1").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    return old, new


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 AND c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal >= 0 END AS good FROM customer""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return tables.upsert(old, new.drop("good"), ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 2")
def append_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return tables.key_conflicts(old, new, ["c_custkey"]).select("c_custkey")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 1")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return tables.delete(old, new, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' OR o_orderkey % 100 = 0")
def trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 100 != 0, utc("o_orderdate")).alias("at"))
    return tables.trim(o, "at", F.lit(datetime(1996, 1, 1, tzinfo=UTC))).select("o_orderkey")


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'insert' WHEN c_custkey % 3 = 1 THEN 'delete' ELSE 'update' END AS change, CASE WHEN c_custkey % 3 <> 1 AND c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment
    FROM customer WHERE c_custkey % 3 <> 2 OR c_custkey % 5 = 0""")
def cdc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return tables.changes(old, new, ["c_custkey"]).select("c_custkey", "change", "c_mktsegment")


@query("SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS before, 'CHANGED' AS after FROM customer WHERE c_custkey % 3 = 2 AND c_custkey % 5 = 0")
def tier_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return tables.value_changes(old, new, "c_custkey", "c_mktsegment")


@query("""
    WITH n AS (SELECT c_custkey AS node FROM customer UNION SELECT c_custkey - c_custkey % 50 FROM customer UNION SELECT c_custkey - c_custkey % 10 FROM customer) SELECT node, node - node % 50 AS component FROM n""")
def components_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    first = c.select("a", (F.col("a") - F.col("a") % 10).alias("b"))
    labels = materialize(connected_components(first), "labels")
    tens = first.select(F.col("b").alias("a")).distinct().select("a", (F.col("a") - F.col("a") % 50).alias("b"))
    delta = materialize(extend_components(labels, tens), "labels-changed")
    return labels.join(delta.select("node"), "node", "left_anti").unionByName(delta)


@query("""
    WITH x AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'new' WHEN c_custkey % 3 = 1 THEN 'gone' WHEN c_custkey % 5 = 0 THEN 'changed' ELSE 'same' END AS change FROM customer) SELECT change, count(*)::BIGINT AS n FROM x GROUP BY change""")
def dry_run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_new(spark, sf_dir)
    return tables.difference(old, new, "c_custkey", ["c_mktsegment", "good"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return tables.first_occurrences(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")
