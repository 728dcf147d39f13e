"""The stored tables: columns, keys, and how long rows stay."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

FIELD = "struct<value:string,source_id:string,at:timestamp,derived:boolean>"
FACT = "struct<value:string,origin:string,at:timestamp>"


@dataclass(frozen=True)
class Table:
    name: str
    schema: str
    key: tuple[str, ...] = ()
    time: str = ""
    keep: timedelta | None = None
    #: The column that readers seek single rows by.
    sought: str = ""


_TABLES = (
    Table("overrides", "row int, person string, action string, value string, note string"),
    Table("applied_overrides", "row_hash string, applied_at timestamp, run_id string", ("row_hash",)),
    Table("people", f"lead_id string, created_at timestamp, held_at timestamp, merged_into string, first_seen map<string,timestamp>, fields map<string,{FIELD}>, conflicts map<string,array<struct<value:string,source_id:string>>>", ("lead_id",)),
    Table("identities", "key string, kind string, lead_id string, source_id string, first_seen_at timestamp", ("key",)),
    Table("company_facts", "domain string, fact string, value string, origin string, at timestamp, previous string, previous_origin string, previous_at timestamp", ("domain", "fact")),
    Table("company_first_seen", "domain string, kind string, at timestamp", ("domain", "kind")),
    Table("enrichment_tries", "domain string, tried_at timestamp, result string", ("domain",)),
    Table("events", "seq long, received_at timestamp, kind string, body string", ("seq",), "received_at", timedelta(days=90)),
    Table("window_events", "event_key string, subject string, lead_id string, domain string, kind string, at timestamp, attrs map<string,string>", ("event_key",), "at", timedelta(days=90)),
    Table("applied_rows", "source_id string, row_id string, row_hash string, lead_id string, first_applied_at timestamp, key_conflict_at timestamp", ("source_id", "row_id")),
    Table("seen_events", "event_key string, first_received_at timestamp, run_id string", ("event_key",), "first_received_at", timedelta(days=365)),
    Table("outcomes", "lead_id string, status string, status_at timestamp, unsubscribed_at timestamp, unsubscribed_origin string, reply_status string, reply_at timestamp, contacted_at timestamp, held_at timestamp, deal_id string, deal_stage string, deal_checked_at timestamp", ("lead_id",)),
    Table("pushes", "lead_id string, lane_id string, step string, lane_kind string, dest string, state string, vendor_id string, intent_run string, called_at timestamp, first_started_at timestamp, attempts int, last_error string, updated_at timestamp", ("lead_id", "lane_id", "step")),
    Table("exports", "lane_id string, lead_id string, email string, linkedin_url string, full_name string, company_domain string, score double, status string, do_not_contact boolean, reasons string, first_listed_at timestamp, updated_at timestamp", ("lane_id", "lead_id")),
    Table("push_plan", "lead_id string, lane_id string, kind string, sink string, dest string, score double, free boolean, reserve boolean", ("lead_id", "lane_id")),
    Table("enrichment_plan", "domain string, tried_at timestamp", ("domain",)),
    Table("ranked", "lead_id string, email string, linkedin_url string, full_name string, company_domain string, derived map<string,string>, account_score double, contact_score double, score double, status string, lane string, reasons string, rubric_version string", ("lead_id",), sought="lead_id"),
    Table("person_keys", "key string, lead_id string", ("key",), sought="key"),
    Table("log", "at timestamp, run_id string, level string, lead_id string, kind string, message string, rubric_version string", (), "at", timedelta(days=90)),
    Table("health", "kind string, key string, value string, first_seen_at timestamp, updated_at timestamp", ("kind", "key")),
    Table("state", "key string, value string", ("key",)),
)
TABLES = {t.name: t for t in _TABLES}
VERSION = 1
