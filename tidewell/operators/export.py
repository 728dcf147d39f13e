"""Export lists: listed once, one contactable row a person, refreshed each run."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.text import csv_safe, format_number, format_time
from tidewell.operators.routing import blocked_reason
from tidewell.operators.status import blocks_cold

COLUMNS = ("lead_id", "email", "linkedin_url", "full_name", "company_domain", "score", "status", "do_not_contact", "reasons", "first_listed_at", "updated_at")
TABLE_SCHEMA = "lane_id string, lead_id string, email string, linkedin_url string, full_name string, company_domain string, score double, status string, do_not_contact boolean, reasons string, first_listed_at timestamp, updated_at timestamp"


def do_not_contact_reason(cold_lanes: list[str]) -> Column:
    """Why a listed person must not be contacted, null if they may be."""
    cold_match = F.try_element_at(F.filter("lanes", lambda x: x.isin(*cold_lanes)), F.lit(1)) if cold_lanes else F.lit(None).cast("string")
    return (
        F.when(blocked_reason().isNotNull(), blocked_reason())
        .when(F.coalesce("deal", F.lit(False)), F.lit("a deal at the company is running or won"))
        .when(blocks_cold(F.col("status")), F.concat(F.lit("stands at "), "status"))
        .when(blocks_cold(F.col("manual_status")), F.concat(F.lit("set by hand to "), "manual_status"))
        .when(F.col("contacted_at").isNotNull(), F.lit("was written to before"))
        .when(F.col("cold_held").isNotNull(), F.concat(F.lit("cold outreach went out in lane "), "cold_held"))
        .when(F.col("cold_open").isNotNull(), F.concat(F.lit("cold outreach is due in lane "), "cold_open"))
        .when(cold_match.isNotNull(), F.concat(F.lit("is for cold lane "), cold_match))
    )


def newly_listed(candidates: DataFrame, listed: DataFrame, live: DataFrame, most: int, now: datetime) -> DataFrame:
    """The first ``most`` candidates in lane and lead order whose person is on no row of the lane's list yet.

    ``candidates`` has lane_id, lane_pos, lead_id and the row's columns. A person counts as listed if any lead merged with theirs is.
    """
    seen = listed.select("lane_id", F.col("lead_id").alias("old")).join(live.select(F.col("lead_id").alias("old"), "live_id"), "old", "left").select("lane_id", F.coalesce("live_id", "old").alias("lead_id")).distinct()
    new = candidates.join(seen, ["lane_id", "lead_id"], "left_anti").orderBy("lane_pos", "lead_id").limit(max(most, 0))
    return new.select("lane_id", "lead_id", "email", "linkedin_url", "full_name", "company_domain", "score", F.lit(None).cast("string").alias("status"), F.lit(True).alias("do_not_contact"), "reasons", F.lit(now).alias("first_listed_at"), F.lit(now).alias("updated_at"))


def keepers(listed: DataFrame, live: DataFrame) -> DataFrame:
    """``lane_id, lead_id, live_id, keeper``: of a family's rows, the live lead's own, else the first listed, stays contactable."""
    x = listed.join(live.select("lead_id", "live_id"), "lead_id", "left").withColumn("live_id", F.coalesce("live_id", "lead_id"))
    w = Window.partitionBy("lane_id", "live_id").orderBy(F.desc(F.col("lead_id") == F.col("live_id")), "first_listed_at", "lead_id")
    return x.withColumn("keeper", F.row_number().over(w) == 1)


def refresh(listed: DataFrame, live: DataFrame, leads: DataFrame, cold_lanes: list[str], judged: bool, now: datetime) -> DataFrame:
    """The lists with status and do_not_contact as of now; only rows that change get a new ``updated_at``.

    ``leads`` has lead_id (live) and what ``do_not_contact_reason`` reads. Where this run did not judge the lanes, no row is opened again.
    """
    x = keepers(listed, live)
    facts = leads.withColumn("__why", do_not_contact_reason(cold_lanes)).select(F.col("lead_id").alias("live_id"), F.col("status").alias("__status"), "__why", F.lit(True).alias("__known"))
    x = x.join(facts, "live_id", "left")
    why = F.when(F.col("__known").isNull(), F.lit("no such lead")).otherwise(F.col("__why"))
    dnc = ~F.col("keeper") | why.isNotNull()
    if not judged:
        dnc = dnc | F.col("do_not_contact")
    changed = ~F.col("__status").eqNullSafe(F.col("status")) | ~dnc.eqNullSafe(F.col("do_not_contact"))
    return x.select(*(F.when(changed, {"status": F.col("__status"), "do_not_contact": dnc, "updated_at": F.lit(now)}[c]).otherwise(F.col(c)).alias(c) if c in ("status", "do_not_contact", "updated_at") else F.col(c) for c in listed.columns))


def as_text(listed: DataFrame) -> DataFrame:
    """The rows as safe text cells, in list order."""
    cells = {
        "score": format_number(F.col("score")), "do_not_contact": F.when(F.col("do_not_contact"), "yes").otherwise("no"), "first_listed_at": format_time(F.col("first_listed_at")), "updated_at": format_time(F.col("updated_at")),
    }
    plain = [csv_safe(F.coalesce(cells.get(c, F.col(c).cast("string")), F.lit(""))).alias(c) for c in COLUMNS]
    return listed.orderBy("first_listed_at", "lead_id").select(*plain)


def write_csv(listed: DataFrame, path: str) -> int:
    """One lane's list as one CSV in list order that only its owner can read, put in place at once; returns the rows.

    The rows are sorted by ranges, and one task writes range after range as it reads them; none goes through the driver. ``path`` may be
    on any file system that Spark knows.
    """
    spark = listed.sparkSession
    draft, jvm = f"{path}.draft-{uuid.uuid4().hex}", spark.sparkContext._jvm
    as_text(listed).coalesce(1).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(draft)
    file = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = file(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = fs.globStatus(file(f"{draft}/part-*"))[0].getPath()
    fs.setPermission(part, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
    fs.delete(file(path), False)
    fs.rename(part, file(path))
    fs.delete(file(draft), True)
    return listed.count()


def mirror(tables: dict[str, DataFrame], folder: str) -> None:
    """A copy of tables for readers, each replaced whole as CSV below ``folder``; cells are safe text, nested ones JSON.

    The copy takes nothing back: it is written after a commit and may fail without harm to the store.
    """
    for name, df in tables.items():
        plain = [csv_safe(F.coalesce(F.to_json(c) if t.startswith(("map", "array", "struct")) else F.col(c).cast("string"), F.lit(""))).alias(c) for c, t in df.dtypes]
        df.select(*plain).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")
