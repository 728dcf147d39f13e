"""Input rows: header resolution, row ids and hashes, groups, and the backlog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions import text as tx
from tidewell.operators.prefix import running_sums
from tidewell.storage import materialize

RECEIVER = "receiver"


def input_rows(df: DataFrame, source_id: str, headers: Sequence[str], order: Sequence[str] = (), source_pos: int = 0) -> DataFrame:
    """``source_id, source_pos, ord, cols``: the raw cells of a wide frame as a map of header to text.

    Of repeated headers the first counts. ``ord`` is the row's place by ``order``, ties as read, counted over ranges of the order so that no
    one task sees all rows; without an order it grows as read.
    """
    names = list(dict.fromkeys(headers))
    pairs = [x for h in names for x in (F.lit(h), F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("")))]
    own = [F.lit(source_id).alias("source_id"), F.lit(source_pos).alias("source_pos")]
    if not order:
        return df.select(*own, (F.monotonically_increasing_id() + 1).alias("ord"), F.create_map(*pairs).alias("cols"))
    by = [f"__by_{k}" for k in range(len(order))]
    rows = df.select(F.create_map(*pairs).alias("cols"), *(F.col(f"`{c}`").alias(b) for c, b in zip(order, by, strict=True)), F.monotonically_increasing_id().alias("__read"), F.lit(1).cast("long").alias("__one"))
    rows = materialize(rows, "input-rows")
    return running_sums(rows, [*by, "__read"], ["__one"]).select(*own, F.col("upto___one").cast("long").alias("ord"), "cols")


def normalize(rows: DataFrame, headers: Sequence[str], aliases: Mapping[str, str] | None = None, unicode: bool = True) -> DataFrame:
    """``rows`` with ``fields`` (field to text, blanks left out), ``row_id, row_hash, reject``.

    The first header in file order owns a field. Emails, profile URLs and company domains are brought into their one form.
    ``reject`` says why a row cannot be applied, null if it can.
    """
    table = tx.header_table(aliases)
    owners: dict[str, str] = {}
    for h in headers:
        name = tx.resolve_header(h, table)
        if name:
            owners.setdefault(name, h)

    def cell(name: str, header: str) -> Column:
        raw = tx.trim(F.try_element_at("cols", F.lit(header)))
        made = {"email": F.lower, "linkedin_url": lambda c: tx.canonical_linkedin(c, unicode), "company.domain": tx.normalize_domain}
        return made.get(name, lambda c: c)(raw)

    entries = F.array(*(F.struct(F.lit(n).alias("key"), cell(n, h).alias("value")) for n, h in owners.items()))
    out = rows.withColumn("fields", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != ""))))
    get = lambda n: F.coalesce(F.try_element_at("fields", F.lit(n)), F.lit(""))
    email, li, domain, name = get("email"), get("linkedin_url"), get("company.domain"), tx.normalize_name(get("full_name"), unicode)
    out = out.withColumn("row_hash", tx.row_hash(F.col("cols"), table))
    row_id = (
        F.when((F.col("source_id") == RECEIVER) & (get("contact_id") != ""), get("contact_id"))
        .when(email != "", email)
        .when(li != "", li)
        .when((domain != "") & (name != ""), F.concat(domain, F.lit("|"), name))
        .otherwise(F.concat(F.lit("row:"), F.substring("row_hash", 1, 16)))
    )
    reject = F.when(email != "", tx.email_fault(email)).when((li == "") & ((domain == "") | (name == "")), F.lit("nothing in the row says who it is"))
    return out.withColumns({"row_id": row_id, "reject": reject})


def groups(rows: DataFrame) -> DataFrame:
    """``source_id, row_id, hash, first_ord, rows``: rows of one source that share an id are applied as one unit.

    One aggregation of numbers (see ``text.group_hash``): an id that a large part of all rows have is combined before the shuffle, and no list of its rows is made.
    """
    return rows.groupBy("source_id", "row_id").agg(tx.group_hash(F.col("row_hash")).alias("hash"), F.min(F.struct("source_pos", "ord")).alias("first_ord"), F.count(F.lit(1)).alias("rows"))


def pending(grouped: DataFrame, applied: DataFrame) -> DataFrame:
    """The groups that were not yet applied at their present hash."""
    return grouped.join(applied.select("source_id", "row_id", F.col("row_hash").alias("hash")), ["source_id", "row_id", "hash"], "left_anti")


def chunk(grouped: DataFrame, most_rows: int, by: Sequence[str] = ("first_ord",)) -> DataFrame:
    """Whole groups in order while their rows stay within ``most_rows``; the first is taken whatever its size.

    No one task sees all groups, see ``running_sums``.
    """
    if not by:
        raise ValueError("the order of the groups is needed")
    upto = running_sums(grouped, by, ["rows"])
    return upto.where((F.col("upto_rows") <= most_rows) | (F.col("upto_rows") == F.col("rows"))).drop("upto_rows")


def fill_first(rows: DataFrame, key: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each key the first present value of each field, in order, with its source; null where none has one."""
    by = F.struct(*order)
    aggs = []
    for f in fields:
        v = F.nullif(F.col(f), F.lit(""))
        aggs.append(F.min_by(F.struct(v.alias("value"), F.col("source_id")), F.when(v.isNotNull(), by)).alias(f))
    return rows.groupBy(key).agg(*aggs)


def conflicts(rows: DataFrame, key: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``key, conflict_fields, conflicts``: where another source gave another value than the one that was kept."""
    long = rows.select(key, "source_id", F.struct(*order).alias("__o"), F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f))))).alias("field", "value")).where("value IS NOT NULL AND value != ''")
    kept = long.groupBy(key, "field").agg(F.min_by(F.struct("value", "source_id"), "__o").alias("kept"))
    odd = long.join(kept, [key, "field"]).where((F.col("value") != F.col("kept.value")) & (F.col("source_id") != F.col("kept.source_id")))
    each = odd.groupBy(key, "field").agg(F.array_sort(F.collect_set(F.struct("value", "source_id"))).alias("others"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list("field")).alias("conflict_fields"), F.map_from_entries(F.collect_list(F.struct("field", "others"))).alias("conflicts"))
