"""People by key: key files in ranges with Bloom filters, of which a look-up reads few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions import text as tx
from tidewell.storage import materialize


def person_keys(live: DataFrame, identities: DataFrame) -> DataFrame:
    """``key, lead_id``: the id of each lead and each email and profile URL, with the live lead it stands for.

    ``live`` is what ``identity.live_leads`` gives. A key that belongs to a lead that is not there is left out.
    """
    ids = live.select(F.col("lead_id").alias("key"), F.col("live_id").alias("lead_id"))
    named = identities.join(live.select("lead_id", "live_id"), "lead_id").select("key", F.col("live_id").alias("lead_id"))
    return ids.unionByName(named).distinct()


def write_by_key(df: DataFrame, path: str, key: str, ranges: int | None = None, most_keys: int = 1_000_000) -> None:
    """Rows sorted by ``key`` in files of a range each, with a Bloom filter of the key in each row group.

    A filter ``key = x`` or ``key IN (...)`` then opens only row groups whose range holds the key, and none if the Bloom filter denies it.
    Without ``ranges`` Spark sizes the files as it sizes partitions. ``df`` is written once before, as the ranges are drawn
    from a sample of it. Bloom filters are made for ``most_keys`` different keys a row group at most and shrink to what it holds.
    """
    rows = materialize(df, "by-key")
    rows = rows.repartitionByRange(ranges, key) if ranges else rows.repartitionByRange(key)
    out = rows.sortWithinPartitions(key).write.option("compression", "zstd")
    out = out.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    out.option(f"parquet.bloom.filter.expected.ndv#{key}", str(most_keys)).parquet(path)


def _reference(raw: str, unicode: bool) -> Column:
    """A person is asked for by key, or by an id as it stands."""
    return F.array_distinct(F.array(tx.normalize_person(F.col(raw), unicode), F.col(raw)))


def find_person(keys: DataFrame, raw: str, unicode: bool = True) -> list[str]:
    """The live leads that go by ``raw``: a lead id, an email or a profile URL. The keys meet the scan as a filter."""
    wanted = keys.sparkSession.createDataFrame([(raw,)], "raw string").select(_reference("raw", unicode).alias("k")).first()["k"]
    return sorted({r["lead_id"] for r in keys.where(F.col("key").isin(*[k for k in wanted if k is not None])).collect()})


def find_people(keys: DataFrame, wanted: DataFrame, raw: str, unicode: bool = True) -> DataFrame:
    """``wanted`` with ``lead_id``, the live lead whom column ``raw`` names, null if nobody goes by it.

    The lead's own key comes before an id as it stands; rows, nulls and repeated rows included, are kept as they are.
    A row asks with two keys at most, which are joined one after the other, so no row is multiplied. Most rows have one key only, and
    some none: these are spread by a hash of the row instead of meeting as nulls. Of a person whom many rows name, Spark may split the rows, as nothing is grouped.
    """
    one = keys.groupBy("key").agg(F.min("lead_id").alias("lead_id"))
    k = _reference(raw, unicode)
    asked = wanted.drop("lead_id")
    row = F.concat(F.lit("\x00"), F.xxhash64(*(c for c, kind in asked.dtypes if "map<" not in kind)).cast("string"))
    for n in (1, 2):
        asked = asked.withColumn(f"has{n}", F.try_element_at(k, F.lit(n)).isNotNull()).withColumn(f"k{n}", F.coalesce(F.try_element_at(k, F.lit(n)), row))
    for n in (1, 2):
        names = one.select(F.col("key").alias(f"key{n}"), F.col("lead_id").alias(f"lead{n}"))
        asked = asked.join(names, F.col(f"has{n}") & (F.col(f"k{n}") == F.col(f"key{n}")), "left")
    return asked.withColumn("lead_id", F.coalesce("lead1", "lead2")).drop(*(f"{c}{n}" for c in ("has", "k", "key", "lead") for n in (1, 2)))
