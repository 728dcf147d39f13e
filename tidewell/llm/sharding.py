"""Contiguous shards of nearly equal bytes by global prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.operators.prefix import running_sums
from tidewell.storage import materialize

#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def byte_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) and a fixed share for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def place(rows: DataFrame, shards: int, size: str = "size", order: Sequence[str] = ("doc_id",), range_rows: int = 250_000) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: contiguous in ``order``, their summed ``size`` nearly equal.

    Rows are dealt to ranges of the order; each range's total is summed apart, the totals before it are its start, and
    a running sum within it gives every row its place among all bytes. The line of bytes is cut at ``shards`` equal targets and a row belongs
    to the target that holds its middle, so that a shard differs from its target by half of its first and half of its last row at most. A
    row larger than a target leaves the shards that it covers empty. ``slot`` counts a shard's rows from 0.

    Nulls come first. Rows that the order does not tell apart follow their size and then the place where they were read, so a key that a third of all
    rows repeat is cut as any other. Sizes below 0 and null sizes count as 0; where all are 0, all rows are in shard 0. The result has
    the columns of ``rows``, less any ``shard`` and ``slot``. The driver holds a row a range, and the starts of the shards.
    """
    spark, cols = rows.sparkSession, [c for c in rows.columns if c not in ("shard", "slot")]
    counted = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    numbered = rows.select(*cols).withColumns({"__size": counted, "__row": F.monotonically_increasing_id(), "__one": F.lit(1).cast("long")})
    numbered = materialize(numbered, "shard-rows")
    # As many ranges as the session's shuffles have parts, or more.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_range = max(1, min(range_rows, -(-numbered.count() // parts)))
    by = [*order, "__size", "__row"]
    upto = materialize(running_sums(numbered, by, ["__size", "__one"], per_range), "shard-sums")
    total = upto.agg(F.max("upto___size")).first()[0] or 0
    middle = F.col("upto___size") * 2 - F.col("__size")  # in half bytes
    # whole numbers all the way: no rounding moves a row across a cut
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(2 * total, 1)).cast("decimal(20,0)")), F.lit(shards - 1)).cast("int")
    out = upto.withColumn("shard", shard)
    first = out.groupBy("shard").agg(F.min("upto___one").alias("__first"))  # a row a shard
    return out.join(F.broadcast(first), "shard").select(*cols, "shard", (F.col("upto___one") - F.col("__first")).alias("slot"))


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of documents in ascending doc_id order.

    A null text has no bytes and the checksum of none; rows repeating an id or without one are placed each for itself. Other columns are ignored.
    """
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    placed = place(docs.select("doc_id", byte_size().alias("size"), crc), shards, order=("doc_id", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int, text: str = "text", order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Write whole rows below ``path``, a folder ``shard=<n>`` each with its rows in slot order; returns what each holds, read back.

    The number of shards should leave a shard fit for one task. Manifest: ``shard, rows, bytes, first, last``; empty shards have no folder.
    """
    rows = materialize(docs.withColumns({"__bytes": byte_size(text), "__id": F.monotonically_increasing_id()}), "shard-input")
    keys = list(dict.fromkeys(order))
    places = place(rows.select("__id", "__bytes", *keys), shards, "__bytes", keys).select("__id", "shard", "slot")
    out = rows.drop("shard", "slot").join(places, "__id").drop("__id", "__bytes")
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    back = docs.sparkSession.read.parquet(path)
    ends = [f(F.struct("slot", *keys)).getField(keys[0]).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(byte_size(text)).alias("bytes"), *ends)
