"""Sums over all rows before a row, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tidewell.storage import materialize


def running_sums(df: DataFrame, by: Sequence[str], cols: Sequence[str], range_rows: int = 250_000) -> DataFrame:
    """``df`` with ``upto_<c>`` for each of ``cols``: the sum over the rows up to this one, itself included, in the order of ``by``.

    The rows are dealt to ranges of about ``range_rows``, a written table; sums run within a range, and the totals of the ranges before
    it are added. The driver holds a row a range. ``by`` should order the rows without ties.
    """
    ranges = max(1, -(-df.count() // range_rows))
    parts = materialize(df.repartitionByRange(ranges, *by).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("__range").agg(*(F.sum(c).alias(c) for c in cols)).collect()
    base, before = [0] * len(cols), []
    for r in sorted(totals, key=lambda r: r["__range"]):
        before.append((r["__range"], *base))
        base = [b + (r[c] or 0) for b, c in zip(base, cols, strict=True)]
    kinds = dict(parts.agg(*(F.sum(c).alias(c) for c in cols)).dtypes)
    schema = ", ".join(["__range int", *(f"`__before_{c}` {kinds[c]}" for c in cols)])
    starts = parts.sparkSession.createDataFrame([(r, *(float(x) if kinds[c] == "double" else x for c, x in zip(cols, xs, strict=True))) for r, *xs in before], schema)
    running = Window.partitionBy("__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(starts), "__range")
    return out.select(*df.columns, *((F.col(f"__before_{c}") + F.sum(c).over(running)).alias(f"upto_{c}") for c in cols))
