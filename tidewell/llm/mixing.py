"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.text import WORD, whole
from tidewell.operators.prefix import running_sums
from tidewell.storage import materialize

ROWS = "doc_id long, source string, size long, floor int, share double, open boolean, copies int, bucket long"


def targets(sized: DataFrame, weights: Sequence[float], times: float, most: float) -> DataFrame:
    """``source, source_size, rows, target`` of each source of (source, size).

    Sources in code point order (null last) weigh ``weights``, repeated, and share ``times`` of all sizes; none gets more than
    ``most`` times its own, and what it cannot take is shared again by weight among the others. In the order of
    most * size / weight the full ones come first: a source is full if what is left for it and all behind it,
    by weight, is as much as it can take. Both orders are running sums, so sources may be as many as rows.
    If all are full, the rest is lost.
    """
    if min(weights) <= 0:
        raise ValueError("weights must be above 0")
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    found = found.withColumns({"last": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    numbered = running_sums(found, ["last", "source"], ["one"])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("upto_one") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = numbered.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most))}).withColumn("level", F.col("cap") / F.col("weight"))
    summed = materialize(running_sums(capped.select("source", "last", "source_size", "rows", "weight", "cap", "level"), ["level", "last", "source"], ["cap", "weight"]), "mix-levels")
    all_ = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    total = times * all_["size"]
    full = (F.lit(total) - (F.col("upto_cap") - F.col("cap"))) >= F.col("level") * (F.lit(all_["weight"]) - (F.col("upto_weight") - F.col("weight")))
    taken = summed.where(full).agg(F.coalesce(F.sum("cap"), F.lit(0.0)).alias("cap"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    left = all_["weight"] - taken["weight"]
    level = (total - taken["cap"]) / left if left > 0 else 0.0
    return summed.select("source", "source_size", "rows", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def chance(seed: int, *parts: object) -> float:
    """A number in [0, 1) that depends only on the seed and the parts."""
    return xxhash.xxh3_64_intdigest(repr((seed, parts)).encode()) / 2**64


def pivot(ids: Iterable, sizes: Iterable[int], shares: Iterable[float], seed: int) -> tuple[list[int | None], int, float]:
    """Pivotal rounding in the given order: (0/1 for each row, index left open or -1, its share).

    The open row and the next one exchange mass (size times share) until one of them
    is integral; the direction is drawn so that neither row's expected share moves.
    Mass is kept exactly, so the sum misses its target by less than the last open row.
    """
    out: list[int | None] = []
    at, p, size, name = -1, 0.0, 0, None
    for k, (i, s, q) in enumerate(zip(ids, sizes, shares, strict=True)):
        out.append(None)
        if q <= 0 or q >= 1 or s <= 0:
            out[k] = int(q >= 1)
            continue
        if at < 0:
            at, p, size, name = k, q, s, i
            continue
        up, down = min((1 - p) * size, q * s), min(p * size, (1 - q) * s)
        if chance(seed, name, i, k) * (up + down) < down:  # the open row gains
            x, y = p + up / size, q - up / s
            first_done, second_done = (1 - p) * size <= q * s, q * s <= (1 - p) * size
            ends = (1, 0)
        else:
            x, y = p - down / size, q + down / s
            first_done, second_done = p * size <= (1 - q) * s, (1 - q) * s <= p * size
            ends = (0, 1)
        if first_done:
            out[at] = ends[0]
        if second_done:
            out[k] = ends[1]
        if first_done and second_done:
            at = -1
        elif first_done:
            at, p, size, name = k, y, s, i
        else:
            p = x
    return out, at, p


def _round(seed: int, last: bool, key: Sequence[str] = ()):
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", *key], ascending=[False, True, *(True for _ in key)], kind="stable", ignore_index=True)
        ids = rows["doc_id"].tolist()
        took, at, p = pivot(ids, rows["size"].tolist(), rows["share"].tolist(), seed)
        if at >= 0 and last:
            took[at] = int(chance(seed, "last", ids[at]) < p)
            at = -1
        rows["open"] = [k == at for k in range(len(rows))]
        if at >= 0:
            rows.loc[at, "share"] = p
        rows["copies"] = [f + (t or 0) for f, t in zip(rows["floor"], took, strict=True)]
        return rows

    return group


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), times: float = 1.5, most: float = 2.0, seed: int = 17, bucket_rows: int = 2_000, fan_in: int = 64, row_key: str | None = None) -> DataFrame:
    """How often each document enters a mix of its sources.

    Returns ``doc_id, size, source_size, target, taken, copies, source`` for every row; ``size`` counts
    words, ``taken`` is ``copies * size``. Sources in code point order (null last) weigh
    ``weights``, repeated; they share ``times`` of all words, see ``targets``. ``most`` is a whole number.

    A source's copy number is target / size for each of its documents. Its
    whole part is taken; the fractions are rounded in buckets of about ``bucket_rows`` rows,
    and what a bucket leaves open goes up a reduction tree that joins ``fan_in``
    buckets a level, until a source has one row, which is drawn. A bucket depends on
    ids alone, so reruns and other partitionings agree, and a hot source is many buckets.
    Targets are worked out in Spark, whatever the number of sources.

    Nulls: a null text has size 0 and a null source is a source; rows of size 0 take
    the whole part only. Rows repeating an id are rounded each for itself. No rows
    give no rows; other columns are ignored. ``row_key`` names a column of unique longs, fixed by being written,
    that is returned as well, so that a row finds its own copies where ids repeat or are null; it takes no part in the draw.
    """
    if most != int(most):
        raise ValueError("most must be a whole number")
    key = [] if row_key is None else [row_key]
    sized = docs.select(
        *(F.col(c).cast("long").alias(c) for c in key),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(whole(), F.lit(WORD)).cast("long").alias("size"),
    )
    sized = materialize(sized, "mix-sizes")
    plan = targets(sized, weights, times, most)
    floor = F.least(F.floor("ratio"), F.lit(int(most))).cast("int")
    plan = plan.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).select(
        F.col("source").alias("plan_source"), "source_size", "target", floor.alias("floor"), F.when(floor >= most, 0.0).otherwise(F.col("ratio") - floor).alias("share"), F.ceil(F.col("rows") / bucket_rows).cast("long").alias("buckets")
    )
    plan_df = materialize(plan, "mix-plan")
    told = plan_df.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.max("buckets"), F.lit(1)).alias("buckets")).first()
    plan_df = F.broadcast(plan_df) if told["sources"] <= 10_000 else plan_df
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    rows = sized.join(plan_df.drop("source_size", "target"), same, "left")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("buckets")))
    rows = rows.select(*key, "doc_id", "source", "size", "floor", "share", F.lit(True).alias("open"), F.lit(0).alias("copies"), "bucket")
    schema = "".join(f"`{c}` long, " for c in key) + ROWS
    levels = 1
    while fan_in ** (levels - 1) < told["buckets"]:
        levels += 1
    done = []
    for level in range(levels):
        out = rows.groupBy("source", "bucket").applyInPandas(_round(seed + level, level == levels - 1, key), schema)
        out = materialize(out, f"mix-{level}")
        done.append(out.where(~F.col("open")))
        rows = out.where("open").withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("long"))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return every.join(plan_df.select("plan_source", "source_size", "target"), same, "left").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source", *key
    )
