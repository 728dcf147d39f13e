"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.storage import materialize


@dataclass(frozen=True)
class Hashes:
    """``tables`` groups of ``width`` projections, cut into slots of ``slot``."""

    a: np.ndarray  # (tables, dim, width)
    b: np.ndarray  # (tables, width)
    slot: float

    @classmethod
    def drawn(cls, dim: int, slot: float, tables: int, width: int, seed: int = 11) -> Hashes:
        rng = np.random.default_rng(seed)
        return cls(rng.standard_normal((tables, dim, width)), rng.random((tables, width)) * slot, slot)

    def slots(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.slot


def key_of(cells: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit bucket key of whole slot numbers."""
    key = np.full(cells.shape[:-1], table + 1, np.uint64)
    for k in range(cells.shape[-1]):
        key = (key ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def perturbations(width: int, probes: int) -> list[np.ndarray]:
    """Sets of moves in order of expected success, as positions in the query's own order of moves.

    A query's 2 * width moves (to the slot below or above, for each projection) are sorted by the squared distance
    to that slot's border, the nearer border of each projection first; the j-th smallest has a known expectation, by which sets of moves are
    generated best first. Moves j and 2 * width - 1 - j are the two directions of one projection.
    """
    m = width
    j = np.arange(1, 2 * m + 1)
    z = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
    out, heap = [np.zeros(0, np.int64)], [(z[0], (0,))]
    while heap and len(out) < probes:
        s, moves = heapq.heappop(heap)
        if not any(2 * m - 1 - k in moves for k in moves):
            out.append(np.array(moves))
        last = moves[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s + z[last + 1], (*moves, last + 1)))
            heapq.heappush(heap, (s + z[last + 1] - z[last], (*moves[:-1], last + 1)))
    return out


def probe_keys(x: np.ndarray, hashes: Hashes, table: int, sets: list[np.ndarray]) -> np.ndarray:
    """(queries, probes) bucket keys, the query's own bucket first."""
    at = hashes.slots(x, table)
    cell = np.floor(at)
    below = at - cell
    width = cell.shape[1]
    near = np.argsort(np.minimum(below, 1 - below), axis=1, kind="stable")
    sign = np.where(below < 0.5, -1, 1)
    out = np.empty((len(x), len(sets)), np.int64)
    rows = np.arange(len(x))
    for p, moves in enumerate(sets):
        c = cell.copy()
        for j in moves:
            axis = near[:, j] if j < width else near[:, 2 * width - 1 - j]
            c[rows, axis] += sign[rows, axis] * (1 if j < width else -1)
        out[:, p] = key_of(c, table)
    return out


def clean_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v array<double>``: rows with an id whose vector is neither null, empty, zero nor with null or non-finite parts."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & ok)


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_list()).astype(np.float64)
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def _base(hashes: Hashes, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            for t in range(len(hashes.a)):
                key = key_of(np.floor(hashes.slots(x, t)), t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(_shard(key, shards)), pa.array(key), batch.column(0), batch.column(1)], ["t", "shard", "bucket", "vec_id", "v"])

    return run


def _probes(hashes: Hashes, sets: list[np.ndarray], shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            for t in range(len(hashes.a)):
                keys = probe_keys(x, hashes, t, sets)
                shard = _shard(keys, shards)
                rows, at, buckets = [], [], []
                for i in range(len(x)):  # buckets of one shard travel with the query once
                    for s in np.unique(shard[i]):
                        rows.append(i)
                        at.append(s)
                        buckets.append(keys[i][shard[i] == s])
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), t, np.int32)), pa.array(at, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(buckets, pa.list_(pa.int64()))],
                    ["t", "shard", "query_id", "q", "buckets"],
                )

    return run


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys.view(np.uint64) % np.uint64(shards)).astype(np.int64)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from differences and not from products."""
    return np.sqrt(((x - q) ** 2).sum(1))


def _nearest(k: int):
    def group(base: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(base) and len(probes):
            base = base.sort_values("bucket", ignore_index=True)
            x, bucket, ids = _matrix(base["v"]), base["bucket"].to_numpy(), base["vec_id"].to_numpy()
            x2 = (x**2).sum(1)
            for query, q, want in zip(probes["query_id"], probes["q"], probes["buckets"], strict=True):
                lo, hi = np.searchsorted(bucket, want, "left"), np.searchsorted(bucket, want, "right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True) if b > a] or [np.zeros(0, np.int64)])
                at = at[ids[at] != query]
                q = np.asarray(q, np.float64)
                if len(at) > k:  # products rule rows out, differences decide
                    near = x2[at] - 2 * (x[at] @ q)
                    slack = 1e-9 * ((q**2).sum() + x2.max())  # far above the rounding of the products
                    at = at[near <= np.partition(near, k - 1)[k - 1] + slack]
                if len(at):
                    d = distances(q, x[at])
                    best = np.lexsort((ids[at], d))[:k]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at[best]], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return group


#: Distances, in slots, at which the chance of a hit is tried.
_TRIED = np.concatenate([[0.0], np.geomspace(0.01, 8, 60)])


def chances(dim: int, tables: int, width: int, sets: list[np.ndarray], tries: int = 400, seed: int = 23) -> np.ndarray:
    """The chance that the probes of all tables find a point, for each distance of _TRIED; only the ratio of distance and slot counts."""
    rng, unit = np.random.default_rng(seed), Hashes.drawn(dim, 1.0, tables, width)
    q, away = rng.standard_normal((2, tries, dim))
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    probed = [np.sort(probe_keys(q, unit, t, sets), axis=1) for t in range(tables)]
    out = []
    for c in _TRIED:
        hit = np.zeros(tries, bool)
        for t, keys in enumerate(probed):
            hit |= (keys == key_of(np.floor(unit.slots(q + c * away, t)), t)[:, None]).any(1)
        out.append(hit.mean())
    return np.minimum.accumulate(out)


def near_distances(x: np.ndarray, k: int, fit_rows: int, n: int) -> np.ndarray:
    """(fit rows, k) distances to the k nearest of ``n`` rows, estimated from the sample ``x`` of them.

    The j-th nearest of a sample is further than that of all rows, by the local dimension, which the distances within the sample tell.
    """
    if len(x) < 2:
        return np.zeros((1, 1))
    k = min(k, len(x) - 1)
    near = []
    for i in range(min(fit_rows, len(x))):
        d = distances(x[i], x)
        d[i] = np.inf
        near.append(np.sort(np.partition(d, k - 1)[:k]))
    out = np.array(near)
    steps = np.where(out[:, :-1] > 0, np.log(np.maximum(out[:, -1:], 1e-300)) - np.log(np.maximum(out[:, :-1], 1e-300)), 0.0)
    if n > len(x) and (steps > 0).any():
        out = out * (len(x) / n) ** steps[steps > 0].mean()
    return out


def fitted_slot(near: np.ndarray, chance: np.ndarray, recall: float) -> float:
    """The narrowest slot at which the neighbours at these distances are found with a mean chance of ``recall``."""
    lo, hi = 1e-9, max(1e-9, float(near.max())) * 1_000
    for _ in range(60):
        mid = (lo * hi) ** 0.5
        lo, hi = (lo, mid) if np.interp(near / mid, _TRIED, chance, right=0.0).mean() >= recall else (mid, hi)
    return hi


def _scan(query_ids: np.ndarray, q: np.ndarray, k: int, block: int = 256):
    """Exact ``k`` nearest rows of a task for each query: products rule rows out, differences decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids = [np.zeros(0, np.int64)] * len(q)
        best_d = [np.zeros(0)] * len(q)
        q2 = (q**2).sum(1)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = np.asarray(batch.column(0)), _matrix(batch.column(1))
            x2 = (x**2).sum(1)
            for at in range(0, len(q), block):
                near = q2[at : at + block, None] + x2 - 2 * (q[at : at + block] @ x.T)
                for i, row in enumerate(near, at):
                    row[ids == query_ids[i]] = np.inf
                    slack = 1e-9 * (q2[i] + x2.max())  # far above the rounding of the products
                    if len(best_d[i]) >= k:
                        take = np.flatnonzero(row <= best_d[i][-1] ** 2 + slack)
                    elif len(row) > k:
                        take = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + slack)
                        if len(np.unique(ids[take])) < k:  # an id on several vectors
                            take = np.arange(len(row))
                    else:
                        take = np.arange(len(row))
                    take = take[ids[take] != query_ids[i]]
                    if len(take):
                        d = np.concatenate([best_d[i], distances(q[i], x[take])])
                        who = np.concatenate([best_ids[i], ids[take]])
                        order = np.lexsort((who, d))
                        order = order[np.sort(np.unique(who[order], return_index=True)[1])][:k]
                        best_ids[i], best_d[i] = who[order], d[order]
        n = [len(b) for b in best_ids]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, n)), pa.array(np.concatenate(best_ids)), pa.array(np.concatenate(best_d))], ["query_id", "vec_id", "score"])

    return run


def scan(kept: DataFrame, asked: DataFrame, k: int, block_rows: int = 4_096) -> DataFrame | None:
    """``query_id, vec_id, score``: all rows of ``kept`` compared with each of ``asked``, a block of queries a pass; None without queries.

    A block travels to the tasks with the code, so the driver holds one block of queries at a time and no row of ``kept`` is shuffled.
    """
    per_block = asked.select("query_id", "q").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() * 2 // block_rows)))))
    out = None
    for b in [r["block"] for r in per_block.select("block").distinct().collect()]:
        rows = per_block.where(F.col("block") == b).toArrow()
        query_ids, q = np.asarray(rows["query_id"].combine_chunks()), _matrix(rows["q"].combine_chunks())
        part = _best(kept.mapInArrow(_scan(query_ids, q, k), "query_id long, vec_id long, score double"), k)
        part = materialize(part, "ann-scan")
        out = part if out is None else out.unionByName(part)
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    tables: int = 10,
    width: int = 16,
    probes: int = 400,
    recall: float = 0.9,
    fit_recall: float = 0.95,
    sample_rows: int = 4_000,
    fit_rows: int = 200,
    shard_rows: int = 20_000,
    most_levels: int = 3,
    scan_short: bool = True,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``: ``query_id, rank, vec_id, score``.

    Each vector is hashed into one bucket of each table; a query looks into ``probes`` buckets of each, its own first and then
    those across near borders in order of expected success. What the tables find is merged, and its Euclidean
    distance taken on the original vectors. The slot is the narrowest at which neighbours as far as those of ``fit_rows`` rows, within a
    sample of ``sample_rows`` rows (fixed bounds), are found with a mean chance of ``fit_recall``; every row is indexed.

    A query is settled when it has k rows that, at their distances, are found with a mean chance of ``recall``. The others, in thin
    regions, look further in tables of doubled slots, ``most_levels`` levels in all, and what each level finds is merged with
    what was found before. Only a query that has fewer than k rows then is compared with every row (``scan_short``), at every size of the table.

    Of vectors that are the same, the k + 1 smallest ids are enough for exact ties, so a vector that
    a third of all rows hold does not fill a bucket. Buckets are dealt to shards; one with more
    than ``shard_rows`` rows is salted, and its probes go to each salt. A task returns k rows a
    query at most.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite parts, take no
    part; a query never finds its own id. Rows repeating an id with one vector count once. Other columns are ignored.
    Vectors of different lengths are refused before anything is hashed.
    """
    base = clean_vectors(vectors, id_col, vec_col)
    asked = clean_vectors(queries, id_col, vec_col).withColumnsRenamed({"vec_id": "query_id", "v": "q"}).dropDuplicates(["query_id"])
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = materialize(base.distinct().withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r"), "ann-base")
    open_ = materialize(asked, "ann-asked")
    sizes = lambda df, v: df.agg(F.count(F.lit(1)), F.min(F.size(v)), F.max(F.size(v))).first()
    (n, *lengths), (_, *asked_lengths) = sizes(kept, "v"), sizes(open_, "q")
    if len(set(lengths + asked_lengths) - {None}) > 1:
        raise ValueError(f"vectors of {min(lengths)} to {max(lengths)} parts, queries of {asked_lengths}: they must be of one length")
    # The rows with the smallest id hashes, of a share of the hashes that holds a few times as many.
    few = kept.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32))).where(F.col("h") < int(min(1.0, 8 * sample_rows / max(n, 1)) * (1 << 32)))
    sample = few.orderBy("h", "vec_id").select("vec_id", "v").limit(sample_rows).toArrow()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return vectors.sparkSession.createDataFrame([], schema)
    x = _matrix(sample["v"].combine_chunks())
    sets = perturbations(width, probes)
    chance = chances(x.shape[1], tables, width, sets)
    slot = fitted_slot(near_distances(x, k, fit_rows, n), chance, fit_recall)
    shards = max(1, -(-n // shard_rows))
    done = None
    for level in range(most_levels):
        hashes = Hashes.drawn(x.shape[1], slot * 2**level, tables, width)
        more = _level(kept, open_, k, hashes, sets, shards, shard_rows)
        if done is not None:
            more = more.unionByName(done.join(open_.select("query_id"), "query_id", "left_semi").select("query_id", "vec_id", "score"))
        found = materialize(_best(more, k), f"ann-found-{level}")
        done = found if done is None else done.join(open_.select("query_id"), "query_id", "left_anti").unionByName(found)
        told = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg(_chance(F.col("score"), chance, hashes.slot)).alias("chance"))
        settled = told.where((F.col("n") >= k) & (F.col("chance") >= recall)).select("query_id")
        open_ = materialize(open_.join(settled, "query_id", "left_anti"), f"ann-open-{level}")
        if open_.isEmpty():
            break
    if scan_short and not open_.isEmpty():
        full = done.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        short = materialize(open_.join(full, "query_id", "left_anti"), "ann-short")
        rest = scan(kept, short, k)
        if rest is not None:
            done = done.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)
    return done.select("query_id", "rank", "vec_id", "score")


def _chance(distance: Column, chance: np.ndarray, slot: float) -> Column:
    """``chances`` at a distance, as a step function that lies below it."""
    out = F.lit(0.0)
    for c, p in zip(_TRIED[::-1].tolist(), chance[::-1].tolist(), strict=True):
        out = F.when(distance <= c * slot, F.lit(float(p))).otherwise(out) if p > 0 else out
    return out


def _level(kept: DataFrame, asked: DataFrame, k: int, hashes: Hashes, sets: list[np.ndarray], shards: int, shard_rows: int) -> DataFrame:
    """What one set of tables finds: ``query_id, vec_id, score``, k rows a task at most.

    Of the joins only the hot buckets travel through the driver, a row for each ``shard_rows`` entries at most. Spark takes the
    probes for as small as the queries that they are made from, and would broadcast them rather than the salts.
    """
    entries = kept.mapInArrow(_base(hashes, shards), "t int, shard long, bucket long, vec_id long, v array<double>")
    hot = entries.groupBy("t", "shard", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows)
    hot = materialize(hot.select("t", "shard", "bucket", F.ceil(F.col("n") / shard_rows).cast("long").alias("salts")), "ann-hot")
    none = F.lit(1).cast("long")
    entries = entries.join(F.broadcast(hot.drop("shard")), ["t", "bucket"], "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.coalesce("salts", none))).drop("salts")
    wanted = asked.mapInArrow(_probes(hashes, sets, shards), "t int, shard long, query_id long, q array<double>, buckets array<long>")
    if hot.isEmpty():
        wanted = wanted.withColumn("salt", F.lit(0).cast("long"))
    else:
        most = F.broadcast(hot.groupBy("t", "shard").agg(F.max("salts").alias("most")))
        salts = F.sequence(F.lit(0).cast("long"), F.coalesce("most", none) - 1)
        wanted = wanted.join(most, ["t", "shard"], "left").withColumn("salt", F.explode(salts)).drop("most")
    key = ["t", "shard", "salt"]
    return entries.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
