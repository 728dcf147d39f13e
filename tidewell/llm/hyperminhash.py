"""Near-duplicates by HyperMinHash registers, banding, estimation and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidewell.llm.text import slices, whole
from tidewell.operators.components import connected_components
from tidewell.storage import materialize

BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
REST = 64 - BUCKET_BITS
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Where an empty bucket looks for a value: the same walk in every document.
_WALK = np.argsort(np.random.default_rng(7).random((BUCKETS, BUCKETS)), axis=1)


class _Words(dict):
    """word -> its 64-bit hash as 8 bytes; started anew when it has grown large."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_digest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: dict[bytes, bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words, A-Z lower-cased; fewer words are one run."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(words.__getitem__, split)), np.uint64)
    k = min(width, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(h) - k + 1 + i] + np.uint64(k))
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """One 16-bit register a bucket: leading zeros of the bucket's least hash, then its next ten bits.

    A bucket without a hash takes the register of the first filled one on its walk, so short texts
    have full signatures too.
    """
    bucket = (hashes >> np.uint64(REST)).astype(np.int64)
    filled, first = np.unique(bucket, return_index=True)
    value = (hashes[first] & np.uint64((1 << REST) - 1)) >> np.uint64(REST - 53)
    mantissa, exponent = np.frexp(value.astype(np.float64))
    tail = np.floor((mantissa * 2 - 1) * (1 << MANTISSA_BITS)).clip(0)
    reg = np.where(value > 0, (53 - exponent) * (1 << MANTISSA_BITS) + tail, 53 << MANTISSA_BITS).astype(np.uint16)
    out, full = np.zeros(BUCKETS, np.uint16), np.zeros(BUCKETS, bool)
    out[filled], full[filled] = reg, True
    if len(filled) < BUCKETS:
        empty = np.flatnonzero(~full)
        walk = _WALK[empty]
        out[empty] = out[walk[np.arange(len(empty)), full[walk].argmax(1)]]
    return out


def chance_rate(n: float, m: np.ndarray | float) -> np.ndarray | float:
    """Probability that two unrelated sets of these sizes have equal registers in a bucket.

    Two least values of n/k and m/k uniform hashes agree in leading zeros and mantissa if they fall
    into one cell [2^-z(1+j/r), 2^-z(1+(j+1)/r)); the sum over cells is close to the integral
    of both densities over cells of relative width 1/r.
    """
    a, b = max(n / BUCKETS, 1.0), np.maximum(np.asarray(m) / BUCKETS, 1.0)
    # Integral of a*b*x * exp(-(a+b)x) dx, times the mean relative cell width 1/(2 ln(2) r).
    return 0.5 / np.log(2) / (1 << MANTISSA_BITS) * a * b / (a + b) ** 2


def estimate(reg: np.ndarray, n: float, regs: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of one set to others from their registers, less the collisions expected by chance."""
    equal = (regs == reg).mean(1)
    chance = chance_rate(n, m)
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def _signatures(width: int, bands: int):
    rows = BUCKETS // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in slices(batches):
            n, digest, keys = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), words, width)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if not len(s):
                    keys.append(None)
                    continue
                r = registers(s).reshape(bands, rows).astype(np.uint64)
                key = salt.copy()
                for k in range(rows):
                    key = _mix(key + r[:, k])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands"],
            )

    return run


def _hits(mark: np.ndarray, local: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each stretch of ``local`` are marked; no stretch is empty."""
    before = np.cumsum(sizes) - sizes
    at = np.repeat(starts - before, sizes)
    at += np.arange(len(at))
    return np.add.reduceat(mark[local[at]].astype(np.int64), before)


def link_group(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None, side: np.ndarray | None = None, slack: float = 0.17) -> list[tuple[int, int]]:
    """Links (i, j) with 100 * intersection >= percent * union that tie all sets which such links tie.

    Pairs that links tie already are passed over, so are those of one ``label`` and, if ``side`` is given, those of
    one side. For the others the registers give an estimate, corrected for chance collisions. Pairs that it places near the
    threshold or above, by ``slack`` (five standard errors), are compared on full sets, the most similar first. Of the rest each must be ruled
    out by proof: a set that is to share ``need`` of its n hashes shares one of its n - need + 1 smallest with the other's
    smallest, for hashes in one order, so a pair without a common one there cannot be a link; if it has one, it is compared too.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    regs = np.stack([registers(s) for s in sets])
    head = size - -(-percent * size // 100) + 1
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    mark = np.zeros(int(local.max()) + 1, bool)
    comp = np.arange(m) if label is None else np.unique(label, return_inverse=True)[1]
    every = np.arange(m)
    first, second = (every, every) if side is None else (every[side == side[0]], every[side != side[0]])
    if len(first) > len(second):
        first, second = second, first
    links = []
    for i in first.tolist():
        rest = second if side is not None else second[i + 1 :]
        rest = rest[comp[rest] != comp[i]]
        rest = rest[100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])]
        if not len(rest):
            continue
        mine = local[starts[i] : starts[i] + size[i]]
        close = estimate(regs[i], size[i], regs[rest], size[rest])
        likely = close >= percent / 100 - slack
        doubtful = rest[~likely]
        if len(doubtful):
            mark[mine[: head[i]]] = True
            doubtful = doubtful[_hits(mark, local, starts[doubtful], head[doubtful]) > 0]
        rest = np.concatenate([rest[likely][np.argsort(-close[likely], kind="stable")], doubtful])
        mark[mine] = True
        for part in np.array_split(rest, -(-int(size[rest].sum()) // 4_000_000)) if len(rest) else ():
            part = part[comp[part] != comp[i]]
            if not len(part):
                continue
            both = _hits(mark, local, starts[part], size[part])
            for j in part[100 * both >= percent * (size[part] + size[i] - both)].tolist():
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    links.append((i, j))
        mark[mine] = False
    return links


def _sets(width: int):
    """(doc_id, component, n, hashes): the full sets of texts, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in slices(batches):
            sets = [shingles(t.as_py(), words, width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "component", "n", "hashes"]
            )

    return run


def _linker(percent: int):
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", ignore_index=True)
        sets = [np.frombuffer(h, np.uint64) for h in rows["hashes"]]
        side = rows["block"].to_numpy()
        links = link_group(sets, percent, rows["label"].to_numpy(), side if (side != side[0]).any() else None)
        ids = rows["doc_id"].to_numpy()
        return pd.DataFrame({"a": [ids[i] for i, _ in links], "b": [ids[j] for _, j in links]}, dtype="int64")

    return group


def _alike(percent: int):
    """The rows (a, b, hashes of a, hashes of b) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _link_large(sets: DataFrame, ties: DataFrame, percent: int, block_hashes: int, block_docs: int) -> DataFrame:
    """Links within coarse components that are too large for one task: ``a, b``.

    First each document is compared with the smallest document it is tied to. What these links tie is a label.
    Then the documents of different labels are compared in blocks: a label above a block's size
    has blocks of its own, which do not meet each other; the other labels share blocks. So a large cluster around
    one document takes work in proportion to its size, times the blocks of the rest.
    """
    star = ties.groupBy("a").agg(F.min("b").alias("b"))
    one = sets.join(star, sets["doc_id"] == star["a"]).select("a", "b", F.col("hashes").alias("x"))
    pairs = one.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    found = materialize(pairs.mapInArrow(_alike(percent), "a long, b long"), "star-links")
    labels = connected_components(found)
    told = sets.join(labels.select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left")
    told = materialize(told.withColumn("label", F.coalesce("label", "doc_id")), "labelled")

    blocks = F.ceil(F.greatest(F.sum("n") / block_hashes, F.count(F.lit(1)) / block_docs)).cast("long")
    load = materialize(told.groupBy("component", "label").agg(blocks.alias("blocks"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")), "labels")
    shared = load.where("blocks = 1").groupBy("component").agg(F.ceil(F.greatest(F.sum("n") / block_hashes, F.sum("docs") / block_docs)).cast("long").alias("shared"))
    own = load.where("blocks > 1").select("component", "label", "blocks")
    upto = F.sum("blocks").over(Window.partitionBy("component").orderBy("label"))
    own = own.join(shared, "component", "left").select("component", "label", "blocks", (F.coalesce("shared", F.lit(0)) + upto - F.col("blocks")).alias("base"))
    total = load.groupBy("component").agg(F.sum(F.when(F.col("blocks") > 1, F.col("blocks"))).alias("own"))
    total = total.join(shared, "component", "left").select("component", F.coalesce("shared", F.lit(0)).alias("shared"), (F.coalesce("shared", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("total"))
    own, total = materialize(own, "own-blocks"), materialize(total, "blocks")

    dealt = told.join(total, "component").join(own, ["component", "label"], "left")
    alone = F.col("base").isNull()
    block = F.when(alone, F.pmod(F.xxhash64("label"), F.col("shared"))).otherwise(F.col("base") + F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    span = lambda lo, hi: F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<long>"))
    zero = F.lit(0).cast("long")
    others = F.when(alone, span(zero, F.col("total"))).otherwise(F.concat(span(zero, F.col("base")), span(F.col("base") + F.col("blocks"), F.col("total"))))
    dealt = dealt.select("doc_id", "component", "label", "hashes", block.alias("block"), F.explode(others).alias("other"))
    groups = dealt.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other")
    return found.unionByName(groups.groupBy("component", "x", "y").applyInPandas(_linker(percent), "a long, b long"))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, id_col: str = "doc_id", text_col: str = "text", block_hashes: int = 1_000_000, block_docs: int = 1_000
) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    Returns one row a row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents with the same set are one class, stood for by its smallest id. Each class
    has 128 registers in ``bands`` bands; classes with an equal band are tied to the smallest
    of the band (one row a class and band, never pairs), and ties make coarse components. All that
    may be linked lies in one of these. Within it the registers estimate each similarity, and no pair is left out unless links tie it
    already or it is shown to be none, see ``link_group``; all links are confirmed on full sets. A coarse
    component with more than ``block_hashes`` hashes or ``block_docs`` documents is split, see ``_link_large``.
    At 85 % a link is missed with a chance of 6e-11 (128 registers, 32 bands), at 80 % of 5e-8.

    Nulls: a null or blank text has no shingles and is linked with nothing; rows without an id are
    passed through as their own component (null) and kept. Rows repeating an id are the same
    document. Other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    sig = rows.select("doc_id", "text").mapInArrow(_signatures(width, bands), "doc_id long, n_shingles long, digest binary, bands array<long>")
    sig = materialize(sig, "signatures")
    some = sig.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = materialize(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    least = materialize(reps.groupBy("band").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "bands")
    ties = reps.join(least, "band").where("doc_id != least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    ties = materialize(ties, "ties")
    coarse = materialize(connected_components(ties), "coarse")

    members = rows.join(coarse, rows["doc_id"] == coarse["node"]).select("doc_id", "component", "text").dropDuplicates(["doc_id"])
    sets = materialize(members.mapInArrow(_sets(width), "doc_id long, component long, n long, hashes binary"), "sets")
    load = sets.groupBy("component").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    large = materialize(load.where((F.col("n") > block_hashes) | (F.col("docs") > block_docs)).select("component"), "large")
    small = sets.join(large, "component", "left_anti").select("doc_id", "component", F.col("doc_id").alias("label"), F.lit(0).cast("long").alias("block"), "hashes")
    links = small.groupBy("component").applyInPandas(_linker(percent), "a long, b long")
    if not large.isEmpty():
        links = links.unionByName(_link_large(sets.join(large, "component", "left_semi"), ties, percent, block_hashes, block_docs))
    final = materialize(connected_components(links), "components")
    # Copies take the component of the row that stands for their class.
    copies = some.join(classes.where("n > 1"), "digest").where("doc_id != rep").select(F.col("doc_id").alias("copy"), "rep").distinct()
    copies = copies.join(final, copies["rep"] == final["node"], "left").select(F.col("copy").alias("node"), F.coalesce("component", "rep").alias("component"))
    found = final.unionByName(copies).groupBy("node").agg(F.min("component").alias("component_id"))
    out = sig.select("doc_id", "n_shingles").join(found, sig["doc_id"] == found["node"], "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"),
    )
