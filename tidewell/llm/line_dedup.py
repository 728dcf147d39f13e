"""Line dedup on exact reference counts behind sharded cuckoo filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewell.llm.text import SPACE_BYTES, slices, whole
from tidewell.storage import materialize, work_path

SLOTS = 4
#: A filter is built for this many times the digests that are there, so that insertions of as many more find room.
GROWTH, MOST_LOAD = 2, 0.93
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Cuckoo filter of 16-bit fingerprints with four slots a bucket, filled in vectorised rounds."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(4, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.8))))), SLOTS), np.uint16))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = ((keys >> np.uint64(48)).astype(np.uint16) | np.uint16(1)).astype(np.uint16)
        one = keys & self.mask
        return fp, one, self._other(one, fp)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return (bucket ^ (fp.astype(np.uint64) * _MIX >> np.uint64(20))) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(keys)
        return (self.table[one] == fp[:, None]).any(1) | (self.table[two] == fp[:, None]).any(1)

    def insert(self, keys: np.ndarray, rounds: int = 500) -> bool:
        """Add one fingerprint a key. False: there was no room for all, and the filter must be built again."""
        fp, at, _ = self._places(keys)
        for turn in range(rounds):
            if not len(at):
                return True
            _, pick = np.unique(at, return_index=True)  # one newcomer a bucket and round
            b, f = at[pick], fp[pick]
            free = self.table[b] == 0
            room = free.any(1)
            slot = np.where(room, free.argmax(1), (b.astype(np.int64) + turn) % SLOTS)
            out = self.table[b, slot][~room]
            self.table[b, slot] = f
            rest = np.ones(len(at), bool)
            rest[pick] = False
            at = np.concatenate([at[rest], self._other(b[~room], out)])
            fp = np.concatenate([fp[rest], out])
        return not len(at)

    def remove(self, keys: np.ndarray) -> None:
        """Take one fingerprint a key away; each key must have been inserted."""
        for fp, *places in zip(*self._places(keys), strict=True):
            for b in places:
                hit = np.flatnonzero(self.table[int(b)] == fp)
                if len(hit):
                    self.table[int(b), hit[0]] = 0
                    break


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE_BYTES).lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, digests = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen = set()
                for line in (text.as_py() or "").encode().split(b"\n"):
                    key = line_key(line)
                    if len(key) >= min_chars and _code_points(key) >= min_chars:
                        seen.add(_digest(key))
                ids += [i] * len(seen)
                digests += seen
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "digest"])

    return run


def _key64(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2].copy() if len(digests) else np.zeros(0, np.uint64)


REFS = "digest binary, n_docs long, last_doc long, again boolean"


class LineIndex:
    """Which documents hold which lines, open to insertions and to deletions of documents.

    ``postings`` is what each document holds: a row a (line digest, document). ``refs`` is the exact table of
    reference counts: a row a (digest, insertion) with the documents that came with it, their largest id and ``again``,
    true if the digest had references before. ``filters`` holds, for each shard of digests, a cuckoo
    filter with one fingerprint a digest that has a reference.

    An insertion asks the filters for each digest of its documents. What they deny is new and only gets its
    fingerprint; what they report is looked up in the exact table, which gives ``again``. So a digest of
    one insertion alone never meets the exact table, and lines in many documents are those that are often
    within an insertion or came again. A deletion takes postings away, counts the digests of what it took anew, and
    removes the fingerprints of those that lost their last reference: the index returns to what it was.
    A filter is built with room for as many digests again (GROWTH); one that runs full is built anew from the exact table, twice as large, which an insertion in proportion to what is there never needs. Insertions append to postings and
    refs; all tables are Parquet, and readers keep the versions they have.
    """

    def __init__(self, spark: SparkSession, postings: DataFrame, refs: DataFrame, filters: DataFrame, shards: int, min_chars: int):
        self.spark, self.postings, self.refs, self.filters, self.shards, self.min_chars = spark, postings, refs, filters, shards, min_chars

    @classmethod
    def empty(cls, spark: SparkSession, shards: int = 64, min_chars: int = 20) -> LineIndex:
        tables = (spark.createDataFrame([], schema) for schema in ("doc_id long, digest binary", REFS, "shard long, filter binary, keys long"))
        return cls(spark, *tables, shards, min_chars)

    @classmethod
    def build(cls, docs: DataFrame, shards: int | None = None, min_chars: int = 20, insertions: int = 2) -> LineIndex:
        """An index of ``docs``, read once and inserted in parts by id; by default a shard for each 20,000 documents, 16 at least."""
        index = cls.empty(docs.sparkSession, shards or max(16, docs.count() // 20_000), min_chars)
        part = F.pmod(F.xxhash64("doc_id"), F.lit(insertions)).cast("int").alias("part")
        lines = materialize(index.lines(docs).select("doc_id", "digest", part), "lines")
        for k in range(insertions):
            index = index.insert_lines(lines.where(F.col("part") == k).select("doc_id", "digest"))
        return index

    def _shard(self):
        return F.pmod(F.xxhash64("digest"), F.lit(self.shards)).alias("shard")

    def lines(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, digest) of the lines that are long enough, once a document; rows without an id are passed over."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).where("doc_id IS NOT NULL")
        return rows.mapInArrow(_keys(self.min_chars), "doc_id long, digest binary").dropDuplicates(["doc_id", "digest"])

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """With the documents of ``docs``, whose ids the index must not hold yet."""
        return self.insert_lines(materialize(self.lines(docs, id_col, text_col), "lines"))

    def insert_lines(self, batch: DataFrame) -> LineIndex:
        """With the postings of new documents, a written table of ``lines``."""
        new = batch.groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")).withColumn("shard", self._shard())
        if self.filters.isEmpty():
            asked = materialize(new.withColumn("again", F.lit(False)), "refs")
            refs, fresh = asked.drop("shard"), asked
        else:
            told = new.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_probe, f"{REFS}, shard long")
            asked = materialize(told.withColumnRenamed("again", "maybe"), "probe")
            maybe = asked.where("maybe")
            held = self.lookup(maybe.select("digest")).select("digest", F.lit(True).alias("again"))
            met = materialize(maybe.join(held, "digest", "left").withColumn("again", F.coalesce("again", F.lit(False))), "met")
            unknown = asked.where("NOT maybe").withColumn("again", F.lit(False))
            refs = self.refs.unionByName(unknown.unionByName(met).select(*self.refs.columns))
            fresh = unknown.select("digest", "shard").unionByName(met.where("NOT again").select("digest", "shard"))
        filters = materialize(fresh.select("digest", "shard").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_fill, self.filters.schema), "filters")
        full = filters.where("filter IS NULL").select("shard")
        if not full.isEmpty():
            again = refs.select("digest").distinct().select("digest", self._shard()).join(full, "shard", "left_semi")
            again = again.groupBy("shard").applyInPandas(_build, self.filters.schema)
            filters = materialize(filters.where("filter IS NOT NULL").unionByName(again), "filters")
        postings = batch if self.postings.isEmpty() else self.postings.unionByName(batch)
        return LineIndex(self.spark, postings, refs, filters, self.shards, self.min_chars)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """``digest, n_docs, last_doc`` of those of the distinct ``digests`` that have references."""
        found = self.refs.join(digests.select("digest"), "digest", "left_semi")
        return found.groupBy("digest").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the documents whose ids are in ``ids``; unknown ids change nothing."""
        gone = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        left = materialize(self.postings.join(gone, "doc_id", "left_anti"), "postings")
        touched = materialize(self.postings.join(gone, "doc_id", "left_semi").select("digest").distinct(), "touched")
        counted = left.join(touched, "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        refs = self.refs.join(touched, "digest", "left_anti").unionByName(counted.withColumn("again", F.lit(False)))
        refs = materialize(refs.select(*self.refs.columns), "refs")
        freed = touched.join(refs.select("digest"), "digest", "left_anti").select("digest", self._shard())
        filters = self.filters.groupBy("shard").cogroup(freed.groupBy("shard")).applyInPandas(_drop, self.filters.schema)
        return LineIndex(self.spark, left, refs, materialize(filters, "filters"), self.shards, self.min_chars)

    def references(self) -> DataFrame:
        """digest, n_docs, last_doc of all digests."""
        return self.refs.groupBy("digest").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def often(self, min_docs: int = 3) -> DataFrame:
        """``digest, n_docs, last_doc`` of the digests in ``min_docs`` documents or more, a written table.

        Only a digest that is often within one insertion, or that the filters reported and the exact table
        confirmed as there before, can be one; the others are not looked up.
        """
        likely = self.refs.where(F.col("again") | (F.col("n_docs") >= min_docs)).select("digest").distinct()
        return materialize(self.lookup(likely).where(F.col("n_docs") >= min_docs), "often")

    def drops(self, min_docs: int = 3) -> DataFrame:
        """(doc_id, digests): the lines that a document loses, those in ``min_docs`` documents or more of which it is not the last.

        Both sides of the join are read from written tables, so Spark sends the frequent digests to all tasks where they
        are few, and otherwise splits the postings of one that a large part of the documents hold.
        """
        lost = self.postings.join(self.often(min_docs), "digest").where(F.col("doc_id") != F.col("last_doc"))
        return lost.groupBy("doc_id").agg(F.collect_list("digest").alias("digests"))

    def apply(self, docs: DataFrame, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``docs`` with ``kept_text, n_lines, n_dropped``.

        A null text is one empty line; no rows give no rows. A row without an id keeps all. Rows repeating an id
        count once and get the same decisions. Columns of the three names are
        replaced, all others are kept.
        """
        docs = docs.drop("kept_text", "n_lines", "n_dropped")
        drops = self.drops(min_docs).withColumnRenamed("doc_id", "__drop_id").withColumnRenamed("digests", "__drop")
        joined = docs.join(drops, F.col(id_col).cast("long") == F.col("__drop_id"), "left").drop("__drop_id")
        at = docs.columns.index(text_col)
        schema = T.StructType([*docs.schema, T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        return joined.mapInArrow(_strip(at), schema)


def _strip(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept, lines, dropped = [], [], []
            for text, lost in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                text, lost = text.as_py() or "", lost.as_py()
                if not lost:
                    kept.append(text)
                    lines.append(text.count("\n") + 1)
                    dropped.append(0)
                    continue
                every, gone = text.encode().split(b"\n"), set(lost)
                stay = [x for x in every if _digest(line_key(x)) not in gone]
                kept.append(b"\n".join(stay).decode())
                lines.append(len(every))
                dropped.append(len(every) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                [*batch.schema.names[:-1], "kept_text", "n_lines", "n_dropped"],
            )

    return run


def _probe(asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    keys = _key64(asked["digest"])
    maybe = np.zeros(len(asked), bool)
    for data in filters["filter"]:
        maybe |= CuckooFilter.load(data).contains(keys)
    return asked.assign(again=maybe)[["digest", "n_docs", "last_doc", "again", "shard"]]


def _fill(new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(filters):
        return _build(new)
    made, keys = CuckooFilter.load(filters["filter"].iloc[0]), filters["keys"].iloc[0] + len(new)
    fits = keys <= MOST_LOAD * made.table.size and made.insert(_key64(new["digest"]))  # no kicks where there is no room
    return pd.DataFrame({"shard": [filters["shard"].iloc[0]], "filter": [made.dump() if fits else None], "keys": [keys]})


def _build(digests: pd.DataFrame) -> pd.DataFrame:
    size = GROWTH * len(digests)
    while not (made := CuckooFilter.sized(size)).insert(_key64(digests["digest"])):
        size *= 2
    return pd.DataFrame({"shard": [digests["shard"].iloc[0]], "filter": [made.dump()], "keys": [len(digests)]})


def _drop(filters: pd.DataFrame, freed: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.load(filters["filter"].iloc[0])
    made.remove(_key64(freed["digest"]))
    return pd.DataFrame({"shard": [filters["shard"].iloc[0]], "filter": [made.dump()], "keys": [filters["keys"].iloc[0] - len(freed)]})
