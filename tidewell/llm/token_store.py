"""Content-addressed store of token ids."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.llm.text import hand_back
from tidewell.llm.tokens import Encoder, stretches
from tidewell.operators.prefix import running_sums
from tidewell.storage import delete, materialize

#: Rolling hash over the last 16 ids; a cut where it is small.
WINDOW = 16
_FACTOR = 0x5851F42D
MEAN, LEAST, MOST = 512, 128, 2048
FILE_DOCS = 65_536
MANIFEST = "file long, documents long, tokens long, base long, root binary"


def rolling(ids: np.ndarray) -> np.ndarray:
    """Polynomial hash, modulo 2^32, of the WINDOW ids that end at each place; nothing stands before the first.

    Built by doubling: the hash of 2w ids is that of the last w plus factor^w times that of the w before.
    """
    h, w, factor = ids.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(1), 1, _FACTOR
    while w < WINDOW:
        more = h.copy()
        more[w:] += h[:-w] * np.uint32(factor)
        h, w, factor = more, 2 * w, factor * factor & 0xFFFFFFFF
    return h


def cuts(ids: np.ndarray, ends: np.ndarray | None = None, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a stream of ids, in which documents end at ``ends`` (default: one document).

    A polynomial over the last WINDOW ids is rolled along the stream; where it is small, and at least ``least``
    ids after the last cut, a chunk ends, at the latest after ``most``, and with its document. As ``least`` is
    above WINDOW, a cut depends on the ids of its own document near it only, so documents
    that share a passage share its inner chunks.
    """
    ends = np.array([len(ids)]) if ends is None else ends
    marks = (np.flatnonzero(rolling(ids) < (1 << 32) // (mean - least)) + 1).tolist() if len(ids) else []
    out, last, k = [], 0, 0
    marks.append(len(ids) + most)
    for end in ends.tolist():
        while last < end:
            while marks[k] < last + least:
                k += 1
            last = min(marks[k], last + most, end)
            out.append(last)
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up alone; no leaves give the digest of nothing."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


# --- crc32 of a concatenation from the parts' crc32 ---------------------------


def _shift_tables() -> np.ndarray:
    """tables[k, byte, value]: what 2^k zero bytes make of a crc register, by its bytes."""

    def times(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for bit in range(32):
            out ^= np.where(v >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
        return out

    one = np.zeros(32, np.uint32)  # one zero bit
    one[0] = 0xEDB88320
    one[1:] = 1 << np.arange(31, dtype=np.uint32)
    step = one
    for _ in range(3):
        step = times(step, step)
    tables = []
    for _ in range(40):
        values = np.arange(256, dtype=np.uint32)
        tables.append([times(step, values << np.uint32(8 * b)) for b in range(4)])
        step = times(step, step)
    return np.array(tables, np.uint32)


_TABLES = _shift_tables()


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The register after ``zeros`` zero bytes, for arrays."""
    out, left = crc.astype(np.uint32), zeros.astype(np.int64)
    for k in range(40):
        on = (left >> k & 1).astype(bool)
        if on.any():
            v, t = out[on], _TABLES[k]
            out[on] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
    return out


# --- writing --------------------------------------------------------------------


@lru_cache(maxsize=1)
def _encoder(tokenizer: str) -> Encoder:
    """One for all tasks of the encoding that a worker gets, as about half the pieces of a task are new to it; the next stage lets it go."""
    return Encoder(tokenizer, most=400_000)


def _encode(tokenizer: str, end_id: int, width: int):
    """One row a document with its recipe, and one row a chunk that is new in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode
        seen: set[bytes] = set()
        for batch in batches:
            for lo, texts in stretches(batch.column(1)):
                stream, ends = encode(texts, end_id)
                if int(stream.max()) >> 8 * width:
                    raise ValueError(f"id {int(stream.max())} does not fit into {width} bytes")
                payload = stream.astype(f"<u{width}").tobytes()
                recipes, root, new, held, at = [], [], [], [], 0
                doc_ends = iter(ends.tolist())
                doc_end = next(doc_ends)
                recipe: list[bytes] = []
                steps: list[bytes] = []
                for cut in cuts(stream, ends):
                    data = payload[width * at : width * cut]
                    d = hashlib.sha256(data).digest()
                    steps.append(d)
                    recipe.append(d + (cut - at).to_bytes(4, "little"))
                    if d not in seen:
                        seen.add(d)
                        new.append(d)
                        held.append(data)
                    at = cut
                    if cut == doc_end:
                        recipes.append(b"".join(recipe))
                        root.append(merkle(steps))
                        recipe, steps, doc_end = [], [], next(doc_ends, None)
                if len(seen) > 500_000:
                    seen.clear()
                none = [None] * len(new)
                n = np.diff(ends, prepend=0).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0).slice(lo, len(texts)), pa.array(none, pa.int64())]),
                        pa.array(n + none, pa.int64()),
                        pa.array(recipes + none, pa.binary()),
                        pa.array(root + new, pa.binary()),
                        pa.array([None] * len(root) + held, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "recipe", "digest", "payload"],
                )
        hand_back()

    return run


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each chunk digest in rows that lie sorted; all document rows."""
    if _encoder.cache_info().currsize:
        _encoder.cache_clear()
        hand_back()
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = pc.if_else(batch.column(5), batch.column(3), None)
        before = pa.concat_arrays([pa.array([last], chunk.type), chunk.slice(0, len(chunk) - 1)])
        yield batch.filter(pc.fill_null(pc.not_equal(chunk, before), True))
        last = chunk[-1].as_py()


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text", range_docs: int = 100_000) -> None:
    """Encode whole texts, append ``end_id`` to each and write a store at ``path``.

    ``chunks``: one row a distinct chunk, (digest, payload); the payload is its ids as little-endian unsigned
    integers of ``width`` bytes (2 holds vocabularies to 65,536; a larger id is an error), the digest their SHA-256.
    ``recipes``: in ascending id order over the files, one row a document: doc_id, file, n_tokens, start
    (ids of all documents before it), root (Merkle root over its chunk digests), recipe (digest and
    length of each chunk in order, 36 bytes each); FILE_DOCS documents make a file. ``manifest``: one row a
    file: file, documents, tokens, base (ids before it), root (Merkle root over its documents' roots).

    Texts are encoded where they are read. A task sends on each chunk once, and one shuffle by digest
    leaves one copy of each: a passage that a third of all documents share is a row a task.
    Running starts need one row a range of ids on the driver.

    Nulls: a null text is empty, a null id sorts first. Rows repeating an id are documents of their own, in
    the order of their roots. No rows give an empty store.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_encode(tokenizer, end_id, width), "doc_id long, n_tokens long, recipe binary, digest binary, payload binary")
    rows = rows.withColumn("chunk", F.col("payload").isNotNull())
    rows = rows.repartition("digest", "doc_id").sortWithinPartitions("chunk", "digest")
    rows = rows.mapInArrow(_first_of_each, "doc_id long, n_tokens long, recipe binary, digest binary, payload binary, chunk boolean")
    rows.write.option("compression", "zstd").partitionBy("chunk").parquet(f"{path}/staged")
    staged = spark.read.schema("doc_id long, n_tokens long, recipe binary, digest binary, payload binary, chunk boolean").parquet(f"{path}/staged")
    docs_only = staged.where("NOT chunk").select("doc_id", "n_tokens", "recipe", F.col("digest").alias("root"))
    placed = running_sums(docs_only.withColumn("one", F.lit(1).cast("long")), ["doc_id", "root"], ["n_tokens", "one"], range_docs)
    ordered = placed.select("doc_id", F.floor((F.col("upto_one") - 1) / FILE_DOCS).cast("long").alias("file"), "n_tokens", (F.col("upto_n_tokens") - F.col("n_tokens")).alias("start"), "root", "recipe")
    ordered = materialize(ordered, "recipes")
    ordered.repartitionByRange(max(1, -(-ordered.count() // range_docs)), "start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _files(recipes(spark, path)).write.parquet(f"{path}/manifest")


def _files(found: DataFrame) -> DataFrame:
    """One manifest row a file of the recipes ``found``."""
    return found.select("file", "start", "n_tokens", "root").groupBy("file").applyInPandas(_file_row, MANIFEST)


def _file_row(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("start")
    return pd.DataFrame({"file": rows["file"].iloc[:1], "documents": len(rows), "tokens": rows["n_tokens"].sum(), "base": rows["start"].iloc[:1], "root": [merkle(list(rows["root"]))]})


# --- reading --------------------------------------------------------------------


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """The unique chunks: ``digest, payload``."""
    return spark.read.schema("digest binary, payload binary, chunk boolean").parquet(f"{path}/staged").where("chunk").select("digest", "payload")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, file long, n_tokens long, start long, root binary, recipe binary").parquet(f"{path}/recipes")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raise ValueError if the recipes are not those that the manifest states, file by file and in one gapless stream."""
    stated, found = manifest(spark, path), _files(recipes(spark, path))
    keys = ["documents", "tokens", "base", "root"]
    both = stated.join(found.select("file", *(F.col(k).alias(f"found_{k}") for k in keys)), "file", "full")
    differ = both.where(~F.array(*(F.col(k).eqNullSafe(F.col(f"found_{k}")) for k in keys)).eqNullSafe(F.array(*[F.lit(True)] * len(keys))))
    ends = stated.select((F.col("file") + 1).alias("file"), (F.col("base") + F.col("tokens")).alias("due"))
    ends = ends.unionByName(spark.createDataFrame([(0, 0)], "file long, due long"))
    gaps = stated.join(ends, "file", "left").where(~F.col("due").eqNullSafe(F.col("base")))
    bad = differ.select("file").unionByName(gaps.select("file")).head(1)
    if bad:
        raise ValueError(f"recipe file {bad[0]['file']} is not what the manifest states")


def _steps(df: DataFrame) -> DataFrame:
    """A row a chunk of each document of ``df``: doc_id, start, k, digest."""
    k = F.sequence(F.lit(0), (F.length("recipe") / 36 - 1).cast("int"))
    return df.select("doc_id", "start", "n_tokens", "root", "recipe", F.explode(k).alias("k")).select(
        "doc_id", "start", "n_tokens", "root", "k", F.substring("recipe", F.col("k") * 36 + 1, F.lit(32)).alias("digest")
    )


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, payloads = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for d, data in zip(digests, payloads, strict=True):
                if hashlib.sha256(data).digest() != d:
                    raise ValueError(f"chunk {d.hex()} does not hold what its digest says")
            ids = memoryview(np.frombuffer(b"".join(payloads), f"<u{width}").astype("<u4").tobytes())
            n = [len(data) // width for data in payloads]
            stop = [4 * x for x in accumulate(n)]
            crc = [zlib.crc32(ids[lo:hi]) for lo, hi in zip([0, *stop], stop)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], ["digest", "crc", "n"])

    return run


def _join_up(rows: pd.DataFrame) -> pd.DataFrame:
    """One row a document from its chunks' sums, checked against its Merkle root and length."""
    rows = rows.sort_values(["start", "doc_id", "k"], kind="stable", ignore_index=True)
    first = np.flatnonzero((rows["k"] == 0).to_numpy())
    n = rows["n"].to_numpy(np.int64)
    end = np.add.reduceat(n, first) if len(first) else n
    inside = np.cumsum(n)
    doc = np.cumsum((rows["k"] == 0).to_numpy()) - 1
    behind = np.cumsum(end)[doc] - inside if len(n) else n
    shifted = crc_shift(rows["crc"].to_numpy(np.uint32), 4 * behind)
    crc = np.bitwise_xor.reduceat(shifted, first) if len(first) else shifted
    digests, bounds = rows["digest"].tolist(), [*first.tolist(), len(rows)]
    for j, at in enumerate(first.tolist()):
        if merkle(digests[at : bounds[j + 1]]) != rows["root"][at] or end[j] != rows["n_tokens"][at]:
            raise ValueError(f"document {rows['doc_id'][at]} is not what its recipe says")
    head = rows.iloc[first]
    return pd.DataFrame({"doc_id": head["doc_id"].to_numpy(), "start": head["start"].to_numpy(), "n_tokens": end, "ids_crc32": crc.astype(np.int64), "chunks": np.diff(bounds)})


def verify(spark: SparkSession, path: str, width: int = 2, bucket_tokens: int = 4_000_000) -> DataFrame:
    """Read all files back: ``doc_id, start, n_tokens, ids_crc32, chunks``.

    Each chunk's payload is read once and checked against its digest; a document's crc32
    is put together from its chunks' (a crc of a concatenation follows from the parts' and
    lengths), so what is shuffled is a few bytes a chunk and not the ids again. Each
    document is checked against its length and Merkle root, and all of them against the
    manifest: a file or document that was lost, added or moved raises. Documents are joined up in
    groups that lie close together in the stream, of about ``bucket_tokens`` ids.
    """
    check_manifest(spark, path)
    sums = chunks(spark, path).mapInArrow(_sums(width), "digest binary, crc long, n long")
    steps = _steps(recipes(spark, path)).withColumnRenamed("digest", "want")
    found = steps.join(sums, steps["want"] == sums["digest"], "left").drop("digest").withColumnRenamed("want", "digest")
    found = found.withColumn("n", F.when(F.col("n").isNull(), F.raise_error(F.lit("a chunk is missing"))).otherwise(F.col("n")))
    found = found.withColumn("bucket", F.floor(F.col("start") / bucket_tokens))
    out = found.groupBy("bucket").applyInPandas(lambda rows: _join_up(rows), "doc_id long, start long, n_tokens long, ids_crc32 long, chunks long")
    return out


def read_documents(spark: SparkSession, path: str, width: int = 2, ids: DataFrame | None = None) -> DataFrame:
    """Whole documents again, ``doc_id, start, ids binary`` (unsigned 32-bit), of all or of the doc_ids in ``ids``."""
    wanted = recipes(spark, path)
    if ids is not None:
        wanted = wanted.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def whole_document(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        data = np.frombuffer(b"".join(rows["payload"]), f"<u{width}").astype("<u4").tobytes()
        return pd.DataFrame({"doc_id": [rows["doc_id"].iloc[0]], "start": [rows["start"].iloc[0]], "ids": [data]})

    return _steps(wanted).join(chunks(spark, path), "digest").groupBy("start").applyInPandas(whole_document, "doc_id long, start long, ids binary")


def drop_store(spark: SparkSession, path: str) -> None:
    delete(spark, path)
