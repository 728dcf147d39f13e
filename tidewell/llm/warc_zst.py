"""WARC archives in Zstandard: one frame a record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.sources.store import Files
from tidewell.storage import materialize, mounted

#: Fixed by the format: magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Fixed by the format: magic numbers of a frame and of a raw dictionary.
FRAME_MAGIC, RAW_DICTIONARY_MAGIC = 0xFD2FB528, 0xEC30A437
#: Fixed by the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long"
_NAMESPACE = uuid.UUID(int=0x5EED)
_HEADERS = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class WarcError(ValueError):
    """An archive that does not hold what its headers say."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def train_dictionary(samples: list[bytes], size: int = 32_768) -> bytes:
    """A Zstandard dictionary; few or odd samples are used as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"WARC"


class Writer:
    """Archives in memory, one record a frame."""

    def __init__(self, dictionary: bytes, level: int = 3):
        self.dictionary = dictionary
        self.codec = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=True, write_content_size=True)
        packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
        self.head = DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed

    def record(self, headers: dict[str, str], block: bytes) -> bytes:
        lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in headers.items())
        return self.codec.compress(f"{VERSION}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")


def _clean(value: str) -> str:
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in value)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    full = data[:4] == RAW_DICTIONARY_MAGIC.to_bytes(4, "little")
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; one frame is decoded at a time.

    Raises ``WarcError`` for a frame that is cut off or damaged, a missing or odd header, and a length that does
    not fit. An archive without a leading dictionary frame is read without a dictionary;
    other skippable frames are passed over.
    """
    at, view, codec = 0, memoryview(data), None
    if len(data) >= 8 and int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC:
        size = int.from_bytes(data[4:8], "little")
        if len(data) < 8 + size:
            raise WarcError("the dictionary frame is cut off")
        raw = bytes(view[8 : 8 + size])
        if int.from_bytes(raw[:4], "little") == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        codec = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        at = 8 + size
    codec = codec or zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if at > len(data):
                raise WarcError("a skippable frame is cut off")
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one = codec.decompressobj()
        record, fed = [], at
        try:
            while not one.eof and fed < len(data):
                step = view[fed : fed + 65_536]
                record.append(one.decompress(step))
                fed += len(step)
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at} is damaged: {e}") from e
        if not one.eof:
            raise WarcError(f"the frame at byte {at} is cut off")
        at = fed - len(one.unused_data)
        yield _parse(b"".join(record))


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:40]!r}")
        headers[name.strip()] = value.strip()
    if missing := [h for h in _HEADERS if h not in headers]:
        raise WarcError(f"headers are missing: {missing}")
    if not headers["Content-Length"].isdigit() or rest[-4:] != b"\r\n\r\n" or len(rest) - 4 != int(headers["Content-Length"]):
        raise WarcError(f"Content-Length {headers['Content-Length']} does not fit {len(rest) - 4} bytes")
    return headers, rest[:-4]


def plan_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, size, refers_to) of each record that repeats an earlier payload of at least ``least_bytes``.

    Payloads are told apart by SHA-1 and length; the smallest page_id of equals stays a response. The
    digest groups are merged on the map side first, so a payload that a third of all
    pages share is one row a task.
    """
    p = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("b"))
    p = p.select("page_id", F.unhex(F.sha1("b")).alias("digest"), F.octet_length("b").alias("size")).where(F.col("size") >= least_bytes)
    first = p.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # A written table, so that Spark sends it to all tasks where it is small and splits a hot payload's pages where not.
    first = materialize(first, "payloads")
    return p.join(first, ["digest", "size"]).where("page_id != refers_to").select("page_id", "digest", "size", "refers_to").distinct()


def _write(folder: str, dictionary: bytes, target_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, task = Writer(dictionary), TaskContext.get()
        done, parts, size = [], [], 0

        def flush() -> None:
            nonlocal parts, size
            if parts:
                name = f"{task.partitionId():06d}-{len(done):06d}-{task.taskAttemptId()}.warc.zst"
                with open(f"{folder}/{name}.draft", "wb") as f:
                    f.writelines([writer.head, *parts])
                os.replace(f"{folder}/{name}.draft", f"{folder}/{name}")
                done.append((name, len(parts)))
                parts, size = [], 0

        for batch in batches:
            for page, url, html, ref in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                payload = (html or "").encode()
                headers = {
                    "WARC-Type": "response" if ref is None else "revisit",
                    "WARC-Record-ID": record_id(page),
                    "WARC-Date": date,
                    "WARC-Target-URI": url or "",
                    "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
                    "WARC-Payload-Length": str(len(payload)),
                    "WARC-Page-ID": "" if page is None else str(page),
                }
                if ref is not None:
                    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(ref), "WARC-Refers-To-Page-ID": str(ref)}
                parts.append(writer.record(headers, payload if ref is None else b""))
                size += len(parts[-1])
                if size >= target_bytes:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["file", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, target_bytes: int = 8_000_000, sample_pages: int = 200, sample_chars: int = 65_536, date: str = "2024-01-01T00:00:00Z") -> int:
    """Write one record a row of ``pages`` (page_id, url, html) into ``.warc.zst`` files; returns the number of files.

    Records are responses, and revisits where ``plan_revisits`` says so; a revisit has no payload but names it by
    digest, length and the record it refers to. The dictionary is trained on ``sample_chars`` characters of
    ``sample_pages`` pages (fixed bounds; the pages with the smallest hashes) and stands at the head of each file. Files end at
    ``target_bytes``. ``folder`` must be in the shared folder, mounted on the workers.

    Each attempt of a task writes files of its own; ``_manifest`` below ``folder`` names those of the attempts that counted, with their
    number of records, so what a lost attempt left behind is never read.

    Nulls: a null html is empty, a null url is empty, a null page_id is a response with an empty
    id. Rows repeating a page_id are a record each, told apart by payload. Other columns are ignored; no rows give no files.
    """
    whole = F.coalesce("html", F.lit(""))
    sample = _sample(pages.select(F.substring(whole, 1, sample_chars).alias("html"), F.xxhash64("page_id", "url").alias("h")), sample_pages)
    local = mounted(folder)
    os.makedirs(local, exist_ok=True)
    payload = F.encode(whole, "UTF-8")
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size"))
    rows = rows.join(plan_revisits(pages, least_bytes), ["page_id", "digest", "size"], "left").select("page_id", "url", "html", "refers_to")
    rows.mapInArrow(_write(local, train_dictionary(sample), target_bytes, date), MANIFEST).write.parquet(f"{folder}/_manifest")
    return manifest(pages.sparkSession, folder).count()


def _sample(pages: DataFrame, rows: int) -> list[bytes]:
    """The pages with the smallest hashes; only a share of the hashes that holds a few times as many is sorted."""
    share = min(1.0, 8 * rows / max(pages.count(), 1))
    few = pages.where(F.pmod("h", F.lit(1 << 32)) < int(share * (1 << 32)))
    return [r["html"].encode() for r in few.orderBy("h", "html").limit(rows).collect()]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``file, records`` of the archives in ``folder``."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            for headers, block in read_archive(content.as_py()):
                rows.append(_checked(headers, block))
                if len(rows) >= 2_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def _checked(headers: dict[str, str], block: bytes) -> tuple:
    kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    page, ref = headers.get("WARC-Page-ID", ""), headers.get("WARC-Refers-To-Page-ID")
    size = headers.get("WARC-Payload-Length", headers["Content-Length"])
    if kind == "response" and (sha1_base32(block) != digest or str(len(block)) != size):
        raise WarcError(f"record {headers['WARC-Record-ID']}: the payload is not what its digest says")
    if kind == "revisit" and (block or ref is None or headers.get("WARC-Refers-To") != record_id(int(ref)) or headers.get("WARC-Profile") != REVISIT_PROFILE):
        raise WarcError(f"record {headers['WARC-Record-ID']}: a revisit that refers to nothing")
    return int(page) if page else None, headers.get("WARC-Target-URI"), kind, int(ref) if ref else None, digest, int(size), block if kind == "response" else None


def _batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    col = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(col, kinds, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the ``.warc.zst`` files that the manifest of ``path`` names, read through Spark from any store; all of them where there is no manifest.

    ``page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload``; payloads are checked against
    digest and length. A folder without archives gives no rows.
    """
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    if Files(spark).exists(f"{path}/_manifest"):
        named = manifest(spark, path).select("file")
        files = files.withColumn("file", F.substring_index("path", "/", -1)).join(named, "file", "left_semi")
    return files.select("content").mapInArrow(_read, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")
