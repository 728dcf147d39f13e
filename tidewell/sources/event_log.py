"""The landing folder of raw events: one durable file a batch, read in order after a cursor."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.text import HIDDEN
from tidewell.operators.events import RAW_SCHEMA

FILE_SCHEMA = RAW_SCHEMA.replace("received_at timestamp", "received_at string")
MAX_BODY, MAX_BATCH = 50_000, 4_000_000


class LogShrank(RuntimeError):
    """The log holds less than was already read."""


class EventLog:
    """Appends to ``root/month=YYYY-MM/<first seq>.json``; a batch is visible at once or not at all.

    The writer is one process, as the receiver is; readers are Spark jobs and streams.
    """

    def __init__(self, root: str, secrets: Iterable[str] = (), secret_fields: Iterable[str] = ("secret",)):
        self.root, self.secrets, self.secret_fields = root, tuple(secrets), tuple(secret_fields)

    def last_seq(self) -> int:
        """The last number used, from the file names alone."""
        last = 0
        for folder, _, names in os.walk(self.root):
            for n in names:
                if n.endswith(".json") and not n.startswith("."):
                    last = max(last, int(n.split("-")[1].removesuffix(".json")))
        return last

    def append(self, bodies: Iterable[tuple[str, str]], received: datetime | None = None) -> list[int]:
        """Store (kind, body) pairs durably and return their numbers; an event counts as taken once this returns."""
        received = (received or datetime.now(UTC)).astimezone(UTC)
        seq = self.last_seq()
        rows = []
        for kind, body in bodies:
            seq += 1
            rows.append({"seq": seq, "received_at": received.strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z", "kind": kind, "body": store_body(body, self.secrets, self.secret_fields)})
        if not rows:
            return []
        text = "\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n"
        folder = os.path.join(self.root, f"month={received:%Y-%m}")
        os.makedirs(folder, exist_ok=True)
        fd, draft = tempfile.mkstemp(dir=folder, prefix=".draft-")
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, os.path.join(folder, f"{rows[0]['seq']:012d}-{rows[-1]['seq']:012d}.json"))
        return [r["seq"] for r in rows]

    def read(self, spark: SparkSession, after: int = 0) -> DataFrame:
        """Events after a cursor; raises ``LogShrank`` if the log ends before it."""
        if after > self.last_seq():
            raise LogShrank(f"the event log ends at {self.last_seq()}, but {after} was already read")
        if not self.last_seq():
            return spark.createDataFrame([], RAW_SCHEMA)
        return raw_frame(spark.read.schema(FILE_SCHEMA).option("recursiveFileLookup", True).json(self.root)).where(F.col("seq") > after)

    def delete_processed(self, upto: int, now: datetime, keep: timedelta = timedelta(days=90)) -> int:
        """Remove files whose events are all at or below the cursor and older than ``keep``; returns how many."""
        gone, oldest = 0, now - keep
        for folder, _, names in os.walk(self.root):
            month = os.path.basename(folder).removeprefix("month=")
            for n in names:
                if not n.endswith(".json") or n.startswith(".") or month > f"{oldest:%Y-%m}":
                    continue
                path = os.path.join(folder, n)
                if int(n.split("-")[1].removesuffix(".json")) > upto:
                    continue
                with open(path, encoding="utf-8") as f:
                    newest = max(json.loads(line)["received_at"] for line in f)
                if newest < f"{oldest:%Y-%m-%dT%H:%M:%S}":
                    os.unlink(path)
                    gone += 1
        return gone


def _scrubbed(value, secrets: Sequence[str], fields: frozenset[str]):
    """A JSON value without the named fields, at any depth, and with secrets hidden in its texts and names."""
    if isinstance(value, str):
        for s in secrets:
            value = value.replace(s, HIDDEN)
        return value
    if isinstance(value, dict):
        return {_scrubbed(k, secrets, fields): _scrubbed(v, secrets, fields) for k, v in value.items() if k.lower() not in fields}
    if isinstance(value, list):
        return [_scrubbed(v, secrets, fields) for v in value]
    return value


def store_body(body: str, secrets: Iterable[str] = (), secret_fields: Iterable[str] = ()) -> str:
    """A body as it is stored: JSON as it came, anything else marked.

    Fields named in ``secret_fields`` (in any case, at any depth) are left out and ``secrets`` hidden in all texts; a body with neither stays as it came.
    One above MAX_BODY loses its lists, then long texts their tails, then whole fields, the longest first, until it fits;
    what is stored is JSON always.
    """
    try:
        got = json.loads(body)
    except ValueError:
        got = None
    if not isinstance(got, dict):
        return json.dumps({"__not_json": True})
    hide = sorted({s for s in secrets if s}, key=len, reverse=True)
    clean = _scrubbed(got, hide, frozenset(f.lower() for f in secret_fields))
    if clean != got:
        got, body = clean, json.dumps(clean)
    if len(body) <= MAX_BODY:
        return body
    short = {k: v[:1_000] if isinstance(v, str) else v for k, v in got.items() if not isinstance(v, list)}
    sizes = sorted(((len(json.dumps({k: v})), k) for k, v in short.items()), reverse=True)
    left = sum(n for n, _ in sizes)
    for n, k in sizes:
        if left <= MAX_BODY:
            break
        del short[k]
        left -= n
    return json.dumps(short)


def raw_frame(df: DataFrame) -> DataFrame:
    return df.select("seq", F.try_to_timestamp("received_at").alias("received_at"), "kind", "body")
