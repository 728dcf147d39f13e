"""Versioned Parquet snapshots behind one manifest, and the lease of a run."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators.lookup import write_by_key
from tidewell.sources.schema import TABLES, VERSION


class StoreError(RuntimeError):
    pass


class Files:
    """Small files in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = True) -> bool:
        """Whether the file was written; without ``overwrite`` an existing file stays and the answer is False."""
        fs, p = self._at(path)
        try:
            stream = fs.create(p, overwrite)
        except Py4JJavaError as e:
            if not overwrite and fs.exists(p):
                return False
            raise StoreError(f"cannot write {path}") from e
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


#: Appended parts of a table are written as one again at this number.
MOST_PARTS = 100


def _parts(entry) -> list[list]:
    """A table's [path, newest time in seconds] in a manifest; a snapshot that was written whole has no time, which is 0."""
    return [] if entry is None else [[entry, 0]] if isinstance(entry, str) else entry


class Store:
    """Tables of ``schema.TABLES`` as immutable Parquet snapshots, or as parts that were appended.

    A commit writes all its snapshots first and then one manifest ``manifest-<n>.json`` that may not exist yet. So a reader sees all of a
    commit or nothing, a broken run leaves only unnamed files, and of two writers one fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def generation(self) -> int:
        found = [int(n[9:-5]) for n in self.files.names(self.root) if n.startswith("manifest-") and n.endswith(".json")]
        return max(found, default=0)

    def manifest(self, generation: int | None = None) -> dict:
        n = self.generation() if generation is None else generation
        if not n:
            return {"version": VERSION, "tables": {}}
        got = json.loads(self.files.read(f"{self.root}/manifest-{n}.json"))
        if got["version"] > VERSION:
            raise StoreError(f"the store has schema version {got['version']}; this build knows {VERSION}")
        return got

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        """A table as of a commit; one that was never written is empty. Columns that a newer writer added are kept."""
        table = TABLES[name]
        at = self.manifest(generation)["tables"].get(name)
        empty = self.spark.createDataFrame([], table.schema)
        if not _parts(at):
            return empty
        got = self.spark.read.option("mergeSchema", len(_parts(at)) > 1).parquet(*(f"{self.root}/{p}" for p, _ in _parts(at)))
        missing = [f for f in empty.schema if f.name not in got.columns]
        return got.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})

    def _write(self, name: str, df: DataFrame, generation: int) -> str:
        if name not in TABLES:
            raise StoreError(f"unknown table {name}")
        path = f"{name}/{generation}-{uuid.uuid4().hex[:8]}"
        if TABLES[name].sought:
            write_by_key(df, f"{self.root}/{path}", TABLES[name].sought)
        else:
            df.write.option("compression", "zstd").parquet(f"{self.root}/{path}")
        return path

    def commit(self, writes: Mapping[str, DataFrame], appends: Mapping[str, DataFrame] | None = None, now: datetime | None = None) -> int:
        """Replace and append to the named tables, all or none; returns the new generation.

        An append writes only its rows. Of a table whose rows are kept for a time only, parts that are older as a whole are
        dropped at ``now``; many small parts are written as one again.
        """
        n = self.generation()
        tables = dict(self.manifest(n)["tables"])
        for name, df in writes.items():
            tables[name] = self._write(name, df, n + 1)
        for name, df in (appends or {}).items():
            path, table = self._write(name, df, n + 1), TABLES.get(name)
            newest = self.spark.read.parquet(f"{self.root}/{path}").agg(F.unix_seconds(F.max(table.time))).first()[0] if table.time else 0
            parts = [*_parts(tables.get(name)), [path, newest or 0]]
            if table.keep and now:
                oldest = (now - table.keep).timestamp()
                parts = [p for p in parts if not p[1] or p[1] >= oldest]
            if len(parts) > MOST_PARTS:
                whole = self.spark.read.option("mergeSchema", True).parquet(*(f"{self.root}/{p}" for p, _ in parts))
                parts = [[self._write(name, whole, n + 1), max(t for _, t in parts)]]
            tables[name] = parts
        if not self.files.write(f"{self.root}/manifest-{n + 1}.json", json.dumps({"version": VERSION, "tables": tables}), overwrite=False):
            raise StoreError("another run has committed meanwhile; nothing of this commit counts")
        return n + 1

    def vacuum(self, keep: int = 3) -> int:
        """Delete snapshots that none of the last ``keep`` commits names; returns how many."""
        n = self.generation()
        named = {p for g in range(max(1, n - keep + 1), n + 1) for entry in self.manifest(g)["tables"].values() for p, _ in _parts(entry)}
        gone = 0
        for name in TABLES:
            for snap in self.files.names(f"{self.root}/{name}"):
                if f"{name}/{snap}" not in named:
                    self.files.delete(f"{self.root}/{name}/{snap}")
                    gone += 1
        for g in range(1, n - keep + 1):
            self.files.delete(f"{self.root}/manifest-{g}.json")
        return gone

    # -- one run at a time
    def acquire(self, run_id: str, seconds: float) -> bool:
        """Take the lease unless another run holds one that has not run out."""
        path = f"{self.root}/lease.json"
        body = json.dumps({"run": run_id, "until": time.time() + seconds})
        if self.files.write(path, body, overwrite=False):
            return True
        held = json.loads(self.files.read(path) or "{}")
        if held.get("run") == run_id or held.get("until", 0) < time.time():
            # Replacing a lease that ran out goes through a delete, so of two runs that try, one creates it.
            self.files.delete(path)
            return self.files.write(path, body, overwrite=False)
        return False

    def release(self, run_id: str) -> None:
        path = f"{self.root}/lease.json"
        if self.files.exists(path) and json.loads(self.files.read(path)).get("run") == run_id:
            self.files.delete(path)
