"""Folders that the driver and all executors share, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent (unit tests, one machine) a folder of our own is
    made once per application and set as the checkpoint folder. On a cluster it must be set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def work_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tidewell/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The table replaces the lineage, so a lost executor costs a re-read and not a
    recomputation, and two consumers of one frame do not compute it twice.
    """
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mounted(path: str) -> str:
    """The local mount of a shared ``file:`` path, for memory mapping and plain files."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: plain files need a shared folder that is mounted on every worker (file:)")
    return url.path


def delete(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
