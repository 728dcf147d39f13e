"""CSV files as raw text rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.text import WHITE_SPACE

MAX_COLUMNS = 1_000


class SourceError(ValueError):
    """A file that cannot be read as what it should be."""


def headers_of(spark: SparkSession, path: str) -> list[str]:
    """The header cells of the first line, byte order mark left out."""
    first = spark.read.option("header", False).option("multiLine", True).option("escape", '"').csv(path).limit(1).collect()
    if not first:
        raise SourceError(f"{path}: no header line")
    out = [(c or "").removeprefix("﻿") for c in first[0]]
    if len(out) > MAX_COLUMNS:
        raise SourceError(f"{path}: more than {MAX_COLUMNS} columns")
    if any("\r" in c for c in out):
        raise SourceError(f"{path}: lines end with carriage returns alone; save it with line feeds")
    return out


def read_rows(spark: SparkSession, path: str, headers: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(rows with one text column a distinct header, headers in order).

    Short rows have nulls, cells beyond the header are dropped, rows of blank cells are left out; of repeated headers the first
    counts. ``multiLine`` reads quoted line breaks; give a cluster many files rather than one large.
    """
    headers = list(headers or headers_of(spark, path))
    names, where = [], {}
    for i, h in enumerate(headers):
        if h.strip() and h not in where:
            where[h] = i
            names.append(h)
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    raw = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    rows = raw.select(*(F.col(f"c{where[n]}").alias(n) for n in names))
    filled = F.coalesce(*(F.nullif(F.btrim(F.col(f"`{n}`"), F.lit(WHITE_SPACE)), F.lit("")) for n in names)) if names else F.lit(None)
    return rows.where(filled.isNotNull()), names
