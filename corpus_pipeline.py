"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import queries
from tidewell.storage import materialize

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language_id", queries.stage_language_id),
    ("line_dedup", queries.stage_line_dedup),
    ("near_dedup", queries.stage_near_dedup),
    ("mixing", queries.stage_mixing),
    ("packing", queries.stage_packing),
]

#: SQL cannot say it (byte models, random rounding, tokenizers); tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
