"""Exact dedup: local winners, then salted digest groups, then one winner a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewell.llm.text import SPACE, whole
from tidewell.storage import materialize


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """Group documents whose texts are equal after each run of white space became one space.

    Returns one row a row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The text itself is a grouping key beside its digest, so every stage compares full content: the map
    side of the aggregation dedupes within a task, the salted groups merge
    task winners (a hot text is spread over ``salts`` tasks), and the last
    aggregation sees at most ``salts`` rows a text. Texts are shuffled twice; the winners, a written
    table without texts, are then joined to (digest, id) pairs. Only if two texts share a
    digest are these told apart by content again.

    Nulls: a null text is empty; a null id never wins unless all ids of its group are
    null. Rows that repeat an id are one document and agree on ``kept``;
    ``group_size`` counts rows. Other columns are ignored. No rows give no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(whole(text_col), SPACE, " ").alias("content"))
    found = winners(base.withColumn("digest", F.unhex(F.sha2("content", 256))), salts)
    return found.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def winners(base: DataFrame, salts: int = 32) -> DataFrame:
    """``doc_id, digest, keep_id, group_size`` of each row of (doc_id, content, digest); any digest will do."""
    salted = (
        base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .groupBy("digest", "salt", "content")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    classes = salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    classes = materialize(classes.select("digest", "keep_id", "group_size"), "exact-classes")
    clash = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest")
    light = base.select("doc_id", "digest")
    if clash.isEmpty():
        return light.join(classes, "digest")
    # Different texts of one digest: those rows are joined on the text too.
    odd = base.join(clash, "digest", "left_semi")
    told = odd.groupBy("digest", "content").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_content = odd.join(told, ["digest", "content"]).select("doc_id", "digest", "keep_id", "group_size")
    by_digest = light.join(clash, "digest", "left_anti").join(classes, "digest")
    return by_digest.select("doc_id", "digest", "keep_id", "group_size").unionByName(by_content)
