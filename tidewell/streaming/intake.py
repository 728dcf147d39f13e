"""The event log as a stream: parsed, deduplicated and applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.events import RAW_SCHEMA, event_key, normalize_keys, parse_raw
from tidewell.sources.event_log import FILE_SCHEMA, raw_frame
from tidewell.sources.schema import TABLES
from tidewell.streaming.stateful import once_by_key

#: How long an event's key is remembered.
MEMORY = TABLES["seen_events"].keep


def raw_stream(spark: SparkSession, root: str, files_a_trigger: int = 1_000) -> DataFrame:
    """New files of a landing folder, each read once: Spark's checkpoint is the cursor."""
    return raw_frame(spark.readStream.schema(FILE_SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_trigger).json(root))


def keyed_events(raw: DataFrame, unicode: bool = True) -> DataFrame:
    """Parsed events with normalized keys and their ``event_key``; rejects and ignored ones are left out."""
    good = parse_raw(raw).where("kind IS NOT NULL").drop("reject", "ignored")
    return normalize_keys(good, unicode).withColumn("event_key", event_key())


def rejects(raw: DataFrame) -> DataFrame:
    """``seq, reject, ignored`` of bodies that are not applied."""
    return parse_raw(raw).where("reject IS NOT NULL OR ignored IS NOT NULL").select("seq", "reject", "ignored")


def run_stream(spark: SparkSession, root: str, checkpoint: str, apply_batch: Callable[[DataFrame, int], None], once: bool = True, every: str = "15 minutes", unicode: bool = True, memory: timedelta = MEMORY) -> StreamingQuery:
    """Feed each batch of new events to ``apply_batch(events, batch_id)``, an event key once in ``memory``.

    Keys are streaming state beside the cursor (``stateful.once_by_key``), so a batch meets the state of its own keys and no table of a year.
    A batch that fails is given again with the same id and events, so ``apply_batch`` must know the batches it has applied
    (see ``apply_to``), and effects happen once. ``once`` takes what is there and stops; end it with ``stateful.finish``.
    """
    events = once_by_key(keyed_events(raw_stream(spark, root), unicode), memory)
    out = events.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(apply_batch)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


def apply_to(store, now_of: Callable[[], object], on_new: Callable[[DataFrame], dict[str, DataFrame]], stream: str = "events") -> Callable[[DataFrame, int], None]:
    """An ``apply_batch`` that commits a batch's effects together with its number.

    ``on_new(events)`` gives the tables to replace. Number and effects are one commit, so a repeat after a failure finds
    either both or neither, and passes over what is there. ``stream`` names the stream where a store has several; a stream that begins anew
    with an empty checkpoint needs another name.
    """
    key = f"batch-of-{stream}"

    def handle(events: DataFrame, batch_id: int) -> None:
        state = store.read("state")
        last = state.where(F.col("key") == key).head(1)
        if (last and int(last[0]["value"]) >= batch_id) or events.isEmpty():
            return
        number = state.sparkSession.createDataFrame([(key, str(batch_id))], state.schema)
        writes = on_new(events)
        rest = writes.get("state", state).where(F.col("key") != key)
        store.commit(writes | {"state": rest.unionByName(number)}, {}, now_of())

    return handle


def silent_kinds(last: DataFrame, watched: list[str], now, quiet: timedelta = timedelta(days=3)) -> DataFrame:
    """``kind, last_received`` of watched kinds from which nothing came for ``quiet``."""
    spark = last.sparkSession
    w = spark.createDataFrame([(k,) for k in watched], "kind string")
    return w.join(last, "kind", "left").where(F.col("last_received").isNull() | (F.col("last_received") < F.lit(now - quiet)))


__all__ = ["RAW_SCHEMA", "apply_to", "keyed_events", "raw_stream", "rejects", "run_stream", "silent_kinds"]
