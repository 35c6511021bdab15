"""The change-feed fold as a stream.

Each micro-batch is reduced to its latest changes and published beside those of the batches
before it, under the batch's number, so a replayed batch replaces itself and a batch costs
what it holds. Reading applies all batches by the same upsert: late and repeated events
change nothing that is newer. ``compact`` folds the batches into one. Ordering is by
``tx`` alone; no watermark is needed and nothing is dropped for being late.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.changefeed import CHANGE_SCHEMA, apply_changes, event_effects, latest_changes
from loomgraph.sources.publish import folders, publish, read_current, remove


def merge_batch(batch: DataFrame, path: str, number: int | None = None) -> DataFrame:
    """Publish the latest changes of one batch of events below ``path``."""
    name = f"batch-{number:012d}" if number is not None else f"batch-{uuid.uuid4().hex}"
    return publish(latest_changes(event_effects(batch, with_body=True)), f"{path}/{name}")


def start_fold(events: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Start the streaming query that keeps ``path`` up to date; returns the query."""
    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, number: merge_batch(batch, path, number)).start()


def folded_changes(spark, path: str) -> DataFrame:
    """The changes of all batches so far, not yet applied to one another."""
    parts = [read_current(spark, f"{path}/{name}") for name in folders(spark, path)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], CHANGE_SCHEMA)


def compact(spark, path: str) -> None:
    """Fold all batches into one. Ending early loses nothing, as changes apply repeatedly."""
    held = folders(spark, path)
    publish(latest_changes(folded_changes(spark, path)), f"{path}/folded-{uuid.uuid4().hex}")
    for name in held:
        remove(spark, f"{path}/{name}")


def folded_state(spark, path: str) -> DataFrame:
    """Current state of what the stream has folded so far."""
    return apply_changes(folded_changes(spark, path))


def arrivals(events: DataFrame, every: str = "1 day", late: str = "10 days") -> DataFrame:
    """Deliveries per type and arrival window, for streams and batches alike."""
    rows = events.withColumn("kind", F.regexp_replace(F.lower("event_type"), r"^\s+|\s+$", ""))
    if events.isStreaming:
        rows = rows.withWatermark("ingested_at", late)
    return rows.groupBy(F.window("ingested_at", every).alias("w"), "kind").agg(F.count(F.lit(1)).alias("deliveries")).select(F.col("w.start").alias("day"), "kind", "deliveries")
