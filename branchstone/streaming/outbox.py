"""The events of a group as a stream: each commit's file is read once, in order, as it appears."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.log import Store

EVENT = "event_id bigint, kind string, version_id string, actor string, at string, delivered boolean, payload map<string,string>"
COMMIT = f"group_id string, sequence bigint, events array<struct<{', '.join(p.replace(' ', ': ', 1) for p in EVENT.split(', '))}>>"


def outbox(store: Store, group: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """A streaming DataFrame of events: exactly once into any sink that keeps Spark's checkpoint."""
    commits = store.spark.readStream.schema(COMMIT).option("maxFilesPerTrigger", files_per_batch).json(f"{store.log.root}/groups/{group}/log")
    return commits.select("group_id", "sequence", F.explode("events").alias("e")).select("group_id", "sequence", "e.*")


def undelivered(events: DataFrame, delivered: DataFrame) -> DataFrame:
    """Events that are not among the delivered (event_id)."""
    return events.join(delivered.select("event_id"), "event_id", "left_anti")
