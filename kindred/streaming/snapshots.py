"""Provisional groups while items arrive.

Later items may retract a group, so results can't be appended: each
snapshot groups everything so far and replaces the one before. Items are
kept in a Parquet folder of the stream's own, one folder a batch, so a
batch that is run again after a failure replaces its own rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

FIRST_S, TIMES_GROUPING = 60.0, 10.0


class Snapshots:
    """A foreachBatch writer: on_snapshot(groups, n_items) no more often than every `interval` s and TIMES_GROUPING times as long as grouping takes."""

    def __init__(self, folder: str, group: Callable[[DataFrame], DataFrame], on_snapshot: Callable[[DataFrame, int], None], interval: float = 300.0):
        self.folder, self.group, self.on_snapshot, self.interval = folder.rstrip("/"), group, on_snapshot, interval
        self.next_at = time.monotonic() + min(FIRST_S, interval)
        self.taken = 0

    def items(self, spark) -> DataFrame:
        """Everything so far; an item that came again counts as it came last."""
        rows = spark.read.option("basePath", self.folder).parquet(f"{self.folder}/batch=*")
        latest = rows.groupBy("uri").agg(F.max("batch").alias("batch"))
        return rows.join(latest, ["uri", "batch"], "left_semi").dropDuplicates(["uri"]).drop("batch")

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        if time.monotonic() >= self.next_at:
            self.snapshot(batch.sparkSession)

    def snapshot(self, spark) -> None:
        began = time.monotonic()
        items = self.items(spark)
        self.on_snapshot(self.group(items), items.count())
        self.taken += 1
        self.next_at = time.monotonic() + max(self.interval, TIMES_GROUPING * (time.monotonic() - began))


def watch(items: DataFrame, writer: Snapshots, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Start grouping a streaming DataFrame of items: until stopped with `every`, else until what is there has been read.

    Stopping the query cancels the scan; batches that were written stay.
    """
    stream = items.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=every) if every else stream.trigger(availableNow=True)).start()
