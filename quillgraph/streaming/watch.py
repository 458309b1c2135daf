"""Following changes of files: coalescing events and applying them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.manifest import language_of
from quillgraph.plans import index
from quillgraph.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def last_operations(events: DataFrame, key: str = "path") -> DataFrame:
    """(path, op, ts, events): the last operation on every path; of equal times the greater id decides."""
    last = F.max(F.struct("ts", "event_id", "op"))
    return events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).groupBy(key).agg(last.alias("l"), F.count("*").alias("events")).select(key, "l.op", "l.ts", "l.event_id", "events")


def coalesce_stream(stream: DataFrame, spark: SparkSession, key: str = "path") -> DataFrame:
    """``last_operations`` of a stream that is read to its end.

    Every micro-batch is coalesced and written under its own number, so a batch
    that runs again replaces itself; the batches are then merged.
    """
    target, progress = shared_folder(spark, "events"), shared_folder(spark, "progress")

    def write(batch: DataFrame, number: int) -> None:
        last_operations(batch, key).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(target)
    last = F.max(F.struct("ts", "event_id", "op"))
    return parts.groupBy(key).agg(last.alias("l"), F.sum("events").alias("events")).select(key, "l.op", "l.ts", "l.event_id", "events")


def debounced(events: DataFrame, gap: str = "2 seconds", watermark: str | None = None, key: str = "path") -> DataFrame:
    """(path, started, ended, events): runs of events on a path with pauses of less than ``gap``.

    With a watermark this runs on a stream: a run comes out once no event can
    belong to it any more, and later events are dropped.
    """
    rows = events.withWatermark("ts", watermark) if watermark else events
    runs = rows.where(F.col(key).isNotNull()).groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return runs.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def moved_as_pairs(events: DataFrame) -> DataFrame:
    """(event_id, path, op, ts): a move, which has (path, moved_to), deletes the old path and creates the new."""
    both = F.when(
        F.col("op") == "moved",
        F.array(F.struct("path", F.lit("deleted").alias("op")), F.struct(F.col("moved_to").alias("path"), F.lit("created").alias("op"))),
    ).otherwise(F.array(F.struct("path", "op")))
    return events.select("event_id", F.explode(both).alias("e"), "ts").select("event_id", "e.path", "e.op", "ts")


def watched(events: DataFrame, root: str) -> DataFrame:
    """(event_id, path, op, ts) of events on source files below ``root``, paths relative to it."""
    inside = events.where(F.col("path").startswith(root.rstrip("/") + "/"))
    relative = inside.withColumn("path", F.substring("path", len(root.rstrip("/")) + 2, 1 << 30))
    return relative.where(language_of("path") != "unknown").select("event_id", "path", "op", "ts")


def follow(stream: DataFrame, spark: SparkSession, root: str, store: str, checkpoint: str) -> None:
    """Keep the store of an indexed tree in step with a stream of (event_id, path, op, ts), paths relative to it.

    In every micro-batch each path counts once: nodes, edges and vectors of its
    file are replaced by what the tree holds now, in the partition of that
    repository.  Running a batch twice gives the same store.
    """

    def step(batch: DataFrame, _: int) -> None:
        last = last_operations(batch).select(F.col("path").alias("file_path"))
        if not last.isEmpty():
            index.update_files(spark, root, store, last)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
