"""Live updates: change events as a stream, applied in micro-batches.

Events are (ts, root, path, kind, structural, text): created, changed,
deleted, renamed_from, renamed_to, or overflow, which asks for a full
reconcile.  A rename is two rows.  A batch is coalesced by path, so the last
event of a path decides; a batch is applied at most once, as its number is
kept in the manifest's folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes
from ..plans.index import Index

EVENT = "event_id long, ts timestamp, root string, path string, kind string, structural boolean, text string"
DELETES = ("deleted", "renamed_from")
MAX_WAIT_FACTOR, MAX_WAIT_MS = 10, 5000


def max_wait_ms(quiet_ms: int) -> int:
    return max(MAX_WAIT_FACTOR * quiet_ms, MAX_WAIT_MS)


def debounced(events: DataFrame, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """A stream of event groups per path, each closed once its path is quiet."""
    w = F.session_window("ts", quiet)
    return (
        events.withWatermark("ts", late)
        .groupBy("root", "path", w)
        .agg(F.bool_or("structural").alias("structural"), F.count("*").alias("n_events"), F.max_by("kind", "event_id").alias("kind"))
        .select("root", "path", F.col("session_window.start").alias("first"), "structural", "n_events", "kind")
    )


def last_events(batch: DataFrame) -> DataFrame:
    return changes.latest(batch, ["root", "path"], ["event_id"])


def apply_batch(index: Index, batch: DataFrame, reconcile: Callable[[], DataFrame] | None = None) -> dict:
    """Apply one batch; an overflow, or more changes than an update is worth, rebuilds from reconcile()."""
    final = last_events(batch.filter("kind <> 'overflow'")).persist()
    try:
        n = final.count()
        lost = batch.filter("kind = 'overflow'").limit(1).count() > 0
        if reconcile and (lost or n > changes.REBUILD_OVER):
            return index.build(reconcile())
        if not n:
            return index.manifest()
        deletes = final.filter(F.col("kind").isin(*DELETES)).select("root", "path")
        upserts = final.filter(~F.col("kind").isin(*DELETES) & F.col("text").isNotNull())
        return index.apply(upserts.select("root", "path", "text"), deletes)
    finally:
        final.unpersist()


def start(events: DataFrame, index: Index, checkpoint: str, reconcile: Callable[[], DataFrame] | None = None, **trigger):
    """Run the stream; one writer per checkpoint, and a batch that was applied before a crash isn't applied again."""

    def each(batch: DataFrame, batch_id: int) -> None:
        mark = f"{index.folder}/applied-{batch_id}"
        if index._get(mark) is None:
            apply_batch(index, batch, reconcile)
            index._put(mark, str(batch_id))

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
