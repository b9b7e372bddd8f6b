"""Change detection: snapshots, ledgers, directory hashes, trust, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import directory
from ..plans.storage import ranked

TICKS_PER_SECOND = 10_000_000
LOCAL_MARGIN, NETWORK_MARGIN, SETTLE_MARGIN = 3 * TICKS_PER_SECOND, 3600 * TICKS_PER_SECOND, 3 * TICKS_PER_SECOND
UNIX_TICKS = 621_355_968_000_000_000
BINARY_HASH = "F" * 32
REBUILD_OVER = 2000
COMPACT_AT = 64
FOLD_PART, FOLD_LEAST, FOLD_MOST = 32, 1024, 50_000


def snapshot_diff(old: DataFrame, new: DataFrame, keep_same: bool = False) -> DataFrame:
    """(path, change): added, removed, modified, and same if wanted, from two tables of (path, content_hash)."""
    joined = old.select("path", F.col("content_hash").alias("_o")).join(new.select("path", F.col("content_hash").alias("_n")), "path", "full_outer")
    change = (
        F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified").otherwise("same")
    )
    out = joined.select("path", change.alias("change"))
    return out if keep_same else out.filter("change <> 'same'")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def needs_rebuild(n_changes: Column) -> Column:
    return n_changes > REBUILD_OVER


def merge_ledger(base: DataFrame, overlay: DataFrame, removed: DataFrame) -> DataFrame:
    """Base without what the overlay replaces or the removals drop, and the overlay."""
    gone = overlay.select("path").unionByName(removed.select("path")).distinct()
    return base.join(gone, "path", "left_anti").unionByName(overlay)


def fold_due(n_overlay: Column, n_base: Column) -> Column:
    """Is an overlay so large that it's folded into a new base: a 32nd of it, between a least and a greatest count?"""
    return n_overlay >= F.least(F.lit(FOLD_MOST), F.greatest(F.lit(FOLD_LEAST), F.floor(n_base / FOLD_PART)))


def entries(ledger: DataFrame, path: str | None = None, prefix: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """A ledger's entries: one path, those below a prefix, those from first up to but without last, or all; every filter reaches the scan."""
    c = F.col("path")
    for value, test in ((path, c == F.lit(path)), (prefix, c.startswith(prefix or "")), (first, c >= F.lit(first)), (last, c < F.lit(last))):
        if value is not None:
            ledger = ledger.filter(test)
    return ledger


def unseen(ledger: DataFrame, seen: DataFrame) -> DataFrame:
    return ledger.select("path").join(seen.select("path"), "path", "left_anti")


def case_collisions(files: DataFrame) -> DataFrame:
    """Spellings of one path that differ in case only: (folded, spellings, n)."""
    out = files.select("path").distinct().groupBy(F.lower("path").alias("folded"))
    return out.agg(F.array_sort(F.collect_list("path")).alias("spellings"), F.count("*").alias("n")).filter("n > 1")


def directory_hashes(files: DataFrame, depth: int | None = None) -> DataFrame:
    """(dir, hash): SHA-256 over the sorted children, bottom-up, one aggregate per level of depth."""
    parts = files.select("path", "content_hash", directory(F.col("path")).alias("dir"))
    level = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    parts = parts.withColumn("level", level)
    deepest = depth if depth is not None else (parts.agg(F.max("level")).first()[0] or 0)
    name = F.substring_index("path", "/", -1)
    entry = F.concat(F.lit("F"), name, F.lit(":"), F.col("content_hash"), F.lit("\n"))
    # directories stand before files, both by name, as 'D' sorts before 'F'
    children = parts.select("dir", "level", F.lit("D/F").substr(3, 1).alias("kind"), name.alias("name"), entry.alias("entry"))
    done = None
    for at in range(deepest, -1, -1):
        here = children.filter(F.col("level") == at).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("kind", "name", "entry"))).alias("c"))
        here = here.select("dir", F.upper(F.sha2(F.array_join(F.transform("c", lambda x: x["entry"]), ""), 256)).alias("hash"))
        done = here if done is None else done.unionByName(here)
        if at:
            up = here.select(
                directory(F.col("dir")).alias("dir"),
                F.lit(at - 1).alias("level"),
                F.lit("D").alias("kind"),
                F.substring_index("dir", "/", -1).alias("name"),
                F.concat(F.lit("D"), F.substring_index("dir", "/", -1), F.lit(":"), F.col("hash"), F.lit("\n")).alias("entry"),
            )
            children = children.unionByName(up)
    return done


def changed_directories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Directories whose hashes differ; files of others need no look."""
    joined = old.select("dir", F.col("hash").alias("_o")).join(new.select("dir", F.col("hash").alias("_n")), "dir", "full_outer")
    return joined.filter(~F.col("_o").eqNullSafe(F.col("_n"))).select("dir")


def ticks(ts: Column) -> Column:
    """A timestamp as 100 ns ticks since the year 1."""
    return F.unix_micros(ts.cast("timestamp")) * 10 + F.lit(UNIX_TICKS)


def from_ticks(t: Column) -> Column:
    return F.timestamp_micros(((t - F.lit(UNIX_TICKS)) / 10).cast("long"))


def matches_listing(size: Column, mtime: Column, hashed_at: Column, listed_size: Column, listed_mtime: Column, recorded_by: Column, network: bool = False) -> Column:
    """May the ledger entry stand for the file's content?"""
    margin = NETWORK_MARGIN if network else LOCAL_MARGIN
    same = (mtime > 0) & (size == listed_size) & (mtime == listed_mtime)
    return same & ((hashed_at > 0) | ((recorded_by > 0) & (mtime <= recorded_by - F.lit(margin))))


def recorded_mtime(mtime: Column, ctime: Column, read_start: Column, prior_mtime: Column, prior_size: Column, prior_ctime: Column, prior_anchor: Column, size: Column, network: bool = False) -> Column:
    """The time to record for a file just read: itself if settled, negated while pending, 0 if unknown."""
    margin = NETWORK_MARGIN if network else LOCAL_MARGIN
    second = (prior_mtime == -mtime) & (prior_size == size) & (prior_ctime == ctime) & (prior_anchor > 0) & (read_start >= prior_anchor + F.lit(SETTLE_MARGIN))
    return (
        F.when(mtime <= 0, F.lit(0))
        .when(F.greatest(mtime, ctime) <= read_start - F.lit(margin), mtime)
        .when(F.coalesce(second, F.lit(False)), mtime)
        .otherwise(-mtime)
        .cast("long")
    )


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest values of order; partial results come before the shuffle, so a hot key is one row a task."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(last.alias("_last")).select("_last.*")


def live(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(tombstones, keys, "left_anti")


def coalesce_events(events: DataFrame) -> DataFrame:
    """One row per path and batch, structural if any of its events is."""
    return events.groupBy("batch_id", "path").agg(F.bool_or("structural").alias("structural"), F.count("*").alias("n_events"))


def quiet_batches(events: DataFrame, key: str, gap: str, max_wait_ms: int | None = None) -> DataFrame:
    """Debounce: events of a key belong together until none comes for the gap; a group that lasts longer than max_wait_ms is cut there."""
    w = F.session_window("ts", gap)
    groups = events.groupBy(key, w).agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    if max_wait_ms is None:
        return groups.drop("session_window")
    spans = groups.select(F.col(key).alias("_key"), F.col("first_ts").alias("_from"), F.col("last_ts").alias("_to"))
    held = events.join(spans, (F.col(key) == F.col("_key")) & (F.col("ts") >= F.col("_from")) & (F.col("ts") <= F.col("_to")))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = F.floor((micros("ts") - micros("_from")) / (max_wait_ms * 1000))
    cut = held.groupBy(key, "_from", part.alias("_part")).agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return cut.drop("_from", "_part")


BATCH_CAP = 50_000


def capped_batches(events: DataFrame, order: list[str], cap: int = BATCH_CAP) -> DataFrame:
    """Add batch_no: at most cap events a batch, in order; a full batch goes at once."""
    return ranked(events, order, "_r").withColumn("batch_no", F.floor(F.col("_r") / cap).cast("long")).drop("_r")


def next_batch(batch: DataFrame, held: DataFrame) -> DataFrame:
    """Paths of a batch and those held back from earlier ones, each once."""
    return batch.select("path").unionByName(held.select("path")).distinct()


def held_back(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Paths that got no answer (absent, or a null listing): they are asked again with the next batch and never taken for deleted."""
    known = answers.filter(F.col("listed").isNotNull()).select("path")
    return asked.select("path").distinct().join(known, "path", "left_anti")
