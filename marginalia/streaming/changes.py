"""File changes: filter, tumbling windows, renames, reconciliation, upserts; batch functions and their streaming form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from marginalia.sources.vault import is_noise, pruned

OPS = ("create", "write", "remove", "rename")
WINDOW = "250 milliseconds"


def judged(events: DataFrame, root: str = "") -> DataFrame:
    """Events with dropped: null, or why an event counts for nothing (chmod, outside_vault, excluded, unknown_op).

    op may name several operations, as 'create|write'; the first of create, write, remove, rename counts.
    """
    op = F.lower("op")
    first = F.coalesce(*[F.when(F.array_contains(F.split(op, r"\|"), o), o) for o in OPS])
    why = F.when(op == "chmod", "chmod").when(~F.col("path").startswith(root) | F.exists(F.split("path", "/"), lambda p: p == ".."), "outside_vault").when(pruned(F.col("path")) | is_noise(F.col("path")), "excluded").when(first.isNull(), "unknown_op")
    return events.withColumns({"dropped": why, "op": F.coalesce(first, op)})


def drop_counts(events: DataFrame, root: str = "") -> DataFrame:
    """(dropped, count); the events that stay are counted under 'active'."""
    return judged(events, root).groupBy(F.coalesce("dropped", F.lit("active")).alias("dropped")).agg(F.count("*").alias("count"))


def debounced(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """(window_start, path, events, coalesced): each changed path once for each tumbling window."""
    rows = judged(events).where("dropped IS NULL")
    return rows.groupBy(F.window("ts", window).alias("w"), "path").agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), "path", "events", (F.col("events") - 1).alias("coalesced"))


def renames(before: DataFrame, after: DataFrame) -> DataFrame:
    """(from, to) of notes that went and came with the same content; only where just one went and one came with it.

    before, after: (path, size, hash). Empty notes are never matched.
    """
    gone = before.where("size > 0").join(after.select("path"), "path", "left_anti").select("hash", F.col("path").alias("from"))
    new = after.where("size > 0").join(before.select("path"), "path", "left_anti").select("hash", F.col("path").alias("to"))
    one = gone.groupBy("hash").agg(F.count("*").alias("n"), F.min("from").alias("from")).where("n = 1")
    other = new.groupBy("hash").agg(F.count("*").alias("m"), F.min("to").alias("to")).where("m = 1")
    return one.join(other, "hash").select("from", "to")


def reconcile(index: DataFrame, disk: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """(path, action): upsert what is new, of another mtime or size, or missing from indexed; delete what is no more on disk."""
    a = index.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.lit(True).alias("known"))
    both = disk.select("path", "mtime", "size", F.lit(True).alias("there")).join(a, "path", "full")
    stale = F.col("known").isNull() | ~F.col("mtime").eqNullSafe(F.col("m")) | ~F.col("size").eqNullSafe(F.col("s"))
    if indexed is not None:
        both = both.join(indexed.select("path", F.lit(True).alias("in_text")), "path", "left")
        stale = stale | F.col("in_text").isNull()
    return both.withColumn("action", F.when(F.col("there").isNull(), "delete").when(stale, "upsert")).where("action IS NOT NULL").select("path", "action")


def applied(notes: DataFrame, batch: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, action) for the paths of a batch: renamed ones first, then remove, skip (same mtime and size) or replace.

    notes: (path, size, mtime, hash) as indexed; disk: the same of the files that are there.
    """
    touched = batch.select("path").distinct()
    old, new = notes.join(touched, "path", "left_semi"), disk.join(touched, "path", "left_semi")
    pairs = renames(old, new)
    moves = pairs.select(F.col("from").alias("path"), F.lit("rename").alias("action"), F.col("to"))
    used = pairs.select(F.explode(F.array("from", "to")).alias("path"))
    both = touched.join(used, "path", "left_anti").join(old.select("path", F.col("size").alias("s"), F.col("mtime").alias("m"), F.lit(True).alias("known")), "path", "left").join(new.select("path", "size", "mtime", F.lit(True).alias("there")), "path", "left")
    same = F.col("known") & F.col("there") & F.col("size").eqNullSafe(F.col("s")) & F.col("mtime").eqNullSafe(F.col("m"))
    action = F.when(F.col("there").isNull(), F.when(F.col("known"), "remove").otherwise("none")).when(same, "skip").otherwise("replace")
    rest = both.select("path", action.alias("action"), F.lit(None).cast("string").alias("to")).where("action <> 'none'")
    return moves.unionByName(rest)


def moved_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links whose notes were renamed, under the new paths; pairs: (from, to)."""
    return links.join(pairs.select(F.col("from").alias("from_path"), "to"), "from_path", "left").withColumn("from_path", F.coalesce("to", "from_path")).drop("to").select(*links.columns)


def changed_paths(stream: DataFrame, window: str = WINDOW, late: str = WINDOW) -> DataFrame:
    """debounced() over a stream; a window is given once the watermark has passed it."""
    return debounced(stream.withWatermark("ts", late), window)


OVERFLOW = "overflow"


def overflows(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """(window_start, overflows, reconciles): however many events say that others were lost, a window has one reconciliation."""
    return events.where(F.lower("op") == OVERFLOW).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("overflows")).select(F.col("w.start").alias("window_start"), "overflows", F.lit(1).cast("long").alias("reconciles"))


def scanned(events: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, op): 'create' for each file that lies, at any depth, in a folder that an event says was created.

    Such files may have come before the folder was watched. disk: the path of every file.
    """
    created = judged(events).where("dropped IS NULL AND op = 'create'").select("path").distinct()
    names = F.split("path", "/")
    above = F.when(F.size(names) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), lambda n: F.array_join(F.slice(names, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    inside = disk.where(~pruned(F.col("path")) & ~is_noise(F.col("path"))).select("path", F.explode(above).alias("folder")).join(created.select(F.col("path").alias("folder")), "folder", "left_semi")
    return inside.select("path", F.lit("create").alias("op")).distinct()


def actions(events: DataFrame, index: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, action, to) for the events of one batch: applied() to the changed paths and those in new folders; where events were lost, reconcile() over everything, once."""
    if not events.where(F.lower("op") == OVERFLOW).isEmpty():
        return reconcile(index, disk).select("path", "action", F.lit(None).cast("string").alias("to"))
    touched = judged(events).where("dropped IS NULL").select("path").unionByName(scanned(events, disk).select("path"))
    return applied(index, touched, disk)


def watch(stream: DataFrame, disk: Callable[[], DataFrame], index: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, window: str = WINDOW) -> StreamingQuery:
    """Starts a query that gives what to do about each window's changes, as actions() judges them, to apply(actions, batch_id).

    A window is what arrived since the last tick, each path once, so none waits for later events; close()
    gives the last one. disk, index: called for each batch. apply must be idempotent for a batch_id, since a
    batch is repeated after a failure.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        try:
            apply(actions(rows, index(), disk()), batch_id)
        finally:
            rows.unpersist()

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=window).foreachBatch(batch).start()


def close(query: StreamingQuery) -> None:
    """Ends a query of watch() after all that has arrived was given to apply."""
    query.processAllAvailable()
    query.stop()


def last_state(events: DataFrame) -> DataFrame:
    """(path, op, ts): the latest event of each path; of several at one time that of the largest event_id, where there is one, then of the last op in order."""
    ties = [F.desc("event_id")] if "event_id" in events.columns else []
    by = Window.partitionBy("path").orderBy(F.desc("ts"), *ties, F.desc("op"))
    return events.withColumn("rank", F.row_number().over(by)).where("rank = 1").select("path", "op", "ts")
