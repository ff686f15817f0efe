"""Incremental change: deltas, tombstones, change sets, index logs, strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_delta(base: DataFrame, delta: DataFrame, tombstones: DataFrame, key: str = "file") -> DataFrame:
    """Delta rows, then base rows of files that are neither in the delta nor deleted."""
    touched = delta.select(key).distinct().unionByName(tombstones.select(key).distinct())
    return delta.unionByName(base.join(touched, key, "left_anti").select(*delta.columns))


def latest(log: DataFrame, key: str = "key", order: str = "seq", op: str = "op") -> DataFrame:
    """The state after a log of add, update and remove operations: the last operation of each key counts."""
    last = log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    return last.where(F.col(op) != "remove")


def change_set(log: DataFrame, key: str = "key", order: str = "seq", op: str = "op") -> DataFrame:
    """key, change since the log began: added, removed or modified; what was added and removed again is nothing."""
    g = log.groupBy(key).agg(F.min_by(op, order).alias("first"), F.max_by(op, order).alias("last"))
    change = F.when((F.col("first") == "add") & (F.col("last") == "remove"), None).when(F.col("first") == "add", "added").when(F.col("last") == "remove", "removed").otherwise("modified")
    return g.select(key, change.alias("change")).where("change is not null")


def without_nodes(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges whose ends both remain."""
    gone = removed.select(F.col("id").alias("_id")).distinct()
    return edges.join(gone, F.col("src") == F.col("_id"), "left_anti").join(gone, F.col("dst") == F.col("_id"), "left_anti")


def moved_as_pairs(changes: DataFrame) -> DataFrame:
    """A move is a deletion of its source and a creation of its destination (columns path, op, dest)."""
    moved = changes.where("op = 'moved'")
    rest = changes.where("op != 'moved'").select("path", "op")
    return rest.unionByName(moved.select("path", F.lit("deleted").alias("op"))).unionByName(moved.select(F.col("dest").alias("path"), F.lit("created").alias("op")))


def classified(added: DataFrame, deleted: DataFrame, renamed: DataFrame) -> DataFrame:
    """path, change: renames leave the added and deleted sets (renamed: old_path, path)."""
    a = added.select("path").join(renamed.select("path"), "path", "left_anti").withColumn("change", F.lit("added"))
    d = deleted.select("path").join(renamed.select(F.col("old_path").alias("path")), "path", "left_anti").withColumn("change", F.lit("deleted"))
    return a.unionByName(d).unionByName(renamed.select("path").withColumn("change", F.lit("renamed")))


def update_strategy(affected: Column, total: Column) -> Column:
    """skip under 0.1 % affected, rebuild over 50 %, sync under 1 %, else async."""
    ratio = affected / total
    return F.when(ratio < 0.001, "skip").when(ratio > 0.5, "rebuild").when(ratio < 0.01, "sync").otherwise("async")


def stale(age_minutes: Column, indexed_commit: Column, head: Column, allow_mismatch: bool = False) -> Column:
    """Older than an hour, or of another commit unless that is allowed."""
    return (age_minutes > 60) | (F.lit(not allow_mismatch) & (indexed_commit != head))


def soft_delete(chunks: DataFrame, file: str, snapshot: str) -> DataFrame:
    return chunks.withColumn("is_deleted", F.col("is_deleted") | ((F.col("file_path") == file) & (F.col("snapshot_id") == snapshot)))


def replace_file(chunks: DataFrame, new: DataFrame, file: str, snapshot: str) -> DataFrame:
    """Soft-delete a file's chunks of a snapshot, then add the new ones."""
    return soft_delete(chunks, file, snapshot).unionByName(new)


def needs_indexing(requests: DataFrame, seen: DataFrame, key: list[str], ttl_hours: int = 24) -> DataFrame:
    """Requests not seen under the same key in the last hours (both have column ts)."""
    s = seen.select(*key, F.col("ts").alias("_seen"))
    recent = requests.join(s, key).where(F.col("_seen") >= F.col("ts") - F.make_interval(hours=F.lit(ttl_hours))).select(*key).distinct()
    return requests.join(recent, key, "left_anti")


def changed_part(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Which of signature, body, doc and format changed, the first that differs; ``none`` if nothing did."""
    out = F.lit("none")
    for part in ("format", "doc", "body", "signature"):
        out = F.when(~old[part].eqNullSafe(new[part]), F.lit(part)).otherwise(out)
    return out


def session_delta(ops: DataFrame) -> DataFrame:
    """Net operations of each transaction: add then remove cancels, the last of an element counts (txn, key, op, seq)."""
    g = ops.groupBy("txn", "key").agg(F.min_by("op", "seq").alias("first"), F.max_by("op", "seq").alias("last"))
    return g.where(~((F.col("first") == "add") & (F.col("last") == "remove"))).select("txn", "key", F.col("last").alias("op"))


def conflicts(deltas: DataFrame) -> DataFrame:
    """Keys that more than one open transaction changes."""
    return deltas.groupBy("key").agg(F.countDistinct("txn").alias("txns")).where("txns > 1")


def consistency(counts: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """index, documents, consistent: within the tolerance of the largest index."""
    top = counts.agg(F.max("documents").alias("_top"))
    return counts.crossJoin(F.broadcast(top)).select("index", "documents", ((F.col("_top") - F.col("documents")) / F.col("_top") <= tolerance).alias("consistent"))
