"""Index delivery: consistency, checkpoints, cache tiers, invalidation and build order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import paths


def visible(reads: DataFrame, applied: DataFrame) -> DataFrame:
    """Reads (index, txn, level) with ``ready``: a strict one waits until its index (index, applied_up_to) has applied its transaction."""
    joined = reads.join(applied.groupBy("index").agg(F.max("applied_up_to").alias("applied_up_to")), "index", "left")
    return joined.withColumn("ready", (F.col("level") != "strict") | F.coalesce(F.col("applied_up_to") >= F.col("txn"), F.lit(False)))


def resumed(log: DataFrame, stages: list[str]) -> DataFrame:
    """job, done, next: from checkpoints (job, stage), the stages done without a gap and the one to go on with (null at the end)."""
    have = log.where(F.col("stage").isin(*stages)).groupBy("job").agg(F.collect_set("stage").alias("have"))  # at most the stages
    done = F.lit(0)
    for i in range(len(stages), 0, -1):
        whole = F.size(F.array_intersect("have", F.array(*map(F.lit, stages[:i])))) == i
        done = F.when(whole & (done == 0), F.lit(i)).otherwise(done)
    return have.select("job", done.alias("done"), F.get(F.array(*map(F.lit, stages)), done).alias("next"))


def cache_tier(old_time: Column, new_time: Column, old_hash: Column, new_hash: Column) -> Column:
    """``time`` when a file's time is the same, ``hash`` when only its content is, else ``miss``."""
    return F.when(F.coalesce(old_time == new_time, F.lit(False)), "time").when(F.coalesce(old_hash == new_hash, F.lit(False)), "hash").otherwise("miss")


def build_order(changed: DataFrame, imports: DataFrame) -> DataFrame:
    """node, level of what must be built again when nodes (id) change; ``imports``: src needs dst; what is needed comes first."""
    back = paths.reach(imports, changed, None, backward=True).select("node").unionByName(changed.select(F.col("id").alias("node"))).distinct()
    inside = imports.select("src", "dst").join(back.select(F.col("node").alias("src")), "src", "left_semi").join(back.select(F.col("node").alias("dst")), "dst", "left_semi")
    level = paths.levels(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return back.join(level, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))


def frozen(writes: DataFrame, compactions: DataFrame) -> DataFrame:
    """Writes (index, seq) with ``applied_at``: one that falls into a compaction (index, first, last) waits for its end.  Compactions of an index are few and apart."""
    held = writes.join(F.broadcast(compactions.select("index", "first", "last")), "index", "left").where(F.col("first").isNull() | F.col("seq").between(F.col("first"), F.col("last")))
    ends = held.where("first IS NOT NULL").groupBy("index", "seq").agg(F.max("last").alias("last"))
    return writes.join(ends, ["index", "seq"], "left").withColumn("applied_at", F.coalesce(F.col("last") + 1, F.col("seq"))).drop("last")
