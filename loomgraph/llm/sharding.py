"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A stable integer key and the number of shards decide a row's shard; no ring
table exists.  When shards are appended, a row either stays or moves into a new
shard, and only the necessary fraction moves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import keep, table

#: The multiplier of the published linear congruential step.
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to ``shards`` - 1, of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        key[live] = key[live] * STEP + np.uint64(1)
        ahead = ((at[live] + 1).astype(np.float64) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        inside = ahead < shards
        live = live[inside]
        at[live] = ahead[inside]
    return at


def assign(df: DataFrame, key_col: str, shards: int, grown: int | None = None) -> DataFrame:
    """``df`` with int columns ``shard`` and, for ``grown`` shards, ``grown_shard``.

    ``key_col``: an integer column; null counts as key 0, so such rows stay
    together.  Repeated keys share a shard.  Columns of ``df`` that are already
    named ``shard`` or ``grown_shard`` are replaced.  An empty table gives an
    empty table.
    """
    names = [c for c in df.columns if c not in ("shard", "grown_shard")]
    kept = df.select(*[F.col(f"`{c}`") for c in names])
    new = ["shard", "grown_shard"] if grown else ["shard"]
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.IntegerType()) for c in new]])
    place = names.index(key_col)

    def run(batches):
        for batch in batches:
            raw = batch.column(place).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            out = [*batch.columns, pa.array(jump(raw, shards).astype(np.int32))]
            if grown:
                out.append(pa.array(jump(raw, grown).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return kept.mapInArrow(run, schema)


#: Rows of a shard are numbered by blocks of a hashed key, so that no task sees a whole shard.
BLOCK_BITS = 12


def slots(df: DataFrame, key_cols: list[str], shard_col: str = "shard") -> DataFrame:
    """``df`` with ``slot``: 0, 1, 2 ... within each shard, without gaps.

    The order is that of a hash of ``key_cols``, then those columns.  Counts of
    the blocks of the hash are summed first (map-side), their running totals
    give each block's first slot, and only the rows within a block are sorted
    together.  Rows alike in ``key_cols`` get distinct slots in any order.
    ``df`` is read twice, so it should be a written table.
    """
    mark = F.xxhash64(*[F.col(c) for c in key_cols])
    df = df.withColumn("_mark", mark).withColumn("_block", F.shiftrightunsigned("_mark", 64 - BLOCK_BITS))
    counts = df.groupBy(shard_col, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard_col).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col(shard_col).alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(shard_col, "_block").orderBy("_mark", *key_cols))
    ranked = df.withColumn("_rank", rank.cast("long"))
    joined = ranked.join(firsts, (F.col(shard_col) == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("slot", F.col("_first") + F.col("_rank") - 1).drop("_mark", "_block", "_rank", "_s", "_b", "_first")


def op10_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """All documents in ``shards`` shards by doc_id (law ``key``), with their shard among one more.

    Null text has size 1 and the checksum of no bytes; a null doc_id counts as
    key 0; rows that repeat a doc_id share a shard and have slots of their own.
    """
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = keep(assign(sized, "doc_id", shards, shards + 1), "sharding")
    out = slots(placed, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
