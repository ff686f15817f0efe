"""Exact deduplication with keyed streaming state, DataFrame operations only.

Each text is normalised (white space deleted) and digested (SHA-256).  Digest,
stable identifier and content locator flow through a Structured Streaming
aggregation whose state never expires and lives in RocksDB on disk, under a
checkpoint in the shared folder: per digest the state retains the best row so
far (most code points, then smallest id, then first locator) and a count.  Run
again with the same ``state`` folder, the query takes up only the new rows.

A digest hit is not taken on trust: the full normalised bytes of all rows of a
digest are compared.  Equality within a digest is ``min(bytes) = max(bytes)``,
which combines before the shuffle, so a group with a third of all rows sends
one row a task.  Digests under which bytes differ are regrouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep, located, shared_path, squeezed, table, without

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Up to so many digests with hits (32 bytes each) are broadcast, so that only texts with hits are
#: compared; beyond it all texts go through the same comparison.  The result is the same.
HIT_LIMIT = 200_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def best_row() -> Column:
    """Smallest is best: most code points, then a known id, then the smallest id, then the first locator."""
    return F.min(F.struct((-F.col("n_points")).alias("less"), F.col("id").isNull().alias("unknown"), F.col("id"), F.col("locator"))).alias("best")


def retained(keyed: DataFrame, state: str) -> DataFrame:
    """Stream ``keyed`` (digest, n_points, id, locator) into the state; gives digest, best, copies."""
    spark = keyed.sparkSession
    keyed.write.mode("append").parquet(f"{state}/input")
    # a store is closed once its version is committed: nothing stays open or on a local disk after the run
    store = "spark.sql.streaming.stateStore."
    settings = {f"{store}providerClass": PROVIDER, f"{store}unloadOnCommit": "true", f"{store}rocksdb.writeBufferSizeMB": "8", f"{store}rocksdb.blockCacheSizeMB": "8"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.readStream.schema(keyed.schema).parquet(f"{state}/input")
        run = (
            rows.groupBy("digest").agg(best_row(), F.count("*").alias("copies"))
            .writeStream.outputMode("update").format("noop").trigger(availableNow=True)
            .option("checkpointLocation", f"{state}/checkpoint").start()
        )
        run.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    kept = spark.read.format("statestore").load(f"{state}/checkpoint")
    return kept.select("key.digest", F.col("value.min").alias("best"), F.col("value.count").alias("copies"))


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", state: str | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``df``: id, locator, keep_id, group_size, kept, digest.

    Null text counts as empty; empty texts are equal to each other and to texts
    of white space.  Of equal texts the row with the most code points stays,
    then the smallest id; a null id comes last.  Of rows alike in text and id,
    exactly one stays, the first by locator.  An empty table gives an empty
    table; other columns of ``df`` have no influence.  ``state``: a shared
    folder that keeps what earlier calls saw; group_size then counts their rows
    too, and keep_id may be one of theirs.
    """
    spark = df.sparkSession
    rows = located(df, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = rows.select("id", "locator", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), squeezed(F.col("text")).alias("bytes"))
    keyed = keep(texts.select(digest(F.col("bytes")).alias("digest"), "n_points", "id", "locator"), "dedup-keys")
    known = keep(retained(keyed, state or shared_path(spark, "dedup-state")), "dedup-known")

    hit = known.where("copies > 1").select("digest")
    full = texts.select(digest(F.col("bytes")).alias("digest"), "bytes")
    if hit.limit(HIT_LIMIT + 1).count() <= HIT_LIMIT:
        full = full.join(F.broadcast(hit), "digest", "left_semi")
    checked = full.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high"))
    clash = keep(checked.where("low != high").select("digest"), "dedup-clash")

    found = keyed.join(known, "digest")
    if not clash.isEmpty():
        both = texts.withColumn("digest", digest(F.col("bytes"))).join(clash, "digest", "left_semi")
        groups = both.groupBy("digest", "bytes").agg(best_row(), F.count("*").alias("copies"))
        apart = both.join(groups, ["digest", "bytes"]).select(*found.columns)
        found = found.join(clash, "digest", "left_anti").unionByName(apart)
    return found.select("id", "locator", F.col("best.id").alias("keep_id"), F.col("copies").alias("group_size"), (F.col("locator") == F.col("best.locator")).alias("kept"), "digest")


def distinct_rows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, columns as they are; rows alike in id and text stay once."""
    return without(df, lambda rows: dedup(rows, id_col=id_col, text_col=text_col).where("NOT kept").select("locator"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT doc_id, text_sha256,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM keyed)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""
