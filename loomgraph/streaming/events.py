"""Event-time operators that run on streams and on batches alike, and their streaming runs.

The engine's windows are Structured Streaming aggregations with watermarks; the
debouncers are session windows or stateful rules over gaps.  ``replay`` drives a
streaming plan over files to completion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_path


def replay(spark: SparkSession, source: DataFrame, plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Run ``plan`` over ``source`` as a stream until its end and read the result.

    Append output goes to a file sink; other modes to the state of the last batch.
    """
    path = shared_path(spark, "replay")
    source.write.parquet(f"{path}/in")
    stream = plan(spark.readStream.schema(source.schema).parquet(f"{path}/in"))
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode("append").option("path", f"{path}/out").start().awaitTermination()
    else:
        schema_holder: list[DataFrame] = []

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")
            schema_holder.append(batch)

        writer.outputMode(mode).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def tumbling(events: DataFrame, size: str, *keys: str, watermark: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", watermark) if watermark else events
    return e.groupBy(F.window("ts", size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, size: str, slide: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window("ts", size, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def leading_debounce(events: DataFrame, gap_seconds: float, key: str = "path") -> DataFrame:
    """The first event of a key fires; those within the gap of the one before are dropped and extend it."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > gap_seconds * 1e6)).drop("_gap")


def trailing_debounce(events: DataFrame, quiet: str, most_seconds: float, key: str = "path") -> DataFrame:
    """Last event of each quiet-period session, sessions cut every ``most_seconds`` from their start."""
    quiet_us = F.lit(float(quiet.split()[0]) * 1e6)
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > quiet_us).cast("int"), F.lit(1))
    s = events.withColumn("_s", F.sum(new).over(w))
    start = F.min("ts").over(Window.partitionBy(key, "_s"))
    s = s.withColumn("_part", F.floor((F.unix_micros("ts") - F.unix_micros(start)) / (most_seconds * 1e6)))
    return s.groupBy(key, "_s", "_part").agg(F.max_by("op", F.struct("ts", "event_id")).alias("op"), F.max("ts").alias("ts"), F.count("*").alias("n")).drop("_s", "_part")


def rate_limited(events: DataFrame, most: int, seconds: float, key: str = "path") -> DataFrame:
    """Events with fewer than ``most`` of their key in the window before them."""
    w = Window.partitionBy(key).orderBy(F.unix_micros("ts")).rangeBetween(int(-seconds * 1e6), -1)
    return events.withColumn("_n", F.count("*").over(w)).where(F.col("_n") < most).drop("_n")


def deduplicated(events: DataFrame, keys: list[str], watermark: str) -> DataFrame:
    """First event of each key within the watermark; state expires with it."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def joined(left: DataFrame, right: DataFrame, key: str, within: str) -> DataFrame:
    """Stream-stream join: right events of the same key at most ``within`` after the left one; both sides are bounded by watermarks."""
    a = left.withWatermark("ts", within).alias("a")
    b = right.withWatermark("ts", within).alias("b")
    return a.join(b, F.expr(f"a.{key} = b.{key} AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {within}"))


def converted(op: Column, exists: Column) -> Column:
    """Raw watcher events: create, data changes, removals; anything else by whether the file exists; metadata is nothing."""
    return F.when(op == "create", "created").when(op == "modify_data", "modified").when(op == "remove", "deleted").when(op == "metadata", None).otherwise(F.when(exists, "modified").otherwise("deleted"))


def job_state(log: DataFrame, most_retries: int = 3) -> DataFrame:
    """job, state, tries of a job log (job, seq, event): queued, running, completed, failed (retried up to a bound), cancelled."""
    def step(s, e):
        state = F.when(s["state"].isin("completed", "cancelled"), s["state"]).when(e == "start", F.when(s["tries"] <= most_retries, "running").otherwise("failed")).when(e == "complete", "completed").when(e == "fail", "failed").when(e == "cancel", "cancelled").otherwise(s["state"])
        return F.struct(state.alias("state"), (s["tries"] + (e == "start").cast("int")).alias("tries"))

    one = log.groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda x: x["event"]).alias("events"))  # one job's life
    out = one.select("job", F.aggregate("events", F.struct(F.lit("queued").alias("state"), F.lit(0).alias("tries")), step).alias("s"))
    return out.select("job", "s.state", "s.tries")


def breaker(calls: DataFrame, most: int = 5, rate: float = 0.5, window: int = 20, key: str = "service") -> DataFrame:
    """Each call (service, seq, ok) with ``open``: the last ``most`` all failed, or a half of the last ``window`` did."""
    w = Window.partitionBy(key).orderBy("seq")
    bad = (~F.col("ok")).cast("int")
    last = F.sum(bad).over(w.rowsBetween(-(most - 1), 0))
    n, fails = F.count("*").over(w.rowsBetween(-(window - 1), 0)), F.sum(bad).over(w.rowsBetween(-(window - 1), 0))
    return calls.withColumn("open", (last >= most) | ((n >= window) & (fails / n >= rate)))


def batches(rows: DataFrame, size: int, order: str = "ts") -> DataFrame:
    """Unprocessed feedback dealt to batches of ``size`` in order of a range sort (approximate batches by partition, exact sizes inside)."""
    by = Window.partitionBy(F.spark_partition_id()).orderBy(order)
    ordered = rows.repartitionByRange(order).sortWithinPartitions(order)
    return ordered.withColumn("part", F.spark_partition_id()).withColumn("batch", F.floor((F.row_number().over(by) - 1) / size))
