"""Tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a session on one machine that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("loomgraph.shared.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a cluster names the folder that all its machines share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("loomgraph.shared.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{base_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


#: Bytes, as the planner sees them, of a table that one task gets; cut into rows and keys it takes a few hundred times as many in memory.
PART = 1 << 18


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt by columns to as many tasks as its size asks for, so that a task's share does not grow with the table.

    Adaptive execution merges shuffled rows up to a size in compressed bytes, which
    says little of what sorting or grouping them takes.  Where the planner does not
    know the size, it stays with the number of partitions that is set.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 46:
        return df.repartition(*columns)
    return df.repartition(min(4096, max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART))), *columns)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there, and executors may be lost."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``keep`` wrote for tables that no later step reads."""
    for t in tables:
        path = t.__dict__.get("_stored_at") if t is not None else None
        if path:
            spark = t.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
