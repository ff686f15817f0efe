"""Folders that every executor and the driver can reach.

Intermediate tables that cut lineage or are read more than once are written to
the folder the cluster names in ``spark.checkpoint.dir``; a lost executor then
costs a re-read, never a recomputation of everything before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..storage import discard, shared_path, tidy

__all__ = ["SPACES", "discard", "keep", "located", "locator", "shared_path", "small_batches", "squeezed", "table", "tidy", "without"]

#: White space of the text contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


#: Rows and bytes of an Arrow batch.  Texts are long: at the default of 10,000 rows or 64 MB a batch of whole texts takes
#: tens of MB in the executor and in its Python worker, several times over.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def small_batches(spark: SparkSession) -> None:
    for name, (default, small) in BATCHES.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, small)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    small_batches(df.sparkSession)
    return storage.keep(df, label)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(text):
    """``text`` (a Column) without the six white-space characters; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def locator(df: DataFrame) -> Column:
    """File and row of each row of ``df``, which was read from files."""
    place = df.metadataColumn("_metadata")
    return F.concat_ws("#", place["file_path"], F.lpad(place["row_index"].cast("string"), 12, "0")).alias("locator")


def located(df: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` and the locator of each row; rows that are in no file are written first."""
    try:
        return df.select(*columns, locator(df))
    except AnalysisException:
        written = keep(df.select(*columns), "located")
        return written.select("*", locator(written))


def without(df: DataFrame, gone: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df``, columns as they are, without the rows whose locators ``gone`` gives (one column) for it."""
    name = "locator"
    while name in df.columns or f"{name}_gone" in df.columns:
        name = f"_{name}"
    try:
        whole = df.select("*", locator(df).alias(name))
    except AnalysisException:
        df = keep(df, "located")
        whole = df.select("*", locator(df).alias(name))
    left = gone(df).toDF(f"{name}_gone")
    return whole.join(left, F.col(f"`{name}`") == F.col(f"`{name}_gone`"), "left_anti").drop(name)
