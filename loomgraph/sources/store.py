"""Stores and sinks: chunk store, node and edge payloads, findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, incremental
from ..schema import CHUNK, DEPENDENCY


def write_payload(nodes: DataFrame, edges: DataFrame, folder: str, files: int = 8) -> None:
    """Nodes by (file_path, kind, start, end, local_seq), edges by (source_id, target_id, kind, local_seq): range-partitioned and sorted, so files prune."""
    n = ["file_path", "kind", "span.start_line", "span.end_line", "local_seq"]
    e = ["source_id", "target_id", "kind", "local_seq"]
    nodes.repartitionByRange(files, *n).sortWithinPartitions(*n).write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.repartitionByRange(files, *e).sortWithinPartitions(*e).write.mode("overwrite").parquet(f"{folder}/edges")


def file_summary(spark: SparkSession, folder: str) -> DataFrame:
    """file_path, nodes, kinds: only the columns needed are read."""
    return spark.read.parquet(f"{folder}/nodes").groupBy("file_path").agg(F.count("*").alias("nodes"), F.countDistinct("kind").alias("kinds"))


def file_nodes(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """One file's nodes: the filter reaches the scan and sorted files are skipped by their statistics."""
    return spark.read.parquet(f"{folder}/nodes").where(F.col("file_path") == path)


def import_edges(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/edges").where("kind = 'IMPORTS'").select("source_id", "target_id")


@dataclass(frozen=True)
class ChunkFilter:
    """Optional conditions, ANDed; deleted chunks are hidden by default."""

    repo_id: str | None = None
    snapshot_id: str | None = None
    path_like: str | None = None
    kind: str | None = None
    visibility: str | None = None
    least_importance: float | None = None
    include_deleted: bool = False
    limit: int | None = 1000

    def column(self) -> Column:
        out = F.lit(True)
        for name in ("repo_id", "snapshot_id", "kind", "visibility"):
            if (value := getattr(self, name)) is not None:
                out = out & (F.col(name) == value)
        if self.path_like is not None:
            out = out & F.col("file_path").like(self.path_like)
        if self.least_importance is not None:
            out = out & (F.col("importance") >= self.least_importance)
        return out if self.include_deleted else out & ~F.col("is_deleted")


class ChunkStore:
    """Chunks and dependencies as Parquet tables partitioned by snapshot; every answer is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name, schema):
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:  # a store without that table yet is empty
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNK)

    def dependencies(self) -> DataFrame:
        return self._read("dependencies", DEPENDENCY)

    def save(self, chunks: DataFrame) -> None:
        chunks.write.mode("append").partitionBy("snapshot_id").parquet(f"{self.folder}/chunks")

    def save_dependencies(self, deps: DataFrame) -> None:
        deps.dropDuplicates(["from_chunk_id", "to_chunk_id", "relationship"]).write.mode("append").parquet(f"{self.folder}/dependencies")

    def find(self, f: ChunkFilter) -> DataFrame:
        found = self.chunks().where(f.column()).orderBy("chunk_id")
        return found if f.limit is None else found.limit(f.limit)

    def get(self, chunk_id: str) -> DataFrame:
        return self.chunks().where(F.col("chunk_id") == chunk_id)

    def count(self, repo_id: str, snapshot_id: str) -> int:
        return self.chunks().where(ChunkFilter(repo_id, snapshot_id).column()).count()

    def stats(self) -> DataFrame:
        c = self.chunks()
        deps = self.dependencies().agg(F.count("*").alias("dependencies"))
        return c.agg(F.countDistinct("repo_id").alias("repositories"), F.countDistinct("snapshot_id").alias("snapshots"), F.sum((~F.col("is_deleted")).cast("int")).alias("chunks")).crossJoin(F.broadcast(deps))

    def replaced(self, file: str, snapshot: str, new: DataFrame) -> DataFrame:
        return incremental.replace_file(self.chunks(), new, file, snapshot)

    def compare(self, a: str, b: str) -> DataFrame:
        one = lambda s: self.chunks().where((F.col("snapshot_id") == s) & ~F.col("is_deleted"))
        return history.compare_snapshots(one(a), one(b))


def sarif(findings: DataFrame, tool: str = "loomgraph") -> DataFrame:
    """One JSON text: findings (rule_id, message, level, path, line) as SARIF results, one row a finding plus the frame."""
    result = F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), F.col("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    ))
    return findings.select(F.lit(tool).alias("tool"), "rule_id", "path", "line", result.alias("result"))
