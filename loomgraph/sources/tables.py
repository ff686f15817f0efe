"""Logical tables over the given Parquet tables, with their DuckDB text.

Column pruning and predicates reach the scans: each logical table is a plain
projection or union, nothing is collected or cached.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # event time must be an instant for watermarks; the tables store wall-clock times in UTC
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, file_path, metadata, value."""

    def part(table, key, kind, name, path, metadata, value):
        df = read(spark, sf_dir, table)
        return df.select(F.concat(F.lit(f"{key}:"), F.col(df.columns[0]).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.expr(name).alias("name"), F.expr(path).alias("file_path"), F.expr(metadata).alias("metadata"), F.expr(value).alias("value"))

    null = "cast(null as string)"
    return _union([
        part("customer", "c", "customer", "c_name", "c_mktsegment", "cast(cast(floor(c_acctbal) as bigint) as string)", "c_acctbal"),
        part("orders", "o", "order", "o_orderstatus", "o_orderpriority", "o_orderstatus", "o_totalprice"),
        part("part", "p", "part", "p_name", "p_brand", "cast(p_size as string)", "p_retailprice"),
        part("supplier", "s", "supplier", "s_name", null, "cast(cast(floor(s_acctbal) as bigint) as string)", "s_acctbal"),
        part("nation", "n", "nation", "n_name", null, null, "cast(null as double)"),
        part("region", "r", "region", "r_name", null, null, "cast(null as double)"),
    ])


NODES = """nodes AS (
  SELECT 'c:' || c_custkey AS id, 'customer' AS kind, c_name AS name, c_mktsegment AS file_path, floor(c_acctbal)::BIGINT::VARCHAR AS metadata, c_acctbal AS value FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, 'order', o_orderstatus, o_orderpriority, o_orderstatus, o_totalprice FROM orders
  UNION ALL SELECT 'p:' || p_partkey, 'part', p_name, p_brand, p_size::VARCHAR, p_retailprice FROM part
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name, NULL, floor(s_acctbal)::BIGINT::VARCHAR, s_acctbal FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'region', r_name, NULL, NULL, NULL FROM region)"""


def edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """src, dst, kind: the foreign keys as a property graph.

    With ``repeats`` an edge comes once for each row that has it.  Closures and
    least costs are the same then, and no task has to hold edges to tell them apart.
    """
    o, c, s, n, li = (read(spark, sf_dir, t) for t in ("orders", "customer", "supplier", "nation", "lineitem"))

    def once(*keys):
        return li.select(*keys) if repeats else dealt(li.select(*keys), *keys).distinct()

    def link(df, a, ka, b, kb, kind):
        return df.select(F.concat(F.lit(f"{ka}:"), F.col(a).cast("string")).alias("src"), F.concat(F.lit(f"{kb}:"), F.col(b).cast("string")).alias("dst"), F.lit(kind).alias("kind"))

    return _union([
        link(o, "o_orderkey", "o", "o_custkey", "c", "CALLS"),
        link(once("l_orderkey", "l_partkey"), "l_orderkey", "o", "l_partkey", "p", "REFERENCES"),
        link(c, "c_custkey", "c", "c_nationkey", "n", "CONTAINS"),
        link(s, "s_suppkey", "s", "s_nationkey", "n", "CONTAINS"),
        link(n, "n_nationkey", "n", "n_regionkey", "r", "CONTAINS"),
        link(once("l_partkey", "l_suppkey"), "l_partkey", "p", "l_suppkey", "s", "DATAFLOW"),
    ])


EDGES = """edges AS (
  SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst, 'CALLS' AS kind FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'REFERENCES' FROM lineitem
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'CONTAINS' FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'CONTAINS' FROM nation
  UNION ALL SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey, 'DATAFLOW' FROM lineitem)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, ts, path, adds, dels, author: order lines as a change history."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit"), F.col("l_shipdate").alias("ts"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("path"),
        F.col("l_quantity").cast("long").alias("adds"), F.col("l_linenumber").cast("long").alias("dels"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("author"),
    )


COMMITS = "commits AS (SELECT l_orderkey AS \"commit\", l_shipdate AS ts, 'p:' || l_partkey AS path, floor(l_quantity)::BIGINT AS adds, l_linenumber::BIGINT AS dels, 's:' || l_suppkey AS author FROM lineitem)"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a symbol table: fqn, content_hash, file."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("file"))
    fqn = F.concat(F.lit("o:"), F.col("k").cast("string")).alias("fqn")
    a = o.where(F.col("k") % 10 != 0).select(fqn, F.md5(F.col("k").cast("string")).alias("content_hash"), "file")
    b = o.where(F.col("k") % 10 != 1).select(fqn, F.md5(F.when(F.col("k") % 7 == 0, F.concat(F.lit("x"), F.col("k").cast("string"))).otherwise(F.col("k").cast("string"))).alias("content_hash"), "file")
    return a, b


SNAPSHOTS = """a AS (SELECT 'o:' || o_orderkey AS fqn, md5(o_orderkey::VARCHAR) AS content_hash, o_orderpriority AS file FROM orders WHERE o_orderkey % 10 <> 0),
b AS (SELECT 'o:' || o_orderkey AS fqn, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END || o_orderkey) AS content_hash, o_orderpriority AS file FROM orders WHERE o_orderkey % 10 <> 1)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, content, file_path, language."""
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("file_path"), F.col("lang").alias("language"))


CHUNKS = "chunks AS (SELECT 'd:' || doc_id AS chunk_id, text AS content, source AS file_path, lang AS language FROM documents)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, source, chunk_id, score: three candidate lists a query, with scores by hash.

    Deterministic stand-ins for retrieval channels: lexical (8 a query), vector (10) and symbol (6).
    """
    q = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))

    def channel(name: str, n: int, step: int):
        e = q.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
        chunk = F.concat(F.lit("d:"), ((F.col("query_id") * 7 + F.col("i") * step) % 37).cast("string"))
        score = ((F.col("query_id") * 31 + F.col("i") * 17 + len(name)) % 100) / 100.0
        return e.select("query_id", F.lit(name).alias("source"), chunk.alias("chunk_id"), score.alias("score"))

    return _union([channel("lexical", 8, 3), channel("vector", 10, 5), channel("symbol", 6, 2)])


HITS = """hits AS (
  SELECT o_orderkey AS query_id, source, 'd:' || ((o_orderkey * 7 + i * step) % 37) AS chunk_id, ((o_orderkey * 31 + i * 17 + len(source)) % 100) / 100.0::DOUBLE AS score
  FROM orders, (VALUES ('lexical', 8, 3), ('vector', 10, 5), ('symbol', 6, 2)) v(source, n, step), generate_series(0, 9) g(i)
  WHERE i < n)"""


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, chunk_id: the relevant chunks of each query."""
    h = hits(spark, sf_dir).select("query_id", "chunk_id").where((F.col("query_id") + F.substring("chunk_id", 3, 9).cast("long")) % 3 == 0)
    return dealt(h, "query_id").distinct()


GOLDEN = "golden AS (SELECT DISTINCT query_id, chunk_id FROM hits WHERE (query_id + substr(chunk_id, 3)::BIGINT) % 3 = 0)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, path, op, ts: file changes."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("path"), F.element_at(F.array(*map(F.lit, ("created", "modified", "deleted", "moved"))), (F.col("event_id") % 4 + 1).cast("int")).alias("op"), "ts")


CHANGES = "changes AS (SELECT event_id, 'u:' || user_id AS path, ['created', 'modified', 'deleted', 'moved'][event_id % 4 + 1] AS op, ts FROM events)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
