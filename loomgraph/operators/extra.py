"""Smaller operators: sketches, scopes, overlays, bitmasks, summaries, hierarchies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import paths


def bloom_shape(n: int, p: float) -> tuple[int, int]:
    """Bits and hashes for ``n`` items at a false-positive rate of ``p``."""
    m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, min(10, max(1, round(m / n * math.log(2))))


def bloom_positions(item: Column, m: int, k: int) -> Column:
    """Double hashing on halves of the item's SHA-256."""
    h = F.sha2(item, 256)
    part = lambda i: F.conv(F.substring(h, i, 12), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(part(1) + i * part(13), F.lit(m)))


def bloom(items: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """The set bits, at most ``m`` rows, whatever the number of items."""
    return items.select(F.explode(bloom_positions(F.col(column), m, k)).alias("bit")).distinct()


def might_contain(items: DataFrame, column: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """Items with ``maybe``: all their bits are set."""
    e = items.select(column, F.explode(F.array_distinct(bloom_positions(F.col(column), m, k))).alias("bit"))
    miss = e.join(bits, "bit", "left_anti").select(column).distinct().withColumn("_miss", F.lit(True))
    return items.join(miss, column, "left").withColumn("maybe", F.col("_miss").isNull()).drop("_miss")


def scope_lookup(uses: DataFrame, scopes: DataFrame, symbols: DataFrame, depth: int = 10) -> DataFrame:
    """use, fqn: the innermost scope (scope, parent) up the chain that defines a name; aliases go before symbols, none: null.

    ``uses``: use, scope, name; ``symbols``: scope, name, fqn, alias.
    """
    up = paths.reach(scopes.where("parent is not null").select(F.col("scope").alias("src"), F.col("parent").alias("dst")), uses.select(F.col("scope").alias("id")).distinct(), depth)
    chain = up.select(F.col("start").alias("scope"), F.col("node").alias("outer"), "distance").unionByName(uses.select("scope").distinct().select("scope", F.col("scope").alias("outer"), F.lit(0).alias("distance")))
    hit = uses.join(chain, "scope").join(symbols.select(F.col("scope").alias("outer"), "name", "fqn", "alias"), ["outer", "name"])
    best = hit.groupBy("use").agg(F.min_by("fqn", F.struct("distance", (~F.col("alias")).alias("plain"), "fqn")).alias("fqn"))
    return uses.join(best, "use", "left").select("use", "fqn")


def overlaid(base: DataFrame, ops: DataFrame) -> DataFrame:
    """Edges (src, dst) after overlay operations (src, dst, op add or remove, seq); rolling back is leaving operations out."""
    last = ops.groupBy("src", "dst").agg(F.max_by("op", "seq").alias("op"))
    kept = base.select("src", "dst").join(last, ["src", "dst"], "left_anti")
    return kept.unionByName(last.where("op = 'add'").select("src", "dst"))


# Role bits of symbol occurrences.
ROLES = {"definition": 1, "import": 2, "write": 4, "read": 8, "test": 16}


def roles(occurrences: DataFrame) -> DataFrame:
    """symbol, file, roles: occurrence roles (symbol, file, role) as one bit mask."""
    bit = F.lit(0)
    for name, value in ROLES.items():
        bit = F.when(F.col("role") == name, value).otherwise(bit)
    return occurrences.groupBy("symbol", "file").agg(F.bit_or(bit).alias("roles"))


def has_role(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(ROLES[name])) != 0


def unchecked_dereferences(uses: DataFrame, checks: DataFrame) -> DataFrame:
    """Dereferences (fn, var, line) of a nullable value with no check of it on an earlier line of the function."""
    first = checks.groupBy("fn", "var").agg(F.min("line").alias("checked"))
    return uses.join(first, ["fn", "var"], "left").where(F.col("checked").isNull() | (F.col("checked") >= F.col("line"))).select("fn", "var", "line")


def summaries(flows: DataFrame) -> DataFrame:
    """fn, tainted parameters that reach the return value and whether globals do (flows: fn, from_kind, index, to_kind)."""
    return flows.groupBy("fn").agg(
        F.array_join(F.array_sort(F.collect_set(F.when((F.col("from_kind") == "param") & (F.col("to_kind") == "return"), F.col("index").cast("string")))), ",").alias("params"),
        F.bool_or(F.col("to_kind") == "global").alias("globals"),
    )


def hierarchy(symbols: DataFrame) -> DataFrame:
    """chunk, parent chunk, level: file, class and function chunks of symbols (file, kind, fqn, parent)."""
    level = F.when(F.col("kind") == "file", 3).when(F.col("kind") == "class", 4).otherwise(5)
    return symbols.select(F.concat_ws(":", "kind", "fqn").alias("chunk"), F.col("parent"), level.alias("level"))


def position_weights(ranked: DataFrame, edge: float = 1.2, middle: float = 0.9) -> DataFrame:
    """Scores of a ranked list times ``edge`` in its first and last quarter and ``middle`` between (query_id, chunk_id, rank, score)."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    share = (F.col("rank") - 1) / F.greatest(F.lit(1), n - 1)
    return ranked.withColumn("score", F.col("score") * F.when((share <= 0.25) | (share >= 0.75), edge).otherwise(middle))


def prefix_counts(words: DataFrame, column: str, longest: int) -> DataFrame:
    """prefix, n, words: a trie as a table, up to ``longest`` characters."""
    w = words.select(column).distinct()
    e = w.select(column, F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(column)))).alias("n"))
    return e.select(F.substring(column, F.lit(1), F.col("n")).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("words"))


def rebuild_cost(changed: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """symbols, milliseconds, files of a rebuild: 5 ms a changed or dependent symbol, a file for ten."""
    r = paths.reach(edges, changed, depth, backward=True).select(F.col("node").alias("id")).unionByName(changed.select("id")).distinct()
    return r.agg(F.count("*").alias("symbols")).select("symbols", (F.col("symbols") * 5).alias("milliseconds"), F.floor(F.col("symbols") / 10).alias("files"))


def rank_mode(nodes: int, edges: int, interactive: bool) -> str:
    """fast for interactive or very large graphs, architecture for dense ones, full for small ones, else ai."""
    if interactive or nodes > 1_000_000:
        return "fast"
    if nodes and edges / nodes > 10:
        return "architecture"
    return "full" if nodes < 10_000 else "ai"


def structural_score(a: Column, b: Column, weights: dict[str, float]) -> Column:
    """Weighted Jaccard of feature sets (structs of arrays with the weights' names)."""
    from ..functions.text import set_jaccard

    return sum((set_jaccard(a[n], b[n]) * w for n, w in weights.items()), F.lit(0.0))
