"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: every source gets ``budget`` times all words by weight, at most
   ``epochs`` times its own words; what a full source cannot take is shared
   again among the others by weight.  Solved in closed form over one row a source.
2. Draw: the rows of a source are permuted by a keyed hash and cut into 4096
   blocks by its leading bits.  Whole passes come first; the rest of the quota
   is a run of blocks in permuted order, and inside the one block where it ends
   a run of rows, the last of them in part.  Only blocks are summed, so a source
   with a third of all rows is spread over 4096 groups.
3. Split: the drawn blocks of all sources are dealt to output shards by a binary
   tree: each node splits the vector of block counts between its halves by a
   multivariate hypergeometric draw, so that the leaves' quotas add up exactly.
   The blocks of a source, permuted once more, then fill the leaves' quotas in
   turn: disjoint, whole blocks.  Each copy of a row gets a keyed hash, its turn:
   sorted by it, the rows of a shard are shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import keep, table

#: Sources by code point weigh these, repeating.
WEIGHTS = (5, 2, 1)
BLOCKS = 4096
#: Leading bits of a turn that make a piece of a shard.
PIECES = 12
#: What a word is.
WORD = r"[^\x20\x09-\x0D]+"


def _key(text):
    """60 bits of an MD5 as a long, the same in Spark and DuckDB."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, budget: float, epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """One row a source (columns skey, source_size) gets weight and target.  As many rows as sources."""
    order = Window.orderBy("skey")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * epochs)
    by = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    ahead, behind, every = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("most").over(ahead), F.lit(0))) / F.sum("weight").over(behind)
    rows = rows.withColumn("full", F.col("most") <= level * F.col("weight"))
    left = F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0))
    share = left / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share * F.col("weight")))
    return rows.select("skey", "source_size", "target")


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Block quotas, shards x sources, from block counts a source, by the splitting tree."""
    out = np.zeros((shards, len(counts)), np.int64)

    def node(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{lo}:{hi}".encode()).digest()[:8], "big"))
        left = np.zeros_like(have)
        need, rest = total * (mid - lo) // (hi - lo), total
        for i, n in enumerate(have.tolist()):  # marginals, one hypergeometric draw a source
            if need and n:
                left[i] = need if rest == n else rng.hypergeometric(n, rest - n, need)
            need -= int(left[i])
            rest -= n
        node(left, lo, mid)
        node(have - left, mid, hi)

    if len(counts):
        node(np.asarray(counts, np.int64), 0, shards)
    return out


def mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float = 1.5, epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, shards: int = 16, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows with size, source_size, target and ``draws`` (array of pass, words, shard, turn).

    Null text has no words; a null source is a source of its own and comes last;
    a null id is hashed as empty.  Repeated rows are drawn each by itself.  A
    document without words draws nothing.  An empty table gives an empty table.
    ``carry``: further columns of ``df`` that the result keeps.
    """
    if not 0 <= budget <= epochs:
        raise ValueError("the budget lies between 0 and the epochs")
    skey = F.when(F.col(f"`{source_col}`").isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(f"`{source_col}`").cast("string")))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    sized = keep(
        df.select(
            F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`") for c in carry], skey.alias("skey"),
            F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _key(F.concat(F.lit(f"{seed}:"), ident)).alias("key"),
        ).withColumn("block", F.shiftright("key", 48).cast("int")),
        "mixing-sizes",
    )
    blocks = sized.groupBy("skey", "block").agg(F.sum("size").alias("words"))
    goal = targets(blocks.groupBy("skey").agg(F.sum("words").alias("source_size")), budget, epochs, weights)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", F.least(whole, F.lit(epochs))).withColumn("extra", quota - F.col("whole") * F.col("source_size"))
    ahead = Window.partitionBy("skey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    blocks = blocks.join(goal, "skey")
    more = ((F.col("before") < F.col("extra")) & (F.col("words") > 0)).cast("int")
    blocks = blocks.withColumn("passes", F.when(F.col("words") > 0, F.col("whole") + more).otherwise(0).cast("int"))
    blocks = keep(blocks, "mixing-blocks")  # sources x 4096 rows at most

    # One row a source reaches the driver, and the tree's quotas come back: shards x sources numbers.
    have = sorted((r["skey"], int(r["n"])) for r in blocks.groupBy("skey").agg(F.sum("passes").alias("n")).collect())
    quotas = split(np.array([n for _, n in have], np.int64), shards, seed)
    ends = np.cumsum(quotas, axis=0)
    spark = df.sparkSession
    ranges = [(k, s, int(ends[s, i] - quotas[s, i]), int(ends[s, i])) for i, (k, _) in enumerate(have) for s in range(shards) if quotas[s, i]]
    ranges = spark.createDataFrame(ranges, "rkey string, shard int, lo long, hi long")
    units = blocks.where("passes > 0").select("skey", "block", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    turn = _key(F.concat_ws(":", F.lit(f"deal{seed}"), F.col("block"), F.col("pass")))
    units = units.withColumn("rank", F.row_number().over(Window.partitionBy("skey").orderBy(turn, "block", "pass")) - 1)
    dealt = units.join(ranges, (F.col("skey") == F.col("rkey")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    homes = dealt.groupBy("skey", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("homes"))  # as many as epochs
    blocks = blocks.join(homes, ["skey", "block"], "left").select(F.col("skey").alias("bkey"), F.col("block").alias("bblock"), "before", "source_size", "target", "whole", "extra", "homes")

    inside = Window.partitionBy("skey", "block").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(blocks, (F.col("skey") == F.col("bkey")) & (F.col("block") == F.col("bblock")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("before") - F.col("ahead")))
    draws = F.filter(
        F.transform(F.coalesce(F.col("homes"), F.array().cast("array<struct<pass:int,shard:int>>")), lambda h: F.struct(h["pass"].alias("pass"), F.when(h["pass"] < F.col("whole"), F.col("size")).otherwise(part).alias("words"), h["shard"].alias("shard"), _key(F.concat_ws(":", F.lit(f"turn{seed}"), F.col("key"), h["pass"])).alias("turn"))),
        lambda d: d["words"] > 0,
    )
    return rows.select("doc_id", *carry, "size", "source_size", "target", draws.alias("draws"))


def placed(mixed: DataFrame) -> DataFrame:
    """One row a whole copy of a document, with its pass, output shard and turn in it, shuffled.

    A shard comes in pieces, by the leading bits of the turn, each whole and in the order of the turns.

    Texts are never cut: a copy drawn in part is kept when at least half of its
    words were drawn, else left out; that concerns one document a source.
    """
    one = mixed.withColumn("draw", F.explode("draws")).where(F.col("draw.words") * 2 >= F.col("size"))
    one = one.withColumn("pass", F.col("draw.pass")).withColumn("shard", F.col("draw.shard")).withColumn("turn", F.col("draw.turn")).drop("draw", "draws")
    return one.repartition("shard", F.shiftright("turn", 60 - PIECES)).sortWithinPartitions("shard", "turn")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"])
    named = lambda c: F.array_join(F.transform("draws", lambda d: d[c].cast("string")), ",").alias(f"{c}s")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), named("shard"), named("turn"))


#: The contract's columns; the shards and turns of the splitting tree are not expressible in SQL, tests draw them again.
OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
weighed AS (
  SELECT skey, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS most,
         [5, 2, 1][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY skey),
levels AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 AS budget,
         (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(most) OVER (ORDER BY most / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (ORDER BY most / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
flagged AS (SELECT *, most <= level * weight AS full_up FROM levels),
goals AS (
  SELECT skey, source_size,
         CASE WHEN full_up THEN most::DOUBLE
              ELSE (budget - coalesce(sum(CASE WHEN full_up THEN most END) OVER (), 0)::DOUBLE)
                   / (sum(CASE WHEN NOT full_up THEN weight END) OVER ())::DOUBLE * weight END AS target
  FROM flagged),
quotas AS (
  SELECT *, floor(target + 0.5)::BIGINT AS quota,
         CASE WHEN source_size > 0 THEN least(2, floor(target + 0.5)::BIGINT // source_size) ELSE 0 END AS whole
  FROM goals),
ranked AS (
  SELECT doc_id, skey, size,
         coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, quota - whole * source_size - before)))::BIGINT AS taken
FROM ranked JOIN quotas USING (skey)
"""
