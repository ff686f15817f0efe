"""Ranking, fusion and cutoffs over hits (query_id, source, chunk_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dealt

# Fusion constants of the channels.
RRF_K = {"vector": 70.0, "lexical": 70.0, "symbol": 50.0, "graph": 50.0}


def by_query(rows: DataFrame) -> DataFrame:
    """Rows dealt by query: ranks, sums and joins by the query that follow shuffle nothing more."""
    return dealt(rows, "query_id")


def ranked(hits: DataFrame, deal: bool = True) -> DataFrame:
    """1-based rank in each query's channel, by score, ties by chunk; without ``deal`` the hits lie by query already."""
    return (by_query(hits) if deal else hits).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "chunk_id")))


def rrf(hits: DataFrame, k: float = 60.0, deal: bool = True) -> DataFrame:
    """Sum of 1 / (k + rank) over the channels."""
    return ranked(hits, deal).groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def weighted_rrf(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of w / (k + rank); the channel is recognised by its name, others have the lexical constant."""
    k, w = F.lit(RRF_K["lexical"]), F.lit(0.0)
    for name, value in RRF_K.items():
        k = F.when(F.contains("source", F.lit(name)), value).otherwise(k)
    for name, value in weights.items():
        w = F.when(F.contains("source", F.lit(name)), value).otherwise(w)
    return ranked(hits).groupBy("query_id", "chunk_id").agg(F.sum(w / (k + F.col("rank"))).alias("score"))


def normalized(hits: DataFrame, method: str) -> DataFrame:
    """``norm`` by min_max (a range of 0 gives 1), clamp, max (only above 1), z_score or rank, inside a query's channel."""
    by = Window.partitionBy("query_id", "source")
    s, lo, hi = F.col("score"), F.min("score").over(by), F.max("score").over(by)
    if method == "min_max":
        norm: Column = F.when(hi > lo, (s - lo) / (hi - lo)).otherwise(1.0)
    elif method == "clamp":
        norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
    elif method == "max":
        norm = F.when(hi > 1, s / hi).otherwise(s)
    elif method == "z_score":
        sd = F.stddev_pop("score").over(by)
        norm = F.when(sd > 0, (s - F.avg("score").over(by)) / sd).otherwise(0.0)
    elif method == "rank":
        n = F.count("*").over(by)
        norm = 1.0 - (F.row_number().over(by.orderBy(F.desc("score"), "chunk_id")) - 1) / n
    else:
        raise ValueError(f"unknown normalisation {method}")
    return by_query(hits).withColumn("norm", norm)


def penalized(norm: Column, virtual: Column) -> Column:
    """Hits in unsaved text count 0.8."""
    return F.when(virtual, norm * 0.8).otherwise(norm)


def consensus(hits: DataFrame, least: int = 1) -> DataFrame:
    """strategies, best and mean rank, quality 1 / (1 + mean / 10) and factor min(1.5, 1 + 0.3 (sqrt n - 1)) (0.5 + quality / 2) of each chunk."""
    g = ranked(hits).groupBy("query_id", "chunk_id").agg(F.countDistinct("source").alias("strategies"), F.min("rank").alias("best_rank"), F.avg("rank").alias("avg_rank")).where(F.col("strategies") >= least)
    g = g.withColumn("quality", 1 / (1 + F.col("avg_rank") / 10.0))
    return g.withColumn("factor", F.least(F.lit(1.5), 1 + 0.3 * (F.sqrt("strategies") - 1)) * (0.5 + 0.5 * F.col("quality")))


def linear(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of normalised scores over the channels that found a chunk."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("source") == name, value).otherwise(w)
    n = normalized(hits, "min_max").withColumn("w", w)
    return n.groupBy("query_id", "chunk_id").agg((F.sum(F.col("norm") * F.col("w")) / F.sum("w")).alias("score"))


def best_of(hits: DataFrame) -> DataFrame:
    return normalized(hits, "min_max").groupBy("query_id", "chunk_id").agg(F.max("norm").alias("score"))


def primary_source(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The channel with the largest score times weight of each fused hit, ties by name."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("source") == name, value).otherwise(w)
    return hits.groupBy("query_id", "chunk_id").agg(F.min_by("source", F.struct((-F.col("score") * w).alias("less"), "source")).alias("primary"))


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), ties: str = "chunk_id") -> DataFrame:
    """The ``k`` best rows of each query; Catalyst limits inside the tasks before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), ties))).where(F.col("rank") <= k)


def adaptive_k(scored: DataFrame, initial: int = 50, least: int = 5, gap: float = 0.1, floor: float = 0.3) -> DataFrame:
    """query_id, k: cut at the first gap over ``gap`` or score under ``floor`` from position ``least`` on.

    With more than 0.8 * initial scores of 0.7 or more, half as much again.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    r = scored.withColumn("i", F.row_number().over(w)).withColumn("after", F.lead("score").over(w))
    stop = (F.col("i") >= least) & (F.col("i") < initial) & (((F.col("score") - F.col("after")) > gap) | (F.col("after") < floor))
    g = r.groupBy("query_id").agg(F.min(F.when(stop, F.col("i"))).alias("cut"), F.count("*").alias("n"), F.sum((F.col("score") >= 0.7).cast("int")).alias("good"))
    wide = F.least(F.floor(F.lit(initial) * 1.5).cast("int"), F.col("n").cast("int"))
    return g.select("query_id", F.when(F.col("good") > 0.8 * initial, wide).otherwise(F.least(F.coalesce("cut", F.lit(initial)), F.col("n")).cast("int")).alias("k"))


def reorder(scored: DataFrame) -> DataFrame:
    """Odd ranks ascending, then even ranks descending, so that the best stand at both ends; under five rows stay."""
    r = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    odd = F.col("rank") % 2 == 1
    place = F.when(F.col("n") < 5, F.col("rank")).when(odd, F.floor((F.col("rank") + 1) / 2)).otherwise(F.col("n") - F.col("rank") / 2 + 1)
    return r.withColumn("place", place.cast("int")).drop("n")


def blended(score: Column, raw: Column) -> Column:
    """0.8 of the sigmoid of a cross-encoder's score and 0.2 of the former score."""
    return 0.8 / (1 + F.exp(-raw)) + 0.2 * score


def initial_k(complexity: Column, intent: Column) -> Column:
    """Simple 10, medium 30, complex 80; symbol at most 15, flow at least 60, concept 40; 5 to 100."""
    k = F.when(complexity == "simple", 10).when(complexity == "medium", 30).otherwise(80)
    k = F.when(intent == "symbol", F.least(k, F.lit(15))).when(intent == "flow", F.greatest(k, F.lit(60))).when(intent == "concept", F.lit(40)).otherwise(k)
    return F.greatest(F.lit(5), F.least(F.lit(100), k))


def intent_k(intent: Column) -> Column:
    return F.when(intent == "symbol", 20).when(intent == "flow", 15).when(intent == "concept", 60).otherwise(40)


def budget_k(base: Column, latency_ms: Column, cost: Column) -> Column:
    """The base, cut to what a latency (1 ms a hit) and a cost (0.0001 a hit) allow; 5 to 100."""
    return F.greatest(F.lit(5), F.least(F.lit(100), base, F.floor(latency_ms).cast("int"), F.floor(cost / 0.0001 + 1e-9).cast("int")))


def specificity_order(rules: DataFrame) -> DataFrame:
    """Rules by specificity descending, wildcards ascending, literal length descending, id."""
    stars = F.length("pattern") - F.length(F.replace("pattern", F.lit("*"), F.lit("")))
    literal = F.length(F.replace("pattern", F.lit("*"), F.lit("")))
    base = F.when(F.col("tier") == 1, 100.0).when(F.col("tier") == 2, 80.0).otherwise(50.0)
    out = rules.withColumn("wildcards", stars).withColumn("literal", literal).withColumn("specificity", base - 5 * stars + 0.1 * literal)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("specificity"), "wildcards", F.desc("literal"), "rule_id")))


# --- evaluation -------------------------------------------------------------


def retrieval_metrics(ranked_hits: DataFrame, golden: DataFrame, k: int) -> DataFrame:
    """One row a query of ``golden``: reciprocal rank, precision, recall, F1, average precision and nDCG at ``k``.

    ``ranked_hits``: query_id, chunk_id, rank; relevance is binary; the ideal gain is over min(relevant, k).
    """
    total = by_query(golden).groupBy("query_id").agg(F.count("*").alias("relevant"), F.collect_set("chunk_id").alias("golden"))
    top = ranked_hits.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank")
    hit = total.join(top, "query_id", "left").withColumn("hit", F.coalesce(F.array_contains("golden", F.col("chunk_id")), F.lit(False)).cast("int"))
    so_far = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rank"))
    hit = hit.withColumn("so_far", so_far)
    out = hit.groupBy("query_id").agg(
        F.max("relevant").alias("relevant"), F.sum("hit").alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("precisions"),
    )
    out = out.fillna(0, ["found", "dcg", "precisions"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    p, r = F.col("found") / F.lit(float(k)), F.col("found") / F.col("relevant")
    return out.select(
        "query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        (F.col("precisions") / F.least(F.col("relevant"), F.lit(k))).alias("ap"), (F.col("dcg") / ideal).alias("ndcg"),
    )


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, rho over common chunks of two rankings (query_id, chunk_id, rank); null under three."""
    both = a.select("query_id", "chunk_id", F.col("rank").alias("ra")).join(b.select("query_id", "chunk_id", F.col("rank").alias("rb")), ["query_id", "chunk_id"])
    w = Window.partitionBy("query_id")
    both = both.withColumn("x", F.row_number().over(w.orderBy("ra", "chunk_id"))).withColumn("y", F.row_number().over(w.orderBy("rb", "chunk_id")))
    g = both.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("x") - F.col("y"), 2)).alias("d"))
    return g.select("query_id", F.when(F.col("n") >= 3, 1 - 6 * F.col("d") / (F.col("n") * (F.pow("n", F.lit(2)) - 1))).alias("rho"))


def hard_negatives(shown: DataFrame, selected: DataFrame, least: int = 1) -> DataFrame:
    """What was shown before the selected chunk, where that stood at ``least`` (0-based) or later."""
    place = shown.join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"]).select("query_id", F.col("rank").alias("chosen_rank")).where(F.col("chosen_rank") - 1 >= least)
    return shown.join(place, "query_id").where(F.col("rank") < F.col("chosen_rank")).select("query_id", "chunk_id", "rank")


# --- context packing --------------------------------------------------------


def packed(chunks: DataFrame, budget: int) -> DataFrame:
    """Greedy packing by rank of chunks (query_id, chunk_id, rank, tokens): those whose running total fits the budget.

    A fold over each query's ranked list: a chunk that does not fit is trimmed to
    the rest if that is over 200 tokens, else skipped; packing ends at 95 %.
    """
    one = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "tokens"))).alias("items"))  # a ranked list, top-k long
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<chunk_id:string,tokens:bigint>>").alias("out"))

    def step(s, x):
        rest = F.lit(budget) - s["used"]
        take = F.when(s["used"] >= 0.95 * budget, F.lit(0).cast("long")).when(x["tokens"] <= rest, x["tokens"].cast("long")).when(rest > 200, rest).otherwise(F.lit(0).cast("long"))
        return F.struct((s["used"] + take).alias("used"), F.when(take > 0, F.concat(s["out"], F.array(F.struct(x["chunk_id"].cast("string").alias("chunk_id"), take.alias("tokens"))))).otherwise(s["out"]).alias("out"))

    folded = one.select("query_id", F.aggregate("items", start, step)["out"].alias("out"))
    return folded.select("query_id", F.posexplode("out").alias("place", "x")).select("query_id", (F.col("place") + 1).alias("place"), "x.chunk_id", "x.tokens")


def overlap_dedup(spans: DataFrame) -> DataFrame:
    """Drop or halve overlapping spans (file, start, end, score) in order of score: overlap of the whole span drops it, half or more halves its score.

    A fold over each file's ranked spans; dropped spans do not count as chosen.
    """
    one = spans.groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "start", "end", "score"))).alias("items"))
    kind = "array<struct<start:int,end:int,score:double>>"

    def step(done, x):
        size = (x["end"] - x["start"] + 1).cast("double")
        worst = F.coalesce(F.array_max(F.transform(done, lambda d: F.greatest(F.lit(0), F.least(d["end"], x["end"]) - F.greatest(d["start"], x["start"]) + 1) / size)), F.lit(0.0))
        score = F.when(worst >= 0.5, x["score"] * 0.5).otherwise(x["score"])
        return F.when(worst >= 1.0, done).otherwise(F.concat(done, F.array(F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), score.cast("double").alias("score")))))

    folded = one.select("file", F.aggregate("items", F.array().cast(kind), step).alias("out"))
    return folded.select("file", F.explode("out").alias("x")).select("file", "x.start", "x.end", "x.score")
