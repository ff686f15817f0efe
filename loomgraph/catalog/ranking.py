"""Ranking, fusion, cutoffs, packing and evaluation over derived hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..sources.tables import GOLDEN, HITS, golden, hits, read, with_
from .base import query

_H = with_(HITS)
_RANKED = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS rank FROM hits)"
_RRF = _H + _RANKED + ", fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM ranked GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused)"


def _fused(spark, sf):
    return R.rrf(hits(spark, sf)).withColumn("score", F.round("score", 9))


def _r(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("w01_channel_ranks", _H + _RANKED + "SELECT query_id, source, chunk_id, rank FROM ranked")
def w01(spark, sf):
    return R.ranked(hits(spark, sf)).select("query_id", "source", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("w02_rrf", _H + _RANKED + "SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ranked GROUP BY ALL")
def w02(spark, sf):
    return _r(R.rrf(hits(spark, sf)), "score")


@query("w03_weighted_rrf", _H + _RANKED + "SELECT query_id, chunk_id, round(sum(CASE source WHEN 'vector' THEN 0.5 / (70 + rank) WHEN 'lexical' THEN 0.3 / (70 + rank) ELSE 0.2 / (50 + rank) END::DOUBLE), 6) AS score FROM ranked GROUP BY ALL")
def w03(spark, sf):
    return _r(R.weighted_rrf(hits(spark, sf), {"vector": 0.5, "lexical": 0.3, "symbol": 0.2}), "score")


_PART = "OVER (PARTITION BY query_id, source)"
for _name, _method, _sql in (
    ("w04_min_max", "min_max", f"CASE WHEN max(score) {_PART} > min(score) {_PART} THEN (score - min(score) {_PART}) / (max(score) {_PART} - min(score) {_PART}) ELSE 1 END"),
    ("w05_clamp", "clamp", "greatest(0.0, least(1.0, score))"),
    ("w06_max", "max", f"CASE WHEN max(score) {_PART} > 1 THEN score / max(score) {_PART} ELSE score END"),
    ("w07_z_score", "z_score", f"CASE WHEN stddev_pop(score) {_PART} > 0 THEN (score - avg(score) {_PART}) / stddev_pop(score) {_PART} ELSE 0 END"),
    ("w07_rank_based", "rank", f"1.0 - (row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) - 1) / (count(*) {_PART})::DOUBLE"),
):

    @query(_name, _H + f"SELECT query_id, source, chunk_id, round(({_sql})::DOUBLE, 6) + 0.0 AS norm FROM hits")
    def norm(spark, sf, method=_method):
        out = R.normalized(hits(spark, sf), method)
        return out.select("query_id", "source", "chunk_id", (F.round("norm", 6) + F.lit(0.0)).alias("norm"))


@query("w04_virtual_penalty", _H + "SELECT query_id, source, chunk_id, round(CASE WHEN chunk_id = 'd:7' THEN score * 0.8 ELSE score END, 6)::DOUBLE AS norm FROM hits")
def w04b(spark, sf):
    return hits(spark, sf).select("query_id", "source", "chunk_id", F.round(R.penalized(F.col("score"), F.col("chunk_id") == "d:7"), 6).alias("norm"))


@query("w08_tie_breaks", _H + "SELECT query_id, source, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 1) DESC, CASE source WHEN 'symbol' THEN 0 WHEN 'lexical' THEN 1 ELSE 2 END, chunk_id) AS place FROM hits")
def w08(spark, sf):
    from pyspark.sql import Window

    channel = F.when(F.col("source") == "symbol", 0).when(F.col("source") == "lexical", 1).otherwise(2)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 1)), channel, "chunk_id")
    return hits(spark, sf).select("query_id", "source", "chunk_id", F.row_number().over(w).cast("long").alias("place"))


@query("w09_adaptive_k", _RRF.replace("sum(1.0::DOUBLE / (60 + rank))", "max(score)") + """, s AS (SELECT *, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS after, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS i FROM fused)
SELECT query_id, CASE WHEN sum((score >= 0.7)::INT) > 0.8 * 12 THEN least(18, count(*)) ELSE least(coalesce(min(CASE WHEN i >= 5 AND i < 12 AND (score - after > 0.1 OR after < 0.3) THEN i END), 12), count(*)) END::INT AS k FROM s GROUP BY query_id""")
def w09(spark, sf):
    best = hits(spark, sf).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return R.adaptive_k(best, initial=12)


@query("w10_reorder", _RRF + "SELECT query_id, chunk_id, CASE WHEN n < 5 THEN rank WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE n - rank // 2 + 1 END::INT AS place FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM top)")
def w10(spark, sf):
    return R.reorder(_fused(spark, sf)).select("query_id", "chunk_id", "place")


@query("a15_consensus", _H + _RANKED + """SELECT query_id, chunk_id, strategies, best_rank, round(avg_rank, 6) AS avg_rank, round(1 / (1 + avg_rank / 10.0), 6) AS quality, round(least(1.5, 1 + 0.3 * (sqrt(strategies) - 1)) * (0.5 + 0.5 / (1 + avg_rank / 10.0)), 6) AS factor FROM (SELECT query_id, chunk_id, count(DISTINCT source) AS strategies, min(rank) AS best_rank, avg(rank) AS avg_rank FROM ranked GROUP BY ALL)""")
def a15(spark, sf):
    return _r(R.consensus(hits(spark, sf)).withColumn("best_rank", F.col("best_rank").cast("long")), "avg_rank", "quality", "factor")


@query("w14_consensus_filter", _H + _RANKED + "SELECT query_id, chunk_id, count(DISTINCT source) AS strategies FROM ranked GROUP BY ALL HAVING count(DISTINCT source) >= 2")
def w14(spark, sf):
    return R.consensus(hits(spark, sf), 2).select("query_id", "chunk_id", "strategies")


_LIN = ", n AS (SELECT *, CASE source WHEN 'vector' THEN 0.5 WHEN 'lexical' THEN 0.3 ELSE 0.2 END AS w, CASE WHEN max(score) OVER p > min(score) OVER p THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 1 END AS norm FROM hits WINDOW p AS (PARTITION BY query_id, source))"


@query("r05_linear_fusion", _H + _LIN + "SELECT query_id, chunk_id, round(sum(norm * w) / sum(w), 6)::DOUBLE AS score FROM n GROUP BY ALL")
def r05(spark, sf):
    return _r(R.linear(hits(spark, sf), {"vector": 0.5, "lexical": 0.3, "symbol": 0.2}), "score")


@query("a36_weighted_mean", _H + _LIN + "SELECT query_id, chunk_id, round(sum(norm * w) / sum(w), 6)::DOUBLE AS score FROM n GROUP BY ALL")
def a36(spark, sf):
    return _r(R.linear(hits(spark, sf), {"vector": 0.5, "lexical": 0.3, "symbol": 0.2}), "score")


@query("r05_max_fusion", _H + _LIN + "SELECT query_id, chunk_id, round(max(norm), 6)::DOUBLE AS score FROM n GROUP BY ALL")
def r05b(spark, sf):
    return _r(R.best_of(hits(spark, sf)), "score")


@query("w18_primary_source", _H + "SELECT query_id, chunk_id, first(source ORDER BY score * CASE source WHEN 'vector' THEN 0.5 WHEN 'lexical' THEN 0.3 ELSE 0.2 END::DOUBLE DESC, source) AS \"primary\" FROM hits GROUP BY ALL")
def w18(spark, sf):
    return R.primary_source(hits(spark, sf), {"vector": 0.5, "lexical": 0.3, "symbol": 0.2})


@query("w19_blended_score", _H + "SELECT query_id, source, chunk_id, round(0.8 / (1 + exp(-(score * 4 - 2))) + 0.2 * score, 6) AS score FROM hits")
def w19(spark, sf):
    return hits(spark, sf).select("query_id", "source", "chunk_id", F.round(R.blended(F.col("score"), F.col("score") * 4 - 2), 6).alias("score"))


@query("k05_top_k", _RRF + "SELECT query_id, chunk_id, rank FROM top WHERE rank <= 5")
def k05(spark, sf):
    return R.top_k(_fused(spark, sf), 5).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("k06_initial_k", "SELECT p_partkey, greatest(5, least(100, CASE p_partkey % 4 WHEN 0 THEN least(k, 15) WHEN 1 THEN greatest(k, 60) WHEN 2 THEN 40 ELSE k END))::INT AS k FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 30 ELSE 80 END AS k FROM part)")
def k06(spark, sf):
    k = F.col("p_partkey")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", R.initial_k(pick(("simple", "medium", "complex"), k % 3), pick(("symbol", "flow", "concept", "code"), k % 4)).alias("k"))


@query("k07_budget_k", "SELECT p_partkey, greatest(5, least(100, least(80, p_size * 3, p_partkey % 97)))::INT AS k FROM part")
def k07(spark, sf):
    return read(spark, sf, "part").select("p_partkey", R.budget_k(F.lit(80), F.col("p_size") * 3, F.col("p_partkey") % 97 * 0.0001).alias("k"))


@query("k08_two_stage", _RRF + "SELECT query_id, chunk_id FROM top WHERE rank <= 8 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY substr(chunk_id, 3)::INT % 7 DESC, chunk_id) <= 3")
def k08(spark, sf):
    first = R.top_k(_fused(spark, sf), 8).drop("rank")
    return R.top_k(first.withColumn("score", F.substring("chunk_id", 3, 9).cast("int") % 7), 3).select("query_id", "chunk_id")


_RULES = "(VALUES ('r1', '*BRASS', 2), ('r2', 'STANDARD*', 2), ('r3', 'PROMO*STEEL', 3), ('r4', 'ECONOMY ANODIZED TIN', 1), ('r5', '*', 3)) v(rule_id, pattern, tier)"


@query("k14_specificity", "SELECT rule_id, round(spec, 2)::DOUBLE AS specificity, row_number() OVER (ORDER BY spec DESC, stars, lit DESC, rule_id) AS place FROM (SELECT *, CASE tier WHEN 1 THEN 100 WHEN 2 THEN 80 ELSE 50 END - 5 * stars + 0.1 * lit AS spec FROM (SELECT *, length(pattern) - length(replace(pattern, '*', '')) AS stars, length(replace(pattern, '*', '')) AS lit FROM (SELECT 'r' || p_partkey AS rule_id, CASE p_partkey % 4 WHEN 0 THEN '*' || p_name WHEN 1 THEN p_name || '*' || p_size || '*' WHEN 2 THEN p_name ELSE '*' END AS pattern, p_partkey % 3 + 1 AS tier FROM part)))")
def k14(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    pattern = F.when(k % 4 == 0, F.concat(F.lit("*"), name)).when(k % 4 == 1, F.concat(name, F.lit("*"), F.col("p_size").cast("string"), F.lit("*"))).when(k % 4 == 2, name).otherwise("*")
    rules = read(spark, sf, "part").select(F.concat(F.lit("r"), k.cast("string")).alias("rule_id"), pattern.alias("pattern"), (k % 3 + 1).alias("tier"))
    return R.specificity_order(rules).select("rule_id", F.round("specificity", 2).alias("specificity"), F.col("place").cast("long").alias("place"))


_EVAL = _RRF + ", " + GOLDEN + """, hit AS (SELECT t.query_id, rank, (g.chunk_id IS NOT NULL)::INT AS hit FROM top t LEFT JOIN golden g ON g.query_id = t.query_id AND g.chunk_id = t.chunk_id WHERE rank <= 5),
soft AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM hit),
g AS (SELECT query_id, sum(hit) AS found, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(hit / log2(rank + 1)) AS dcg, sum(CASE WHEN hit = 1 THEN so_far / rank ELSE 0 END) AS precisions FROM soft GROUP BY query_id),
m AS (SELECT r.query_id, coalesce(1.0 / first, 0)::DOUBLE AS rr, coalesce(found, 0) / 5.0::DOUBLE AS p, coalesce(found, 0) / relevant::DOUBLE AS r, coalesce(precisions, 0) / least(relevant, 5) AS ap, coalesce(dcg, 0) / list_sum([1 / log2(i + 1) FOR i IN generate_series(1, least(relevant, 5))]) AS ndcg FROM (SELECT query_id, count(*) AS relevant FROM golden GROUP BY query_id) r LEFT JOIN g USING (query_id))
"""


def _metrics(spark, sf):
    return R.retrieval_metrics(R.top_k(_fused(spark, sf), 100), golden(spark, sf), 5)


@query("a23_retrieval_metrics", _EVAL + "SELECT query_id, round(rr, 6) AS rr, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6)::DOUBLE AS f1, round(ap, 6) AS ap, round(ndcg, 6) AS ndcg FROM m")
def a23(spark, sf):
    return _r(_metrics(spark, sf), "rr", "precision", "recall", "f1", "ap", "ndcg")


@query("a24_stratified_metrics", _EVAL + "SELECT coalesce(stratum, 'all') AS stratum, round(avg(rr), 6) AS mrr, round(avg(ap), 6) AS map, round(avg(ndcg), 6) AS ndcg, count(*) AS n FROM (SELECT *, CASE WHEN query_id % 3 = 0 THEN 'easy' ELSE 'hard' END AS stratum FROM m) GROUP BY GROUPING SETS ((stratum), ())")
def a24(spark, sf):
    m = _metrics(spark, sf).withColumn("stratum", F.when(F.col("query_id") % 3 == 0, "easy").otherwise("hard"))
    g = m.rollup("stratum").agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count("*").alias("n"))
    return g.withColumn("stratum", F.coalesce("stratum", F.lit("all")))


@query("a22_spearman", _H + _RANKED + """, b AS (SELECT x.query_id, x.chunk_id, row_number() OVER (PARTITION BY x.query_id ORDER BY x.rank, x.chunk_id) AS a, row_number() OVER (PARTITION BY x.query_id ORDER BY y.rank, x.chunk_id) AS b FROM ranked x JOIN ranked y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id WHERE x.source = 'lexical' AND y.source = 'vector')
SELECT query_id, CASE WHEN count(*) >= 3 THEN round(1 - 6 * sum((a - b) ** 2) / (count(*) * (count(*) ** 2 - 1)), 6) END AS rho FROM b GROUP BY query_id""")
def a22(spark, sf):
    r = R.ranked(hits(spark, sf))
    return _r(R.spearman(r.where("source = 'lexical'"), r.where("source = 'vector'")), "rho")


@query("r23_hard_negatives", _RRF + "SELECT t.query_id, t.chunk_id, t.rank FROM top t JOIN top s ON s.query_id = t.query_id AND s.rank = 2 + t.query_id // 20 % 4 WHERE t.rank < s.rank AND s.rank - 1 >= 2")
def r23(spark, sf):
    top = R.top_k(_fused(spark, sf), 100)
    chosen = top.where(F.col("rank") == 2 + F.floor(F.col("query_id") / 20) % 4).select("query_id", "chunk_id")
    return R.hard_negatives(top, chosen, 2).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("a20_ab_metrics", _H + "SELECT CASE WHEN query_id % 3 = 0 THEN 'a' ELSE 'b' END AS variant, count(*) AS n, round(avg(score), 6) AS mean FROM hits GROUP BY 1")
def a20(spark, sf):
    return hits(spark, sf).groupBy(F.when(F.col("query_id") % 3 == 0, "a").otherwise("b").alias("variant")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("a21_latency_percentiles", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, list_sort(list(value))[(count(*) * 0.5)::INT + 1 - ((count(*) * 0.5)::INT > count(*) * 0.5)::INT] AS p50, list_sort(list(value))[(floor(count(*) * 0.95) + 1)::INT] AS p95 FROM events GROUP BY event_type")
def a21(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type")
    e = read(spark, sf, "events").withColumn("i", F.row_number().over(w.orderBy("value")) - 1).withColumn("n", F.count("*").over(w))
    at = lambda q: F.max(F.when(F.col("i") == F.floor(F.col("n") * q), F.col("value")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


@query("a27_success_ema", _H + "SELECT source, round(0.9 * 0.5 + 0.1 * sum((score >= 0.5)::INT) / count(*), 6)::DOUBLE AS rate FROM hits GROUP BY source")
def a27(spark, sf):
    return hits(spark, sf).groupBy("source").agg(F.round(0.9 * 0.5 + 0.1 * F.sum((F.col("score") >= 0.5).cast("int")) / F.count("*"), 6).alias("rate"))


@query("r21_adaptive_weights", _H + ", r AS (SELECT source, sum((score >= 0.5)::INT) / count(*)::DOUBLE AS rate, count(*) AS n FROM hits GROUP BY source), t AS (SELECT sum(rate) AS total FROM r) SELECT source, round(greatest(0.05, least(0.8, least(1.0, n / 50.0) * rate / total + (1 - least(1.0, n / 50.0)) / 3.0)), 6)::DOUBLE AS weight FROM r, t")
def r21(spark, sf):
    from pyspark.sql import Window

    r = hits(spark, sf).groupBy("source").agg((F.sum((F.col("score") >= 0.5).cast("int")) / F.count("*")).alias("rate"), F.count("*").alias("n"))
    share = F.col("rate") / F.sum("rate").over(Window.partitionBy())  # one row a channel
    trust = F.least(F.lit(1.0), F.col("n") / 50.0)
    return r.select("source", F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.8), trust * share + (1 - trust) / 3.0)), 6).alias("weight"))


@query("r13_multi_query_fusion", _H + ", v AS (SELECT query_id // 40 AS q, query_id, chunk_id, max(score) AS score FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q, query_id ORDER BY score DESC, chunk_id) AS rank FROM v) SELECT q, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r GROUP BY ALL")
def r13(spark, sf):
    each = hits(spark, sf).select(F.floor(F.col("query_id") / 40).alias("query_id"), F.col("query_id").cast("string").alias("source"), "chunk_id", "score")
    v = R.by_query(each).groupBy("query_id", "source", "chunk_id").agg(F.max("score").alias("score"))
    return _r(R.rrf(v, deal=False).withColumnRenamed("query_id", "q"), "score")


@query("r26_mixed_ranking", _H + "SELECT query_id, chunk_id, score FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, source) = 1 ORDER BY score DESC, query_id, chunk_id LIMIT 40")
def r26(spark, sf):
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "source"))
    return hits(spark, sf).withColumn("r", first).where("r = 1").select("query_id", "chunk_id", "score").orderBy(F.desc("score"), "query_id", "chunk_id").limit(40)


@query("j22_expansion_boost", _H + "SELECT query_id, chunk_id, round(max(score * CASE WHEN chunk_id LIKE '%3%' OR chunk_id LIKE '%9%' THEN 1.1 ELSE 1 END), 6)::DOUBLE AS score FROM hits GROUP BY query_id, chunk_id")
def j22(spark, sf):
    best = hits(spark, sf).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    match = F.lit(False)
    for term in ("3", "9"):
        match = match | F.contains(F.lower("chunk_id"), F.lit(term))
    return best.select("query_id", "chunk_id", F.round(F.when(match, F.col("score") * 1.1).otherwise(F.col("score")), 6).alias("score"))


@query("w13_packing", _RRF.replace("WITH ", "WITH RECURSIVE ", 1) + """, items AS (SELECT query_id, chunk_id, rank, (substr(chunk_id, 3)::INT * 37 % 400 + 50)::BIGINT AS tokens FROM top WHERE rank <= 12),
r(query_id, rank, used, take, chunk_id) AS (
  SELECT DISTINCT query_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM items
  UNION ALL SELECT query_id, rank, used + take, take, chunk_id FROM (
    SELECT i.query_id, i.rank, r.used, i.chunk_id, CASE WHEN r.used >= 950 THEN 0 WHEN i.tokens <= 1000 - r.used THEN i.tokens WHEN 1000 - r.used > 200 THEN 1000 - r.used ELSE 0 END AS take
    FROM r JOIN items i ON i.query_id = r.query_id AND i.rank = r.rank + 1))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS place, chunk_id, take AS tokens FROM r WHERE take > 0""")
def w13(spark, sf):
    top = R.top_k(_fused(spark, sf), 12)
    return R.packed(top.withColumn("tokens", (F.substring("chunk_id", 3, 9).cast("int") * 37 % 400 + 50).cast("long")), 1000)


@query("w12_overlap_dedup", """WITH RECURSIVE li AS (SELECT l_orderkey AS file, (l_partkey % 40)::INT AS s, (l_partkey % 40 + floor(l_quantity))::INT AS e, 1 - l_discount AS score FROM lineitem),
it AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, s, e) AS i, count(*) OVER (PARTITION BY file) AS n FROM li),
r(file, i, n, done) AS (
  SELECT DISTINCT file, 0::BIGINT, n, []::STRUCT(s INT, e INT, score DOUBLE)[] FROM it
  UNION ALL SELECT file, i, n, CASE WHEN w >= 1 THEN done ELSE list_append(done, {'s': s, 'e': e, 'score': CASE WHEN w >= 0.5 THEN score * 0.5 ELSE score END::DOUBLE}) END FROM (
    SELECT r.file, it.i, r.n, r.done, it.s, it.e, it.score, coalesce(list_max([greatest(0, least(d.e, it.e) - greatest(d.s, it.s) + 1) / (it.e - it.s + 1)::DOUBLE FOR d IN r.done]), 0) AS w
    FROM r JOIN it ON it.file = r.file AND it.i = r.i + 1))
SELECT file, d.s AS start, d.e AS "end", round(d.score, 6) AS score FROM (SELECT file, unnest(done) AS d FROM r WHERE i = n)""")
def w12(spark, sf):
    li = read(spark, sf, "lineitem")
    return _r(R.overlap_dedup(li.select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 40).cast("int").alias("start"), (F.col("l_partkey") % 40 + F.col("l_quantity")).cast("int").alias("end"), (1 - F.col("l_discount")).alias("score"))), "score")
