"""Lexical, symbol and vector search, graph candidates and their fan-out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import set_jaccard, trigrams
from ..storage import keep


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: t != "")


def inverted_index(docs: DataFrame, key: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """term, doc, tf, len: the index is a table; one aggregation with a map-side combine.

    With ``only`` (term) it has the rows of those terms, and no other term leaves the task that reads its text.
    """
    t = docs.select(F.col(key).alias("doc"), terms(F.col(text)).alias("ts"))
    e = t.select("doc", F.size("ts").alias("len"), F.explode("ts").alias("term"))
    if only is not None:
        e = e.join(F.broadcast(only.select("term").distinct()), "term", "left_semi")
    return e.groupBy("term", "doc", "len").agg(F.count("*").alias("tf"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the different terms of queries (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def corpus_figures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """n_docs, avg_len over the documents that have a term; texts are not cut into rows for it."""
    each = docs.select(F.col(key).alias("doc"), F.size(terms(F.col(text))).alias("len")).where("len > 0").distinct()
    return each.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def bm25(index: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, figures: DataFrame | None = None) -> DataFrame:
    """query_id, doc, score for queries (query_id, text) over an inverted index.

    An index of the asked terms alone needs the ``corpus_figures`` of its documents.
    """
    q = asked_terms(queries)
    docs = index.select("doc", "len").distinct().agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")) if figures is None else figures
    wanted = keep(index.join(q.select("term").distinct(), "term", "left_semi"), "asked-terms")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    hit = wanted.join(df, "term").join(q, "term").crossJoin(F.broadcast(docs))  # one row of corpus figures
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hit.groupBy("query_id", "doc").agg(F.sum(part).alias("score"))


def all_terms(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc, score: documents with every term of the query, by the log-scaled term frequencies."""
    q = queries.select("query_id", F.array_distinct(terms(F.col("text"))).alias("ts")).withColumn("n", F.size("ts"))
    e = q.select("query_id", "n", F.explode("ts").alias("term"))
    hit = index.join(e, "term").groupBy("query_id", "doc", "n").agg(F.count("*").alias("found"), F.sum(F.log(1.0 + F.col("tf"))).alias("score"))
    return hit.where("found = n").select("query_id", "doc", "score")


def _scored(ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int, threshold: float | None):
    """Rows and queries (places) and exact scores of what may be among the ``k`` best of a query and reaches the threshold.

    A matrix product picks candidates with a margin for its rounding; the score
    of a candidate adds its products in order, so that equal vectors tie.
    """
    def exact(x, y):
        out = np.zeros(len(x))
        for j in range(x.shape[1]):
            out += x[:, j] * y[:, j]
        return out

    nv, nq = np.sqrt(exact(v, v)), np.sqrt(exact(q, q))
    unit = lambda x, n: x / np.where(n > 0, n, 1.0)[:, None]
    about = unit(v, nv) @ unit(q, nq).T
    least = np.full(len(q), -np.inf if threshold is None else threshold)
    if k < len(v):
        least = np.maximum(least, np.partition(about, len(v) - k, axis=0)[len(v) - k])
    i, j = np.nonzero(about >= least - 1e-9)
    size = nv[i] * nq[j]
    score = np.zeros(len(i))
    for at in range(0, len(i), 65536):
        s = slice(at, at + 65536)
        score[s] = exact(v[i[s]], q[j[s]])
    score = np.where(size > 0, score / np.where(size > 0, size, 1.0), 0.0)
    if threshold is not None:
        i, j, score = (x[score >= threshold] for x in (i, j, score))
    if k < len(v):
        order = np.lexsort((ids[i], -score, j))
        i, j, score = i[order], j[order], score[order]
        start = np.concatenate([[0], np.cumsum(np.bincount(j, minlength=len(q)))[:-1]])
        near = np.arange(len(j)) - start[j] < k
        i, j, score = i[near], j[near], score[near]
    return i, j, score


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the ``k`` nearest by cosine, exactly; queries are a stated set against all rows.

    Blocks of vectors meet blocks of queries of as many dimensions as matrices, and
    only the nearest of a block are ranked among all.  Vectors that are null or of
    other dimensions than the query have no score and come last, by id.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n, m = vectors.count(), queries.count()
    wide = max(1, -(-n // 8192), min(4 * cores, -(-n // 512)))
    high = max(1, -(-m // 8192))
    v = vectors.where("embedding is not null").select("vec_id", "embedding", F.size("embedding").alias("d"), F.pmod(F.xxhash64("vec_id"), F.lit(wide)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(high - 1))).alias("y"))
    q = queries.where("embedding is not null").select("query_id", F.col("embedding").alias("asked"), F.size("embedding").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("x"), F.pmod(F.xxhash64("query_id"), F.lit(high)).cast("int").alias("y"))
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"

    def run(left, right):
        names = ["query_id", "vec_id", "score"]
        lists = lambda t, c: np.array(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(t.num_rows, -1)
        keys, asked = left.column("vec_id").combine_chunks(), right.column("query_id").combine_chunks()
        none = pa.table([asked.slice(0, 0), keys.slice(0, 0), pa.array([], pa.float64())], names=names)
        if not left.num_rows or not right.num_rows:
            return none
        place = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        a, b, out = lists(left, "embedding"), lists(right, "asked"), [none]
        for at in range(0, len(b), 256):
            i, j, score = _scored(place, a, b[at : at + 256], k, threshold)
            out.append(pa.table([asked.take(pa.array(j + at)), keys.take(pa.array(i)), pa.array(score)], names=names))
        return pa.concat_tables(out)

    scored = v.groupBy("d", "x", "y").cogroup(q.groupBy("d", "x", "y")).applyInArrow(run, kinds)
    if threshold is None:
        d = F.coalesce(F.nullif(F.size("embedding"), F.lit(-1)), F.lit(-1))
        few = vectors.select("vec_id", d.alias("dv")).withColumn("r", F.row_number().over(Window.partitionBy("dv").orderBy("vec_id"))).where(F.col("r") <= k)
        unlike = queries.select("query_id", d.alias("dq")).join(few, (F.col("dq") != F.col("dv")) | (F.col("dq") == -1))
        scored = scored.unionByName(unlike.select("query_id", "vec_id", F.lit(None).cast("double").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = scored.withColumn("rank", rank)
    return ranked if k >= n else ranked.where(F.col("rank") <= k)


def symbol_search(symbols: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, name, stage, score: exact names, else edit distance up to 2 (the closest), else trigram Jaccard of 0.7 or more.

    Near names share the length band and one of three pieces of the query (three
    pieces and two edits leave one piece whole), so candidates come from equi joins.
    """
    s = symbols.select("name", F.lower("name").alias("low")).distinct()
    q = queries.select("query_id", F.lower("text").alias("q"))
    exact = q.join(s, F.col("q") == F.col("low")).select("query_id", "name", F.lit("exact").alias("stage"), F.lit(1.0).alias("score"))
    rest = q.join(exact.select("query_id").distinct(), "query_id", "left_anti").where(F.length("q") >= 3)

    third = F.floor(F.length("q") / 3).cast("int")
    start = F.array(F.lit(1), third + 1, third * 2 + 1)
    size = F.array(third, third, F.length("q") - third * 2)
    pieces = rest.select("query_id", "q", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.element_at(start, i).alias("at"), F.substring("q", F.element_at(start, i), F.element_at(size, i)).alias("piece")))).alias("i", "p"))
    pieces = pieces.select("query_id", "q", "i", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("shift"), "p.at", "p.piece").withColumn("at", F.col("at") + F.col("shift")).where("at >= 1").withColumn("n", F.length("piece"))
    shapes = pieces.select("at", "n").distinct()  # places and lengths, bounded by the longest query
    cut = s.join(F.broadcast(shapes), F.length("low") >= F.col("at") + F.col("n") - 1).withColumn("piece", F.substring("low", F.col("at"), F.col("n")))
    near = pieces.join(cut, ["at", "n", "piece"]).select("query_id", "q", "name", "low").distinct().withColumn("d", F.levenshtein("q", "low")).where("d <= 2")
    near = near.withColumn("best", F.min("d").over(Window.partitionBy("query_id"))).where("d = best").select("query_id", "name", F.lit("fuzzy").alias("stage"), (1.0 / (1 + F.col("d"))).alias("score"))
    left = rest.join(near.select("query_id").distinct(), "query_id", "left_anti")
    a = left.withColumn("qg", trigrams(F.col("q"))).withColumn("g", F.explode("qg"))
    b = s.withColumn("ng", trigrams(F.col("low"))).withColumn("g", F.explode("ng"))
    fuzzy = a.join(b, "g").dropDuplicates(["query_id", "name"]).withColumn("score", set_jaccard(F.col("qg"), F.col("ng"))).where("score >= 0.7")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "name"))
    fuzzy = fuzzy.withColumn("r", rank).where(F.col("r") <= k).select("query_id", "name", F.lit("trigram").alias("stage"), "score")
    return exact.unionByName(near).unionByName(fuzzy)


# Channels of each intent.
CHANNELS = {"code": ("lexical", "vector"), "concept": ("lexical", "vector"), "symbol": ("symbol", "lexical"), "flow": ("graph", "symbol"), "overview": ("vector", "lexical"), "doc": ("docstring", "vector")}


def fan_out(hits: DataFrame, intents: DataFrame) -> DataFrame:
    """Hits of the channels that each query's intent (query_id, intent) asks."""
    rows = [(i, c) for i, cs in CHANNELS.items() for c in cs]
    wanted = intents.join(F.broadcast(hits.sparkSession.createDataFrame(rows, "intent string, source string")), "intent")
    return hits.join(wanted.select("query_id", "source"), ["query_id", "source"])


# Fusion weights of each intent.
WEIGHTS = {
    "code": {"vector": 0.4, "lexical": 0.3, "symbol": 0.2, "graph": 0.1}, "symbol": {"vector": 0.1, "lexical": 0.2, "symbol": 0.5, "graph": 0.2},
    "flow": {"vector": 0.1, "lexical": 0.1, "symbol": 0.3, "graph": 0.5}, "concept": {"vector": 0.6, "lexical": 0.2, "symbol": 0.1, "graph": 0.1},
}


def weighted(intents: DataFrame) -> DataFrame:
    """query_id, source, weight: the fusion weights of each query's intent (query_id, intent)."""
    rows = [(i, c, w) for i, cs in WEIGHTS.items() for c, w in cs.items()]
    presets = intents.sparkSession.createDataFrame(rows, "intent string, source string, weight double")
    return intents.join(F.broadcast(presets), "intent").select("query_id", "source", "weight")


def fused_by_intent(hits: DataFrame, intents: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: clamped scores summed by the weights of the query's intent."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return hits.join(weighted(intents), ["query_id", "source"]).groupBy("query_id", "chunk_id").agg(F.sum(clamped * F.col("weight")).alias("score"))


def retrieved(hits: DataFrame, intents: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, place: the ``k`` best of the fused hits of each query; scores alike in nine digits tie by chunk."""
    if not 1 <= k <= 1000:
        raise ValueError("between 1 and 1000 hits a query")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id"))
    return fused_by_intent(hits, intents).withColumn("place", rank.cast("long")).where(F.col("place") <= k)


def blended_weights(probabilities: dict[str, float]) -> dict[str, float]:
    """Profiles mixed by intent probability; graph x 1.3 if flow is over 0.2, symbol x 1.2 if symbol is over 0.3; sums to one."""
    out = {c: sum(p * WEIGHTS[i][c] for i, p in probabilities.items()) for c in ("vector", "lexical", "symbol", "graph")}
    out["graph"] *= 1.3 if probabilities.get("flow", 0) > 0.2 else 1
    out["symbol"] *= 1.2 if probabilities.get("symbol", 0) > 0.3 else 1
    total = sum(out.values())
    return {c: w / total for c, w in out.items()} if total else out


def co_terms(docs: DataFrame, key: str, text: str, window: int = 9) -> DataFrame:
    """a, b, n: symmetric counts of terms at most ``window`` apart, summed before the shuffle."""
    t = docs.select(F.col(key).alias("doc"), terms(F.col(text)).alias("ts"))
    e = t.select("ts", F.posexplode("ts").alias("i", "a")).select("a", F.explode(F.slice("ts", F.col("i") + 2, window)).alias("b")).where("a != b")
    return e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def searched(docs: DataFrame, needle: str, limit: int = 50, most: int = 1000) -> DataFrame:
    """Substring search; a limit under 1 or none is 50, at most 1000."""
    n = 50 if limit is None or limit < 1 else min(limit, most)
    return docs.where(F.contains("content", F.lit(needle))).orderBy("chunk_id").limit(n)
