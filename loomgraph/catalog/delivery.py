"""Queries over delivery of indexes, compiled rules, code patterns, bounded searches and tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import compiled as K
from ..operators import delivery as L
from ..operators import incremental as I
from ..operators import search as S
from ..plans import paths
from ..plans.selectors import E, Limits, Q
from ..plans.service import PlanExecutor, QueryPlan, Registry, escalated
from ..sources import parsers as P
from ..sources.tables import EDGES, HITS, NODES, edges, hits, nodes, read, with_
from .base import query
from .surface import _modules

_N, _E, _NE, _H = with_(NODES), with_(EDGES), with_(NODES, EDGES), with_(HITS)


def _text(c):
    return F.col(c).cast("string")


# --- delivery ---------------------------------------------------------------


@query("t11_consistency", "SELECT o_orderkey AS txn, o_orderkey % 2 = 1 OR o_orderkey <= (SELECT max(o_orderkey) // 2 FROM orders) AS ready FROM orders")
def t11(spark, sf):
    """Even transactions read strictly, from an index that has applied half of all."""
    o = read(spark, sf, "orders")
    reads = o.select(F.lit("lexical").alias("index"), F.col("o_orderkey").alias("txn"), F.when(F.col("o_orderkey") % 2 == 0, "strict").otherwise("eventual").alias("level"))
    applied = o.agg(F.floor(F.max("o_orderkey") / 2).alias("applied_up_to")).withColumn("index", F.lit("lexical"))
    return L.visible(reads, applied).select("txn", "ready")


@query("t18_freeze_buffer", "SELECT o_orderpriority AS index, o_orderkey AS seq, CASE WHEN o_orderkey BETWEEN 10 AND 50 THEN 51 WHEN o_orderkey BETWEEN 100 AND 300 THEN 301 ELSE o_orderkey END AS applied_at FROM orders")
def t18(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("index"), F.col("o_orderkey").alias("seq"))
    names = o.select("index").distinct()
    runs = names.withColumn("r", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last")) for a, b in ((10, 50), (100, 300))]))).select("index", "r.*")
    return L.frozen(o, runs)


@query("t22_resumed_jobs", "WITH h AS (SELECT c_custkey AS job, c_custkey % 4 AS n FROM customer WHERE c_custkey % 4 > 0) SELECT job, CASE n WHEN 3 THEN 1 ELSE n END AS done, CASE n WHEN 1 THEN 'parse' WHEN 2 THEN 'index' ELSE 'parse' END AS next FROM h")
def t22(spark, sf):
    """Jobs with the first, with the first two, or with the first and the third stage done."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("job"), (F.col("c_custkey") % 4).alias("n")).where("n > 0")
    log = c.select("job", F.explode(F.when(F.col("n") == 1, F.array(F.lit("scan"))).when(F.col("n") == 2, F.array(F.lit("scan"), F.lit("parse"))).otherwise(F.array(F.lit("scan"), F.lit("index")))).alias("stage"))
    return L.resumed(log, ["scan", "parse", "index"])


@query("t27_cache_tiers", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'time' WHEN p_partkey % 5 <> 0 THEN 'hash' ELSE 'miss' END AS tier FROM part")
def t27(spark, sf):
    k = F.col("p_partkey")
    tier = L.cache_tier(F.col("p_size"), F.col("p_size") + F.when(k % 3 == 0, 0).otherwise(1), F.md5("p_name"), F.md5(F.concat("p_name", F.when(k % 5 == 0, "x").otherwise(""))))
    return read(spark, sf, "part").select("p_partkey", tier.alias("tier"))


@query("t28_build_order", "SELECT 'r:1' AS node, 0 AS level UNION ALL SELECT 'n:' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 's:' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'c:' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def t28(spark, sf):
    """A region changes: its nations, then their customers and suppliers."""
    return L.build_order(spark.createDataFrame([("r:1",)], "id string"), edges(spark, sf).where("kind = 'CONTAINS'"))


# --- rules and code patterns ------------------------------------------------

_SPECS = {
    "big": {"all": [{"field": "p_size", "op": "at_least", "value": 30}, {"not": {"field": "p_brand", "op": "is", "value": "Brand#13"}}]},
    "named": {"any": [{"field": "p_name", "op": "like", "value": "*plate"}, {"field": "p_type", "op": "in", "value": ["PROMO", "SMALL"]}]},
    "cheap": {"field": "p_retailprice", "op": "at_most", "value": 920},
}


@query("n30_compiled_rules", "SELECT 'big' AS rule_id, p_partkey AS id FROM part WHERE p_size >= 30 AND p_brand <> 'Brand#13' UNION ALL SELECT 'named', p_partkey FROM part WHERE p_name LIKE '%plate' OR p_type IN ('PROMO', 'SMALL') UNION ALL SELECT 'cheap', p_partkey FROM part WHERE p_retailprice <= 920")
def n30(spark, sf):
    return K.findings(read(spark, sf, "part").withColumn("id", F.col("p_partkey")), _SPECS)


@query("n33_code_patterns", "SELECT p_partkey AS k, 6 AS line, 'f' || p_size || '(x)' AS code FROM part")
def n33(spark, sf):
    found = K.code_matches(_modules(spark, sf), "$F($X)")
    return found.select(F.regexp_extract("path", r"m(\d+)\.py", 1).cast("long").alias("k"), "line", "code")


@query("n33_repeated_metavariable", "SELECT p_partkey AS k FROM part WHERE p_size % 2 = 0")
def n33b(spark, sf):
    """The same expression on both sides."""
    code = F.concat(F.lit("y = a[0] + "), F.when(F.col("p_size") % 2 == 0, "a[0]").otherwise("a[1]"))
    files = read(spark, sf, "part").select(_text("p_partkey").alias("path"), code.alias("content"))
    return K.code_matches(files, "$X + $X").select(F.col("path").cast("long").alias("k"))


@query("x11_effect_patterns", "SELECT p_partkey, CASE WHEN p_name LIKE 'red %' THEN 'LOG' WHEN p_name LIKE '%plate' THEN 'IO' WHEN p_name LIKE '%o%' THEN 'READ' ELSE 'UNKNOWN' END AS effect FROM part")
def x11(spark, sf):
    patterns = [("red *", "LOG"), ("*plate", "IO"), ("*o*", "READ")]
    return read(spark, sf, "part").select("p_partkey", K.effect_of(F.col("p_name"), patterns).alias("effect"))


@query("x04_registered_scorer", "SELECT p_partkey, round(p_retailprice / 1000 + p_size / 100, 6) AS score FROM part")
def x04(spark, sf):
    """A scorer is a named plug-in that gives a Column."""
    scorers = Registry()
    scorers.register("price")(lambda df: F.col("p_retailprice") / 1000 + F.col("p_size") / 100)
    p = read(spark, sf, "part")
    return p.select("p_partkey", F.round(scorers("price", p), 6).alias("score"))


@query("x07_extractor_by_language", "SELECT lang, count(*) AS n FROM (SELECT CASE p_partkey % 2 WHEN 0 THEN 'python' ELSE 'markdown' END AS lang FROM part) GROUP BY lang")
def x07(spark, sf):
    """Files go to the extractor of their language."""
    files = read(spark, sf, "part").select(F.concat(_text("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, ".py").otherwise(".md")).alias("path"), F.when(F.col("p_partkey") % 2 == 0, "x = 1").otherwise("# Title\ntext").alias("content"))
    extractors = Registry()
    extractors.register("python")(lambda f: P.python_symbols(f).select("path"))
    extractors.register("markdown")(lambda f: P.markdown_sections(f).select("path"))
    parts = [extractors(n, files.where(P.language_of(F.col("path")) == n)).withColumn("lang", F.lit(n)) for n in ("python", "markdown")]
    return parts[0].unionByName(parts[1]).groupBy("lang").agg(F.count("*").alias("n"))


@query("s30_rule_files", "SELECT n_regionkey::VARCHAR AS path, 'R' || n_nationkey AS rule_id, 'type.' || n_name AS type, 'call*' AS call, CASE WHEN n_nationkey % 2 = 0 THEN 'high' ELSE 'medium' END AS severity, NULL AS cwe, NULL AS error FROM nation UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, NULL, 'KeyError'")
def s30(spark, sf):
    """A rule file for each region, with a rule for each of its nations; and one whose rule has no id."""
    n = read(spark, sf, "nation")
    rule = F.concat(F.lit('{"id": "R'), _text("n_nationkey"), F.lit('", "type": "type.'), F.col("n_name"), F.lit('", "call": "call*"'), F.when(F.col("n_nationkey") % 2 == 0, ', "severity": "HIGH"').otherwise(""), F.lit("}"))
    files = n.groupBy(_text("n_regionkey").alias("path")).agg(F.concat(F.lit('{"rules": ['), F.array_join(F.array_sort(F.collect_list(rule)), ", "), F.lit("]}")).alias("content"))
    broken = spark.createDataFrame([("broken", '[{"call": "x"}]')], "path string, content string")
    return K.rules_of(files.unionByName(broken))


@query("d07_exact_tier", "SELECT p_partkey AS id, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN 'exact' ELSE 'none' END AS tier FROM part")
def d07(spark, sf):
    """Digests of names: equal ones are exact clones, different ones are not alike."""
    from ..operators import clones as D

    return D.tiers(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.sha2("p_name", 512).alias("code")))


# --- analyses ---------------------------------------------------------------


@query("n08_value_propagation", "WITH n AS (SELECT 'n:' || n_nationkey AS node, n_regionkey + 1 AS v FROM nation) SELECT 'r:' || r_regionkey AS node, 0::BIGINT AS value FROM region UNION ALL SELECT node, v FROM n UNION ALL SELECT 's:' || s_suppkey, v + 2 FROM supplier JOIN n ON node = 'n:' || s_nationkey UNION ALL SELECT 'c:' || c_custkey, v + 2 FROM customer JOIN n ON node = 'n:' || c_nationkey")
def n08(spark, sf):
    """From regions down; an edge to a nation adds its region's number and one, an edge further down two."""
    e = edges(spark, sf).where("kind = 'CONTAINS'")
    down = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.when(F.col("dst").like("r:%"), F.substring("dst", 3, 9).cast("long") + 1).otherwise(2).alias("add"))
    start = read(spark, sf, "region").select(F.concat(F.lit("r:"), _text("r_regionkey")).alias("node"), F.lit(0).cast("long").alias("value"))
    return A.propagated(start, down)


_FLOWS = "f AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS sink, 'CWE-' || (l_linenumber % 3) AS cwe, ['info', 'low', 'medium', 'high', 'critical'][l_partkey % 5 + 1] AS severity, l_discount * 10 AS confidence FROM lineitem)"


@query("n11_taint_query", f"WITH {_FLOWS} SELECT source, sink, severity FROM f WHERE cwe = 'CWE-1' AND severity IN ('high', 'critical') AND confidence >= 0.3 AND source LIKE 's1%'")
def n11(spark, sf):
    li = read(spark, sf, "lineitem")
    severity = F.element_at(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    flows = li.select(F.concat(F.lit("s"), _text("l_suppkey")).alias("source"), F.concat(F.lit("p"), _text("l_partkey")).alias("sink"), F.concat(F.lit("CWE-"), (F.col("l_linenumber") % 3).cast("string")).alias("cwe"), severity.alias("severity"), (F.col("l_discount") * 10).alias("confidence"))
    return A.taint_query(flows, cwe="CWE-1", severity="high", confidence=0.3, source="^s1").select("source", "sink", "severity")


@query("n16_semantic_diff", "WITH p AS (SELECT p_partkey AS k FROM part) SELECT 'f' || k AS fqn, CASE k % 6 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'modified' END AS change, CASE k % 6 WHEN 2 THEN 'signature' WHEN 3 THEN 'calls' WHEN 4 THEN 'effects' END AS parts, k % 6 IN (0, 2, 4) AS breaking FROM p WHERE k % 6 < 5")
def n16(spark, sf):
    k = F.col("p_partkey")
    p = read(spark, sf, "part").withColumn("fqn", F.concat(F.lit("f"), _text("p_partkey")))
    old = p.where(k % 6 != 1).select("fqn", F.lit("a, b").alias("signature"), F.array(F.lit("g")).alias("calls"), F.array(F.lit("READ")).alias("effects"))
    new = p.where(k % 6 != 0).select("fqn", F.when(k % 6 == 2, "a").otherwise("a, b").alias("signature"), F.when(k % 6 == 3, F.array(F.lit("h"))).otherwise(F.array(F.lit("g"))).alias("calls"), F.when(k % 6 == 4, F.array(F.lit("READ"), F.lit("WRITE"))).otherwise(F.array(F.lit("READ"))).alias("effects"))
    return A.semantic_diff(old, new)


@query("g48_graph_of_files", "SELECT 'node' AS part, kind, n * (SELECT count(*) FROM part) AS n FROM (VALUES ('module', 1), ('class', 1), ('method', 1)) v(kind, n) UNION ALL SELECT 'edge', kind, n * (SELECT count(*) FROM part) FROM (VALUES ('IMPORTS', 1), ('CONTAINS', 2), ('INHERITS', 1), ('READS', 5), ('CALLS', 1)) v(kind, n)")
def g48(spark, sf):
    """Symbols and relations of files as nodes and edges of one graph."""
    return P.python_graph(_modules(spark, sf)).groupBy("part", "kind").agg(F.count("*").alias("n"))


# --- bounded searches -------------------------------------------------------


def _joined(df):
    return df.select(F.array_join("path", ">").alias("path"))


@query("f13_expansion_limit", "SELECT 's:' || s_suppkey || '>n:' || s_nationkey AS path FROM supplier WHERE s_nationkey < 5")
def f13(spark, sf):
    """Two depths would be needed for the regions; the second exceeds the bound."""
    n, e = nodes(spark, sf), edges(spark, sf)
    first = read(spark, sf, "supplier").count()
    ends = Q.kind("region") | Q.union(*[Q.by_id(f"n:{i}") for i in range(5)])
    flow = (Q.kind("supplier") >> ends).via(E.kinds("CONTAINS")).depth(3).bounded(Limits(10**6, first + 1))
    return _joined(paths.run(flow, n, e, flip=False))


@query("g46_presets", "SELECT path FROM (SELECT 's:' || s_suppkey AS a, 'n:' || s_nationkey AS b, 'r:' || n_regionkey AS c, a || '>' || b || '>' || c AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey < 25) ORDER BY a, b, c LIMIT 10")
def g46(spark, sf):
    """The realtime preset: depth 3, ten paths."""
    flow = (Q.union(*[Q.by_id(f"s:{i}") for i in range(25)]) >> Q.kind("region")).via(E.kinds("CONTAINS")).preset("realtime")
    return _joined(paths.run(flow, nodes(spark, sf), edges(spark, sf), flip=False))


@query("g45_light_budget", "SELECT 'o:' || o_orderkey || '>c:' || o_custkey AS path FROM orders WHERE o_orderkey BETWEEN 1 AND 40 ORDER BY 'o:' || o_orderkey LIMIT 10")
def g45(spark, sf):
    plan = QueryPlan("call_chain", tuple(f"o:{i}" for i in range(1, 41)), (), 1, "light")
    return _joined(PlanExecutor(nodes(spark, sf), edges(spark, sf)).execute(plan))


# --- retrieval --------------------------------------------------------------

_INTENTS = "i AS (SELECT DISTINCT query_id, ['code', 'symbol', 'flow', 'concept'][query_id % 4 + 1] AS intent FROM hits)"
_PRESETS = "w(intent, source, w) AS (VALUES ('code', 'vector', 0.4), ('code', 'lexical', 0.3), ('code', 'symbol', 0.2), ('symbol', 'vector', 0.1), ('symbol', 'lexical', 0.2), ('symbol', 'symbol', 0.5), ('flow', 'vector', 0.1), ('flow', 'lexical', 0.1), ('flow', 'symbol', 0.3), ('concept', 'vector', 0.6), ('concept', 'lexical', 0.2), ('concept', 'symbol', 0.1))"


def _intents(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("code", "symbol", "flow", "concept"))), (F.col("query_id") % 4 + 1).cast("int"))
    return hits(spark, sf).select("query_id", kind.alias("intent")).distinct()


@query("r12_weight_presets", _H + f", {_INTENTS}, {_PRESETS} SELECT query_id, source, w::DOUBLE AS weight FROM i JOIN w USING (intent)")
def r12(spark, sf):
    return S.weighted(_intents(spark, sf)).where("source != 'graph'").select("query_id", "source", "weight")


@query("r08_weights_by_intent", _H + f", {_INTENTS}, {_PRESETS} SELECT query_id, chunk_id, round(sum(greatest(0, least(1, score)) * w)::DOUBLE, 6) AS score FROM hits JOIN i USING (query_id) JOIN w USING (intent, source) GROUP BY ALL")
def r08(spark, sf):
    return S.fused_by_intent(hits(spark, sf), _intents(spark, sf)).withColumn("score", F.round("score", 6))


@query("r15_retrieval", _H + f", {_INTENTS}, {_PRESETS}, f AS (SELECT query_id, chunk_id, sum(greatest(0, least(1, score)) * w) AS s FROM hits JOIN i USING (query_id) JOIN w USING (intent, source) GROUP BY ALL) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s::DOUBLE, 9) DESC, chunk_id) AS place FROM f QUALIFY place <= 5")
def r15(spark, sf):
    """Intent, weights, fusion and cut in one call."""
    return S.retrieved(hits(spark, sf), _intents(spark, sf), 5).select("query_id", "chunk_id", "place")


@query("r22_golden_set", "SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS answer FROM orders WHERE o_orderkey % 5 <> 0")
def r22(spark, sf):
    """A golden set after additions, changes and removals: the last operation of each entry counts."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    op = lambda df, seq, name, answer: df.select("key", F.lit(seq).alias("seq"), F.lit(name).alias("op"), F.lit(answer).alias("answer"))
    log = op(o, 1, "add", "old").unionByName(op(o.where("key % 3 = 0"), 2, "update", "new")).unionByName(op(o.where("key % 5 = 0"), 3, "remove", None))
    return I.latest(log).select(F.col("key").alias("query_id"), "answer")


@query("r24_escalated_strategy", "SELECT 'deep' AS strategy, p_partkey AS id FROM part WHERE p_size >= 40")
def r24(spark, sf):
    """The cheap strategy finds nothing good enough, so the deep one answers."""
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("score"))
    name, found = escalated("big", [("cheap", lambda q: p.where("score < 0.2")), ("deep", lambda q: p.where("score >= 0.8"))], 0.5)
    return found.select(F.lit(name).alias("strategy"), "id")


# --- tools ------------------------------------------------------------------


@query("z06_slice", "SELECT DISTINCT 'c:' || o_custkey AS node FROM orders WHERE o_orderkey IN (1, 2, 3) UNION SELECT 'n:' || c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey IN (1, 2, 3) UNION SELECT 'r:' || n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey IN (1, 2, 3)")
def z06(spark, sf):
    plan = QueryPlan("slice", ("o:1", "o:2", "o:3"), (), 3, "heavy")
    e = edges(spark, sf).where("kind IN ('CALLS', 'CONTAINS')")
    return paths.reach(e, nodes(spark, sf).where(F.col("id").isin(*plan.sources)).select("id"), plan.depth).select("node").distinct()


@query("z09_references", _E + "SELECT 'references' AS tool, src AS id FROM edges WHERE dst = 'p:5' AND kind = 'REFERENCES' UNION ALL SELECT 'callers', src FROM edges WHERE dst = 'c:1' AND kind = 'CALLS'")
def z09(spark, sf):
    from ..plans.builder import EdgeQuery

    e = EdgeQuery(edges(spark, sf))
    refs = e.references_to("p:5").execute().select(F.lit("references").alias("tool"), F.col("src").alias("id"))
    return refs.unionByName(e.callers_of("c:1").execute().select(F.lit("callers").alias("tool"), F.col("src").alias("id")))


@query("z10_preview_impact", "SELECT 'n:' || n_nationkey AS node, 1 AS distance FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 's:' || s_suppkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2 UNION ALL SELECT 'c:' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def z10(spark, sf):
    """What a change of a region touches."""
    start = spark.createDataFrame([("r:2",)], "id string")
    return paths.reach(edges(spark, sf).where("kind = 'CONTAINS'"), start, 2, backward=True).select("node", "distance")
