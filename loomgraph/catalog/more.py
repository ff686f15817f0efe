"""Further queries: fields, scopes, sketches, overlays, pages, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analysis as A
from ..operators import extra as M
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import ranking as R
from ..operators import rules as U
from ..operators import search as S
from ..plans import paths
from ..plans.builder import field_value
from ..plans.selectors import E, Q
from ..sources import parsers as P
from ..sources.store import sarif
from ..sources.tables import EDGES, GOLDEN, HITS, NODES, edges, golden, hits, nodes, read, with_
from .base import query

_N, _E, _NE, _H = with_(NODES), with_(EDGES), with_(NODES, EDGES), with_(HITS)


def _starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query("s01_document_scan", _NE + "SELECT 'nodes' AS part, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")
def s01(spark, sf):
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return count(nodes(spark, sf), "nodes").unionByName(count(edges(spark, sf), "edges"))


@query("s02_graph_index", _NE + "SELECT n.id, n.name, count(e.dst) AS outgoing FROM nodes n LEFT JOIN edges e ON e.src = n.id WHERE n.kind IN ('nation', 'region', 'supplier') GROUP BY ALL")
def s02(spark, sf):
    n = nodes(spark, sf).where("kind in ('nation', 'region', 'supplier')").select("id", "name")
    return n.join(edges(spark, sf).select(F.col("src").alias("id"), "dst"), "id", "left").groupBy("id", "name").agg(F.count("dst").alias("outgoing"))


@query("s11_normalized_paths", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/b' || p_size || '.py' WHEN 1 THEN 'a/' || p_size WHEN 2 THEN NULL ELSE 'x/y' END AS path FROM part")
def s11(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("./a//b"), n, F.lit(".py"))).when(k == 1, F.concat(F.lit("a\\z\\..\\"), n)).when(k == 2, "../up").otherwise("x/./y")
    return read(spark, sf, "part").select("p_partkey", P.normalized_path(raw).alias("path"))


@query("s13_payload_order", _N + "SELECT id, row_number() OVER (ORDER BY file_path NULLS FIRST, kind, id) AS place FROM nodes")
def s13(spark, sf):
    n = nodes(spark, sf)
    order = [F.col("file_path").asc_nulls_first(), F.col("kind"), F.col("id")]
    # places without one task for all rows: ranks inside files, after the counts of the files before
    inside = F.row_number().over(Window.partitionBy("file_path").orderBy(*order[1:]))
    sizes = n.groupBy("file_path").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("file_path").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = sizes.select(F.col("file_path").alias("f"), before.alias("before"))
    return n.withColumn("inside", inside).join(heads, F.col("file_path").eqNullSafe(F.col("f"))).select("id", (F.col("before") + F.col("inside")).cast("long").alias("place"))


@query("s14_import_edges", _E + "SELECT src AS source_id, dst AS target_id FROM edges WHERE kind = 'REFERENCES'")
def s14(spark, sf):
    return edges(spark, sf).where("kind = 'REFERENCES'").select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"))


@query("s28_findings_json", """SELECT p_partkey AS line, '{"ruleId":"R' || p_size || '","level":"warning","message":{"text":"' || p_name || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || p_brand || '"},"region":{"startLine":' || p_partkey || '}}}]}' AS result FROM part""")
def s28(spark, sf):
    f = read(spark, sf, "part").select(F.concat(F.lit("R"), F.col("p_size").cast("string")).alias("rule_id"), F.col("p_name").alias("message"), F.lit("warning").alias("level"), F.col("p_brand").alias("path"), F.col("p_partkey").alias("line"))
    return sarif(f).select("line", "result")


@query("s26_history_rows", "SELECT 'c' || c_custkey AS \"commit\", 'f' || c_nationkey || '.py' AS file, c_nationkey::BIGINT AS adds, 1::BIGINT AS dels FROM customer UNION ALL SELECT 'd' || c_custkey, 'g.py', 2, 0 FROM customer")
def s26(spark, sf):
    """A log of two commits for each customer; binary files have no counts."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    log = F.concat(F.lit("c"), k, F.lit("|2024-01-01\n"), n, F.lit("\t1\tf"), n, F.lit(".py\n-\t-\tb.bin\nd"), k, F.lit("|2024-01-02\n2\t0\tg.py"))
    return P.git_log(read(spark, sf, "customer").select(k.alias("path"), log.alias("content"))).select("commit", "file", "adds", "dels")


@query("f04_field_value", _N + "SELECT id, coalesce(name, '') AS name, coalesce(file_path, '') AS file, coalesce(metadata, '') AS other FROM nodes")
def f04(spark, sf):
    return nodes(spark, sf).select("id", field_value("name").alias("name"), field_value("file_path").alias("file"), field_value("anything").alias("other"))


@query("f07_combined_filters", _N + "SELECT id FROM nodes WHERE kind = 'customer' AND file_path = 'MACHINERY' AND value > 0 AND name LIKE '%1%'")
def f07(spark, sf):
    from ..plans.builder import NodeQuery

    return NodeQuery(nodes(spark, sf)).filter("customer").where_field("file_path", "MACHINERY").where(lambda: F.col("value") > 0).where(F.expr("name like '%1%'")).execute().select("id")


@query("f14_factories", _N + "SELECT kind, count(*) AS n FROM nodes WHERE kind IN ('order', 'part') GROUP BY kind")
def f14(spark, sf):
    return nodes(spark, sf).where((Q.kind("Order") | Q.kind("PART")).column()).groupBy("kind").agg(F.count("*").alias("n"))


@query("f30_scope_expansion", _E + "SELECT DISTINCT id FROM (SELECT 'n:3' AS id UNION ALL SELECT src FROM edges WHERE kind = 'CONTAINS' AND dst = 'n:3')")
def f30(spark, sf):
    e = edges(spark, sf).where("kind = 'CONTAINS'")
    r = paths.reach(e, _starts(spark, "n:3"), 1, backward=True)
    return r.select(F.col("node").alias("id")).unionByName(_starts(spark, "n:3")).distinct()


@query("f36_kwarg_constraint", "SELECT p_partkey, p_size % 2 = 0 AS ok, CASE WHEN p_size % 2 = 0 THEN 0.15 ELSE 0 END::DOUBLE AS delta FROM part")
def f36(spark, sf):
    kw = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("verify"), F.lit("False"))).otherwise(F.create_map(F.lit("x"), F.lit("1")))
    v = U.kwarg(kw, "verify", "False")
    return read(spark, sf, "part").select("p_partkey", v["ok"].alias("ok"), v["delta"].alias("delta"))


@query("f37_guard", "SELECT p_partkey, p_size % 3 <> 0 AS ok, CASE WHEN p_size % 3 = 1 THEN -0.6 ELSE 0 END::DOUBLE AS delta FROM part")
def f37(spark, sf):
    effect = F.when(F.col("p_size") % 3 == 0, "block").when(F.col("p_size") % 3 == 1, "reduce").otherwise("allow")
    v = U.guard(F.array(F.struct(F.lit("k").alias("kind"), F.lit("is_safe()").alias("pattern"), effect.alias("effect"), F.lit(0.4).alias("multiplier"))), "k", "safe")
    return read(spark, sf, "part").select("p_partkey", v["ok"].alias("ok"), F.round(v["delta"], 6).alias("delta"))


@query("f38_prefilters", "SELECT p_partkey, starts_with(p_name, 'a') AS a, ends_with(p_type, 'ARD') AS b, p_size % 4 > 1 AS c FROM part")
def f38(spark, sf):
    args = F.sequence(F.lit(0), F.col("p_size") % 4 - 1)
    args = F.when(F.col("p_size") % 4 > 0, args).otherwise(F.array().cast("array<int>"))
    return read(spark, sf, "part").select("p_partkey", U.call_startswith(F.col("p_name"), "a").alias("a"), U.type_endswith(F.col("p_type"), "ARD").alias("b"), U.has_arg_index(args, 1).alias("c"))


@query("j04_relative_imports", "WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS d, 'a' || p_size AS a, 'b' || p_partkey AS b FROM part) SELECT a || '.' || b || '.c' AS module, ['.', '..', '...'][d + 1] || 'd' || k AS target, CASE d WHEN 0 THEN a || '.' || b || '.' WHEN 1 THEN a || '.' ELSE '' END || 'd' || k AS fqn FROM p")
def j04(spark, sf):
    """One, two or three dots go up as many steps."""
    k, n, at = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), (F.col("p_partkey") % 3 + 1).cast("int")
    a, b, d = F.concat(F.lit("a"), n), F.concat(F.lit(".b"), k), F.concat(F.lit("d"), k)
    p = read(spark, sf, "part")
    imports = p.select(F.concat(a, b, F.lit(".c")).alias("module"), F.concat(F.element_at(F.array(F.lit("."), F.lit(".."), F.lit("...")), at), d).alias("target"))
    symbols = p.select(F.element_at(F.array(F.concat(a, b, F.lit("."), d), F.concat(a, F.lit("."), d), d), at).alias("fqn"))
    return A.resolved_imports(imports, symbols).select("module", "target", "fqn")


@query("j05_scope_lookup", "SELECT c_custkey AS use, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '.x' ELSE 'r' || n_regionkey || '.x' END AS fqn FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j05(spark, sf):
    s = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    scopes = c.select(s("c", "c_custkey").alias("scope"), s("n", "c_nationkey").alias("parent")).unionByName(n.select(s("n", "n_nationkey").alias("scope"), s("r", "n_regionkey").alias("parent")))
    symbols = r.select(s("r", "r_regionkey").alias("scope")).unionByName(c.where("c_custkey % 3 = 0").select(s("c", "c_custkey").alias("scope"))).select("scope", F.lit("x").alias("name"), F.concat("scope", F.lit(".x")).alias("fqn"), F.lit(False).alias("alias"))
    return M.scope_lookup(c.select(F.col("c_custkey").alias("use"), s("c", "c_custkey").alias("scope"), F.lit("x").alias("name")), scopes, symbols)


@query("j12_co_occurrence", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL")
def j12(spark, sf):
    from ..operators.history import co_changes

    li = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("commit"), F.col("l_suppkey").alias("path"))
    return co_changes(li, widest=1_000_000).select("a", "b", F.col("together").alias("n"))


@query("j18_type_property", "SELECT p_partkey FROM part WHERE (p_type, p_size) IN (('STANDARD', 5), ('PROMO', 7), ('ECONOMY', 9))")
def j18(spark, sf):
    index = spark.createDataFrame([("STANDARD", 5), ("PROMO", 7), ("ECONOMY", 9)], "p_type string, p_size int")
    return read(spark, sf, "part").join(index, ["p_type", "p_size"], "left_semi").select("p_partkey")


@query("j21_enriched_hits", _H + "SELECT query_id, h.source, h.chunk_id, coalesce(d.n_chars, 0) AS n_chars FROM hits h LEFT JOIN documents d ON 'd:' || d.doc_id = h.chunk_id AND d.doc_id % 2 = 0")
def j21(spark, sf):
    d = read(spark, sf, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("chunk_id"), "n_chars")
    return hits(spark, sf).drop("score").join(d, "chunk_id", "left").fillna(0, ["n_chars"])


@query("a18_hash_stats", "SELECT count(*) AS hashes, sum((n > 1)::INT)::BIGINT AS collisions, round(avg(n), 6) AS mean FROM (SELECT md5(p_type) AS h, count(*) AS n FROM part GROUP BY 1)")
def a18(spark, sf):
    h = read(spark, sf, "part").groupBy(F.md5("p_type").alias("h")).agg(F.count("*").alias("n"))
    return h.agg(F.count("*").alias("hashes"), F.sum((F.col("n") > 1).cast("int")).alias("collisions"), F.round(F.avg("n"), 6).alias("mean"))


@query("a25_golden_stats", with_(HITS, GOLDEN) + "SELECT CASE WHEN query_id % 3 = 0 THEN 'easy' ELSE 'hard' END AS difficulty, count(DISTINCT query_id) AS queries, count(*) AS relevant FROM golden GROUP BY 1")
def a25(spark, sf):
    return golden(spark, sf).groupBy(F.when(F.col("query_id") % 3 == 0, "easy").otherwise("hard").alias("difficulty")).agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("relevant"))


@query("a29_effect_merge", "SELECT o_custkey AS fn, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS effects, min(o_totalprice) AS confidence, bool_and(o_orderstatus = 'F') AS idempotent FROM orders GROUP BY 1")
def a29(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("fn")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("effects"), F.min("o_totalprice").alias("confidence"), F.bool_and(F.col("o_orderstatus") == "F").alias("idempotent"))


@query("a33_scope_stats", _N + "SELECT kind, count(*) AS n, count(DISTINCT file_path) AS files FROM nodes GROUP BY kind")
def a33(spark, sf):
    return nodes(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))


@query("a34_bloom_filter", "WITH h AS (SELECT p_name, p_partkey % 2 = 0 AS member, ('0x' || substr(sha256(p_name), 1, 12))::BIGINT AS a, ('0x' || substr(sha256(p_name), 13, 12))::BIGINT AS b FROM (SELECT p_name || p_partkey AS p_name, p_partkey FROM part)), pos AS (SELECT p_name, member, (a + i * b) % 4793 AS bit FROM h, generate_series(0, 6) g(i)), bits AS (SELECT DISTINCT bit FROM pos WHERE member) SELECT p_name, bool_and(bit IN (SELECT bit FROM bits)) AS maybe FROM pos GROUP BY p_name")
def a34(spark, sf):
    p = read(spark, sf, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("p_name"), (F.col("p_partkey") % 2 == 0).alias("member"))
    m, k = M.bloom_shape(500, 0.01)
    return M.might_contain(p.select("p_name"), "p_name", M.bloom(p.where("member"), "p_name", m, k), m, k)


@query("w11_position_weights", "SELECT o_custkey AS query_id, o_orderkey AS chunk_id, round(o_totalprice * CASE WHEN s <= 0.25 OR s >= 0.75 THEN 1.2 ELSE 0.9 END, 4) AS score FROM (SELECT *, (row_number() OVER w - 1) / greatest(1, count(*) OVER (PARTITION BY o_custkey) - 1)::DOUBLE AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))")
def w11(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score"))
    o = o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    return M.position_weights(o).select("query_id", "chunk_id", F.round("score", 4).alias("score"))


@query("w15_period_changes", "SELECT m::VARCHAR AS month, greatest(0, n - coalesce(lag(n) OVER (ORDER BY m), n)) AS added, greatest(0, coalesce(lag(n) OVER (ORDER BY m), n) - n) AS deleted FROM (SELECT date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders GROUP BY 1)")
def w15(spark, sf):
    m = read(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.lag("n").over(Window.orderBy("month")), F.col("n"))  # one row a month
    return m.select(F.col("month").cast("string").alias("month"), F.greatest(F.lit(0), F.col("n") - before).alias("added"), F.greatest(F.lit(0), before - F.col("n")).alias("deleted"))


@query("k03_batches", _N + "SELECT (row_number() OVER (ORDER BY id) - 1) // 300 AS batch, id FROM nodes WHERE kind = 'customer'")
def k03(spark, sf):
    c = nodes(spark, sf).where("kind = 'customer'").select("id")
    return c.select(F.floor((F.row_number().over(Window.orderBy("id")) - 1) / 300).alias("batch"), "id")


@query("k09_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 30 OFFSET 60")
def k09(spark, sf):
    from ..plans.service import cursor, page

    return page(read(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 30, cursor(60))[0].select("o_orderkey")


@query("k11_longest_path", "WITH RECURSIVE " + EDGES + """, e AS (SELECT DISTINCT src, dst FROM edges),
p(src, dst, depth) AS (SELECT 'o:' || i, 'o:' || i, 0 FROM range(1, 8) t(i) UNION SELECT p.src, e.dst, depth + 1 FROM p JOIN e ON e.src = p.dst WHERE depth < 5)
SELECT src, dst, max(depth)::INT AS depth FROM p WHERE dst LIKE 'r:%' GROUP BY src, dst""")
def k11(spark, sf):
    """Orders reach regions by their customers (three steps) or their parts and suppliers (four)."""
    flow = (Q.union(*[Q.by_id(f"o:{i}") for i in range(1, 8)]) >> Q.kind("region")).via(E.all).depth(5).unlimited()
    return paths.longest(paths.run(flow, nodes(spark, sf), edges(spark, sf))).select("src", "dst", "depth")


@query("k13_structure_order", _H + "SELECT query_id, source, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE source WHEN 'symbol' THEN 0 WHEN 'lexical' THEN 1 ELSE 2 END, score DESC, chunk_id) AS place FROM hits")
def k13(spark, sf):
    role = F.when(F.col("source") == "symbol", 0).when(F.col("source") == "lexical", 1).otherwise(2)
    return hits(spark, sf).select("query_id", "source", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(role, F.desc("score"), "chunk_id")).cast("long").alias("place"))


@query("u02_selector_intersection", _N + "SELECT id FROM nodes WHERE kind = 'part' AND file_path = 'Brand#22'")
def u02(spark, sf):
    return nodes(spark, sf).where((Q.kind("part") & Q.in_file("Brand#22")).column()).select("id")


@query("u03_edge_union", _E + "SELECT kind, count(*) AS n FROM edges WHERE kind IN ('CALLS', 'DATAFLOW', 'CONTAINS') GROUP BY kind")
def u03(spark, sf):
    return edges(spark, sf).where((E.call | E.dfg | E.kinds("CONTAINS")).column()).groupBy("kind").agg(F.count("*").alias("n"))


@query("u04_union_flow", _E + "SELECT a.src, b.dst FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src IN ('c:1', 's:1', 's:2') AND a.kind = 'CONTAINS' AND b.kind = 'CONTAINS'")
def u04(spark, sf):
    flow = (Q.union(Q.by_id("c:1"), Q.by_id("s:1"), Q.by_id("s:2")) >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(2)
    return paths.run(flow, nodes(spark, sf), edges(spark, sf)).select("src", "dst")


@query("g12_all_paths_pass", _E + "SELECT a.src, bool_and(a.dst IN ('n:3', 'n:7', 'n:11') AND b.dst <> 'r:0') AS holds FROM edges a JOIN edges b ON b.src = a.dst WHERE a.kind = 'CONTAINS' AND b.kind = 'CONTAINS' AND a.src LIKE 's:%' GROUP BY a.src")
def g12(spark, sf):
    flow = (Q.kind("supplier") >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(2).unlimited()
    found = paths.run(flow, nodes(spark, sf), edges(spark, sf))
    passes = F.arrays_overlap("path", F.array(F.lit("n:3"), F.lit("n:7"), F.lit("n:11"))) & (F.col("dst") != "r:0")
    return found.groupBy("src").agg(F.bool_and(passes).alias("holds"))


@query("g18_dead_blocks", _E + "SELECT a.src, b.dst FROM edges a JOIN edges b ON b.src = a.dst WHERE a.kind = 'CONTAINS' AND b.kind = 'CONTAINS' AND a.src LIKE 's:%' AND a.dst NOT IN ('n:1', 'n:2', 'n:4')")
def g18(spark, sf):
    dead = Q.union(*[Q.by_id(f"n:{i}") for i in (1, 2, 4)])
    flow = (Q.kind("supplier") >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(2).excluding(dead).unlimited()
    return paths.run(flow, nodes(spark, sf), edges(spark, sf)).select("src", "dst")


@query("g25_symbol_impact", _E + "SELECT d.dst AS changed, count(DISTINCT d.src) AS direct, count(DISTINCT d.src) FILTER (d.src NOT LIKE '%7') AS outside_tests FROM edges d WHERE d.kind IN ('CALLS', 'REFERENCES') GROUP BY d.dst")
def g25(spark, sf):
    e = edges(spark, sf).where("kind in ('CALLS', 'REFERENCES')").select("src", "dst").distinct()
    return e.groupBy(F.col("dst").alias("changed")).agg(F.count("*").alias("direct"), F.sum((~F.col("src").like("%7")).cast("int")).alias("outside_tests"))


@query("g26_rebuild_cost", _E + "SELECT n AS symbols, n * 5 AS milliseconds, n // 10 AS files FROM (SELECT count(DISTINCT id) AS n FROM (SELECT 'c:1' AS id UNION ALL SELECT 'c:2' UNION ALL SELECT src FROM edges WHERE kind = 'CALLS' AND dst IN ('c:1', 'c:2')))")
def g26(spark, sf):
    return M.rebuild_cost(_starts(spark, "c:1", "c:2"), edges(spark, sf).where("kind = 'CALLS'"))


@query("g37_both_ways", _E + ", f AS (SELECT dst AS node, 0.85 * 0.6 AS s FROM edges WHERE kind = 'CONTAINS' AND src = 'n:3' UNION ALL SELECT src, 0.85 * 0.4 FROM edges WHERE kind = 'CONTAINS' AND dst = 'n:3') SELECT 'n:3' AS start, node, round(max(s), 6)::DOUBLE AS score FROM (SELECT * FROM f WHERE s > 0.4 UNION ALL SELECT * FROM (SELECT * FROM f WHERE s < 0.4 ORDER BY node LIMIT 40)) GROUP BY node")
def g37(spark, sf):
    return G.both_ways(edges(spark, sf).where("kind = 'CONTAINS'"), _starts(spark, "n:3"), 1).select("start", "node", F.round("score", 6).alias("score"))


@query("g47_path_parts", _E + "SELECT a.src, a.dst = 'n:3' AS has_node, a.src || '>' || a.dst AS sub FROM edges a JOIN edges b ON b.src = a.dst WHERE a.kind = 'CONTAINS' AND b.kind = 'CONTAINS' AND a.src LIKE 's:%'")
def g47(spark, sf):
    flow = (Q.kind("supplier") >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(2).unlimited()
    return paths.run(flow, nodes(spark, sf), edges(spark, sf)).select("src", F.array_contains("path", "n:3").alias("has_node"), F.array_join(F.slice("path", 1, 2), ">").alias("sub"))


@query("g49_overlay_graph", _E + ", b AS (SELECT src, dst FROM edges WHERE kind = 'CONTAINS') SELECT src, dst FROM b WHERE NOT (src LIKE 's:%' AND dst = 'n:3') UNION ALL SELECT 'x:1', 'n:1'")
def g49(spark, sf):
    b = edges(spark, sf).where("kind = 'CONTAINS'").select("src", "dst")
    ops = b.where("src like 's:%' and dst = 'n:3'").select("src", "dst", F.lit("remove").alias("op"), F.lit(1).alias("seq"))
    ops = ops.unionByName(spark.createDataFrame([("x:1", "n:1", "remove", 1), ("x:1", "n:1", "add", 2)], "src string, dst string, op string, seq int"))
    return M.overlaid(b, ops)


@query("g50_one_hop", _E + "SELECT 'callers' AS part, src AS node FROM edges WHERE kind = 'CALLS' AND dst = 'c:7' UNION ALL SELECT 'references', dst FROM edges WHERE kind = 'REFERENCES' AND src = 'o:7'")
def g50(spark, sf):
    e = edges(spark, sf)
    return e.where("kind = 'CALLS' and dst = 'c:7'").select(F.lit("callers").alias("part"), F.col("src").alias("node")).unionByName(e.where("kind = 'REFERENCES' and src = 'o:7'").select(F.lit("references").alias("part"), F.col("dst").alias("node")))


@query("r07_hit_rows", _H + "SELECT query_id, source, chunk_id, score AS score_raw, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_id) AS rank FROM hits")
def r07(spark, sf):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "chunk_id")
    return hits(spark, sf).select("query_id", "source", "chunk_id", F.col("score").alias("score_raw"), F.row_number().over(w).cast("long").alias("rank"))


_INTENT = "CASE query_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'symbol' ELSE 'flow' END"


@query("r14_fan_out", _H + f"SELECT query_id, source, count(*) AS n FROM (SELECT *, {_INTENT} AS intent FROM hits) WHERE intent = 'code' AND source IN ('lexical', 'vector') OR intent = 'symbol' AND source IN ('symbol', 'lexical') OR intent = 'flow' AND source = 'symbol' GROUP BY ALL")
def r14(spark, sf):
    h = hits(spark, sf)
    i = h.select("query_id").distinct().withColumn("intent", F.when(F.col("query_id") % 3 == 0, "code").when(F.col("query_id") % 3 == 1, "symbol").otherwise("flow"))
    return S.fan_out(h, i).groupBy("query_id", "source").agg(F.count("*").alias("n"))


@query("r11_blended_fusion", _H + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS rank FROM hits), w AS (SELECT 0.25 / 1.21 AS vector, 0.25 / 1.21 AS lexical, 0.35 * 1.2 / 1.21 AS symbol) SELECT query_id, chunk_id, round(sum(CASE source WHEN 'vector' THEN vector / (70 + rank) WHEN 'lexical' THEN lexical / (70 + rank) ELSE symbol / (50 + rank) END), 6)::DOUBLE AS score FROM ranked, (SELECT 0.25 / t AS vector, 0.25 / t AS lexical, 0.42 / t AS symbol FROM (SELECT 0.25 + 0.25 + 0.42 + 0.15 AS t)) GROUP BY ALL")
def r11(spark, sf):
    w = S.blended_weights({"code": 0.5, "symbol": 0.5})
    return R.weighted_rrf(hits(spark, sf), w).withColumn("score", F.round("score", 6))


@query("r16_structural_rerank", "SELECT p_partkey, round(0.3 * (p_partkey % 2 = 0)::INT + 0.25 * (p_size % 3 = 0)::INT, 6)::DOUBLE AS score FROM part")
def r16(spark, sf):
    a = F.struct(F.array((F.col("p_partkey") % 2).cast("string")).alias("signature"), F.array((F.col("p_size") % 3).cast("string")).alias("hierarchy"))
    b = F.struct(F.array(F.lit("0")).alias("signature"), F.array(F.lit("0")).alias("hierarchy"))
    return read(spark, sf, "part").select("p_partkey", F.round(M.structural_score(a, b, {"signature": 0.3, "hierarchy": 0.25}), 6).alias("score"))


@query("r25_search_limit", "SELECT doc_id FROM documents WHERE contains(text, 'and') ORDER BY 'd:' || doc_id LIMIT 50")
def r25(spark, sf):
    from ..sources.tables import chunks

    return S.searched(chunks(spark, sf), "and", 0).select(F.substring("chunk_id", 3, 12).cast("long").alias("doc_id"))


@query("d09_clone_filters", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 10 >= 8 AND least(a.p_size, b.p_size) >= 10 AND a.p_partkey % 7 <> 0 AND b.p_partkey % 7 <> 0 ORDER BY a.p_partkey % 10 DESC, a, b LIMIT 40")
def d09(spark, sf):
    from ..operators import clones

    p = read(spark, sf, "part")
    f = p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("loc"), F.lit(100).alias("tokens"), (F.col("p_partkey") % 7 == 0).alias("is_test"))
    pairs = p.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), (F.col("p_partkey") % 10 / 10.0).alias("similarity"))
    return clones.filtered(pairs, f, least=0.8, loc=10, tests=False, limit=40).select("a", "b")


@query("t13_incremental_update", _E + "SELECT DISTINCT id FROM (SELECT 'c:1' AS id UNION ALL SELECT src FROM edges WHERE dst = 'c:1' AND kind = 'CALLS')")
def t13(spark, sf):
    changed = _starts(spark, "c:1")
    r = paths.reach(edges(spark, sf).where("kind = 'CALLS'"), changed, 5, backward=True)
    return r.select(F.col("node").alias("id")).unionByName(changed).distinct()


@query("t15_replace_file", "SELECT is_deleted, count(*) AS n FROM (SELECT doc_id % 5 = 0 OR source = 'src1' AS is_deleted FROM documents UNION ALL SELECT false FROM documents WHERE source = 'src1') GROUP BY 1")
def t15(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("file_path"), F.lit("s").alias("snapshot_id"), (F.col("doc_id") % 5 == 0).alias("is_deleted"))
    new = d.where("file_path = 'src1'").withColumn("is_deleted", F.lit(False))
    return I.replace_file(d, new, "src1", "s").groupBy("is_deleted").agg(F.count("*").alias("n"))


@query("t16_soft_delete", "SELECT doc_id FROM documents WHERE NOT (doc_id % 5 = 0 OR source = 'src2')")
def t16(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("file_path"), F.lit("s").alias("snapshot_id"), (F.col("doc_id") % 5 == 0).alias("is_deleted"))
    return I.soft_delete(d, "src2", "s").where("not is_deleted").select("doc_id")


@query("n06_unchecked_dereferences", "SELECT u.l_orderkey AS fn, u.l_suppkey AS var, u.l_linenumber AS line FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N') u LEFT JOIN (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS c FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL) k ON k.l_orderkey = u.l_orderkey AND k.l_suppkey = u.l_suppkey WHERE c IS NULL OR c >= u.l_linenumber")
def n06(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fn"), F.col("l_suppkey").alias("var"), F.col("l_linenumber").alias("line"), "l_returnflag")
    return M.unchecked_dereferences(li.where("l_returnflag != 'N'").drop("l_returnflag").distinct(), li.where("l_returnflag = 'N'"))


@query("n07_graph_tabulation", "WITH RECURSIVE " + EDGES + ", e AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('CALLS', 'CONTAINS')), r(node) AS (SELECT 'o:1' UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r WHERE node <> 'o:1'")
def n07(spark, sf):
    return paths.reach(edges(spark, sf).where("kind in ('CALLS', 'CONTAINS')"), _starts(spark, "o:1"), 50).select("node")


@query("n10_function_summaries", "SELECT l_orderkey AS fn, coalesce(array_to_string(list_sort(list_distinct(list(l_linenumber::VARCHAR) FILTER (l_returnflag = 'N'))), ','), '') AS params, bool_or(l_returnflag = 'R') AS globals FROM lineitem GROUP BY 1")
def n10(spark, sf):
    flows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fn"), F.lit("param").alias("from_kind"), F.col("l_linenumber").alias("index"), F.when(F.col("l_returnflag") == "N", "return").when(F.col("l_returnflag") == "R", "global").otherwise("local").alias("to_kind"))
    return M.summaries(flows)


@query("n28_occurrence_roles", "SELECT l_partkey AS symbol, l_shipdate::DATE::VARCHAR AS file, bit_or(CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 8 ELSE 4 END)::INT AS roles FROM lineitem GROUP BY ALL")
def n28(spark, sf):
    role = F.when(F.col("l_linenumber") % 3 == 0, "definition").when(F.col("l_linenumber") % 3 == 1, "read").otherwise("write")
    return M.roles(read(spark, sf, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_shipdate").cast("date").cast("string").alias("file"), role.alias("role")))


@query("n31_trigram_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%bolt%'")
def n31(spark, sf):
    rules = spark.createDataFrame([("r", "*bolt*")], "rule_id string, pattern string")
    p = read(spark, sf, "part")
    return U.matches(rules, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))).join(p.select(F.col("p_partkey").alias("id"), "p_name").hint("merge"), "id").select(F.col("id").alias("p_partkey"), "p_name")


@query("n32_prefix_trie", "SELECT substr(t, 1, n) AS prefix, count(*) AS words FROM (SELECT DISTINCT p_type AS t FROM part), generate_series(1, 6) g(n) WHERE n <= length(t) GROUP BY 1")
def n32(spark, sf):
    return M.prefix_counts(read(spark, sf, "part"), "p_type", 6)


@query("n26_chunk_hierarchy", "SELECT kind || ':' || fqn AS chunk, parent, level FROM (SELECT 'file' AS kind, p_brand AS fqn, NULL AS parent, 3 AS level FROM part GROUP BY p_brand UNION ALL SELECT 'class', p_brand || '.' || p_type, 'file:' || p_brand, 4 FROM part GROUP BY p_brand, p_type UNION ALL SELECT 'function', p_name || p_partkey, 'class:' || p_brand || '.' || p_type, 5 FROM part)")
def n26(spark, sf):
    p = read(spark, sf, "part")
    f = p.select("p_brand").distinct().select(F.lit("file").alias("kind"), F.col("p_brand").alias("fqn"), F.lit(None).cast("string").alias("parent"))
    c = p.select("p_brand", "p_type").distinct().select(F.lit("class").alias("kind"), F.concat_ws(".", "p_brand", "p_type").alias("fqn"), F.concat(F.lit("file:"), "p_brand").alias("parent"))
    m = p.select(F.lit("function").alias("kind"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("fqn"), F.concat(F.lit("class:"), F.concat_ws(".", "p_brand", "p_type")).alias("parent"))
    return M.hierarchy(f.unionByName(c).unionByName(m))


@query("n37_dependency_kinds", _NE + "SELECT CASE WHEN n.id IS NULL THEN 'external' ELSE 'internal' END AS kind, count(*) AS n FROM edges e LEFT JOIN (SELECT id FROM nodes WHERE kind <> 'supplier') n ON n.id = e.dst GROUP BY 1")
def n37(spark, sf):
    n = nodes(spark, sf).where("kind != 'supplier'").select(F.col("id").alias("dst"), F.lit(True).alias("inside"))
    return edges(spark, sf).join(n, "dst", "left").groupBy(F.when(F.col("inside").isNull(), "external").otherwise("internal").alias("kind")).agg(F.count("*").alias("n"))


@query("n38_trusted_library", "SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD%' THEN 'IO' WHEN p_type LIKE 'PROMO%' THEN 'PURE' ELSE 'UNKNOWN' END AS effect FROM part")
def n38(spark, sf):
    known = spark.createDataFrame([("STANDARD*", "IO"), ("PROMO*", "PURE")], "rule_id string, effect string").withColumn("pattern", F.col("rule_id"))
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("text"))
    hit = U.matches(known, p).join(F.broadcast(known.select("rule_id", "effect")), "rule_id").select("id", "effect")  # two rules
    return p.join(hit.hint("merge"), "id", "left").select(F.col("id").alias("p_partkey"), F.coalesce("effect", F.lit("UNKNOWN")).alias("effect"))


@query("c26_priority", "SELECT p_partkey, round(greatest(0, least(1, 0.55 * (p_partkey % 3) + 0.30 * (p_partkey % 2))), 6)::DOUBLE AS priority FROM part")
def c26(spark, sf):
    from ..functions.scores import priority

    k = F.col("p_partkey")
    return read(spark, sf, "part").select("p_partkey", F.round(priority(k % 3, k % 2, F.lit(0)), 6).alias("priority"))


@query("x01_user_predicate", _N + "SELECT id FROM nodes WHERE kind = 'part' AND length(name) % 2 = 0")
def x01(spark, sf):
    return nodes(spark, sf).where("kind = 'part'").where((F.length("name") % 2) == 0).select("id")


@query("z02_plan_execution", _E + "SELECT a.src, b.dst FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src = 'p:1' AND a.kind = 'DATAFLOW' AND b.kind = 'CONTAINS'")
def z02(spark, sf):
    from ..plans.selectors import EdgeSelector
    from ..plans.service import PlanExecutor, QueryPlan

    e = edges(spark, sf).withColumn("kind", F.when(F.col("kind") == "CONTAINS", "CALLS").when(F.col("kind") == "CALLS", "OTHER").otherwise(F.col("kind")))
    assert EdgeSelector(("CALLS",)).kinds
    plan = QueryPlan("slice", ("p:1",), tuple(f"n:{i}" for i in range(25)), 2, "heavy")
    return PlanExecutor(nodes(spark, sf), e).execute(plan).select("src", "dst")


@query("c39_ignore_globs", "SELECT p_partkey, p_partkey % 3 = 0 AS ignored FROM part")
def c39b(spark, sf):
    path = F.when(F.col("p_partkey") % 3 == 0, "a/node_modules/x.js").otherwise("src/x.js")
    return read(spark, sf, "part").select("p_partkey", F.regexp_like(path, F.lit(X.glob_regex("**/node_modules/**"))).alias("ignored"))
