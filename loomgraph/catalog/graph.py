"""Graph analyses over the key graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..plans import paths
from ..sources.tables import EDGES, NODES, edges, nodes, read, with_
from .base import query

_E, _NE = with_(EDGES), with_(NODES, EDGES)
_CLOSURE = "WITH RECURSIVE " + EDGES + """, e AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ({kinds})), r(start, node, d) AS (
 SELECT {start} UNION SELECT r.start, {to}, d + 1 FROM r JOIN e ON {frm} = r.node WHERE d < {depth}), m AS (SELECT start, node, min(d) AS d FROM r WHERE node <> start GROUP BY ALL) """


def _closure(kinds, start, depth, backward=False):
    return _CLOSURE.format(kinds=kinds, start=start, depth=depth, to="e.src" if backward else "e.dst", frm="e.dst" if backward else "e.src")


def _starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query("j01_endpoints", _NE + "SELECT a.kind AS from_kind, e.kind, b.kind AS to_kind, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst GROUP BY ALL")
def j01(spark, sf):
    n, e = nodes(spark, sf), edges(spark, sf)
    a, b = n.select(F.col("id").alias("src"), F.col("kind").alias("from_kind")), n.select(F.col("id").alias("dst"), F.col("kind").alias("to_kind"))
    return e.join(a, "src").join(b, "dst").groupBy("from_kind", "kind", "to_kind").agg(F.count("*").alias("n"))


@query("j02_resolved_neighbours", _E + "SELECT dst AS node, kind FROM edges WHERE src = 'o:1' AND kind IN ('CALLS', 'REFERENCES') UNION ALL SELECT src, kind FROM edges WHERE dst = 's:1' AND kind = 'DATAFLOW'")
def j02(spark, sf):
    e = edges(spark, sf)
    ahead = e.where((F.col("src") == "o:1") & F.col("kind").isin("CALLS", "REFERENCES")).select(F.col("dst").alias("node"), "kind")
    return ahead.unionByName(e.where((F.col("dst") == "s:1") & (F.col("kind") == "DATAFLOW")).select(F.col("src").alias("node"), "kind"))


@query("j19_entry_points", _NE + "SELECT kind, count(*) AS n FROM nodes WHERE id NOT IN (SELECT dst FROM edges) GROUP BY kind")
def j19(spark, sf):
    return G.entry_points(nodes(spark, sf), edges(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("j19_leaves", _NE + "SELECT id, kind FROM nodes WHERE id NOT IN (SELECT src FROM edges)")
def j19b(spark, sf):
    return G.leaves(nodes(spark, sf), edges(spark, sf)).select("id", "kind")


@query("a16_degrees", _E + "SELECT coalesce(a.node, b.node) AS node, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming FROM (SELECT src AS node, count(*) AS outgoing FROM edges GROUP BY 1) a FULL JOIN (SELECT dst AS node, count(*) AS incoming FROM edges GROUP BY 1) b ON a.node = b.node")
def a16(spark, sf):
    return G.degrees(edges(spark, sf))


@query("a16_graph_stats", _NE + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def a16b(spark, sf):
    return nodes(spark, sf).agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(edges(spark, sf).agg(F.count("*").alias("edges"))))


@query("a31_reverse_index", _E + "SELECT dst AS node, kind, count(*) AS n, array_to_string(list_sort(list(src))[1:100], ',') AS first FROM edges WHERE kind = 'CONTAINS' GROUP BY dst, kind")
def a31(spark, sf):
    return G.adjacency(edges(spark, sf).where("kind = 'CONTAINS'"), reverse=True).select("node", "kind", "n", F.array_join("first", ",").alias("first"))


@query("a32_request_flow", _E + "SELECT a.src AS route, a.dst AS handler, b.dst AS service, c.dst AS repository FROM edges a JOIN edges b ON b.src = a.dst AND b.kind = 'CONTAINS' JOIN edges c ON c.src = b.dst AND c.kind = 'CONTAINS' WHERE a.kind = 'CALLS'")
def a32(spark, sf):
    e = edges(spark, sf)
    a = e.where("kind = 'CALLS'").select(F.col("src").alias("route"), F.col("dst").alias("handler"))
    b = e.where("kind = 'CONTAINS'").select(F.col("src").alias("handler"), F.col("dst").alias("service"))
    c = e.where("kind = 'CONTAINS'").select(F.col("src").alias("service"), F.col("dst").alias("repository"))
    return a.join(b, "handler").join(c, "service").select("route", "handler", "service", "repository")


@query("g20_reachability", _closure("'CONTAINS', 'DATAFLOW'", "DISTINCT src, src, 0 FROM e WHERE src LIKE 'p:1%'", 4) + "SELECT start, node, d::INT AS distance FROM m")
def g20(spark, sf):
    e = edges(spark, sf, repeats=True).where("kind IN ('CONTAINS', 'DATAFLOW')")
    return paths.reach(e, e.where("src like 'p:1%'").select(F.col("src").alias("id")).distinct(), 4).select("start", "node", "distance")


@query("g21_can_reach", _closure("'CALLS', 'CONTAINS'", "DISTINCT src, src, 0 FROM e WHERE src IN ('o:1', 'o:2', 'o:3')", 20) + "SELECT start, node, d::INT AS distance FROM m WHERE node LIKE 'r:%'")
def g21(spark, sf):
    e = edges(spark, sf).where("kind IN ('CALLS', 'CONTAINS')")
    return paths.reach(e, _starts(spark, "o:1", "o:2", "o:3")).where("node like 'r:%'").select("start", "node", "distance")


@query("g22_meeting_points", "WITH RECURSIVE " + EDGES + ", e AS (SELECT DISTINCT src, dst FROM edges), f(node) AS (SELECT 'p:1' UNION SELECT e.dst FROM f JOIN e ON e.src = f.node), b(node) AS (SELECT 'r:1' UNION SELECT e.src FROM b JOIN e ON e.dst = b.node) SELECT node FROM f WHERE node IN (SELECT node FROM b)")
def g22(spark, sf):
    return paths.meeting(edges(spark, sf, repeats=True), _starts(spark, "p:1"), _starts(spark, "r:1"))


@query("u12_chop", "WITH RECURSIVE " + EDGES + ", e AS (SELECT DISTINCT src, dst FROM edges WHERE kind <> 'REFERENCES'), f(node) AS (SELECT 'o:4' UNION SELECT e.dst FROM f JOIN e ON e.src = f.node), b(node) AS (SELECT id FROM (VALUES ('r:0'), ('r:1'), ('r:2'), ('r:3'), ('r:4')) v(id) UNION SELECT e.src FROM b JOIN e ON e.dst = b.node) SELECT node FROM f WHERE node IN (SELECT node FROM b)")
def u12(spark, sf):
    return paths.meeting(edges(spark, sf, repeats=True).where("kind != 'REFERENCES'"), _starts(spark, "o:4"), _starts(spark, *[f"r:{i}" for i in range(5)]))


@query("g23_transitive_dependencies", _closure("'REFERENCES', 'DATAFLOW', 'CONTAINS'", "DISTINCT src, src, 0 FROM e WHERE src IN ('o:1', 'o:7')", 3) + "SELECT start, count(*) AS n FROM m GROUP BY start")
def g23(spark, sf):
    return paths.reach(edges(spark, sf, repeats=True).where("kind != 'CALLS'"), _starts(spark, "o:1", "o:7"), 3).groupBy("start").agg(F.count("*").alias("n"))


@query("g24_impact", _closure("'CALLS', 'CONTAINS'", "DISTINCT dst, dst, 0 FROM e WHERE dst LIKE 'n:%'", 5, True) + "SELECT start, sum((d = 1)::INT)::BIGINT AS direct, count(*) AS transitive FROM m GROUP BY start")
def g24(spark, sf):
    e = edges(spark, sf).where("kind IN ('CALLS', 'CONTAINS')")
    return G.impact(e, e.where("dst like 'n:%'").select(F.col("dst").alias("id")).distinct(), 5)


@query("g28_affected_files", _closure("'CALLS'", "DISTINCT dst, dst, 0 FROM e WHERE dst IN ('c:1', 'c:10', 'c:100')", 3, True).replace("WITH RECURSIVE ", "WITH RECURSIVE " + NODES + ", ", 1) + "SELECT DISTINCT file_path FROM m JOIN nodes ON id = node")
def g28(spark, sf):
    r = paths.reach(edges(spark, sf).where("kind = 'CALLS'"), _starts(spark, "c:1", "c:10", "c:100"), 3, backward=True)
    return r.join(nodes(spark, sf), F.col("node") == F.col("id")).select("file_path").distinct()


@query("a19_impact_summary", _closure("'CALLS', 'CONTAINS'", "DISTINCT dst, dst, 0 FROM e WHERE dst LIKE 'c:1%'", 5, True) + ", i AS (SELECT start, sum((d = 1)::INT) AS direct, count(*) AS transitive FROM m GROUP BY start) SELECT CASE WHEN r >= 0.7 THEN 'high' WHEN r >= 0.3 THEN 'medium' ELSE 'low' END AS level, count(*) AS n, sum(transitive)::BIGINT AS dependents FROM (SELECT *, least(1.0, least(1.0, 10.0 * transitive / 1000) + least(0.3, 5.0 * direct / 1000)) AS r FROM i) GROUP BY 1")
def a19(spark, sf):
    from ..functions.scores import impact_risk, risk_level

    e = edges(spark, sf).where("kind IN ('CALLS', 'CONTAINS')")
    i = G.impact(e, e.where("dst like 'c:1%'").select(F.col("dst").alias("id")).distinct(), 5)
    level = risk_level(impact_risk(F.col("direct"), F.col("transitive"), F.lit(1000)))
    return i.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("transitive").alias("dependents"))


@query("g27_call_depth", "WITH RECURSIVE " + EDGES + ", e AS (SELECT DISTINCT src, dst FROM edges WHERE kind <> 'REFERENCES' AND kind <> 'CALLS'), p(first, node, d) AS (SELECT id, id, 0 FROM (VALUES ('p:1'), ('p:2')) v(id) UNION ALL SELECT first, e.dst, d + 1 FROM p JOIN e ON e.src = p.node WHERE d < 8) SELECT first, max(d)::INT AS depth FROM p GROUP BY first")
def g27(spark, sf):
    from ..plans.selectors import E, Q

    flow = ((Q.by_id("p:1") | Q.by_id("p:2")) >> Q.kind("region")).via(E.kinds("DATAFLOW", "CONTAINS")).depth(8).unlimited()
    return paths.run(flow, nodes(spark, sf), edges(spark, sf)).groupBy(F.col("src").alias("first")).agg(F.max("depth").alias("depth"))


def _pagerank_sql(rounds: int) -> str:
    steps = []
    for i in range(rounds):
        prev = "r0" if i == 0 else f"r{i}"
        steps.append(f"r{i + 1} AS (SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(s.got, 0) + (SELECT coalesce(sum(score), 0) FROM {prev} WHERE node NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM n)) AS score FROM n LEFT JOIN (SELECT e.dst, sum(r.score / o.k) AS got FROM e JOIN o ON o.src = e.src JOIN {prev} r ON r.node = e.src GROUP BY e.dst) s ON s.dst = n.node)")
    return with_(EDGES) + ", e AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CONTAINS'), o AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src), n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS score FROM n), " + ", ".join(s.replace(" AS (SELECT n.node", " AS MATERIALIZED (SELECT n.node", 1) for s in steps)


@query("g29_pagerank", _pagerank_sql(4) + f" SELECT node, round(score, 8) AS score FROM r4")
def g29(spark, sf):
    return paths.rank(edges(spark, sf).where("kind = 'CONTAINS'"), 4).select("node", F.round("score", 8).alias("score"))


@query("g31_personal_weights", "SELECT c_custkey AS node, round(greatest(0, least(1, 0.4 * (c_custkey % 3) + 0.3 * (c_custkey % 2))), 6)::DOUBLE AS weight FROM customer")
def g31(spark, sf):
    c = read(spark, sf, "customer")
    items = c.select(F.col("c_custkey").alias("node"), F.lit("ide").alias("origin"), (F.col("c_custkey") % 3).alias("weight")).unionByName(c.select(F.col("c_custkey").alias("node"), F.lit("query").alias("origin"), (F.col("c_custkey") % 2).alias("weight")))
    return G.blend_weights(items).withColumn("weight", F.round("weight", 6))


@query("g33_components", "WITH RECURSIVE " + EDGES + ", e AS (SELECT src AS a, dst AS b FROM edges WHERE kind = 'CONTAINS' AND dst LIKE 'r:%' OR kind = 'CONTAINS' AND src LIKE 's:%'), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other) SELECT node, min(other) AS root FROM r GROUP BY node")
def g33(spark, sf):
    e = edges(spark, sf).where("kind = 'CONTAINS' and (dst like 'r:%' or src like 's:%')")
    return paths.components(e)


@query("g34_co_change_cluster", "WITH RECURSIVE c AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), n AS (SELECT s, count(*) AS n FROM c GROUP BY s), p AS (SELECT x.s AS a, y.s AS b, count(*) AS k FROM c x JOIN c y ON x.o = y.o AND x.s < y.s GROUP BY ALL), e AS (SELECT a, b FROM p JOIN n u ON u.s = a JOIN n v ON v.s = b WHERE k / (u.n + v.n - k)::DOUBLE >= 0.022), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, other) AS (SELECT a, a FROM w UNION SELECT r.node, w.b FROM r JOIN w ON w.a = r.other) SELECT node, min(other) AS root FROM r GROUP BY node")
def g34(spark, sf):
    from ..operators.history import co_changes

    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("path"))
    e = co_changes(li).where("coupling >= 0.022").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return paths.components(e)


@query("g35_cheapest", "WITH RECURSIVE " + EDGES + ", e AS (SELECT DISTINCT src, dst, CASE kind WHEN 'CALLS' THEN 1.0 WHEN 'CONTAINS' THEN 0.5 WHEN 'REFERENCES' THEN 2.0 WHEN 'DATAFLOW' THEN 1.2 END::DOUBLE AS c FROM edges), r(start, node, cost, d) AS (SELECT id, id, 0.0::DOUBLE, 0 FROM (VALUES ('o:1'), ('o:2')) v(id) UNION SELECT start, e.dst, cost + c, d + 1 FROM r JOIN e ON e.src = r.node WHERE d < 5) SELECT start, node, round(min(cost), 6) AS cost FROM r WHERE node <> start AND cost <= 30 GROUP BY ALL")
def g35(spark, sf):
    e = edges(spark, sf, repeats=True).withColumn("cost", G.edge_cost(F.col("kind")))
    return G.cheapest(e, _starts(spark, "o:1", "o:2")).select("start", "node", F.round("cost", 6).alias("cost"))


@query("g36_edge_cost", _E + "SELECT kind, round(CASE kind WHEN 'CALLS' THEN 1.0 WHEN 'CONTAINS' THEN 0.5 WHEN 'REFERENCES' THEN 2.0 ELSE 1.2 END * CASE WHEN src LIKE '%1' THEN 1.3 ELSE 1 END * CASE WHEN dst LIKE '%2' THEN 1.2 ELSE 1 END, 6)::DOUBLE AS cost, count(*) AS n FROM edges GROUP BY ALL")
def g36(spark, sf):
    e = edges(spark, sf)
    cost = G.edge_cost(F.col("kind"), conditional=F.col("src").like("%1"), loop=F.col("dst").like("%2"))
    return e.groupBy("kind", F.round(cost, 6).alias("cost")).agg(F.count("*").alias("n"))


@query("g38_expansion", _closure("'REFERENCES', 'DATAFLOW', 'CONTAINS', 'CALLS'", "DISTINCT src, src, 0 FROM e WHERE src IN ('o:1', 'o:2', 'o:3')", 3) + "SELECT start, node, round(greatest(0.3, 1 - 0.15 * d), 6)::DOUBLE AS score FROM m QUALIFY row_number() OVER (PARTITION BY start ORDER BY d, node) <= 40")
def g38(spark, sf):
    return G.expanded(edges(spark, sf, repeats=True), _starts(spark, "o:1", "o:2", "o:3")).select("start", "node", F.round("score", 6).alias("score"))


@query("g39_proximity", _E + ", u AS (SELECT src AS a, dst AS b FROM edges WHERE kind = 'CONTAINS' UNION SELECT dst, src FROM edges WHERE kind = 'CONTAINS'), p AS (SELECT a.id AS a, b.id AS b FROM (VALUES ('s:1'), ('s:2'), ('n:1')) a(id), (VALUES ('s:1'), ('n:1'), ('n:2'), ('r:1'), ('r:2')) b(id)) SELECT a, b, CASE WHEN a = b OR (a, b) IN (SELECT a, b FROM u) THEN 1.0 WHEN (a, b) IN (SELECT x.a, y.b FROM u x JOIN u y ON y.a = x.b) THEN 0.5 WHEN (a, b) IN (SELECT x.a, z.b FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = y.b WHERE x.a IN ('s:1', 's:2', 'n:1')) THEN 0.25 ELSE 0 END::DOUBLE AS proximity FROM p")
def g39(spark, sf):
    pairs = spark.createDataFrame([(a, b) for a in ("s:1", "s:2", "n:1") for b in ("s:1", "n:1", "n:2", "r:1", "r:2")], "a string, b string")
    return G.proximity(edges(spark, sf).where("kind = 'CONTAINS'"), pairs)


@query("g40_backward_slice", _closure("'CALLS', 'CONTAINS', 'DATAFLOW'", "'n:3', 'n:3', 0", 30, True) + "SELECT start, node FROM m UNION ALL SELECT 'n:3', 'n:3'")
def g40(spark, sf):
    e = edges(spark, sf, repeats=True)
    return G.slice_(e.where("kind IN ('CALLS', 'CONTAINS')"), e.where("kind = 'DATAFLOW'"), _starts(spark, "n:3"))


@query("g40_thin_slice", _closure("'DATAFLOW'", "'s:3', 's:3', 0", 30, True) + "SELECT start, node FROM m UNION ALL SELECT 's:3', 's:3'")
def g40b(spark, sf):
    e = edges(spark, sf, repeats=True)
    return G.slice_(e.where("kind = 'CONTAINS'"), e.where("kind = 'DATAFLOW'"), _starts(spark, "s:3"), thin=True)


@query("g41_dependence_graph", "SELECT CASE WHEN c AND d THEN 'both' WHEN c THEN 'control' ELSE 'data' END AS kind, count(*) AS n FROM (SELECT p, s, bool_or(t = 'c') AS c, bool_or(t = 'd') AS d FROM (SELECT l_partkey AS p, l_suppkey AS s, 'c' AS t FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_partkey, l_suppkey, 'd' FROM lineitem WHERE l_linenumber >= 3) GROUP BY p, s) GROUP BY 1")
def g41(spark, sf):
    li = read(spark, sf, "lineitem")
    side = lambda cond: li.where(cond).select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return G.dependence_graph(side("l_linenumber <= 3"), side("l_linenumber >= 3")).groupBy("kind").agg(F.count("*").alias("n"))


_TREE = "tree AS (SELECT 'r:' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer)"


def tree(spark, sf):
    s = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))
    r = read(spark, sf, "region").select(s("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    n = read(spark, sf, "nation").select(s("n", "n_nationkey").alias("id"), s("r", "n_regionkey").alias("parent"))
    return r.unionByName(n).unionByName(read(spark, sf, "customer").select(s("c", "c_custkey").alias("id"), s("n", "c_nationkey").alias("parent")))


@query("a26_tree_rollup", with_(_TREE) + "SELECT node, sum(v)::BIGINT AS total FROM (SELECT c.parent AS node, 1 AS v FROM tree c WHERE c.id LIKE 'c:%' UNION ALL SELECT n.parent, 1 FROM tree c JOIN tree n ON n.id = c.parent WHERE c.id LIKE 'c:%' UNION ALL SELECT id, 1 FROM tree WHERE id LIKE 'c:%') GROUP BY node")
def a26(spark, sf):
    t = tree(spark, sf)
    return G.tree_rollup(t, t.where("id like 'c:%'").select("id", F.lit(1).alias("value")))


@query("g43_tree_depth", with_(_TREE) + "SELECT id AS node, CASE WHEN id LIKE 'r:%' THEN 0 WHEN id LIKE 'n:%' THEN 1 ELSE 2 END AS depth FROM tree")
def g43(spark, sf):
    return G.tree_depth(tree(spark, sf))


@query("k12_topological_levels", with_(EDGES) + ", e AS (SELECT src, dst FROM edges WHERE kind IN ('CALLS', 'CONTAINS')) SELECT node, max(l)::INT AS level FROM (SELECT src AS node, 0 AS l FROM e WHERE src LIKE 'o:%' OR src LIKE 's:%' OR src LIKE 'c:%' UNION ALL SELECT dst, 1 FROM e UNION ALL SELECT dst, 2 FROM e WHERE src LIKE 'c:%' AND src IN (SELECT dst FROM e) UNION ALL SELECT dst, 2 FROM e WHERE src LIKE 'n:%' UNION ALL SELECT b.dst, 3 FROM e a JOIN e b ON b.src = a.dst WHERE a.src LIKE 'c:%' AND a.src IN (SELECT dst FROM e)) GROUP BY node")
def k12(spark, sf):
    return paths.levels(edges(spark, sf).where("kind IN ('CALLS', 'CONTAINS')"))


@query("g32_strong_components", """WITH n AS (SELECT c_custkey AS c, 24 AS ring FROM customer WHERE c_custkey > 0)
SELECT 'c:' || lpad(c::VARCHAR, 9, '0') AS node, 'c:000000001' AS root FROM n WHERE c <= ring
UNION ALL SELECT 'c:' || lpad(c::VARCHAR, 9, '0'), 'c:' || lpad((c - c % 2)::VARCHAR, 9, '0') FROM n WHERE c > ring AND c % 4 IN (0, 1) AND c - c % 2 > ring AND c - c % 2 + 1 IN (SELECT c FROM n)""")
def g32(spark, sf):
    """Customers: the first 24 are one ring, of the others every second pair is mutual, and all hang below the ring."""
    c, ring = read(spark, sf, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("c")), 24
    name = lambda x: F.concat(F.lit("c:"), F.lpad(x.cast("string"), 9, "0"))
    round_ = c.where(F.col("c") <= ring).select(name(F.col("c")).alias("src"), name(F.col("c") % ring + 1).alias("dst"))
    other = c.where(F.col("c") > ring)
    mates = other.where(F.col("c") % 4 == 0).join(other.select((F.col("c") - 1).alias("c")).hint("merge"), "c")
    pairs = mates.select(name(F.col("c")).alias("src"), name(F.col("c") + 1).alias("dst"))
    below = other.select(name(F.col("c") % ring + 1).alias("src"), name(F.col("c")).alias("dst"))
    return paths.strong_components(round_.unionByName(pairs).unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(below))
