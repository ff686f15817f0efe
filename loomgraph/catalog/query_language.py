"""Node, edge and path queries over the key graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import paths
from ..plans.builder import EdgeQuery, NodeQuery
from ..plans.selectors import E, Q
from ..sources.tables import EDGES, NODES, edges, nodes, with_
from .base import query

_N, _NE = with_(NODES), with_(NODES, EDGES)
_REC = "WITH RECURSIVE " + NODES + ",\n" + EDGES + ",\n"


def _show(df):
    return df.select("src", "dst", "depth", F.array_join("path", ">").alias("path"))


def _recursive(start: str, kinds: str, depth: int, end: str) -> str:
    """Simple paths that end at the first target, in DuckDB."""
    return _REC + f"""p(src, dst, depth, path, done) AS (
  SELECT id, id, 0, [id], false FROM nodes WHERE {start}
  UNION ALL
  SELECT p.src, e.dst, depth + 1, list_append(path, e.dst), coalesce(t.id IS NOT NULL, false)
  FROM p JOIN (SELECT DISTINCT src, dst FROM edges WHERE {kinds}) e ON e.src = p.dst LEFT JOIN (SELECT id FROM nodes WHERE {end}) t ON t.id = e.dst
  WHERE NOT done AND depth < {depth} AND NOT list_contains(path, e.dst))
SELECT src, dst, depth, array_to_string(path, '>') AS path FROM p WHERE done"""


@query("path_order_to_region", _recursive("kind = 'order' AND name = 'F'", "kind IN ('CALLS', 'CONTAINS')", 3, "kind = 'region'"))
def order_to_region(spark, sf):
    """Which region each finished order rolls up to."""
    flow = (Q.kind("order", "F") >> Q.kind("region")).via(E.kinds("CALLS", "CONTAINS")).depth(3).unlimited()
    return _show(paths.run(flow, nodes(spark, sf), edges(spark, sf)))


@query("f02_node_kind", _N + "SELECT id, name FROM nodes WHERE kind = 'part'")
def f02(spark, sf):
    return NodeQuery(nodes(spark, sf)).filter("order").filter("part").execute().select("id", "name")


@query("f03_where_field", _N + "SELECT id FROM nodes WHERE kind = 'part' AND name = 'new bolt' AND coalesce(metadata, '') = '36'")
def f03(spark, sf):
    return NodeQuery(nodes(spark, sf)).filter("part").where_field("name", "new bolt").where_field("size", "36").execute().select("id")


@query("f03_null_is_empty", _N + "SELECT id FROM nodes WHERE coalesce(file_path, '') = ''")
def f03b(spark, sf):
    return NodeQuery(nodes(spark, sf)).where_field("file_path", "").execute().select("id")


@query("f05_where_fn", _N + "SELECT id, value FROM nodes WHERE kind = 'part' AND value > 950")
def f05(spark, sf):
    return NodeQuery(nodes(spark, sf)).filter("part").where(lambda: F.col("value") > 950).execute().select("id", "value")


@query("f06_expression_filter", _N + "SELECT id FROM nodes WHERE kind = 'part' AND value BETWEEN 905 AND 980 AND name LIKE '%o%'")
def f06(spark, sf):
    return NodeQuery(nodes(spark, sf)).filter("part").where(F.expr("value between 905 and 980")).where(F.expr("name like '%o%'")).execute().select("id")


@query("f08_edge_kind", with_(EDGES) + "SELECT src, dst FROM edges WHERE kind = 'CALLS'")
def f08(spark, sf):
    return EdgeQuery(edges(spark, sf)).filter("CALLS").execute().select("src", "dst")


@query("f09_edge_field", with_(EDGES) + "SELECT src, kind FROM edges WHERE dst = 'n:3'")
def f09(spark, sf):
    return EdgeQuery(edges(spark, sf)).where_field("target_id", "n:3").execute().select("src", "kind")


@query("f10_callers", with_(EDGES) + "SELECT src FROM edges WHERE kind = 'CALLS' AND dst = 'c:10'")
def f10(spark, sf):
    return EdgeQuery(edges(spark, sf)).callers_of("c:10").execute().select("src")


@query("f10_callees_and_dataflow", with_(EDGES) + "SELECT dst, kind FROM edges WHERE (kind = 'CALLS' AND src = 'o:7') OR (kind = 'DATAFLOW' AND src = 'p:5') OR (kind = 'DATAFLOW' AND dst = 's:2') OR (kind = 'REFERENCES' AND dst = 'p:9')")
def f10b(spark, sf):
    q = EdgeQuery(edges(spark, sf))
    parts = [q.callees_of("o:7"), q.dataflow_from("p:5"), q.dataflow_to("s:2"), q.references_to("p:9")]
    out = parts[0].execute()
    for p in parts[1:]:
        out = out.unionByName(p.execute())
    return out.distinct().select("dst", "kind")


@query("f11_selector_union", _N + "SELECT id FROM nodes WHERE id = 'r:1' OR kind = 'nation' OR (name = 'F' AND file_path = '1-URGENT')")
def f11(spark, sf):
    return nodes(spark, sf).where(Q.union(Q.by_id("r:1"), Q.kind("nation"), Q.name("F", "1-URGENT")).column()).select("id")


@query("f12_edge_selector", with_(EDGES) + "SELECT kind, count(*) AS n FROM edges WHERE kind IN ('CALLS', 'DATAFLOW') GROUP BY kind")
def f12(spark, sf):
    return edges(spark, sf).where((E.call | E.dfg).column()).groupBy("kind").agg(F.count("*").alias("n"))


@query("f18_match_name", _N + "SELECT id FROM nodes WHERE kind = 'supplier' AND name = 'Supplier#000000001' UNION ALL SELECT id FROM nodes WHERE kind = 'region'")
def f18(spark, sf):
    return nodes(spark, sf).where((Q.kind("supplier", "Supplier#000000001") | Q.kind("region")).column()).select("id")


@query("f21_source_names", _N + "SELECT id FROM nodes WHERE kind = 'part' AND (contains(name, 'get') OR contains(name, 'post') OR contains(name, 'input') OR contains(name, 'request'))")
def f21(spark, sf):
    return nodes(spark, sf).where((Q.kind("part") & Q.source("request")).column()).select("id")


@query("f22_sink_names", _N + "SELECT id FROM nodes WHERE contains(name, 'send') OR contains(name, 'sendto') OR contains(name, 'log') OR contains(name, 'print') OR contains(name, 'logger')")
def f22(spark, sf):
    return nodes(spark, sf).where((Q.sink("network") | Q.sink("log")).column()).select("id")


@query("f23_edge_types", with_(EDGES) + "SELECT kind IN ('CALLS') AS call, kind IN ('DATAFLOW') AS dfg, false AS cfg, count(*) AS n FROM edges GROUP BY ALL")
def f23(spark, sf):
    e = edges(spark, sf)
    return e.groupBy(E.call.column().alias("call"), E.dfg.column().alias("dfg"), E.cfg.column().alias("cfg")).agg(F.count("*").alias("n"))


@query("f24_node_filter", _N + "SELECT id FROM nodes WHERE kind = 'part' AND name LIKE 'n%' AND file_path = 'Brand#13'")
def f24(spark, sf):
    return nodes(spark, sf).where((F.col("kind") == "part") & F.col("name").startswith("n") & (F.col("file_path") == "Brand#13")).select("id")


@query("f25_nodes_in_file", _N + "SELECT kind, file_path, count(*) AS n FROM nodes WHERE file_path IS NOT NULL GROUP BY ALL")
def f25(spark, sf):
    return nodes(spark, sf).where("file_path is not null").groupBy("kind", "file_path").agg(F.count("*").alias("n"))


@query("f27_search_content", "SELECT doc_id FROM documents WHERE contains(text, 'the') ORDER BY doc_id LIMIT 50")
def f27(spark, sf):
    from ..sources.tables import read

    return read(spark, sf, "documents").where(F.contains("text", F.lit("the"))).select("doc_id").orderBy("doc_id").limit(50)


@query("f29_scope", "SELECT chunk_id FROM (SELECT 'd:' || doc_id AS chunk_id, source AS p, lang FROM documents) WHERE p IN ('src1', 'src2') OR regexp_matches(p, '^src1[0-9]$') AND lang = 'en'")
def f29(spark, sf):
    from ..sources.tables import chunks

    return chunks(spark, sf).where(F.col("file_path").isin("src1", "src2") | (F.regexp_like("file_path", F.lit("^src1[0-9]$")) & (F.col("language") == "en"))).select("chunk_id")


@query("a01_aggregate", _N + "SELECT kind, count(*) AS count, round(avg(try_cast(metadata AS DOUBLE)), 6) AS avg, sum(try_cast(metadata AS DOUBLE)) AS sum, min(try_cast(metadata AS DOUBLE)) AS min, max(try_cast(metadata AS DOUBLE)) AS max FROM nodes WHERE kind IN ('part', 'order') GROUP BY kind")
def a01(spark, sf):
    out = None
    for kind in ("part", "order"):
        one = NodeQuery(nodes(spark, sf)).filter(kind).order_by("name").limit(3).aggregate().withColumn("kind", F.lit(kind)).withColumn("avg", F.round("avg", 6))
        out = one if out is None else out.unionByName(one)
    return out


@query("k01_order_limit_offset", _N + "SELECT id, value FROM nodes WHERE kind = 'order' ORDER BY value DESC, id LIMIT 25 OFFSET 10")
def k01(spark, sf):
    return NodeQuery(nodes(spark, sf)).filter("order").order_by("value", descending=True).offset(10).limit(25).execute().select("id", "value")


@query("k04_take", _N + "SELECT id FROM nodes WHERE kind = 'customer' ORDER BY id LIMIT 20")
def k04(spark, sf):
    return NodeQuery(nodes(spark, sf)).filter("customer").take(20).select("id")


@query("g01_forward_paths", _recursive("kind = 'part' AND file_path = 'Brand#13'", "kind IN ('DATAFLOW', 'CONTAINS')", 3, "kind = 'region'"))
def g01(spark, sf):
    flow = ((Q.kind("part") & Q.in_file("Brand#13")) >> Q.kind("region")).via(E.kinds("DATAFLOW", "CONTAINS")).depth(3).unlimited()
    return _show(paths.run(flow, nodes(spark, sf), edges(spark, sf)))


@query("g02_backward_paths", with_(EDGES) + "SELECT r.id AS src, c.src AS dst, 2 AS depth, r.id || '>' || n.src || '>' || c.src AS path FROM (SELECT 'r:1' AS id) r JOIN edges n ON n.dst = r.id AND n.kind = 'CONTAINS' JOIN edges c ON c.dst = n.src AND c.kind = 'CONTAINS' AND c.src LIKE 'c:%'")
def g02(spark, sf):
    flow = (Q.kind("customer") << Q.by_id("r:1")).via(E.kinds("CONTAINS")).depth(2).unlimited()
    return _show(paths.run(flow, nodes(spark, sf), edges(spark, sf)))


@query("g03_adjacency", with_(EDGES) + "SELECT src, dst, 1 AS depth, src || '>' || dst AS path FROM edges WHERE kind = 'CONTAINS' AND src LIKE 'n:%'")
def g03(spark, sf):
    return _show(paths.run((Q.kind("nation") > Q.kind("region")).via(E.kinds("CONTAINS")).limit_paths(1000), nodes(spark, sf), edges(spark, sf)))


@query("g05_depth_bounds", with_(EDGES) + "SELECT count(*) AS n FROM edges a JOIN edges b ON b.src = a.dst AND b.kind = 'CONTAINS' AND b.dst LIKE 'r:%' WHERE a.kind = 'CONTAINS'")
def g05(spark, sf):
    flow = (Q.any() >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(3, 2).unlimited()
    return paths.run(flow, nodes(spark, sf), edges(spark, sf)).where("depth = 2").agg(F.count("*").alias("n"))


@query("g06_path_predicate", _recursive("id LIKE 'c:1%'", "kind = 'CONTAINS'", 2, "kind = 'region'") + " AND list_contains(path, 'n:3')")
def g06(spark, sf):
    flow = ((Q.kind("customer") & Q.like("c:1%")) >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(2).where_path(lambda p: F.array_contains(p, "n:3")).unlimited()
    return _show(paths.run(flow, nodes(spark, sf), edges(spark, sf)))


@query("g08_excluding", _recursive("kind = 'supplier'", "kind = 'CONTAINS' AND src <> 'n:3' AND dst <> 'n:3'", 2, "kind = 'region'"))
def g08(spark, sf):
    flow = (Q.kind("supplier") >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(2).excluding(Q.by_id("n:3")).unlimited()
    return _show(paths.run(flow, nodes(spark, sf), edges(spark, sf)))


@query("u06_cleansed_by", _recursive("kind = 'supplier'", "kind = 'CONTAINS'", 2, "kind = 'region'") + " AND (list_contains(path, 'n:3') OR list_contains(path, 'n:5'))")
def u06(spark, sf):
    flow = (Q.kind("supplier") >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(2).cleansed_by(Q.by_id("n:3") | Q.by_id("n:5")).unlimited()
    return _show(paths.run(flow, nodes(spark, sf), edges(spark, sf)))


@query("g07_within", _recursive("id IN ('s:1', 's:2', 's:3')", "kind = 'CONTAINS' AND (src IN ('s:1', 's:2') OR src LIKE 'n:%')", 2, "kind = 'region'"))
def g07(spark, sf):
    scope = Q.union(Q.by_id("s:1"), Q.by_id("s:2"), Q.kind("nation"), Q.kind("region"))
    flow = (Q.union(*[Q.by_id(f"s:{i}") for i in (1, 2, 3)]) >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(2).within(scope).limit_paths(1000)
    return _show(paths.run(flow, nodes(spark, sf), edges(spark, sf)))


@query("g09_limit_paths", _recursive("kind = 'customer'", "kind = 'CONTAINS'", 2, "kind = 'region'") + " ORDER BY depth, p.path LIMIT 15")
def g09(spark, sf):
    flow = (Q.kind("customer") >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(2).limit_paths(15)
    return _show(paths.run(flow, nodes(spark, sf), edges(spark, sf), flip=False))


@query("g14_shortest_paths", with_(EDGES) + "SELECT a.src, b.dst, 2 AS depth, min(a.src || '>' || a.dst || '>' || b.dst) AS path FROM edges a JOIN edges b ON b.src = a.dst AND b.kind = 'DATAFLOW' WHERE a.kind = 'REFERENCES' AND a.src IN ('o:1', 'o:2', 'o:3', 'o:4', 'o:5') GROUP BY a.src, b.dst")
def g14(spark, sf):
    starts = Q.union(*[Q.by_id(f"o:{i}") for i in range(1, 6)])
    flow = (starts >> Q.kind("supplier")).via(E.kinds("REFERENCES", "DATAFLOW")).depth(2).unlimited()
    return _show(paths.one_shortest(paths.run(flow, nodes(spark, sf), edges(spark, sf))))
