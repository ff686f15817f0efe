"""Queries over builders, selectors, stores, parsers and clone stages that have no other query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import clones as D
from ..operators import incremental as I
from ..plans import paths
from ..plans.builder import EdgeQuery, NodeQuery
from ..plans.selectors import E, Q
from ..plans.service import Cache, PlanExecutor, QueryPlan, Stages, clamp_limit
from ..sources import parsers as P
from ..sources.store import ChunkFilter, ChunkStore
from ..sources.tables import EDGES, NODES, edges, nodes, read, with_
from ..storage import shared_path
from .base import query

_N, _E, _NE = with_(NODES), with_(EDGES), with_(NODES, EDGES)
_REC = "WITH RECURSIVE " + NODES + ",\n" + EDGES + ",\n"


def _key(name: str):
    return F.col(name).cast("string")


# --- parsers ----------------------------------------------------------------


def _modules(spark, sf):
    """A Python file for each part."""
    k, s = _key("p_partkey"), _key("p_size")
    code = F.concat(F.lit("import os.path\nclass C"), s, F.lit('(Base):\n    """Doc '), k, F.lit('"""\n    def m'), k, F.lit("(self, x):\n        if x:\n            return f"), s, F.lit("(x)\n        return x"))
    return read(spark, sf, "part").select(F.concat(F.lit("src/pkg"), s, F.lit("/m"), k, F.lit(".py")).alias("path"), code.alias("content"))


_MODULE = "p AS (SELECT 'pkg' || p_size || '.m' || p_partkey AS m, 'C' || p_size AS c, 'm' || p_partkey AS f, p_size AS s, p_partkey AS k FROM part)"


@query("s04_python_symbols", f"WITH {_MODULE} SELECT 'module' AS kind, m AS fqn, NULL AS parent, 1 AS start_line, 7 AS end_line, NULL AS docstring, 2 AS complexity FROM p UNION ALL SELECT 'class', m || '.' || c, m, 2, 7, 'Doc ' || k, 2 FROM p UNION ALL SELECT 'method', m || '.' || c || '.' || f, m || '.' || c, 4, 7, NULL, 2 FROM p")
def s04(spark, sf):
    return P.python_symbols(_modules(spark, sf)).select("kind", "fqn", "parent", "start_line", "end_line", "docstring", "complexity")


@query("s05_python_relations", f"WITH {_MODULE}, q AS (SELECT *, m || '.' || c AS cls, m || '.' || c || '.' || f AS fn FROM p) SELECT 'IMPORTS' AS kind, m AS src, 'os.path' AS dst, 1 AS line FROM q UNION ALL SELECT 'CONTAINS', m, cls, 2 FROM q UNION ALL SELECT 'INHERITS', cls, 'Base', 2 FROM q UNION ALL SELECT 'READS', cls, cls || '.Base', 2 FROM q UNION ALL SELECT 'CONTAINS', cls, fn, 4 FROM q UNION ALL SELECT 'READS', fn, fn || '.x', 5 FROM q UNION ALL SELECT 'CALLS', fn, 'f' || s, 6 FROM q UNION ALL SELECT 'READS', fn, fn || '.f' || s, 6 FROM q UNION ALL SELECT 'READS', fn, fn || '.x', 6 FROM q UNION ALL SELECT 'READS', fn, fn || '.x', 7 FROM q")
def s05(spark, sf):
    return P.python_relations(_modules(spark, sf)).select("kind", "src", "dst", "line")


@query("s08_notebook_cells", "SELECT p_partkey::VARCHAR AS path, 0 AS cell, 'markdown' AS cell_type, '# Title ' || p_name AS source FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey::VARCHAR, 1, 'code', 'x = ' || p_size FROM part WHERE p_partkey % 5 <> 0")
def s08(spark, sf):
    book = F.concat(F.lit('{"cells":[{"cell_type":"markdown","source":["# Title ","'), F.col("p_name"), F.lit('"]},{"cell_type":"code","source":"x = '), _key("p_size"), F.lit('"}],"nbformat":4}'))
    files = read(spark, sf, "part").select(_key("p_partkey").alias("path"), F.when(F.col("p_partkey") % 5 == 0, "{broken").otherwise(book).alias("content"))
    return P.notebook_cells(files)


@query("s10_discovered_files", "SELECT n_name AS line FROM nation")
def s10(spark, sf):
    root = shared_path(spark, "files")
    read(spark, sf, "nation").select("n_name").write.text(f"{root}/src")
    read(spark, sf, "region").select("r_name").write.text(f"{root}/node_modules/x")
    return P.discovered(spark, root, ("txt",)).select(F.explode(F.split("content", "\n")).alias("line")).where("line != ''")


@query("s27_diff_hunks", "SELECT 'dir' || p_size || '/f' || p_partkey || '.py' AS file, CASE p_partkey % 3 WHEN 1 THEN 0 ELSE p_size END::INT AS old_start, CASE p_partkey % 3 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END::INT AS old_count, CASE p_partkey % 3 WHEN 2 THEN 0 ELSE p_size END::INT AS new_start, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INT AS new_count, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS added, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END::BIGINT AS removed FROM part")
def s27(spark, sf):
    """A changed, an added or a deleted file for each part."""
    k, n = F.col("p_partkey") % 3, _key("p_size")
    name = F.concat(F.lit("dir"), n, F.lit("/f"), _key("p_partkey"), F.lit(".py"))
    changed = F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -"), n, F.lit(" +"), n, F.lit(",2 @@\n-old\n+new\n+more\n same"))
    added = F.concat(F.lit("--- /dev/null\n+++ b/"), name, F.lit("\n@@ -0,0 +"), n, F.lit(" @@\n+new"))
    deleted = F.concat(F.lit("--- a/"), name, F.lit("\n+++ /dev/null\n@@ -"), n, F.lit(",2 +0,0 @@\n-one\n-two"))
    diffs = read(spark, sf, "part").select(_key("p_partkey").alias("path"), F.when(k == 0, changed).when(k == 1, added).otherwise(deleted).alias("content"))
    return P.diff_hunks(diffs).drop("path")


# --- chunk store ------------------------------------------------------------


def _store(spark, sf):
    """Two snapshots of chunks from the parts; the second lacks every seventh and changes every fifth."""
    store = ChunkStore(spark, shared_path(spark, "chunk-store"))
    k = F.col("p_partkey")

    def snapshot(name, df, changed):
        texts = {"chunk_id": F.concat(F.lit(f"{name}:"), _key("p_partkey")), "repo_id": F.lit("repo"), "snapshot_id": F.lit(name), "file_path": F.col("p_brand"), "kind": F.when(k % 2 == 0, "function").otherwise("class"), "fqn": F.concat(F.lit("f"), _key("p_partkey")), "language": F.lit("py"), "visibility": F.lit("public"), "content": F.col("p_name")}
        hashed = F.md5(F.concat(F.when(F.lit(changed) & (k % 5 == 0), "x").otherwise(""), F.col("p_name")))
        out = df.select(*[v.cast("string").alias(n) for n, v in texts.items()], hashed.alias("content_hash"), (F.col("p_size") / 50).cast("float").alias("importance"), (k % 11 == 0).alias("is_deleted"))
        from ..schema import CHUNK

        have = set(out.columns)
        return out.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in CHUNK])

    part = read(spark, sf, "part")
    store.save(snapshot("a", part, False).unionByName(snapshot("b", part.where(k % 7 != 0), True)))
    return store


_STORED = "st AS (SELECT 'a' AS snap, *, md5(p_name) AS h FROM part UNION ALL SELECT 'b', *, md5(CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END || p_name) FROM part WHERE p_partkey % 7 <> 0)"


@query("s15_stored_chunks", f"WITH {_STORED} SELECT snap || ':' || p_partkey AS chunk_id, p_brand AS file_path FROM st WHERE snap = 'b' AND p_brand LIKE 'Brand#1%' AND p_partkey % 2 = 0 AND p_partkey % 11 <> 0 AND p_size / 50 >= 0.2")
def s15(spark, sf):
    f = ChunkFilter(snapshot_id="b", path_like="Brand#1%", kind="function", least_importance=0.2, limit=None)
    return _store(spark, sf).find(f).select("chunk_id", "file_path")


@query("s16_store_stats", f"WITH {_STORED} SELECT 1::BIGINT AS repositories, count(DISTINCT snap) AS snapshots, count(*) FILTER (p_partkey % 11 <> 0) AS chunks, 0::BIGINT AS dependencies FROM st")
def s16(spark, sf):
    return _store(spark, sf).stats()


@query("s29_compared_snapshots", f"WITH {_STORED}, a AS (SELECT 'f' || p_partkey AS fqn, h FROM st WHERE snap = 'a' AND p_partkey % 11 <> 0), b AS (SELECT 'f' || p_partkey AS fqn, h FROM st WHERE snap = 'b' AND p_partkey % 11 <> 0) SELECT coalesce(a.fqn, b.fqn) AS fqn, CASE WHEN a.fqn IS NULL THEN 'added' WHEN b.fqn IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b USING (fqn) WHERE a.h IS DISTINCT FROM b.h")
def s29(spark, sf):
    return _store(spark, sf).compare("a", "b").select("fqn", "change")


@query("s17_schema_constraints", f"WITH {_STORED} SELECT count(*) - count(DISTINCT snap || ':' || p_partkey) AS repeated_ids, count(*) FILTER (p_size / 50 NOT BETWEEN 0 AND 1) AS odd_importance FROM st")
def s17(spark, sf):
    """Constraints of the chunk table as assertion counts."""
    c = _store(spark, sf).chunks()
    return c.agg((F.count("*") - F.countDistinct("chunk_id")).alias("repeated_ids"), F.count_if((F.col("importance") < 0) | (F.col("importance") > 1)).alias("odd_importance"))


# --- builders and limits ----------------------------------------------------


def _aggregate(name, sql, column):
    @query(name, _N + f"SELECT {sql} AS {column} FROM nodes WHERE kind = 'part' AND value > 910")
    def run(spark, sf):
        # order, limit and offset do not count for aggregates
        q = NodeQuery(nodes(spark, sf)).filter("part").where(F.col("value") > 910).order_by("name").limit(3).offset(1)
        return q.aggregate().select(F.round(column, 6).alias(column) if column == "avg" else F.col(column))

    return run


a02 = _aggregate("a02_average", "round(avg(TRY_CAST(metadata AS DOUBLE)), 6)", "avg")
a03 = _aggregate("a03_sum", "sum(TRY_CAST(metadata AS DOUBLE))", "sum")
a04 = _aggregate("a04_min", "min(TRY_CAST(metadata AS DOUBLE))", "min")
a04b = _aggregate("a04_max", "max(TRY_CAST(metadata AS DOUBLE))", "max")
a05 = _aggregate("a05_count_ignores_limit", "count(*)", "count")


@query("a02_no_numbers_is_null", _N + "SELECT count(*) AS count, NULL::DOUBLE AS avg FROM nodes WHERE kind = 'nation'")
def a02b(spark, sf):
    return NodeQuery(nodes(spark, sf)).filter("nation").aggregate().select("count", "avg")


@query("k02_limit_offset", _N + "SELECT id, row_number() OVER (ORDER BY coalesce(name, '') DESC, id) AS place FROM nodes WHERE kind = 'customer' QUALIFY place > 10 AND place <= 35")
def k02(spark, sf):
    from pyspark.sql import Window

    page = NodeQuery(nodes(spark, sf)).filter("customer").order_by("name", descending=True).offset(10).limit(25).execute()
    return page.select("id", (F.row_number().over(Window.orderBy(F.desc("name"), "id")) + 10).cast("long").alias("place"))  # one page


@query("k10_clamped_limit", _N + "SELECT 'none' AS asked, least(50, count(*)) AS n FROM nodes WHERE kind = 'order' UNION ALL SELECT 'many', least(1000, count(*)) FROM nodes WHERE kind = 'order' UNION ALL SELECT 'some', least(7, count(*)) FROM nodes WHERE kind = 'order'")
def k10(spark, sf):
    q = NodeQuery(nodes(spark, sf)).filter("order").order_by("name")
    parts = [q.limit(clamp_limit(n)).execute().agg(F.count("*").alias("n")).select(F.lit(k).alias("asked"), "n") for k, n in (("none", None), ("many", 10**9), ("some", 7))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f01_builder", _NE + "SELECT n.id, count(*) AS callers FROM nodes n JOIN edges e ON e.dst = n.id AND e.kind = 'CALLS' WHERE n.kind = 'customer' AND n.file_path = 'BUILDING' GROUP BY n.id")
def f01(spark, sf):
    n = NodeQuery(nodes(spark, sf)).filter("customer").where_field("file_path", "BUILDING").execute().select("id")
    e = EdgeQuery(edges(spark, sf)).filter("CALLS").execute().select(F.col("dst").alias("id"))
    return n.join(e, "id").groupBy("id").agg(F.count("*").alias("callers"))


@query("f15_edge_factories", _E + "SELECT kind, kind = 'CALLS' AS call, kind IN ('DATAFLOW', 'READS', 'WRITES') AS dfg, kind LIKE 'CFG_%' AS cfg, true AS \"all\", count(*) AS n FROM edges GROUP BY ALL")
def f15(spark, sf):
    flags = {n: getattr(E, n).column().alias(n) for n in ("call", "dfg", "cfg", "all")}
    return edges(spark, sf).groupBy("kind", *flags.values()).agg(F.count("*").alias("n"))


_KINDS = ["Variable", "Function", "Block", "Expression", "Class", "Module", "Field", "TemplateSlot", "Alias"]


def _typed(spark, sf):
    """Parts as nodes of the language's kinds."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    return read(spark, sf, "part").select(_key("p_partkey").alias("id"), kind.alias("kind"), F.col("p_type").alias("name"), F.col("p_brand").alias("file_path"))


_TYPED = "t AS (SELECT p_partkey::VARCHAR AS id, [" + ", ".join(f"'{k}'" for k in _KINDS) + "][p_partkey % 9 + 1] AS kind, p_type AS name FROM part)"


@query("f16_node_factories", f"WITH {_TYPED} SELECT id, lower(kind) AS made FROM t")
def f16(spark, sf):
    made = {"variable": Q.var(), "function": Q.func(), "block": Q.block(), "expression": Q.expr(), "class": Q.cls(), "module": Q.module(), "field": Q.field(), "templateslot": Q.template_slot(), "alias": Q.alias_of()}
    name = F.lit(None).cast("string")
    for kind, selector in made.items():
        name = F.when(selector.column(), kind).otherwise(name)
    return _typed(spark, sf).select("id", name.alias("made"))


@query("f19_match_call", f"WITH {_TYPED} SELECT id FROM t WHERE kind = 'Function' AND name = 'Manufacturer#1'")
def f19(spark, sf):
    """A call selects functions of that exact name."""
    return _typed(spark, sf).where(Q.call("Manufacturer#1").column()).select("id")


@query("f20_match_block_expr_module", f"WITH {_TYPED} SELECT id, kind FROM t WHERE kind = 'Block' OR (kind = 'Expression' AND name = 'Manufacturer#2') OR (kind = 'Module' AND name LIKE 'Manufacturer#%')")
def f20(spark, sf):
    t = _typed(spark, sf)
    return t.where((Q.block() | Q.expr("Manufacturer#2")).column() | (Q.module().column() & F.col("name").like("Manufacturer#%"))).select("id", "kind")


@query("f17_edge_union", _E + "SELECT src, dst FROM edges WHERE kind IN ('CALLS', 'DATAFLOW', 'READS', 'WRITES')")
def f17(spark, sf):
    return edges(spark, sf).where((E.dfg | E.call).column()).select("src", "dst")


# --- paths ------------------------------------------------------------------


def _walks(start, kinds, depth, end, extra="true"):
    return _REC + f"""p(src, dst, depth, path, done) AS (
  SELECT id, id, 0, [id], false FROM nodes WHERE {start}
  UNION ALL
  SELECT p.src, e.dst, depth + 1, list_append(path, e.dst), coalesce(t.id IS NOT NULL, false)
  FROM p JOIN (SELECT DISTINCT src, dst FROM edges WHERE kind IN ({kinds})) e ON e.src = p.dst LEFT JOIN (SELECT id FROM nodes WHERE {end}) t ON t.id = e.dst
  WHERE NOT done AND depth < {depth} AND NOT list_contains(path, e.dst) AND {extra})
SELECT array_to_string(path, '>') AS path FROM p WHERE done"""


def _joined(df):
    return df.select(F.array_join("path", ">").alias("path"))


@query("g04_via", _walks("kind = 'supplier'", "'CONTAINS'", 2, "kind = 'region'"))
def g04(spark, sf):
    flow = (Q.kind("supplier") >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(2).unlimited()
    return _joined(paths.run(flow, nodes(spark, sf), edges(spark, sf)))


@query("g15_simple_paths", _walks("kind = 'customer' AND file_path = 'MACHINERY'", "'CONTAINS'", 3, "kind = 'region' AND name = 'ASIA'"))
def g15(spark, sf):
    flow = (Q.kind("customer") & Q.in_file("MACHINERY")) >> Q.kind("region", "ASIA")
    return _joined(paths.run(flow.via(E.kinds("CONTAINS")).depth(3).unlimited(), nodes(spark, sf), edges(spark, sf), flip=False))


@query("g17_flipped_paths", _walks("kind = 'customer' AND file_path = 'MACHINERY'", "'CONTAINS'", 3, "kind = 'region' AND name = 'ASIA'"))
def g17(spark, sf):
    """The same paths from the smaller end."""
    flow = (Q.kind("customer") & Q.in_file("MACHINERY")) >> Q.kind("region", "ASIA")
    return _joined(paths.run(flow.via(E.kinds("CONTAINS")).depth(3).unlimited(), nodes(spark, sf), edges(spark, sf), flip=True))


@query("g16_backward_paths", _REC + "p(dst, depth, path, done) AS (SELECT id, 0, [id], false FROM nodes WHERE kind = 'region' UNION ALL SELECT e.src, depth + 1, list_append(path, e.src), coalesce(t.id IS NOT NULL, false) FROM p JOIN (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CONTAINS') e ON e.dst = p.dst LEFT JOIN (SELECT id FROM nodes WHERE kind = 'supplier') t ON t.id = e.src WHERE NOT done AND depth < 3 AND NOT list_contains(path, e.src)) SELECT array_to_string(path, '>') AS path FROM p WHERE done")
def g16(spark, sf):
    flow = (Q.kind("supplier") << Q.kind("region")).via(E.kinds("CONTAINS")).depth(3).unlimited()
    return _joined(paths.run(flow, nodes(spark, sf), edges(spark, sf)))


@query("u05_excluding", _walks("kind = 'supplier'", "'CONTAINS'", 3, "kind = 'region'", "e.dst NOT IN (SELECT 'n:' || n_nationkey FROM nation WHERE n_name LIKE '%A')"))
def u05(spark, sf):
    flow = (Q.kind("supplier") >> Q.kind("region")).via(E.kinds("CONTAINS")).depth(3).unlimited()
    ending = Q.kind("nation") & type(Q.any())(lambda: F.col("name").like("%A"))
    return _joined(paths.run(flow.excluding(ending), nodes(spark, sf), edges(spark, sf)))


@query("u11_meeting_points", _NE + "SELECT DISTINCT m AS node FROM (SELECT e.src AS m, e.src, e.dst FROM edges e UNION ALL SELECT e.dst, e.src, e.dst FROM edges e) WHERE src IN (SELECT id FROM nodes WHERE kind = 'supplier') AND dst IN (SELECT id FROM nodes WHERE kind = 'nation' AND name < 'G')")
def u11(spark, sf):
    n, e = nodes(spark, sf), edges(spark, sf).where("kind = 'CONTAINS'")
    return paths.meeting(e, n.where("kind = 'supplier'").select("id"), n.where("kind = 'nation' and name < 'G'").select("id"), 1)


@query("g11_any_path", _E + "SELECT r_name AS name, EXISTS (SELECT 1 FROM edges a JOIN edges b ON b.src = a.dst AND b.kind = 'CONTAINS' WHERE a.kind = 'CONTAINS' AND a.src LIKE 's:%' AND b.dst = 'r:' || r_regionkey) AS found FROM region")
def g11(spark, sf):
    n, e = nodes(spark, sf), edges(spark, sf)
    names = [r["r_name"] for r in read(spark, sf, "region").select("r_name").collect()]  # five names
    rows = [(x, paths.any_path((Q.kind("supplier") >> Q.kind("region", x)).via(E.kinds("CONTAINS")).depth(2), n, e)) for x in names]
    return spark.createDataFrame(rows, "name string, found boolean")


@query("g44_call_chain_plan", _E + "SELECT src || '>' || dst AS path FROM edges WHERE kind = 'CALLS' AND src IN ('o:1', 'o:2', 'o:3')")
def g44(spark, sf):
    plan = QueryPlan("call_chain", ("o:1", "o:2", "o:3"), (), 3, "heavy")
    return _joined(PlanExecutor(nodes(spark, sf), edges(spark, sf)).execute(plan))


@query("z03_cached_plans", _E + "SELECT 'answer' AS what, count(*) AS n FROM edges WHERE kind = 'CALLS' AND src = 'o:1' UNION ALL SELECT 'hits', 2 UNION ALL SELECT 'misses', 2")
def z03(spark, sf):
    """A plan asked three times and again under another snapshot: two hits, two misses."""
    cache, plan = Cache(), QueryPlan("call_chain", ("o:1",))
    n, e = nodes(spark, sf), edges(spark, sf)
    for snapshot, times in (("a", 3), ("b", 1)):
        for _ in range(times):
            out = PlanExecutor(n, e, snapshot, cache).execute(plan)
    counts = spark.createDataFrame([("hits", cache.hits), ("misses", cache.misses)], "what string, n long")
    return out.agg(F.count("*").alias("n")).select(F.lit("answer").alias("what"), "n").unionByName(counts)


@query("z04_stages", "SELECT n_regionkey AS region, count(*) AS nations, 100 * count(*) AS score FROM nation GROUP BY 1")
def z04(spark, sf):
    """Stages given out of order run in topological order."""
    s = Stages()
    s.add("score", lambda r: r["count"].withColumn("score", F.col("nations") * 100), ("count",))
    s.add("count", lambda r: r["read"].groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("nations")), ("read",))
    s.add("read", lambda r: read(spark, sf, "nation"))
    return s.run()["score"]


# --- clones -----------------------------------------------------------------


def _names(spark, sf):
    # a small file that much is made of: dealt to all tasks
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("code")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("d02_signature_slots", "SELECT p_partkey AS id, true AS within FROM part")
def d02(spark, sf):
    """A signature has no more slots than the fragment has shingles, nor than hashes asked for."""
    h = D.shingle_hashes(_names(spark, sf))
    n = D.signatures(h, 16).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"))
    return h.join(n, "id").select("id", ((F.col("n") == F.col("slots")) & (F.col("n") <= F.least(F.lit(16), F.size("hs"))) & (F.col("n") >= 1)).alias("within"))


@query("d03_equal_texts_estimate_one", "SELECT a.p_partkey AS a, b.p_partkey AS b, 1.0::DOUBLE AS similarity FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey AND a.p_brand = b.p_brand")
def d03(spark, sf):
    label = read(spark, sf, "part").where("p_name is not null and p_brand is not null").select(F.col("p_partkey").alias("id"), F.struct("p_name", "p_brand").alias("label"))
    return D.estimate(D.sketches(D.shingle_hashes(_names(spark, sf)), 32), label)


@query("j13_equal_texts_share_bands", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey")
def j13(spark, sf):
    """Candidates that are equal texts: all pairs of them share a band."""
    label = read(spark, sf, "part").where("p_name is not null").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return D.candidate_pairs(D.sketches(D.shingle_hashes(_names(spark, sf)), 32), 32, label)


@query("a17_bucket_stats", "SELECT count(*) AS buckets, sum(n)::BIGINT AS entries, max(n) AS largest FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)")
def a17(spark, sf):
    """One band over all slots: its buckets are the different texts."""
    digests = _names(spark, sf).withColumn("code", F.md5("code"))  # texts whose shingles tell them apart
    return D.bucket_stats(D.sketches(D.shingle_hashes(digests), 32), 32)


@query("d10_clones_in_file", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
def d10(spark, sf):
    """Exact clones inside one file, as pairs of the group's first with the others and of those among themselves."""
    g = D.exact_groups(_names(spark, sf)).join(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand"), "id")
    x, y = (g.select(F.col("id").alias(n), "group_id", "p_brand") for n in ("a", "b"))
    return x.join(y, ["group_id", "p_brand"]).where("a < b").select("a", "b")


# --- incremental ------------------------------------------------------------


@query("t17_delta_and_tombstones", "SELECT o_orderkey AS k, 'd' AS origin FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'b' FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def t17(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return I.merge_delta(o.withColumn("origin", F.lit("b")), o.where("k % 5 = 0").withColumn("origin", F.lit("d")), o.where("k % 7 = 0 and k % 5 != 0"), "k")


@query("n09_unsanitised_flows", _E + ", f AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'CONTAINS') SELECT a.src AS source, b.dst AS sink, 2 AS distance FROM f a JOIN f b ON b.src = a.dst WHERE a.src LIKE 's:%' AND b.dst LIKE 'r:%' AND a.dst NOT IN (SELECT 'n:' || n_nationkey FROM nation WHERE n_nationkey % 4 = 0)")
def n09(spark, sf):
    """From suppliers to regions past the nations that sanitise."""
    n, e = nodes(spark, sf), edges(spark, sf).where("kind = 'CONTAINS'")
    clean = read(spark, sf, "nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("n:"), _key("n_nationkey")).alias("id"))
    return A.tainted(n.where("kind = 'supplier'").select("id"), n.where("kind = 'region'").select("id"), clean, e)
