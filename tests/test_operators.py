"""Operators on hand-made tables with known answers."""

import ast

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scores, text
from loomgraph.operators import analysis, clones, graph, history, incremental, ranking, rules, search
from loomgraph.plans import paths
from loomgraph.plans.builder import EdgeQuery, NodeQuery
from loomgraph.plans.selectors import E, Limits, Q
from loomgraph.plans.service import Cache, PlanExecutor, QueryPlan, Registry, Stages, clamp_limit, escalated, page, tuned
from loomgraph.schema import CHUNK, EDGE, NODE
from loomgraph.sources import parsers, store
from loomgraph.streaming import events


@pytest.fixture(scope="module")
def scenario(spark):
    rows = [(f"func{i}", "function", f"func{i}", "a.py", str(5 * i), float(10 * i)) for i in range(1, 11)] + [(f"Class{i}", "class", f"Class{i}", "a.py", None, None) for i in range(1, 4)]
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, file_path string, metadata string, value double")
    edges = spark.createDataFrame([("func1", "func2", "CALLS"), ("func2", "func3", "CALLS"), ("func1", "var1", "DATAFLOW")], "src string, dst string, kind string")
    return nodes, edges


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_node_and_edge_queries(scenario):
    nodes, edges = scenario
    q = NodeQuery(nodes).filter("function")
    assert q.execute().count() == 10 and nodes.count() == 13
    a = q.limit(1).aggregate().first()
    assert (a["count"], a["avg"], a["min"], a["max"]) == (10, 27.5, 5, 50)
    assert q.aggregate("value").first()["sum"] == 550
    assert q.order_by("value", descending=True).limit(1).execute().first()["id"] == "func10"
    assert q.where(lambda: F.col("value") > 50).execute().count() == 5
    batches = list(q.stream(3))
    assert len(batches) == 4 and len(batches[-1]) == 1
    assert q.for_each_batch(4, lambda b: None) == 3
    with pytest.raises(ValueError):
        list(q.stream(0))
    e = EdgeQuery(edges)
    assert ids(e.callers_of("func2").execute(), "src") == ["func1"]
    assert ids(e.callees_of("func2").execute(), "dst") == ["func3"]
    assert ids(e.dataflow_from("func1").execute(), "dst") == ["var1"]
    assert e.where_field("other", "x").execute().count() == 0 and e.filter("ALL").execute().count() == 3


@pytest.fixture(scope="module")
def diamond(spark):
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in ("ab", "ac", "bd", "cd", "da")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(n, "function", n, None, None, None) for n in "abcd"], "id string, kind string, name string, file_path string, metadata string, value double")
    return nodes, edges


def test_paths_in_a_diamond_with_a_cycle(spark, diamond):
    nodes, edges = diamond
    flow = (Q.by_id("a") >> Q.by_id("d")).via(E.call).depth(3)
    found = [r["path"] for r in paths.run(flow, nodes, edges).collect()]
    assert found == [["a", "b", "d"], ["a", "c", "d"]]
    assert [r["path"] for r in paths.run((Q.by_id("a") << Q.by_id("d")).depth(2), nodes, edges).collect()] == [["d", "b", "a"], ["d", "c", "a"]]
    assert ids(paths.reach(edges, spark.createDataFrame([("a",)], "id string")), "node") == ["b", "c", "d"]
    assert {r["node"]: r["root"] for r in paths.strong_components(edges).collect()} == dict.fromkeys("abcd", "a")
    assert paths.any_path(flow, nodes, edges) and not paths.any_path(flow.excluding(Q.by_id("b") | Q.by_id("c")), nodes, edges)
    with pytest.raises(ValueError):
        paths.levels(edges)
    with pytest.raises(ValueError):
        Limits(max_paths=0)
    assert "via CALLS depth 1..3" in flow.explain()


def test_walking_from_the_smaller_end_changes_nothing(spark):
    edges = spark.createDataFrame([(f"s{i}", "m", "CALLS") for i in range(40)] + [("m", "t", "CALLS"), ("s1", "s2", "CALLS")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(f"s{i}", "start") for i in range(40)] + [("m", "mid"), ("t", "end")], "id string, kind string").withColumn("name", F.col("id"))
    flow = (Q.kind("start") >> Q.kind("end")).depth(3).limit_paths(1000)
    a, b = ([tuple(r["path"]) for r in paths.run(flow, nodes, edges, flip=f).collect()] for f in (True, False))
    assert a == b and len(a) == 41


def test_depth_bound(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "CALLS") for i in range(12)], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(f"n{i}", "f", f"n{i}") for i in range(13)], "id string, kind string, name string")
    reach = lambda t: paths.run(Q.by_id("n0") >> Q.by_id(t), nodes, edges).count()
    assert reach("n10") == 1 and reach("n11") == 0


def test_rank_and_hubs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("d", "e")], "src string, dst string")
    rank = {r["node"]: r["score"] for r in paths.rank(edges, 30).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["c"] == max(rank.values())
    personal = {r["node"]: r["score"] for r in paths.rank(edges, 30, personal=spark.createDataFrame([("d", 1.0)], "node string, weight double")).collect()}
    assert personal["d"] > rank["d"]
    assert {r["node"]: r["hub"] for r in paths.hubs(edges).collect()}["d"] > 0.5


def test_fusion_examples(spark):
    hits = spark.createDataFrame([(1, "lexical", "x", 0.9), (1, "lexical", "y", 0.8), (1, "vector", "y", 0.9), (1, "vector", "z", 0.8)], "query_id int, source string, chunk_id string, score double")
    order = [(r["chunk_id"], r["score"]) for r in ranking.top_k(ranking.rrf(hits), 9).orderBy("rank").collect()]
    assert [c for c, _ in order] == ["y", "x", "z"] and abs(order[0][1] - (1 / 61 + 1 / 62)) < 1e-12
    two = spark.createDataFrame([(1, "vector", "c", 0.9)] + [(1, "lexical", n, s) for n, s in (("a", 0.9), ("b", 0.8), ("c", 0.7))], "query_id int, source string, chunk_id string, score double")
    c = ranking.consensus(two).where("chunk_id = 'c'").first()
    assert (c["avg_rank"], round(c["quality"], 4), round(c["factor"], 5)) == (2.0, 0.8333, 1.03058)
    one = ranking.consensus(two).where("chunk_id = 'a'").first()
    assert round(one["factor"], 5) == 0.95455


def test_cutoff_overlap_and_packing(spark):
    scores_ = [0.9, 0.85, 0.8, 0.75, 0.7, 0.4, 0.35, 0.3, 0.25]
    df = spark.createDataFrame([(1, f"c{i}", s) for i, s in enumerate(scores_)], "query_id int, chunk_id string, score double")
    assert ranking.adaptive_k(df).first()["k"] == 5
    spans = spark.createDataFrame([("f", 1, 10, 0.9), ("f", 2, 5, 0.8), ("f", 8, 13, 0.7)], "file string, start int, end int, score double")
    assert sorted((r["start"], r["score"]) for r in ranking.overlap_dedup(spans).collect()) == [(1, 0.9), (8, 0.35)]
    chunks = spark.createDataFrame([(1, f"c{i}", i, t) for i, t in enumerate([500, 400, 300, 50], 1)], "query_id int, chunk_id string, rank int, tokens long")
    assert [(r["chunk_id"], r["tokens"]) for r in ranking.packed(chunks, 1150).orderBy("place").collect()] == [("c1", 500), ("c2", 400), ("c3", 250)]


def test_ndcg_example(spark):
    shown = spark.createDataFrame([(1, f"c{i}", i) for i in range(1, 6)], "query_id int, chunk_id string, rank int")
    m = ranking.retrieval_metrics(shown, spark.createDataFrame([(1, "c2"), (1, "c4"), (2, "z")], "query_id int, chunk_id string"), 5)
    rows = {r["query_id"]: r for r in m.collect()}
    assert round(rows[1]["ndcg"], 4) == 0.6509 and rows[1]["rr"] == 0.5 and rows[1]["recall"] == 1.0 and rows[2]["ndcg"] == 0


def test_co_change_and_snapshots(spark):
    c = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "B"), (3, "A"), (4, "B"), (4, "C")], "commit int, path string")
    ab = history.co_changes(c).where("a = 'A' and b = 'B'").first()
    assert ab["coupling"] == 0.5 and round(ab["b_given_a"], 4) == round(ab["a_given_b"], 4) == 0.6667
    one = lambda rows: spark.createDataFrame(rows, "fqn string, content_hash string, file string")
    d = history.compare_snapshots(one([("f", "h1", "x"), ("g", "h2", "x"), (None, "z", "x")]), one([("f", "h9", "x"), ("k", "h3", "x")]))
    assert sorted((r["fqn"], r["change"]) for r in d.collect()) == [("f", "modified"), ("g", "deleted"), ("k", "added")]


def test_tokenizers_and_wildcards(spark):
    names = spark.createDataFrame([("getUserName",), ("HTTPServer_v2",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(text.identifier_tokens(F.col("n"))).collect()] == [["get", "user", "name"], ["http", "server", "v2"], [], None]
    pairs = spark.createDataFrame([("*.Cursor", "sqlite3.cursor"), ("execute*", "executemany"), ("*", ""), ("*", None), ("a.c", "abc")], "p string, t string")
    assert [r[0] for r in pairs.select(text.wildcard_match(F.col("p"), F.col("t"))).collect()] == [True, True, False, False, False]


def test_rule_tiers_lose_no_match(spark):
    patterns = ["*brass", "st*", "*an*", "abc", "a*c", "*", "", "x*yz*", "*é*", "**"]
    texts = ["abc", "ABRASS", "stan", "xayzq", "é", "a", "", None, "ac", "st"]
    r = spark.createDataFrame([(f"r{i}", p) for i, p in enumerate(patterns)], "rule_id string, pattern string")
    e = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    fast = sorted(map(tuple, rules.matches(r, e).collect()))
    slow = sorted(map(tuple, r.crossJoin(e).where(text.wildcard_match(F.col("pattern"), F.col("text"))).select("rule_id", "id").collect()))
    assert fast == slow


def test_rule_predicates(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(rules.is_const(F.lit("'a'")))["ok"] and not get(rules.is_const(F.lit(None).cast("string")))["ok"]
    assert get(rules.is_not_const(F.lit("user")))["delta"] == 0.1 and not get(rules.matches_regex(F.lit("a"), "("))["ok"]
    guards = F.array(F.struct(F.lit("k").alias("kind"), F.lit("safe()").alias("pattern"), F.lit("reduce").alias("effect"), F.lit(0.4).alias("multiplier")))
    v = get(rules.guard(guards, "k", "safe"))
    assert v["ok"] and abs(v["delta"] + 0.6) < 1e-9
    assert get(rules.guard(guards, "other", "safe"))["delta"] == 0


def test_incremental(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "file string, v int")
    out = incremental.merge_delta(base, spark.createDataFrame([("b", 2)], "file string, v int"), spark.createDataFrame([("c",)], "file string"))
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 2)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "src string, dst string")
    assert incremental.without_nodes(edges, spark.createDataFrame([("b",)], "id string")).count() == 1


def test_store(spark, tmp_path):
    s = store.ChunkStore(spark, f"file://{tmp_path}/store")
    assert s.chunks().count() == 0
    row = lambda i, snap, h, dead=False: (f"c{i}", "r", snap, f"f{i % 2}.py", 1, 9, "function", f"m.f{i}", "python", "public", "text", h, None, 0.5, dead, {}, None, None)
    s.save(spark.createDataFrame([row(1, "s1", "a"), row(2, "s1", "b"), row(3, "s1", "c", True)], CHUNK))
    s.save(spark.createDataFrame([row(1, "s2", "x"), row(4, "s2", "d")], CHUNK))
    assert s.count("r", "s1") == 2 and s.find(store.ChunkFilter(path_like="f1%")).count() == 2
    assert sorted((r["fqn"], r["change"]) for r in s.compare("s1", "s2").collect()) == [("m.f1", "modified"), ("m.f2", "deleted"), ("m.f4", "added")]
    after = s.replaced("f1.py", "s1", spark.createDataFrame([row(9, "s1", "n")], CHUNK))
    assert after.where("not is_deleted and snapshot_id = 's1'").count() == 2


def test_payload(spark, tmp_path):
    n = [("n1", "function", "f", "m.f", "a.py", "python", None, None, None, None, (1, 0, 5, 0), False, i, {}) for i in range(3)] + [("n9", "class", "C", "m.C", "b.py", "python", None, None, None, None, (1, 0, 5, 0), False, 0, {})]
    e = [("e1", "IMPORTS", "n1", "n9", None, 0, {}), ("e2", "CALLS", "n1", "n9", None, 0, {})]
    store.write_payload(spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE), f"file://{tmp_path}/p")
    assert {(r["file_path"], r["nodes"]) for r in store.file_summary(spark, f"file://{tmp_path}/p").collect()} == {("a.py", 3), ("b.py", 1)}
    assert store.file_nodes(spark, f"file://{tmp_path}/p", "b.py").count() == 1 and store.import_edges(spark, f"file://{tmp_path}/p").count() == 1


CODE = '''import os
from .util import helper
class A(Base):
    """Doc."""
    def m(self):
        x = helper()
        if x:
            return os.path.join(x)
def broken():
    return A().m()
'''


def test_python_parser(spark):
    files = spark.createDataFrame([("src/pkg/mod.py", CODE), ("bad.py", "def ("), ("none.py", None)], "path string, content string")
    symbols = {r["fqn"]: r for r in parsers.python_symbols(files).collect()}
    assert symbols["pkg.mod.A.m"]["kind"] == "method" and symbols["pkg.mod.A"]["docstring"] == "Doc." and symbols["pkg.mod.A.m"]["complexity"] == 2
    assert "SyntaxError" in symbols["bad"]["error"] and symbols["none"]["error"] is None
    rel = {(r["kind"], r["src"], r["dst"]) for r in parsers.python_relations(files).collect()}
    assert {("INHERITS", "pkg.mod.A", "Base"), ("CALLS", "pkg.mod.A.m", "os.path.join"), ("IMPORTS", "pkg.mod", ".util.helper"), ("CONTAINS", "pkg.mod.A", "pkg.mod.A.m")} <= rel
    assert len(ast.parse(CODE).body) == 4


def test_document_parsers(spark):
    md = spark.createDataFrame([("d.md", "intro\n# One\ntext\n```\n# no\n```\n## Two\nmore")], "path string, content string")
    got = [(r["section"], r["level"], r["title"], r["body"]) for r in parsers.markdown_sections(md).orderBy("section").collect()]
    assert got == [(0, 0, None, "intro"), (1, 1, "One", "text\n```\n# no\n```"), (2, 2, "Two", "more")]
    nb = spark.createDataFrame([("n.ipynb", '{"cells":[{"cell_type":"code","source":["a\\n","b"]},{"cell_type":"markdown","source":"c"}]}'), ("x.ipynb", "{")], "path string, content string")
    assert [(r["cell_type"], r["source"]) for r in parsers.notebook_cells(nb).orderBy("cell").collect()] == [("code", "a\nb"), ("markdown", "c")]
    log = spark.createDataFrame([("l", "abc|2024-01-01\n3\t1\ta.py\n-\t-\tb.bin\ndef|2024-01-02\n2\t0\tc.py")], "path string, content string")
    assert sorted((r["commit"], r["file"], r["adds"]) for r in parsers.git_log(log).collect()) == [("abc", "a.py", 3), ("def", "c.py", 2)]
    diff = spark.createDataFrame([("d", "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n+b\n-c\n+d\n@@ -9 +10 @@\n-q")], "path string, content string")
    assert sorted((r["old_start"], r["old_count"], r["added"], r["removed"]) for r in parsers.diff_hunks(diff).collect()) == [(1, 2, 2, 1), (9, 1, 0, 1)]
    p = spark.createDataFrame([("./a//b.py",), ("a/x/../b",), ("../up",)], "p string")
    assert [r[0] for r in p.select(parsers.normalized_path(F.col("p"))).collect()] == ["a/b.py", "a/b", None]


def test_points_to_with_loads_and_stores(spark):
    c = spark.createDataFrame([("ALLOC", 1, 100), ("ALLOC", 2, 200), ("STORE", 1, 2), ("LOAD", 3, 1), ("COPY", 4, 3)], "kind string, lhs long, rhs long")
    assert sorted(map(tuple, analysis.points_to(c).collect())) == [(1, 100), (2, 200), (3, 200), (4, 200), (100, 200)]


def test_effects_and_typestate(spark):
    own = spark.createDataFrame([("a", "PURE"), ("b", "IO"), ("c", "PURE")], "fn string, effect string")
    calls = spark.createDataFrame([("a", "b"), ("c", "x")], "src string, dst string")
    assert sorted(map(tuple, analysis.effects(own, calls).collect())) == [("a", "IO"), ("b", "IO"), ("c", "UNKNOWN")]
    log = spark.createDataFrame([("f", 1, "open"), ("f", 2, "open"), ("f", 3, "close"), ("g", 1, "open")], "object string, seq int, action string")
    got = {r["object"]: (r["state"], r["violations"], r["leaked"]) for r in analysis.typestate(log, {("closed", "open"): "open", ("open", "close"): "closed"}, "closed", {"closed"}).collect()}
    assert got == {"f": ("closed", 1, False), "g": ("open", 0, True)}


def test_near_clones_and_labels(spark):
    base = "def f(x):\n    return x + 1  " + " ".join(f"name{i * i}" for i in range(60))
    f = spark.createDataFrame([(1, base), (2, base + "//c"), (3, base.replace("return", "yield", 1)), (4, "other text entirely, nothing shared")], "id int, code string")
    assert sorted((r["a"], r["b"]) for r in clones.near_clones(f, 0.7, 64, 32).collect()) == [(1, 2), (1, 3), (2, 3)]
    assert {r["id"] for r in clones.exact_groups(f).collect()} == {1, 2}
    nodes = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, label string")
    labels = {r["id"]: r["label"] for r in clones.wl_labels(nodes, spark.createDataFrame([("a", "c")], "src string, dst string"), 1).collect()}
    assert labels["a"] != labels["b"]


def test_search_stages(spark):
    symbols = spark.createDataFrame([("getUser",), ("getUsers",), ("setName",)], "name string")
    q = spark.createDataFrame([("1", "GETUSER"), ("2", "getUsrs"), ("3", "zz")], "query_id string, text string")
    got = {(r["query_id"], r["name"], r["stage"]) for r in search.symbol_search(symbols, q).collect()}
    assert got == {("1", "getUser", "exact"), ("2", "getUsers", "fuzzy")}
    w = search.blended_weights({"flow": 0.5, "symbol": 0.5})
    assert abs(sum(w.values()) - 1) < 1e-9 and w["graph"] > w["vector"]


def test_bucket_shares(spark):
    n = {r["v"]: r["n"] for r in spark.range(2000).select(scores.bucket("e", F.col("id"), {"a": 0.5, "b": 0.5}).alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert 900 < n["a"] < 1100


def test_streaming_append_windows(spark):
    rows = [(i, F.lit(None)) for i in range(0)] or [(i, f"2024-01-01 00:{i:02d}:00", 1.0) for i in range(0, 50, 5)]
    e = spark.createDataFrame(rows, "event_id int, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    out = events.replay(spark, e, lambda s: events.tumbling(s, "10 minutes", watermark="1 minute"))
    assert {r["n"] for r in out.collect()} == {2}


def test_plans_cache_and_stages(scenario):
    nodes, edges = scenario
    plan = QueryPlan("call_chain", ("func1",), ("func3",))
    run = PlanExecutor(nodes, edges)
    assert run.execute(plan).first()["path"] == ["func1", "func2", "func3"]
    run.execute(plan)
    assert (run.cache.hits, run.cache.misses) == (1, 1) and len(plan.digest()) == 16
    with pytest.raises(NotImplementedError):
        QueryPlan("impact", ("a",)).validate()
    assert "NotImplementedError" in run.execute_all([QueryPlan("primitive", ("a",))]).popitem()[1]
    clock = iter(range(0, 1000, 200)).__next__
    c = Cache(1, 300, lambda: clock())
    c.put("a", 1)
    assert c.get("a") == 1 and c.get("a") is None
    stages = Stages().add("l2", lambda r: r["l1"] + 1, ("l1",)).add("l1", lambda r: 1)
    assert stages.order() == [["l1"], ["l2"]] and stages.run()["l2"] == 2 and stages.run({"l1": 5})["l2"] == 6
    with pytest.raises(ValueError):
        Stages().add("a", lambda r: 1, ("b",)).order()
    first, at = page(nodes, ["id"], 6)
    second, at2 = page(nodes, ["id"], 6, at)
    third, end = page(nodes, ["id"], 6, at2)
    assert first.count() == second.count() == 6 and third.count() == 1 and end is None
    assert (clamp_limit(None), clamp_limit(0), clamp_limit(5000)) == (50, 50, 1000)
    r = Registry()
    r.register("x")(lambda v: v + 1)
    assert r("x", 1) == 2
    with pytest.raises(KeyError):
        r("y")
    assert tuned([{"a": 1.0}, {"a": 2.0}, {"a": 9.0}], lambda c: c["a"] < 5, lambda c: c["a"])[0] == {"a": 2.0}
    low, high = nodes.select(F.lit(0.1).alias("score")), nodes.select(F.lit(0.9).alias("score"))
    assert escalated("q", [("cheap", lambda q: low), ("deep", lambda q: high)], 0.5)[0] == "deep"


def test_graph_helpers(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string").withColumn("kind", F.lit("CALLS"))
    start = spark.createDataFrame([("b",)], "id string")
    assert sorted((r["node"], r["score"]) for r in graph.both_ways(edges, start).collect()) == [("a", 0.34), ("c", 0.51), ("d", 0.42)]
    assert graph.degrees(edges).where("node = 'a'").first()["incoming"] == 0


def test_near_clones_in_wide_buckets(spark):
    """Sixty copies and sixty pairs around one common passage, in one band: all pairs, not only those with the first."""
    passage = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))
    own = lambda g: "".join(f"{chr(97 + g % 26)}{g * 7919 + i * 31}" for i in range(20))
    rows = [(i, "the same text") for i in range(60)]
    rows += [(100 + 2 * g + k, passage + own(g) + "?!" * k) for g in range(60) for k in (0, 1)]
    f = spark.createDataFrame(rows, "id long, code string")
    sets = {r["id"]: set(r["hs"]) for r in clones.shingle_hashes(f).collect()}
    want = sorted((a, b) for a, x in sets.items() for b, y in sets.items() if a < b and min(x) == min(y) and len(x & y) >= 0.7 * len(x | y))
    assert len(want) > 60 * 59 // 2
    assert sorted((r["a"], r["b"]) for r in clones.near_clones(f, 0.7, 1, 1).collect()) == want


def test_near_clones_of_long_texts(spark, tmp_path):
    """The query takes texts of over 4,000 characters."""
    from loomgraph.queries import QUERIES

    long = " ".join(f"word{i}" for i in range(1000))
    spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r["a"], r["b"]) for r in QUERIES["d04_near_clones"](spark, str(tmp_path)).collect()] == [(1, 2)]
