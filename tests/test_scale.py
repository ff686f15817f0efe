"""Operators whose work must follow the input and the result: hot keys, many copies, keys cut from texts."""

from pyspark.sql import functions as F

from loomgraph.functions import scores, text
from loomgraph.operators import analysis, rules


def test_rule_matches_broadcast_no_entities(spark, tmp_path):
    """texts cut into keys look small to the planner; only lengths and first characters are broadcast."""
    spark.createDataFrame([(1, "a bolt"), (2, "Hot rod")], "id long, text string").write.parquet(f"{tmp_path}/e")
    r = spark.createDataFrame([("r1", "*bolt*"), ("r2", "h*"), ("r3", "*d"), ("r4", "*")], "rule_id string, pattern string")
    found = rules.matches(r, spark.read.parquet(f"{tmp_path}/e"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert (plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin"), plan.count("BroadcastNestedLoopJoin")) == (5, 1, 2)
    assert sorted(map(tuple, found.collect())) == [("r1", 1), ("r2", 2), ("r3", 2), ("r4", 1), ("r4", 2)]


def test_shadowing_against_all_pairs(spark):
    """every kind of pattern, several rules of one, null and empty ones."""
    patterns = ["*", "*", "**", "bol*", "BOL*", "bol*", "*olt", "b*t", "bolt", "bolt", "Bolt", "", None, "*ol*", "x"]
    r = spark.createDataFrame([(f, f"r{i}", p) for f in ("f", "g") for i, p in enumerate(patterns)] + [("h", "r0", "bol*"), (None, "r1", "*")], "family string, rule_id string, pattern string")
    a, b = r.toDF("family", "wide", "wp"), r.toDF("family", "narrow", "np")
    want = a.join(b, "family").where((F.col("wide") != F.col("narrow")) & text.subsumes(F.col("wp"), F.col("np"))).select("family", "wide", "narrow")
    got = rules.shadowing(r)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    from loomgraph.operators import pairs  # the pairs come from lists of ids, not from a join by family

    assert pairs.LIST > 1 and "explode(xs" in got._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_lists(spark, monkeypatch):
    """F8: classes of several lists give each pair once."""
    from loomgraph.operators import pairs

    monkeypatch.setattr(pairs, "LIST", 3)
    m = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(20, 27)] + [("c", 99)], "cls string, id long")
    links = spark.createDataFrame([("a", "a", 1), ("a", "b", 2), ("c", "c", 3)], "x string, y string, w int")
    want = sorted([(1, i, j) for i in range(20) for j in range(i + 1, 20)] + [(2, i, j) for i in range(20) for j in range(20, 27)])
    assert sorted(map(tuple, pairs.expanded(links, m).collect())) == want
    both = pairs.expanded(spark.createDataFrame([("a", "a")], "x string, y string"), m, m)
    assert both.count() == both.distinct().count() == 20 * 19


def test_overlaps_of_equal_spans(spark):
    """F8: spans of equal lines meet as one."""
    spans = [(i, "f", 10 * (i % 4), 10 * (i % 4) + 10 + 60 * (i % 2)) for i in range(40)] + [(50, "f", 500, 500), (51, "g", 0, 900), (52, "f", 12, 5)]
    s = spark.createDataFrame(spans, "id long, file string, start int, end int")
    out = analysis.overlapping(s)
    want = sorted(("f" if f == "f" else f, a, b) for a, f, s1, e1 in spans for b, g, s2, e2 in spans if f == g and a < b and not (e1 < s2 or e2 < s1))
    assert sorted(map(tuple, out.collect())) == want
    assert "explode(xs" in out._jdf.queryExecution().optimizedPlan().toString()


def test_spans_held_by_points(spark):
    """counts by a running total; points without spans and files without points."""
    s = spark.createDataFrame([("f", 1, 5)] * 300 + [("f", 5, 9), ("f", 9, 3), ("g", 0, 1), ("k", None, 2)], "file string, start int, end int")
    p = spark.createDataFrame([("f", i) for i in range(12)] * 2 + [("h", 1)], "file string, line int")
    want = sorted([("f", i, 300 * (1 <= i <= 5) + (5 <= i <= 9)) for i in range(12)] + [("h", 1, 0)])
    assert sorted(map(tuple, analysis.holding(p, s).collect())) == want


def test_innermost_meets_equal_spans_once(spark):
    """of spans of equal lines only the first id goes into slots."""
    s = spark.createDataFrame([(i, "f", 0, 200) for i in range(9, 300)] + [(7, "f", 3, 9), (5, "f", 3, 9)], "id long, file string, start int, end int")
    p = spark.createDataFrame([("f", 4), ("f", 100), ("f", 300)], "file string, line int")
    out = analysis.innermost(p, s)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("f", 4, 5), ("f", 100, 9), ("f", 300, None)], key=str)
    assert "min(id" in out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[-1]


def test_estimates_of_copies(spark):
    """equal sketches are compared once, and only within a label."""
    from loomgraph.operators import clones

    rows = [(i, "one text of some length") for i in range(30)] + [(40 + i, "one text of some lengths") for i in range(3)] + [(90, "entirely unlike")]
    f = spark.createDataFrame(rows, "id long, code string")
    label = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i, _ in rows], "id long, label string")
    sig = {}
    for r in clones.signatures(clones.shingle_hashes(f), 32).collect():
        sig.setdefault(r["id"], {})[r["slot"]] = r["least"]
    alike = {(a, b): sum(x.get(s) == h for s, h in y.items()) / max(len(x), len(y)) for a, x in sig.items() for b, y in sig.items() if a < b}
    sk = clones.sketches(clones.shingle_hashes(f), 32)
    assert {(a, b): s for a, b, s in clones.estimate(sk).collect()} == {p: s for p, s in alike.items() if s}
    assert {(a, b): s for a, b, s in clones.estimate(sk, label).collect()} == {p: s for p, s in alike.items() if s and (p[0] + p[1]) % 2 == 0}


def test_candidates_of_copies(spark):
    """pairs of copies come from lists, others share a band of slots."""
    from loomgraph.operators import clones

    rows = [(i, "one text of some length") for i in range(30)] + [(40, "one text of some lengths"), (41, None), (42, ""), (43, ""), (90, "unlike")]
    f = spark.createDataFrame(rows, "id long, code string")
    sig = {}
    for r in clones.signatures(clones.shingle_hashes(f), 32).collect():
        sig.setdefault(r["id"], {}).setdefault(r["slot"] // 4, {})[r["slot"]] = r["least"]
    want = sorted((a, b) for a, x in sig.items() for b, y in sig.items() if a < b and any(x.get(k) == v for k, v in y.items()))
    out = clones.candidate_pairs(clones.sketches(clones.shingle_hashes(f), 32), 4)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 400


def test_sketches_are_made_where_rows_are_read(spark):
    """one shuffle by bucket and one of its totals; none by the slots of a fragment."""
    from loomgraph.operators import clones

    f = spark.createDataFrame([(1, "some text"), (2, "some text"), (3, "other"), (4, None)], "id long, code string")
    out = clones.bucket_stats(clones.sketches(clones.shingle_hashes(f), 32), 32)
    assert tuple(out.first()) == (2, 3, 2)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_near_clones_store_no_shingles(spark, monkeypatch):
    """what is written has no list of shingles, and the bounds before the comparison lose no pair."""
    from loomgraph.operators import clones

    texts = {g * 10 + k: " ".join(f"w{(g * 97 + i * 31 + (i < 3 * k) * 7) % 1009}" for i in range(40 + 20 * g)) for g in range(6) for k in range(5)}
    f = spark.createDataFrame(list(texts.items()), "id int, code string")
    written, keep = [], clones.keep
    monkeypatch.setattr(clones, "keep", lambda df, label: (written.append((label, df.columns)), keep(df, label))[1])
    got = {(r["a"], r["b"]): r["similarity"] for r in clones.near_clones(f, 0.6, 8, 8).collect()}
    sets = {r["id"]: set(r["hs"]) for r in clones.shingle_hashes(f).collect()}
    slot = lambda s: {h % 8: h for h in sorted(s, reverse=True)}
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and slot(x).items() & slot(y).items() and len(x & y) >= 0.6 * len(x | y)}
    assert got == want and want and not any("hs" in columns for _, columns in written)


def test_renames_against_all_pairs(spark):
    """common and rare parts, sizes, ties and a path of two sizes."""
    from loomgraph.operators import history

    old = [(f"src/a/b/c/d/e/f/g/h/i{i % 3}/x{i // 2}.py", 100 + i % 5) for i in range(400)] + [("src/z.py", None), ("other/x3.md", 7)]
    new = [(f"src/a/b/c/d/e/f/g/h/i{i % 4}/x{i}.py", 100 + i % 7) for i in range(150, 260)] + [("src/a/b/c/d/e/f/g/h/i1/new.py", 300), ("src/a/b/c/d/e/f/g/h/i1/new.py", 101), ("other/x3.md", 7), ("src/z.py", 3)]
    kind = "path string, size int"
    got = history.rename_pairs(spark.createDataFrame(new, kind), spark.createDataFrame(old, kind), alike_least=0.75)

    def alike(x, y):
        a, b = set(x.split("/")), set(y.split("/"))
        return len(a & b) / len(a | b)

    want = {}
    for p, s in new:
        for o, z in old:
            if p.rsplit(".", 1)[1] == o.rsplit(".", 1)[1] and (z is None or min(s, z) / max(s, z) >= 0.9) and alike(p, o) >= 0.75:
                want[p] = min(want.get(p, (0, "")), (-alike(p, o), o))
    found = {r["path"]: (-r["alike"], r["old_path"]) for r in got.collect()}
    assert sorted(found.items() ^ want.items()) == [] and len(want) > 90
    assert len({w[1] for w in want.values()}) > 20


def test_renames_in_one_folder_meet_once(spark, monkeypatch):
    """files that share only common parts meet as one class; a join by a common part would pair them all."""
    from loomgraph.operators import history

    monkeypatch.setattr(history, "COMMON", 4)
    f = spark.range(600).selectExpr("id", "concat('a/b/c/d/e/f/g/h/', id, '.py') path", "7 size")
    got = history.rename_pairs(f.where("id < 300"), f.where("id >= 300"), alike_least=0.75)
    assert {r["old_path"] for r in got.collect()} == {"a/b/c/d/e/f/g/h/300.py"} and got.count() == 300


def test_vectors_meet_as_matrices(spark):
    """equal vectors tie by id, zero vectors score 0, blocks and thresholds lose nothing."""
    import random

    from loomgraph.operators import search

    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(9)]) for i in range(700)] + [(1000 + i, [0.1 * (j + 1) for j in range(9)]) for i in range(40)] + [(2000, [0.0] * 9), (2001, None), (2002, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id % 100 = 0").selectExpr("vec_id query_id", "embedding")
    pairs = v.crossJoin(q.withColumnRenamed("embedding", "e")).select("query_id", "vec_id", scores.cosine(F.col("embedding"), F.col("e")).alias("s")).where("s is not null").collect()
    by = {}
    for a, b, s in pairs:
        by.setdefault(a, []).append((-s, b))
    want = sorted((a, b, -s, i + 1) for a, x in by.items() for i, (s, b) in enumerate(sorted(x)[:5]))
    out = search.vector_search(v, q, 5)
    assert sorted((r["query_id"], r["vec_id"], r["score"], r["rank"]) for r in out.collect()) == want
    all_ = search.vector_search(v, q, 1_000_000_000, 0.3)
    assert sorted((r["query_id"], r["vec_id"]) for r in all_.collect()) == sorted((a, b) for a, b, s in pairs if s >= 0.3)
    assert "FlatMapCoGroups" in out._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_without_a_score_come_last(spark):
    """null vectors and other dimensions fill up the nearest, as they did when every pair was scored."""
    from loomgraph.operators import search

    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [1.0]), (4, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (2, None)], "query_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"] and round(r["score"], 4)) for r in search.vector_search(v, q, 4).collect()}
    assert got == {(0, 1): (0, 1.0), (0, 2): (1, 0.7071), (0, 3): (2, None), (0, 4): (3, None), **{(2, i + 1): (i, None) for i in range(4)}}


def test_co_changes_count_where_lists_arrive(spark, monkeypatch):
    """paths travel with lists; a path of many commits is dealt to several tasks, and sweeps pair nothing."""
    from loomgraph.operators import history

    monkeypatch.setattr(history, "TOGETHER", 5)
    rows = [(c, p) for c in range(40) for p in range(12) if (c * 7 + p * p) % 5 < 3 or p == 0] + [(1, 0), (None, 3), (3, None)] + [(99, p) for p in range(30)]
    out = history.co_changes(spark.createDataFrame(rows, "commit int, path int"), widest=20)
    of, want = {}, {}
    for c, p in rows:
        if c is not None and p is not None and c != 99:
            of.setdefault(c, set()).add(p)
    for ps in of.values():
        for a in ps:
            for b in ps:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r["a"], r["b"]): r["together"] for r in out.collect()} == want
    assert "filter(paths" in out._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_by_query_shuffle_once(spark):
    """Ranks and sums of a query lie in one task; metrics join by the query alone."""
    from loomgraph.operators import ranking

    h = spark.range(50).selectExpr("id % 5 query_id", "array('a', 'b')[id % 2] source", "concat('d', id % 7) chunk_id", "id / 50 score")
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert (count(ranking.consensus(h)), count(ranking.rrf(h))) == (1, 1)
    golden = h.select("query_id", "chunk_id").distinct().where("chunk_id != 'd3'")
    m = ranking.retrieval_metrics(ranking.top_k(ranking.rrf(h), 100), golden, 5)
    assert "chunk_id" not in "".join(x for x in m._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    assert m.count() == 5 and m.where("rr > 0 and recall <= 1").count() == 5


def test_files_of_one_split_are_parsed_by_all_cores(spark):
    """parsing does not stay in the few tasks that read a small table."""
    from loomgraph.operators import compiled
    from loomgraph.sources import parsers

    files = spark.range(40).selectExpr("concat('src/m', id, '.py') path", "'import os\\ndef f(x):\\n    return os.g(x)' content").coalesce(1)
    for df in (parsers.python_symbols(files), parsers.python_relations(files), compiled.code_matches(files, "$F($X)"), parsers.python_graph(files)):
        assert df.rdd.getNumPartitions() >= 16
    got = {(r["part"], r["kind"]): r["count"] for r in parsers.python_graph(files).groupBy("part", "kind").count().collect()}
    one = parsers.parse_source("src/m1.py", "import os\ndef f(x):\n    return os.g(x)")
    want = {}
    for part, kinds in (("node", [s[1] for s in one[0]]), ("edge", [r[1] for r in one[1]])):
        for k in kinds:
            want[part, k] = want.get((part, k), 0) + 40
    assert got == want


def test_asked_terms_alone_give_the_same_scores(spark):
    """only the asked terms leave the tasks that read the texts."""
    from loomgraph.operators import search

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(i + 1))) for i in range(30)] + [(50, ""), (51, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "w3 w5 w5"), (2, "w0 none")], "query_id long, text string")
    full = search.bm25(search.inverted_index(docs, "doc_id", "text"), q)
    few = search.bm25(search.inverted_index(docs, "doc_id", "text", search.asked_terms(q)), q, figures=search.corpus_figures(docs, "doc_id", "text"))
    plain = lambda df: sorted((r["query_id"], r["doc"], round(r["score"], 9)) for r in df.collect())
    assert plain(full) == plain(few) and len(plain(few)) > 20


def test_tasks_grow_with_the_table(spark, sf, monkeypatch):
    """A task's share of the edges does not grow with their number; edges that repeat change no closure."""
    from loomgraph import storage
    from loomgraph.operators import graph
    from loomgraph.plans import paths
    from loomgraph.sources.tables import edges

    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey")
    few = storage.dealt(li, "l_orderkey").rdd.getNumPartitions()
    monkeypatch.setattr(storage, "PART", 1 << 10)
    assert storage.dealt(li, "l_orderkey").rdd.getNumPartitions() > 2 * few
    assert edges(spark, sf)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    e = spark.createDataFrame([("a", "b", 2.0), ("a", "b", 1.0), ("b", "c", 1.0), ("b", "c", 1.0), (None, "c", 1.0), ("c", None, 1.0), (None, None, 1.0)], "src string, dst string, cost double")
    starts = spark.createDataFrame([("a",)], "id string")
    assert sorted((r["node"], r["distance"]) for r in paths.reach(e.where("dst is not null"), starts).collect()) == [("b", 1), ("c", 2)]
    assert sorted((r["node"], r["cost"]) for r in graph.cheapest(e.where("dst is not null"), starts).collect()) == [("b", 1.0), ("c", 2.0)]
    assert sorted(map(tuple, graph.degrees(e).collect()), key=str) == sorted([("a", 2, 0), ("b", 2, 2), ("c", 1, 3), (None, 2, 0), (None, 0, 2)], key=str)


def test_pairs_come_in_runs(spark, monkeypatch):
    """lists are in order, and each id is followed by the greater ones of one list, so files of pairs are small."""
    from loomgraph.operators import pairs

    monkeypatch.setattr(pairs, "LIST", 5)
    m = spark.createDataFrame([("a", (i * 37) % 101) for i in range(60)], "cls string, id long")
    found = [tuple(r) for r in pairs.expanded(spark.createDataFrame([("a", "a")], "x string, y string"), m).collect()]
    ids = sorted((i * 37) % 101 for i in range(60))
    assert sorted(found) == [(i, j) for i in ids for j in ids if i < j]
    rises = sum(a[0] == b[0] and a[1] < b[1] or a[0] != b[0] for a, b in zip(found, found[1:], strict=False))
    assert rises > 0.8 * len(found) and "sort_array" in pairs.lists(m)._jdf.queryExecution().optimizedPlan().toString()


def _kept_plans(monkeypatch, module):
    """What ``keep`` writes from now on: label and physical plan."""
    written, keep = [], module.keep
    monkeypatch.setattr(module, "keep", lambda df, label: (written.append((label, df._jdf.queryExecution().sparkPlan().toString())), keep(df, label))[1])
    return written


def test_transitive_dependencies_hold_no_edges(spark, sf, monkeypatch):
    """the edges of a closure are written as they are read; no task gathers them to find repeated ones."""
    from loomgraph.catalog.graph import g23
    from loomgraph.plans import paths
    from loomgraph.sources.tables import edges

    written = _kept_plans(monkeypatch, paths)
    assert g23(spark, sf).count() == 2
    plans = [plan for label, plan in written if label == "reach-edges"]
    assert plans and not any(x in plan for plan in plans for x in ("Aggregate", "Exchange"))
    assert sorted(map(tuple, edges(spark, sf, repeats=True).distinct().collect())) == sorted(map(tuple, edges(spark, sf).collect()))


def test_expansion_holds_no_edges(spark, sf, monkeypatch):
    """as F24; slices, distances and least costs over all edges share the step."""
    from loomgraph.catalog import graph as catalog
    from loomgraph.operators import graph
    from loomgraph.plans import paths

    written = _kept_plans(monkeypatch, paths), _kept_plans(monkeypatch, graph)
    for query in (catalog.g38, catalog.g20, catalog.g35, catalog.g40b):
        query(spark, sf)
    plans = [plan for found in written for label, plan in found if label in ("reach-edges", "costs")]
    assert len(plans) == 4 and not any(x in plan for plan in plans for x in ("Aggregate", "Exchange"))


def test_meeting_points_search_back_inside(spark, monkeypatch):
    """what reaches the targets but is not ahead of a source is never written, and walks of full depth on both sides are found."""
    from loomgraph.plans import paths

    chain = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n3", "m1"), ("m1", "m2"), ("m2", "n9"), ("n5", "n2"), ("n6", "n6")]
    many = [(f"x{i}", f"n{i % 12}") for i in range(500)] + [(f"y{i}", f"x{i}") for i in range(500)]
    e = spark.createDataFrame([*chain, *many, ("n1", "n2"), ("x1", None), (None, "n4")], "src string, dst string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    written, keep = [], paths.keep
    monkeypatch.setattr(paths, "keep", lambda df, label: (out := keep(df, label), written.append((label, out.count())))[0])

    def within(starts, pairs, depth):
        seen = set(starts)
        for _ in range(depth):
            seen |= {b for a, b in pairs if a in seen}
        return seen

    back = [(b, a) for a, b in chain + many]
    for sources, targets, depth in ((("n0",), ("n4",), 2), (("n0", "n7"), ("n6", "n9"), 3), (("n5",), ("x3",), 1)):
        want = within(sources, chain + many, depth) & within(targets, back, depth)
        assert sorted(r["node"] for r in paths.meeting(e, ids(*sources), ids(*targets), depth).collect()) == sorted(want)
    assert max(n for label, n in written if label != "meeting-edges") < 30


def test_strong_components_broadcast_few_edges(spark, monkeypatch):
    """above ``FEW`` edges (here none) no join of a step goes through the driver; the components are the same."""
    from loomgraph.plans import paths

    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    want = sorted([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("g", "g")])
    monkeypatch.setattr(paths, "FEW", 0)
    written = _kept_plans(monkeypatch, paths)
    assert sorted(map(tuple, paths.strong_components(e).collect())) == want
    plans = [plan for label, plan in written if label in ("strong-colours", "strong-parts", "strong-inside")]
    joined = [("SortMergeJoin" in plan, "BroadcastHashJoin" in plan) for plan in plans if "Join" in plan]
    assert (True, False) in joined and (True, True) not in joined and (False, True) not in joined
