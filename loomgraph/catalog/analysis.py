"""Rules, search, clones, analyses, storage and parsing over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import wildcard_match
from ..operators import analysis as A
from ..operators import clones as D
from ..operators import rules as U
from ..operators import search as S
from ..sources import parsers as P
from ..sources.store import ChunkFilter
from ..sources.tables import read
from .base import query

_PATTERNS = [("r1", "*bolt"), ("r2", "NEW*"), ("r3", "*old*"), ("r4", "HOT ROD"), ("r5", "bl*bolt"), ("r6", "*"), ("r7", ""), ("r8", "C*D")]
_RULES = "(VALUES " + ", ".join(f"('{r}', '{p}')" for r, p in _PATTERNS) + ") v(rule_id, pattern)"


def _rules(spark):
    return spark.createDataFrame(_PATTERNS, "rule_id string, pattern string")


def _entities(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


@query("j09_rule_matches", f"SELECT rule_id, p_partkey AS id FROM part JOIN {_RULES} ON pattern <> '' AND regexp_full_match(lower(p_name), replace(lower(pattern), '*', '.*'))")
def j09(spark, sf):
    return U.matches(_rules(spark), _entities(spark, sf))


@query("j10_exact_index", "SELECT p_partkey, rule FROM part JOIN (VALUES ('STANDARD', 'Brand#13', 'x'), ('PROMO', 'Brand#22', 'y')) v(t, b, rule) ON p_type = t AND p_brand = b")
def j10(spark, sf):
    index = spark.createDataFrame([("STANDARD", "Brand#13", "x"), ("PROMO", "Brand#22", "y")], "p_type string, p_brand string, rule string")
    return read(spark, sf, "part").join(index, ["p_type", "p_brand"]).select("p_partkey", "rule")


@query("c29_tiers", "SELECT p_partkey, [1, 2, 2, 2, 3, 3][p_partkey % 6 + 1] AS tier FROM part")
def c29(spark, sf):
    n, at = F.col("p_size").cast("string"), (F.col("p_partkey") % 6 + 1).cast("int")
    none = F.lit(None).cast("string")
    exact, star = F.concat(F.lit("T"), n), F.concat(F.lit("*.T"), n)
    type_ = F.element_at(F.array(exact, none, star, none, star, none), at)
    call = F.element_at(F.array(exact, exact, exact, F.concat(exact, F.lit("*")), F.concat(exact, F.lit("*")), F.concat(F.lit("*"), n, F.lit("*"))), at)
    return read(spark, sf, "part").select("p_partkey", U.tier(type_, call).alias("tier"))


@query("f35_value_constraints", "SELECT p_partkey, p_partkey % 4 = 0 OR p_partkey % 4 = 1 AS const, p_partkey % 4 = 2 AS not_const, p_partkey % 4 = 1 AS string_like, p_partkey % 4 = 0 AS int_like, p_partkey % 4 <> 3 AND length(arg) BETWEEN 1 AND 4 AS bound FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '''' || p_size || '''' WHEN 2 THEN 'x.y' || p_size END AS arg FROM part)")
def f35(spark, sf):
    k, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    arg = F.when(k == 0, n).when(k == 1, F.concat(F.lit("'"), n, F.lit("'"))).when(k == 2, F.concat(F.lit("x.y"), n))
    return read(spark, sf, "part").select("p_partkey", U.is_const(arg)["ok"].alias("const"), U.is_not_const(arg)["ok"].alias("not_const"), U.is_string_like(arg)["ok"].alias("string_like"), U.is_int_like(arg)["ok"].alias("int_like"), U.length_bound(arg, 1, 4)["ok"].alias("bound"))


@query("f34_predicate_chain", "SELECT p_partkey, ok, round(CASE WHEN p_name LIKE '%bolt' THEN 0.1 + CASE WHEN shell THEN 0.2 ELSE 0 END ELSE 0 END, 6)::DOUBLE AS delta FROM (SELECT p_partkey, p_name, p_size % 2 = 0 AS shell, p_name LIKE '%bolt' AND p_size % 2 = 0 AND p_size % 3 <> 0 AS ok FROM part)")
def f34(spark, sf):
    kwargs = F.create_map(F.lit("shell"), F.when(F.col("p_size") % 2 == 0, "True").otherwise("False"))
    guards = F.array(F.struct(F.lit("sink").alias("kind"), F.lit("is_safe(").alias("pattern"), F.when(F.col("p_size") % 3 == 0, "block").otherwise("allow").alias("effect"), F.lit(0.5).alias("multiplier")))
    v = U.chain(U.verdict(U.type_endswith(F.col("p_name"), "bolt")), U.is_not_const(F.col("p_name")), U.kwarg(kwargs, "shell", "True"), U.guard(guards, "sink", "is_safe"))
    return read(spark, sf, "part").select("p_partkey", v["ok"].alias("ok"), v["delta"].alias("delta"))


@query("f33_ignored", "SELECT p_partkey, regexp_matches(path, '^lib/(.*/)?[^/]*\\.py$') OR p_brand IN ('Brand#13') AS ignored FROM (SELECT p_partkey, p_brand, CASE WHEN p_size % 2 = 0 THEN 'lib/a/b.py' ELSE 'src/b.py' END AS path FROM part)")
def f33(spark, sf):
    path = F.when(F.col("p_size") % 2 == 0, "lib/a/b.py").otherwise("src/b.py")
    return read(spark, sf, "part").select("p_partkey", U.ignored(path, F.col("p_brand"), ["lib/**/*.py"], ["Brand#13"]).alias("ignored"))


@query("f32_policy_flows", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT') AND o_orderkey % 3 <> 0")
def f32(spark, sf):
    o = read(spark, sf, "orders").withColumn("source_tag", F.col("o_orderstatus")).withColumn("sink_tag", F.col("o_orderpriority")).withColumn("blocked", F.col("o_orderkey") % 3 == 0)
    return U.policy_flows(o, ["F", "O"], ["1-URGENT"]).select("o_orderkey")


@query("f26_chunk_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source LIKE 'src1%' AND doc_id % 5 <> 0 AND n_chars / 20000.0 >= 0.1 ORDER BY doc_id LIMIT 200")
def f26(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("lang").alias("kind"), F.col("source").alias("file_path"), (F.col("n_chars") / 20000.0).alias("importance"), (F.col("doc_id") % 5 == 0).alias("is_deleted"))
    f = ChunkFilter(kind="en", path_like="src1%", least_importance=0.1, limit=200)
    return d.where(f.column()).select("doc_id").orderBy("doc_id").limit(f.limit)


@query("f28_smart_filter", "SELECT p_partkey, round(CASE WHEN d < 90 THEN 1 * (1 + (1 - d / 90.0) * 0.3) ELSE 1 END, 6)::DOUBLE AS score FROM (SELECT p_partkey, p_partkey % 120 AS d FROM part WHERE p_size >= 10 AND p_partkey % 4 >= 2)")
def f28(spark, sf):
    from ..functions.scores import recency_boost

    k = F.col("p_partkey")
    kept = read(spark, sf, "part").where((F.col("p_size") >= 10) & (k % 4 >= 2))
    return kept.select("p_partkey", F.round(recency_boost(F.lit(1.0), k % 120, 0.3), 6).alias("score"))


@query("n29_rule_shadowing", "WITH r AS (SELECT p_brand AS family, 'r' || p_partkey AS id, CASE p_partkey % 20 WHEN 0 THEN '*' WHEN 1 THEN substr(p_name, 1, 3) || '*' ELSE p_name || p_partkey END AS p FROM part) SELECT w.family, w.id AS wide, n.id AS narrow FROM r w JOIN r n ON w.family = n.family AND w.id <> n.id AND (w.p = n.p OR w.p = '*' OR (NOT contains(n.p, '*') AND contains(w.p, '*') AND starts_with(n.p, replace(w.p, '*', ''))))")
def n29(spark, sf):
    k = F.col("p_partkey")
    pattern = F.when(k % 20 == 0, "*").when(k % 20 == 1, F.concat(F.substring("p_name", 1, 3), F.lit("*"))).otherwise(F.concat("p_name", k.cast("string")))
    return U.shadowing(read(spark, sf, "part").select(F.col("p_brand").alias("family"), F.concat(F.lit("r"), k.cast("string")).alias("rule_id"), pattern.alias("pattern")))


@query("n36_arbitration", "SELECT o_orderkey AS id, o > min(o) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS suppressed FROM (SELECT *, o_orderkey % 4 AS o FROM orders)")
def n36(spark, sf):
    basis = F.element_at(F.array(*map(F.lit, ("PROVEN", "INFERRED", "HEURISTIC", "UNKNOWN"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    claims = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("severity"), basis.alias("basis"))
    return U.arbitrated(claims).select("id", "suppressed")


@query("c30_confidence", "SELECT p_partkey, round(greatest(0, least(1, (p_size / 50.0 + 0.2) * 0.9)), 6)::DOUBLE AS confidence FROM part")
def c30(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.round(U.confidence(F.col("p_size") / 50.0, [("add", 0.2), ("mul", 0.9)]), 6).alias("confidence"))


@query("a35_rule_telemetry", "SELECT event_type AS rule_id, count(*) AS matches, round(avg(value), 4) AS mean, max(value) AS highest, round(avg((event_id % 10 = 0)::INT), 6) AS fp_rate FROM events GROUP BY 1")
def a35(spark, sf):
    m = read(spark, sf, "events").select(F.col("event_type").alias("rule_id"), F.col("value").alias("latency"), (F.col("event_id") % 10 == 0).alias("false_positive"))
    return U.rule_telemetry(m).withColumn("mean", F.round("mean", 4)).withColumn("fp_rate", F.round("fp_rate", 6))


_TERMS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9_]+'), lambda t: t <> '')"
_INDEX = f"idx AS (SELECT term, doc, len, count(*) AS tf FROM (SELECT doc_id AS doc, len(ts) AS len, unnest(ts) AS term FROM (SELECT doc_id, {_TERMS.format('text')} AS ts FROM documents)) GROUP BY ALL), q AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS.format('text')}) AS term FROM benchmark WHERE item_id % 100 = 0)"


def _asked(spark, sf):
    """The stated set of questions, with all their terms."""
    return read(spark, sf, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")


@query("r01_bm25", f"WITH {_INDEX}, c AS (SELECT count(*) AS n, avg(len) AS avg_len FROM (SELECT DISTINCT doc, len FROM idx)), df AS (SELECT term, count(*) AS df FROM idx GROUP BY term) SELECT query_id, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 4)::DOUBLE AS score FROM idx JOIN q USING (term) JOIN df USING (term), c GROUP BY ALL")
def r01(spark, sf):
    docs, asked = read(spark, sf, "documents"), _asked(spark, sf)
    index = S.inverted_index(docs, "doc_id", "text", S.asked_terms(asked))
    return S.bm25(index, asked, figures=S.corpus_figures(docs, "doc_id", "text")).withColumn("score", F.round("score", 4))


@query("r03_all_terms", f"WITH {_INDEX}, n AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id) SELECT query_id, doc, round(sum(ln(1.0 + tf)), 4) AS score FROM idx JOIN q USING (term) JOIN n USING (query_id) GROUP BY query_id, doc, n HAVING count(*) = n")
def r03(spark, sf):
    asked = _asked(spark, sf)
    return S.all_terms(S.inverted_index(read(spark, sf, "documents"), "doc_id", "text", S.asked_terms(asked)), asked).withColumn("score", F.round("score", 4))


@query("r02_vector_search", "SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) <= 5")
def r02(spark, sf):
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return S.vector_search(e, q, 5).select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query("s19_vector_threshold", "SELECT q.vec_id AS query_id, count(*) AS n FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.3 GROUP BY 1")
def s19(spark, sf):
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return S.vector_search(e, q, 1_000_000_000, 0.3).groupBy("query_id").agg(F.count("*").alias("n"))


_TRIGRAMS = "list_distinct([substr({0}, i, 3) FOR i IN generate_series(1, length({0}) - 2)])"


@query("r04_symbol_search", f"""WITH q AS (SELECT k || n_nationkey AS query_id, lower(n_name) || tail AS t FROM nation, (VALUES ('e', ''), ('f', 'q'), ('t', 'qqq')) v(k, tail)),
p AS (SELECT query_id, n_name AS name, t, levenshtein(t, lower(n_name)) AS d, {_TRIGRAMS.format('t')} AS x, {_TRIGRAMS.format('lower(n_name)')} AS y FROM q, nation),
j AS (SELECT *, min(d) OVER (PARTITION BY query_id) AS least, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE AS alike FROM p),
a AS (SELECT query_id, name, CASE WHEN least = 0 THEN 'exact' WHEN least <= 2 THEN 'fuzzy' ELSE 'trigram' END AS stage, CASE WHEN least <= 2 THEN 1 / (1.0 + d)::DOUBLE ELSE alike END AS score FROM j WHERE d = least AND least <= 2 OR least > 2 AND alike >= 0.7)
SELECT query_id, name, stage, round(score, 6) AS score FROM a QUALIFY stage <> 'trigram' OR row_number() OVER (PARTITION BY query_id ORDER BY a.score DESC, name) <= 10""")
def r04(spark, sf):
    """Each nation by its name in small letters, with one letter more and with three more."""
    n = read(spark, sf, "nation")
    asked = lambda kind, text: n.select(F.concat(F.lit(kind), F.col("n_nationkey").cast("string")).alias("query_id"), text.alias("text"))
    queries = asked("e", F.lower("n_name")).unionByName(asked("f", F.concat("n_name", F.lit("q")))).unionByName(asked("t", F.concat("n_name", F.lit("qqq"))))
    return S.symbol_search(n.select(F.col("n_name").alias("name")), queries).withColumn("score", F.round("score", 6))


@query("r19_co_terms", f"SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM (SELECT ts[i] AS a, unnest(ts[i + 1:i + 9]) AS b FROM (SELECT ts, unnest(generate_series(1, len(ts))) AS i FROM (SELECT {_TERMS.format('text')} AS ts FROM benchmark))) WHERE a <> b GROUP BY 1, 2")
def r19(spark, sf):
    return S.co_terms(read(spark, sf, "benchmark"), "item_id", "text")


_CODE = "trim(regexp_replace(regexp_replace(regexp_replace(text, '/\\*.*?\\*/', '', 'gs'), '//[^\\n]*', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"


@query("d01_exact_clones", f"SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY c) AS group_id, n FROM (SELECT doc_id, {_CODE} AS c, count(*) OVER (PARTITION BY {_CODE}) AS n FROM documents) WHERE n > 1")
def d01(spark, sf):
    return D.exact_groups(_fragments(spark, sf))


def _fragments(spark, sf):
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code"))


@query("d04_near_clones")
def d04(spark, sf):
    return D.near_clones(_fragments(spark, sf)).withColumn("type", D.routed(F.col("similarity")))


@query("d05_routing", "SELECT p_partkey, CASE WHEN s >= 0.95 THEN 'type1' WHEN s >= 0.7 THEN 'type2' WHEN s >= 0.6 THEN 'type3' WHEN s >= 0.5 THEN 'type4' END AS type FROM (SELECT p_partkey, (p_partkey % 101) / 100.0 AS s FROM part)")
def d05(spark, sf):
    return read(spark, sf, "part").select("p_partkey", D.routed(F.col("p_partkey") % 101 / 100.0).alias("type"))


@query("d06_label_histograms", "SELECT round(sum(least(x, y)) / sum(greatest(x, y))::DOUBLE, 6) AS similarity FROM (SELECT coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM (SELECT p_type AS l, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT p_type AS l, count(*) AS n FROM part WHERE p_partkey % 2 = 1 GROUP BY 1) b ON a.l = b.l)")
def d06(spark, sf):
    h = lambda r: read(spark, sf, "part").where(f"p_partkey % 2 = {r}").groupBy(F.col("p_type").alias("label")).agg(F.count("*").alias("n"))
    return D.histogram_jaccard(h(0), h(1)).select(F.round("similarity", 6).alias("similarity"))


_GROUPS = "v AS (SELECT p_partkey AS k, p_partkey - p_partkey % 4 AS g FROM part)"


@query("n01_points_to_unified", f"WITH {_GROUPS} SELECT k AS var, 1000000 + g AS location FROM v UNION ALL SELECT k, 2000002 + g FROM v WHERE g + 2 IN (SELECT k FROM v)")
def n01(spark, sf):
    return A.points_to_unified(_constraints(spark, sf)).select("var", "location")


def _constraints(spark, sf):
    """Variables in groups of four, each copied from the one before; the first and the third have a location of their own."""
    k = F.col("p_partkey")
    v = read(spark, sf, "part").select(k)
    alloc = v.where(k % 4 == 0).select(F.lit("ALLOC").alias("kind"), k.alias("lhs"), (k + 1_000_000).alias("rhs"))
    more = v.where(k % 4 == 2).select(F.lit("ALLOC").alias("kind"), k.alias("lhs"), (k + 2_000_000).alias("rhs"))
    copy = v.where(k % 4 > 0).select(F.lit("COPY").alias("kind"), k.alias("lhs"), (k - 1).alias("rhs"))
    return alloc.unionByName(more).unionByName(copy)


@query("n02_points_to", f"WITH {_GROUPS} SELECT k AS var, 1000000 + g AS location FROM v UNION ALL SELECT k, 2000002 + g FROM v WHERE k % 4 >= 2")
def n02(spark, sf):
    return A.points_to(_constraints(spark, sf)).select("var", "location")


@query("n04_aliases", f"WITH {_GROUPS} SELECT a.k AS a, b.k AS b, b.k % 4 < 2 AS must FROM v a JOIN v b ON a.g = b.g AND a.k < b.k")
def n04(spark, sf):
    return A.aliases(A.points_to(_constraints(spark, sf)))


_CALLS = "cl AS (SELECT DISTINCT 'c' || o_custkey AS src, 'n' || c_nationkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), ow AS (SELECT 'r' || r_regionkey AS fn, CASE WHEN r_regionkey % 2 = 0 THEN 'PURE' ELSE 'NETWORK' END AS effect FROM region UNION ALL SELECT 'n' || n_nationkey, 'PURE' FROM nation UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'LOG' ELSE 'PURE' END FROM customer)"


def _effect_tables(spark, sf):
    s = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    o, c, n, r = (read(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    calls = o.join(c, o["o_custkey"] == c["c_custkey"]).select(s("c", "o_custkey").alias("src"), s("n", "c_nationkey").alias("dst")).unionByName(n.select(s("n", "n_nationkey").alias("src"), s("r", "n_regionkey").alias("dst"))).distinct()
    own = r.select(s("r", "r_regionkey").alias("fn"), F.when(F.col("r_regionkey") % 2 == 0, "PURE").otherwise("NETWORK").alias("effect")).unionByName(n.select(s("n", "n_nationkey").alias("fn"), F.lit("PURE").alias("effect"))).unionByName(c.select(s("c", "c_custkey").alias("fn"), F.when(F.col("c_custkey") % 3 == 0, "LOG").otherwise("PURE").alias("effect")))
    return own, calls


@query("n14_effects", f"WITH RECURSIVE {_CALLS}, e(fn, effect) AS (SELECT fn, effect FROM ow UNION SELECT cl.src, e.effect FROM e JOIN cl ON cl.dst = e.fn) SELECT fn, effect FROM e WHERE effect <> 'PURE' OR fn NOT IN (SELECT fn FROM e WHERE effect <> 'PURE')")
def n14(spark, sf):
    return A.effects(*_effect_tables(spark, sf))


@query("a30_effect_severity", f"WITH {_CALLS} SELECT fn, max(CASE effect WHEN 'NETWORK' THEN 7 WHEN 'LOG' THEN 2 ELSE 0 END)::INT AS severity FROM ow GROUP BY fn")
def a30(spark, sf):
    own, _ = _effect_tables(spark, sf)
    return own.groupBy("fn").agg(F.max(A.effect_severity(F.col("effect"))).alias("severity"))


@query("n15_effect_diff", f"WITH {_CALLS}, nw AS (SELECT fn, CASE WHEN fn LIKE 'c1%' THEN 'NETWORK' ELSE effect END AS effect FROM ow) SELECT fn, effect, 'added' AS change, effect = 'NETWORK' AS breaking FROM (SELECT * FROM nw EXCEPT SELECT * FROM ow) UNION ALL SELECT fn, effect, 'removed', false FROM (SELECT * FROM ow EXCEPT SELECT * FROM nw)")
def n15(spark, sf):
    own, _ = _effect_tables(spark, sf)
    return A.effect_diff(own, own.withColumn("effect", F.when(F.col("fn").like("c1%"), "NETWORK").otherwise(F.col("effect"))))


@query("n12_taint_flows", "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_suppkey % 7 <> 0) SELECT 'p:' || p AS source, 's:' || s AS sink, 1 AS distance FROM e WHERE p <= 50 AND s % 2 = 0")
def n12(spark, sf):
    from ..sources.tables import edges

    e = edges(spark, sf).where("kind = 'DATAFLOW'")
    ids = lambda col, cond: e.select(F.col(col).alias("id")).distinct().where(cond)
    n = F.substring("id", 3, 12).cast("int")
    return A.tainted(ids("src", n <= 50), ids("dst", n % 2 == 0), ids("dst", n % 7 == 0), e)


@query("n13_finding_diff", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'added' ELSE 'fixed' END AS change FROM orders WHERE o_orderkey % 10 IN (0, 1)")
def n13(spark, sf):
    o = read(spark, sf, "orders")
    return A.finding_diff(o.where("o_orderkey % 10 != 0"), o.where("o_orderkey % 10 != 1"), ["o_orderkey"])


@query("n21_reaching_definitions", "SELECT u.l_orderkey AS fn, u.l_linenumber AS line, max(d.l_linenumber) AS def_line FROM lineitem u LEFT JOIN lineitem d ON d.l_orderkey = u.l_orderkey AND d.l_linenumber < u.l_linenumber AND d.l_returnflag = 'N' GROUP BY ALL")
def n21(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fn"), F.lit("x").alias("name"), F.col("l_linenumber").alias("line"), F.lit(0).alias("col"), "l_returnflag")
    return A.reaching_definitions(li.drop("l_returnflag"), li.where("l_returnflag = 'N'").drop("l_returnflag")).select("fn", "line", "def_line").distinct()


_SPANS = "sp AS (SELECT p_partkey AS id, p_brand AS file, (p_partkey * 7 % 500)::INT AS s, (p_partkey * 7 % 500 + p_size)::INT AS e FROM part)"


def _spans(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(k.alias("id"), F.col("p_brand").alias("file"), (k * 7 % 500).cast("int").alias("start"), (k * 7 % 500 + F.col("p_size")).cast("int").alias("end"))


@query("j16_span_overlap", f"WITH {_SPANS} SELECT a.file, a.id AS a, b.id AS b FROM sp a JOIN sp b ON a.file = b.file AND a.id < b.id AND NOT (a.e < b.s OR b.e < a.s)")
def j16(spark, sf):
    return A.overlapping(_spans(spark, sf))


@query("j17_innermost_span", f"WITH {_SPANS}, p AS (SELECT DISTINCT p_brand AS file, (p_partkey * 13 % 550)::INT AS line FROM part) SELECT p.file, p.line, first(id ORDER BY e - s, id) AS id FROM p LEFT JOIN sp ON sp.file = p.file AND line BETWEEN s AND e GROUP BY ALL")
def j17(spark, sf):
    points = read(spark, sf, "part").select(F.col("p_brand").alias("file"), (F.col("p_partkey") * 13 % 550).cast("int").alias("line")).distinct()
    return A.innermost(points, _spans(spark, sf))


@query("j14_lock_regions", f"WITH {_SPANS} SELECT l.l_orderkey, l.l_linenumber, l.line, count(DISTINCT sp.id) AS locks FROM (SELECT DISTINCT l_orderkey, l_linenumber, 'Brand#1' || (l_partkey % 5 + 1) AS file, (l_partkey % 500)::INT AS line FROM lineitem) l LEFT JOIN sp ON sp.file = l.file AND l.line BETWEEN s AND e GROUP BY l.l_orderkey, l.l_linenumber, l.line, l.file")
def j14(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Brand#1"), (F.col("l_partkey") % 5 + 1).cast("string")).alias("file"), (F.col("l_partkey") % 500).cast("int").alias("line")).distinct()
    hit = A.holding(li, _spans(spark, sf)).withColumnRenamed("n", "locks")
    return li.join(hit, ["file", "line"], "left").fillna(0, ["locks"]).select("l_orderkey", "l_linenumber", "line", "locks")


_ACCESS = "ac AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS var, l_linenumber % 3 = 0 AS w, CASE WHEN l_quantity > 25 THEN l_suppkey % 3 END AS l FROM lineitem)"


@query("j15_race_pairs", f"WITH {_ACCESS} SELECT var, a, b, severity FROM (SELECT x.var, x.id AS a, y.id AS b, CASE WHEN y.w THEN 'critical' ELSE 'high' END AS severity FROM ac x JOIN ac y ON x.var = y.var AND x.id <> y.id AND x.w AND NOT coalesce(x.l = y.l, false) AND (NOT y.w OR x.id < y.id))")
def j15(spark, sf):
    li = read(spark, sf, "lineitem")
    a = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("var"), (F.col("l_linenumber") % 3 == 0).alias("write"), F.when(F.col("l_quantity") > 25, F.col("l_suppkey") % 3).alias("lock"))
    return A.races(a)


@query("n18_race_severity", f"WITH {_ACCESS} SELECT severity, count(*) AS n FROM (SELECT CASE WHEN y.w THEN 'critical' ELSE 'high' END AS severity FROM ac x JOIN ac y ON x.var = y.var AND x.id <> y.id AND x.w AND NOT coalesce(x.l = y.l, false) AND (NOT y.w OR x.id < y.id)) GROUP BY 1")
def n18(spark, sf):
    return j15(spark, sf).groupBy("severity").agg(F.count("*").alias("n"))


@query("t23_typestate", """WITH e AS (SELECT user_id AS object, event_id AS seq, ['open', 'read', 'close'][event_id % 3 + 1] AS action FROM events),
b AS (SELECT *, coalesce(last_value(CASE WHEN action <> 'read' THEN action END IGNORE NULLS) OVER (PARTITION BY object ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'close') AS before FROM e)
SELECT object, CASE WHEN coalesce(last(action ORDER BY seq) FILTER (action <> 'read'), 'close') = 'open' THEN 'open' ELSE 'closed' END AS state,
       count(*) FILTER ((before = 'open') = (action = 'open'))::INT AS violations, coalesce(last(action ORDER BY seq) FILTER (action <> 'read'), 'close') = 'open' AS leaked FROM b GROUP BY object""")
def t23(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("object"), F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, ("open", "read", "close"))), (F.col("event_id") % 3 + 1).cast("int")).alias("action"))
    return A.typestate(e, {("closed", "open"): "open", ("open", "read"): "open", ("open", "close"): "closed"}, "closed", {"closed"})


@query("t24_merged_states", "SELECT o_custkey AS object, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 'definite' WHEN bool_or(o_orderstatus = 'F') THEN 'may_be_leaked' ELSE 'may_be' END AS verdict FROM orders GROUP BY 1")
def t24(spark, sf):
    b = read(spark, sf, "orders").select(F.col("o_custkey").alias("object"), F.col("o_orderstatus").alias("state"))
    return A.merged_states(b, {"F"}).select("object", "verdict")


@query("j03_import_resolution", "SELECT 'pk' || p_size || '.x' || p_partkey AS module, CASE p_partkey % 4 WHEN 0 THEN 'pk' || p_size || '.m' || p_partkey WHEN 1 THEN 'm' || p_partkey WHEN 2 THEN '.m' || p_partkey ELSE 'nothing' || p_partkey END AS target, CASE WHEN p_partkey % 4 < 3 THEN 'pk' || p_size || '.m' || p_partkey END AS fqn, ['exact', 'partial', 'relative', 'unresolved'][p_partkey % 4 + 1] AS method FROM part")
def j03(spark, sf):
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    p = read(spark, sf, "part")
    fqn = F.concat(F.lit("pk"), n, F.lit(".m"), k)
    target = F.element_at(F.array(fqn, F.concat(F.lit("m"), k), F.concat(F.lit(".m"), k), F.concat(F.lit("nothing"), k)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return A.resolved_imports(p.select(F.concat(F.lit("pk"), n, F.lit(".x"), k).alias("module"), target.alias("target")), p.select(fqn.alias("fqn")))


@query("a28_complexity_class", "SELECT p_partkey, ['constant', 'linear', 'quadratic', 'cubic', 'exponential'][p_partkey % 5 + 1] AS class FROM part")
def a28(spark, sf):
    return read(spark, sf, "part").select("p_partkey", A.complexity_class(F.col("p_partkey") % 5).alias("class"))


@query("n27_chunk_ids", "SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) = 1 THEN 'chunk:r:function:' || p_type ELSE 'chunk:r:function:' || p_type || ':' || substr(md5(p_name), 1, 8) END AS chunk_id FROM part")
def n27(spark, sf):
    c = read(spark, sf, "part").select("p_partkey", F.lit("function").alias("kind"), F.col("p_type").alias("fqn"), F.md5("p_name").alias("content_hash"), F.col("p_partkey").alias("local_seq"))
    return A.chunk_ids(c, "r").select("p_partkey", "chunk_id")


@query("n17_symbol_hashes", "SELECT p_partkey, sha256(p_name || '|' || p_type) AS signature, sha256(p_brand) AS body FROM part")
def n17(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_type"), 256).alias("signature"), F.sha2("p_brand", 256).alias("body"))


@query("n35_repair_ranking", "SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size * 7 + p_partkey % 10 * 3 DESC, p_partkey) AS place FROM part WHERE p_partkey % 3 = 0")
def n35(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3 == 0).alias("compiles"), F.lit(True).alias("passes"), F.col("p_size").alias("x"), (F.col("p_partkey") % 10).alias("y"))
    return A.repaired(p, {"x": 7.0, "y": 3.0}).select("id", F.col("place").cast("long").alias("place"))


@query("n34_false_positive_score", "SELECT p_partkey, round(1 / (1 + exp(-(p_size * 0.1 + p_partkey % 7 * -0.2 + 0.5))), 6) AS score FROM part")
def n34(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.round(A.false_positive_score({"a": F.col("p_size"), "b": F.col("p_partkey") % 7}, {"a": 0.1, "b": -0.2}, 0.5), 6).alias("score"))


@query("a06_storage_stats", "SELECT count(DISTINCT source) AS repositories, count(DISTINCT lang) AS snapshots, sum((doc_id % 5 <> 0)::INT)::BIGINT AS chunks FROM documents")
def a06(spark, sf):
    d = read(spark, sf, "documents")
    return d.agg(F.countDistinct("source").alias("repositories"), F.countDistinct("lang").alias("snapshots"), F.sum((F.col("doc_id") % 5 != 0).cast("int")).alias("chunks"))


@query("a07_count_chunks", "SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL")
def a07(spark, sf):
    return read(spark, sf, "documents").where("doc_id % 5 != 0").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("a37_distinct_counts", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def a37(spark, sf):
    return read(spark, sf, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("w20_frames", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w AS running, lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS next, ntile(3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INT AS tile FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")
def w20(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w.rowsBetween(-1, 0)).alias("running"), F.lead("l_quantity").over(w).alias("next"), F.ntile(3).over(w).alias("tile"))


@query("s07_document_lines", "SELECT doc_id, i AS line, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)")
def s07(spark, sf):
    return P.lines(read(spark, sf, "documents"), "doc_id", "text").withColumn("line", F.col("line").cast("long"))


@query("s06_languages", "SELECT k, CASE k % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE NULL END AS language FROM (SELECT p_partkey AS k FROM part)")
def s06(spark, sf):
    path = F.when(F.col("p_partkey") % 3 == 0, "a/b.PY").when(F.col("p_partkey") % 3 == 1, "c.ts").otherwise("d.zzz")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("k"), P.language_of(path).alias("language"))


@query("s12_line_range", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS text FROM documents")
def s12(spark, sf):
    return read(spark, sf, "documents").select("doc_id", P.line_range(F.col("text"), F.lit(2), F.lit(4)).alias("text"))


@query("s24_document_chunks", "SELECT doc_id, i AS chunk, substr(text, i * 900 + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 100) / 900.0)::INT - 1)))::INT AS i FROM documents)")
def s24(spark, sf):
    return P.document_chunks(read(spark, sf, "documents"), "doc_id", "text")


@query("s23_index_documents", "SELECT 'd:' || doc_id AS chunk_id, length(source || ' ' || text) AS n, text IS NULL AS failed FROM documents")
def s23(spark, sf):
    from ..sources.tables import chunks

    return P.index_documents(chunks(spark, sf)).select("chunk_id", F.length("search_text").cast("long").alias("n"), F.col("error").isNotNull().alias("failed"))


@query("s21_inverted_index", f"SELECT term, count(*) AS docs, sum(tf)::BIGINT AS total FROM (SELECT term, doc, count(*) AS tf FROM (SELECT item_id AS doc, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL) GROUP BY term")
def s21(spark, sf):
    return S.inverted_index(read(spark, sf, "benchmark"), "item_id", "text").groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("total"))


@query("s20_graph_store", "SELECT 'n:' || n_nationkey AS id, count(c_custkey) AS contained FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def s20(spark, sf):
    from ..sources.tables import edges, nodes

    n = nodes(spark, sf).where("kind = 'nation'").select("id")
    e = edges(spark, sf).where("kind = 'CONTAINS' and src like 'c:%'").select(F.col("dst").alias("id"), "src")
    return n.join(e, "id", "left").groupBy("id").agg(F.count("src").alias("contained"))


@query("u10_distinct_pairs", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def u10(spark, sf):
    return read(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("u01_selector_algebra", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' UNION SELECT p_partkey FROM part WHERE p_size > 40 INTERSECT SELECT p_partkey FROM part WHERE p_type LIKE '%ARD'")
def u01(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    return p.where((F.col("p_brand") == "Brand#13") | ((F.col("p_size") > 40) & F.col("p_type").like("%ARD"))).select("p_partkey")


@query("f39_wildcards", "SELECT p_partkey, [true, true, true, false, false][p_partkey % 5 + 1] AS hit FROM part")
def f39(spark, sf):
    """A star stands for any run, a dot for itself; case does not count, an empty text never matches."""
    name, at = F.col("p_name"), (F.col("p_partkey") % 5 + 1).cast("int")
    pattern = F.element_at(F.array(F.concat(F.lit("*"), F.upper(F.right(name, F.lit(3)))), F.concat(F.substring(name, 1, 4), F.lit("*")), name, F.replace(name, F.lit(" "), F.lit(".")), F.lit("*")), at)
    text = F.element_at(F.array(name, F.upper(name), F.upper(name), name, F.lit("")), at)
    return read(spark, sf, "part").select("p_partkey", wildcard_match(pattern, text).alias("hit"))