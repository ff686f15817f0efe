"""Scalar functions: identifiers, text, scores, vectors, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..sources.tables import COMMITS, NODES, commits, nodes, read, with_
from .base import query

#: Identifiers built from part names, the same in both engines.
_NAMES = "(SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'getUserName' || p_partkey WHEN 1 THEN 'HTTPServer_v' || p_size WHEN 2 THEN '__init__' WHEN 3 THEN '_' || replace(p_name, ' ', '_') ELSE '#Field' || p_size END AS name, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'go' END AS lang, CASE p_partkey % 4 WHEN 0 THEN 'src/app/m' || p_size || '.py' WHEN 1 THEN 'lib/tests/test_' || p_size || '.py' WHEN 2 THEN '.ci/pkg/a' || p_size || '.ts' ELSE 'main' || p_size || '.go' END AS path FROM part)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("getUserName"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("HTTPServer_v"), size)).when(k % 5 == 2, "__init__").when(k % 5 == 3, F.concat(F.lit("_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))).otherwise(F.concat(F.lit("#Field"), size))
    lang = F.when(k % 3 == 0, "python").when(k % 3 == 1, "typescript").otherwise("go")
    path = F.when(k % 4 == 0, F.concat(F.lit("src/app/m"), size, F.lit(".py"))).when(k % 4 == 1, F.concat(F.lit("lib/tests/test_"), size, F.lit(".py"))).when(k % 4 == 2, F.concat(F.lit(".ci/pkg/a"), size, F.lit(".ts"))).otherwise(F.concat(F.lit("main"), size, F.lit(".go")))
    return read(spark, sf_dir, "part").select(k.alias("k"), name.alias("name"), lang.alias("lang"), path.alias("path"))


@query("c01_identifier_tokens", f"""
SELECT k, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_\\s]+', ' ', 'g')), ' '), lambda t: t <> ''), '|') AS tokens FROM {_NAMES}""")
def c01(spark, sf):
    return names(spark, sf).select("k", F.array_join(X.identifier_tokens(F.col("name")), "|").alias("tokens"))


@query("c02_word_tokens", f"""
SELECT k, array_to_string(list_filter(string_split(lower(regexp_replace(regexp_replace(name || ' ' || path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: t <> ''), '|') AS tokens FROM {_NAMES}""")
def c02(spark, sf):
    return names(spark, sf).select("k", F.array_join(X.word_tokens(F.concat_ws(" ", "name", "path")), "|").alias("tokens"))


@query("c03_char_ngrams", "SELECT p_partkey, array_to_string([substr(lower(p_name), i, 3) FOR i IN generate_series(1, length(p_name) - 2)], '|') AS grams FROM part")
def c03(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(X.char_ngrams(F.col("p_name"), 3), "|").alias("grams"))


@query("c04_trigram_set", "SELECT p_partkey, array_to_string(list_sort(list_distinct([substr(lower(p_type), i, 3) FOR i IN generate_series(1, length(p_type) - 2)])), '|') AS grams FROM part")
def c04(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(X.trigrams(F.col("p_type")), "|").alias("grams"))


@query("c05_edit_distance", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(lower(a.n_name), lower(b.n_name))::INT AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def c05(spark, sf):
    n = read(spark, sf, "nation")
    a, b = n.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("ak"), "n_regionkey"), n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("bk"), "n_regionkey")
    return a.join(b, "n_regionkey").where("ak < bk").select("a", "b", F.levenshtein(F.lower("a"), F.lower("b")).alias("d"))


@query("c06_shingles", "SELECT c_custkey, len(list_distinct([substr(c_name, i, 5) FOR i IN generate_series(1, length(c_name) - 4)]))::INT AS n FROM customer")
def c06(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.size(X.shingles(F.col("c_name"), 5)).alias("n"))


@query("c07_normalized_code", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('/* ' || lang || ' */ ' || text || ' // ' || source, '/\\*.*?\\*/', '', 'gs'), '//[^\\n]*', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS code FROM documents")
def c07(spark, sf):
    code = F.concat(F.lit("/* "), F.col("lang"), F.lit(" */ "), F.col("text"), F.lit(" // "), F.col("source"))
    return read(spark, sf, "documents").select("doc_id", X.normalized_code(code).alias("code"))


@query("c08_normalized_type", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'number' WHEN 2 THEN 'cursor' ELSE 'custom' END AS type FROM part")
def c08(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, "Str").when(k % 4 == 1, "builtins.Double").when(k % 4 == 2, "sqlite3.Cursor").otherwise("My.Type")
    return read(spark, sf, "part").select("p_partkey", X.normalized_type(raw, {"My.Type": "custom"}).alias("type"))


_PATTERNS = "(VALUES ('*BOLT'), ('new*'), ('*old*'), ('HOT rod'), ('bl*bolt'), (''))"


@query("c09_wildcard_match", f"SELECT p_partkey, pattern, pattern <> '' AND regexp_full_match(lower(p_name), replace(lower(pattern), '*', '.*')) AS hit FROM part, {_PATTERNS} v(pattern)")
def c09(spark, sf):
    patterns = ["*BOLT", "new*", "*old*", "HOT rod", "bl*bolt", ""]
    rows = read(spark, sf, "part").select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, patterns))).alias("pattern"))
    return rows.select("p_partkey", "pattern", X.wildcard_match(F.col("pattern"), F.col("p_name")).alias("hit"))


@query("c10_pattern_class", "SELECT p_partkey, ['suffix', 'prefix', 'contains', 'exact', 'complex', 'complex'][p_partkey % 6 + 1] AS class FROM part")
def c10(spark, sf):
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    kinds = [F.concat(F.lit("*"), name), F.concat(name, F.lit("*")), F.concat(F.lit("*"), name, F.lit("*")), name, F.concat(name, F.lit("*"), size), F.lit("*")]
    pattern = F.element_at(F.array(*kinds), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", X.pattern_class(pattern).alias("class"))


@query("c11_fqn", f"SELECT k, fqn, CASE WHEN contains(fqn, '.') THEN regexp_replace(fqn, '\\.[^.]*$', '') ELSE '' END AS parent, string_split(fqn, '.')[-1] AS name FROM (SELECT k, replace(regexp_replace(regexp_replace(path, '\\.[A-Za-z]+$', ''), '^(.*/)?src/', ''), '/', '.') AS fqn FROM {_NAMES})")
def c11(spark, sf):
    rows = names(spark, sf).select("k", X.fqn_of_path(F.col("path")).alias("fqn"))
    return rows.select("k", "fqn", X.fqn_parent(F.col("fqn")).alias("parent"), X.fqn_name(F.col("fqn")).alias("name"))


@query("c12_is_test", f"SELECT k, regexp_matches(path, '(^|/)(tests?|__tests__|spec)/') OR regexp_matches(string_split(path, '/')[-1], '^test_|_test\\.|\\.test\\.|\\.spec\\.') OR regexp_matches(name, '^(test_|Test)|(_test|Test)$') AS is_test FROM {_NAMES}")
def c12(spark, sf):
    return names(spark, sf).select("k", X.is_test(F.col("path"), F.col("name")).alias("is_test"))


@query("c13_visibility", f"""SELECT k, CASE lang WHEN 'python' THEN CASE WHEN regexp_matches(name, '^__.*__$') THEN 'public' WHEN starts_with(name, '__') THEN 'private' WHEN starts_with(name, '_') THEN 'internal' ELSE 'public' END
 WHEN 'typescript' THEN CASE WHEN starts_with(name, '#') THEN 'private' WHEN starts_with(name, '_') THEN 'internal' ELSE 'public' END
 ELSE CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'public' ELSE 'internal' END END AS visibility FROM {_NAMES}""")
def c13(spark, sf):
    return names(spark, sf).select("k", X.visibility(F.col("name"), F.col("lang")).alias("visibility"))


@query("c14_module", f"SELECT k, CASE WHEN starts_with(path, 'src/') THEN 'app' WHEN starts_with(path, '.ci') THEN 'pkg' ELSE string_split(path, '/')[1] END AS module FROM {_NAMES}")
def c14(spark, sf):
    return names(spark, sf).select("k", X.module_of(F.col("path")).alias("module"))


_ASK = "(SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'function getUser definition' WHEN 1 THEN 'trace calls from a to b' WHEN 2 THEN 'explain why' WHEN 3 THEN 'example code' ELSE 'zzz' END AS q FROM benchmark)"


def asks(spark, sf):
    k = F.col("item_id")
    return read(spark, sf, "benchmark").select("item_id", F.when(k % 5 == 0, "function getUser definition").when(k % 5 == 1, "trace calls from a to b").when(k % 5 == 2, "explain why").when(k % 5 == 3, "example code").otherwise("zzz").alias("q"))


@query("c15_query_features", f"SELECT item_id, len(string_split(q, ' '))::INT AS tokens, regexp_matches(q, '[a-z][A-Z]') AS camel, contains(q, '/') AS path, regexp_matches(q, '\\b(AND|OR|NOT)\\b') AS boolean FROM {_ASK}")
def c15(spark, sf):
    return asks(spark, sf).select("item_id", F.size(F.split("q", " ")).alias("tokens"), F.regexp_like("q", F.lit("[a-z][A-Z]")).alias("camel"), F.contains("q", F.lit("/")).alias("path"), F.regexp_like("q", F.lit(r"\b(AND|OR|NOT)\b")).alias("boolean"))


@query("c16_intent_scores", "SELECT item_id, [0.316448, 0.147021, 0.188546, 0.212628, 0.384582][item_id % 5 + 1]::DOUBLE AS symbol, [0.157143, 0.488127, 0.139678, 0.157519, 0.14148][item_id % 5 + 1]::DOUBLE AS flow, [0.157143, 0.108916, 0.343553, 0.157519, 0.14148][item_id % 5 + 1]::DOUBLE AS concept, [0.157143, 0.108916, 0.139678, 0.259705, 0.14148][item_id % 5 + 1]::DOUBLE AS code, [0.212121, 0.147021, 0.188546, 0.212628, 0.190978][item_id % 5 + 1]::DOUBLE AS balanced FROM benchmark")
def c16(spark, sf):
    """The twin has the probabilities of the five questions, worked out by hand."""
    p = X.intent_probabilities(F.col("q"))
    return asks(spark, sf).select("item_id", *[F.round(p[i], 6).alias(i) for i in (*X.INTENTS, "balanced")])


@query("c17_rule_intent", "SELECT item_id, ['symbol', 'flow', 'concept', 'code', 'symbol'][item_id % 5 + 1] AS intent FROM benchmark")
def c17(spark, sf):
    return asks(spark, sf).select("item_id", X.rule_intent(F.col("q")).alias("intent"))


@query("c18_symbol_extraction", f"SELECT item_id, array_to_string(regexp_extract_all(q, '[a-z]+[A-Z][A-Za-z0-9]*')[1:5], '|') AS symbols FROM {_ASK}")
def c18(spark, sf):
    return asks(spark, sf).select("item_id", F.array_join(F.slice(F.regexp_extract_all("q", F.lit("[a-z]+[A-Z][A-Za-z0-9]*"), F.lit(0)), 1, 5), "|").alias("symbols"))


@query("c19_token_estimate", "SELECT doc_id, greatest(1, floor(len(list_filter(regexp_split_to_array(text, '[\\s\\x0B]+'), lambda w: w <> '')) * 0.75))::INT AS tokens FROM documents")
def c19(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("c20_trimmed_chunk", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:6], chr(10)) AS trimmed FROM documents")
def c20(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 1, 6), "\n").alias("trimmed"))


@query("c21_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def c21(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


_DAYS = "(DATE '1998-12-31' - l_shipdate::DATE)"


@query("c22_recency_decay", f"SELECT l_orderkey, l_linenumber, round(exp(-{_DAYS} / 90.0), 6) AS decay FROM lineitem")
def c22(spark, sf):
    days = F.datediff(F.lit("1998-12-31").cast("date"), F.col("l_shipdate"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.recency_decay(days), 6).alias("decay"))


@query("c23_git_boost", f"""SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 5
  WHEN 0 THEN CASE WHEN d <= 7 THEN 0.2 WHEN d <= 30 THEN 0.2 / (1 + (d - 7) / 10.0) ELSE 0 END
  WHEN 1 THEN CASE WHEN hot THEN -0.1 WHEN churn < 0.3 THEN 0.05 ELSE 0 END WHEN 2 THEN CASE WHEN hot THEN -0.05 ELSE 0 END
  WHEN 3 THEN CASE WHEN churn < 0.3 THEN 0.1 WHEN hot THEN -0.05 ELSE 0 END ELSE CASE WHEN d <= 90 THEN 0.05 ELSE 0 END END::DOUBLE, 6) AS boost
FROM (SELECT l_orderkey, l_linenumber, {_DAYS} % 100 AS d, l_discount * 10 AS churn, l_quantity > 40 AS hot FROM lineitem)""")
def c23(spark, sf):
    days = F.datediff(F.lit("1998-12-31").cast("date"), F.col("l_shipdate")) % 100
    intent = F.element_at(F.array(*map(F.lit, ("flow", "code", "symbol", "concept", "overview"))), F.col("l_linenumber") % 5 + 1)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.git_boost(intent, days, F.col("l_discount") * 10, F.col("l_quantity") > 40), 6).alias("boost"))


@query("c24_error_prone", """SELECT p_partkey, round(0.30 * ((c >= 0.3)::INT + (c >= 0.6)::INT + (c >= 0.9)::INT) / 3.0 + 0.20 * ((a >= 2)::INT + (a >= 4)::INT + (a >= 6)::INT) / 3.0 + 0.25 * (1 - least(1, greatest(0, v))) + 0.15 * ((x >= 5)::INT + (x >= 10)::INT + (x >= 20)::INT) / 3.0 + 0.10 * CASE WHEN d <= 30 THEN 1.0 WHEN d <= 90 THEN 0.5 ELSE 0 END, 6) AS score
FROM (SELECT p_partkey, (p_partkey % 11) / 10.0 AS c, p_partkey % 8 AS a, (p_partkey % 7) / 6.0 AS v, p_size AS x, p_partkey % 120 AS d FROM part)""")
def c24(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select("p_partkey", F.round(S.error_prone(k % 11 / 10.0, k % 8, k % 7 / 6.0, F.col("p_size"), k % 120), 6).alias("score"))


@query("c25_importance", "SELECT p_partkey, round(0.5 * (p_partkey % 10) / 10.0 + 0.3 * (p_partkey % 7) / 7.0 + 0.2 * (p_partkey % 3) / 3.0, 6) AS importance, round(greatest(0, least(1, 0.55 * (p_partkey % 10) / 10.0 + 0.30 * (p_partkey % 7) + 0.15 * (p_partkey % 3) / 3.0)), 6)::DOUBLE AS priority FROM part")
def c25(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select("p_partkey", F.round(S.combined_importance(k % 10 / 10.0, k % 7 / 7.0, k % 3 / 3.0), 6).alias("importance"), F.round(S.priority(k % 10 / 10.0, k % 7, k % 3 / 3.0), 6).alias("priority"))


@query("c27_correlation_adjusted", """SELECT p_partkey, round(greatest(0, least(1, CASE WHEN v >= 0.85 AND greatest(l, s) < 0.2 THEN x * 0.6 WHEN v >= 0.7 AND l < 0.3 THEN x - 0.05 ELSE x END)), 6) AS score FROM (
 SELECT *, 0.5 + CASE WHEN l >= 0.7 AND s >= 0.7 THEN 0.15 ELSE 0 END + CASE WHEN s >= 0.7 AND g >= 0.7 THEN 0.1 ELSE 0 END::DOUBLE AS x FROM (
 SELECT p_partkey, (p_partkey % 10) / 10.0 AS l, (p_partkey * 3 % 10) / 10.0 AS v, (p_partkey * 7 % 11) / 10.0 AS s, (p_partkey % 13) / 12.0 AS g FROM part))""")
def c27(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select("p_partkey", F.round(S.correlation_adjusted(F.lit(0.5), k % 10 / 10.0, k * 3 % 10 / 10.0, k * 7 % 11 / 10.0, k % 13 / 12.0), 6).alias("score"))


@query("c28_impact_risk", """SELECT p_partkey, round(r, 6) AS risk, CASE WHEN r >= 0.7 THEN 'high' WHEN r >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM (SELECT p_partkey, least(1.0, least(1.0, 10.0 * (p_partkey % 50) / 1000.0) + least(0.3, 5.0 * (p_partkey % 9) / 1000.0))::DOUBLE AS r FROM part)""")
def c28(spark, sf):
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select("p_partkey", S.impact_risk((k % 9).cast("double"), (k % 50).cast("double"), F.lit(1000.0)).alias("r"))
    return rows.select("p_partkey", F.round("r", 6).alias("risk"), S.risk_level(F.col("r")).alias("level"))


@query("c31_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def c31(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query("c32_plan_hash", """SELECT p_brand, substr(sha256('{"brand":"' || p_brand || '","n":' || n || '}'), 1, 16) AS hash FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)""")
def c32(spark, sf):
    rows = read(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return rows.select("p_brand", F.substring(F.sha2(F.to_json(F.struct(F.col("p_brand").alias("brand"), "n")), 256), 1, 16).alias("hash"))


@query("c33_ab_bucket", "SELECT variant, count(*) AS n FROM (SELECT CASE WHEN b < 0.5 THEN 'control' WHEN b < 0.8 THEN 'a' ELSE 'b' END AS variant FROM (SELECT (('0x' || substr(md5('exp:' || c_custkey), 1, 15))::BIGINT % 10000) / 10000.0 AS b FROM customer)) GROUP BY variant")
def c33(spark, sf):
    return read(spark, sf, "customer").select(S.bucket("exp", F.col("c_custkey"), {"control": 0.5, "a": 0.3, "b": 0.2}).alias("variant")).groupBy("variant").agg(F.count("*").alias("n"))


@query("c34_vector_metrics", """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dot, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS l2 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def c34(spark, sf):
    e = read(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    x, y = F.col("embedding"), F.col("other")
    return e.join(b, "vec_id").select("vec_id", F.round(S.dot(x, y), 4).alias("dot"), F.round(S.cosine(x, y), 4).alias("cosine"), F.round(S.l2(x, y), 4).alias("l2"))


@query("c35_max_sim", """WITH g AS (SELECT label, list(embedding::DOUBLE[] ORDER BY vec_id)[1:3] AS vs FROM embeddings GROUP BY label)
SELECT a.label AS a, b.label AS b, round(list_sum([list_max([list_dot_product(q, d) FOR d IN b.vs]) FOR q IN a.vs]), 4) AS score FROM g a JOIN g b ON b.label = (a.label + 1) % 10""")
def c35(spark, sf):
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    top = read(spark, sf, "embeddings").withColumn("r", rank).where("r <= 3").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]).alias("vs"))
    a, b = top.select(F.col("label").alias("a"), F.col("vs").alias("q")), top.select(F.col("label").alias("b"), F.col("vs").alias("d"))
    return a.join(b, F.col("b") == (F.col("a") + 1) % 10).select("a", "b", F.round(S.max_sim(F.col("q"), F.col("d")), 4).alias("score"))


@query("c36_low_rank_adapter", "SELECT vec_id, round(embedding[1]::DOUBLE + 0.5 * (embedding[1]::DOUBLE + embedding[2]::DOUBLE) * 2, 4) AS first FROM embeddings")
def c36(spark, sf):
    a = [[1.0] if i < 2 else [0.0] for i in range(64)]
    b = [[2.0 if i == 0 else 0.0 for i in range(64)]]
    return read(spark, sf, "embeddings").select("vec_id", F.round(S.low_rank(F.col("embedding"), a, b, 0.5)[0], 4).alias("first"))


@query("c37_json_access", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def c37(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("c38_date_arithmetic", "SELECT o_orderkey, (DATE '1998-12-31' - o_orderdate::DATE)::INT AS days, floor((DATE '1998-12-31' - o_orderdate::DATE) / 7.0)::INT AS weeks FROM orders")
def c38(spark, sf):
    days = F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate"))
    return read(spark, sf, "orders").select("o_orderkey", days.alias("days"), F.floor(days / 7).cast("int").alias("weeks"))


@query("c39_glob", f"SELECT k, regexp_matches(path, '^src/(.*/)?[^/]*\\.py$') AS source, regexp_matches(path, '(^|.*/)test_[^/]*$') AS test FROM {_NAMES}")
def c39(spark, sf):
    return names(spark, sf).select("k", F.regexp_like("path", F.lit(X.glob_regex("src/**/*.py"))).alias("source"), F.regexp_like("path", F.lit(X.glob_regex("test_*"))).alias("test"))


@query("c40_pattern_subsumption", "SELECT p_partkey, [true, true, false, true, false][p_partkey % 5 + 1] AS holds FROM part")
def c40(spark, sf):
    name, size, at = F.col("p_name"), F.col("p_size").cast("string"), (F.col("p_partkey") % 5 + 1).cast("int")
    begin = F.concat(F.substring("p_name", 1, 3), F.lit("*"))
    wide = F.element_at(F.array(begin, name, name, F.lit("*"), F.concat(F.lit("*"), size, F.lit("zz"))), at)
    narrow = F.element_at(F.array(name, name, begin, F.concat(F.lit("x*"), size), name), at)
    return read(spark, sf, "part").select("p_partkey", X.subsumes(wide, narrow).alias("holds"))


@query("c41_severity", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 9.5 WHEN 1 THEN 8.0 WHEN 2 THEN 5.5 ELSE 2.5 END::DOUBLE AS severity FROM orders")
def c41(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ("critical", "HIGH", "medium", "low"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, sf, "orders").select("o_orderkey", S.severity_number(name).alias("severity"))


@query("c42_symbol_descriptor", "SELECT p_partkey, 'scip pip ' || p_brand || ' . ' || p_name AS descriptor FROM part")
def c42(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.scip_descriptor(F.lit("scip"), F.lit("pip"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_name")).alias("descriptor"))


@query("c43_intervals", """SELECT p_partkey, CASE WHEN greatest(a, 20) <= least(b, 60) THEN greatest(a, 20) END AS inter_lo, least(a, 20) AS union_lo, a + 20 AS add_lo, a - 60 AS sub_lo, least(a * 20, a * 60, b * 20, b * 60) AS mul_lo FROM (SELECT p_partkey, p_size - 10 AS a, p_size + p_partkey % 9 AS b FROM part)""")
def c43(spark, sf):
    a = F.struct((F.col("p_size") - 10).cast("long").alias("lo"), (F.col("p_size") + F.col("p_partkey") % 9).alias("hi"))
    b = F.struct(F.lit(20).cast("long").alias("lo"), F.lit(60).cast("long").alias("hi"))
    return read(spark, sf, "part").select("p_partkey", *[S.interval(op, a, b)["lo"].alias(f"{name}_lo") for op, name in (("intersect", "inter"), ("union", "union"), ("add", "add"), ("sub", "sub"), ("mul", "mul"))])


@query("c44_path_condition", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size = 10 WHEN 1 THEN p_size <> 10 WHEN 2 THEN p_size < 10 WHEN 3 THEN p_size > 10 ELSE false END AS holds FROM part")
def c44(spark, sf):
    op = F.element_at(F.array(*map(F.lit, ("eq", "neq", "lt", "gt", "null"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", S.condition_holds(F.col("p_size"), op, F.lit(10)).alias("holds"))


@query("c22_recency_boost", with_(COMMITS) + "SELECT path, round(CASE WHEN d < 90 THEN 2.0 * (1 + (1 - d / 90.0) * 0.5) ELSE 2.0 END, 6)::DOUBLE AS score FROM (SELECT path, min(DATE '1998-12-31' - ts::DATE) AS d FROM commits GROUP BY path)")
def c22b(spark, sf):
    last = commits(spark, sf).groupBy("path").agg(F.min(F.datediff(F.lit("1998-12-31").cast("date"), F.col("ts"))).alias("d"))
    return last.select("path", F.round(S.recency_boost(F.lit(2.0), F.col("d"), 0.5), 6).alias("score"))


@query("u14_set_jaccard", with_(NODES) + "SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::DOUBLE, 6) AS jaccard FROM (SELECT id, list_distinct([substr(lower(name), i, 3) FOR i IN generate_series(1, length(name) - 2)]) AS g FROM nodes WHERE kind = 'nation') a JOIN (SELECT id, list_distinct([substr(lower(name), i, 3) FOR i IN generate_series(1, length(name) - 2)]) AS g FROM nodes WHERE kind = 'nation') b ON a.id < b.id")
def u14(spark, sf):
    g = nodes(spark, sf).where("kind = 'nation'").select("id", X.trigrams(F.col("name")).alias("g"))
    a, b = g.select(F.col("id").alias("a"), F.col("g").alias("ga")), g.select(F.col("id").alias("b"), F.col("g").alias("gb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(X.set_jaccard(F.col("ga"), F.col("gb")), 6).alias("jaccard"))
