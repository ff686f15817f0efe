"""Histories, snapshots, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..sources.tables import COMMITS, SNAPSHOTS, commits, read, snapshots, with_
from .base import query

_C = with_(COMMITS)


@query("a08_churn", _C + """SELECT path, count(DISTINCT "commit") AS commits, sum(adds)::BIGINT AS added, sum(dels)::BIGINT AS deleted, greatest(1, max(ts)::DATE - min(ts)::DATE)::INT AS days_active,
 round((sum(adds) + sum(dels)) / greatest(1, max(ts)::DATE - min(ts)::DATE)::DOUBLE, 6) AS churn_rate, round(count(DISTINCT "commit") / greatest(1.0, (max(ts)::DATE - min(ts)::DATE) / 7.0::DOUBLE), 6) AS frequency FROM commits GROUP BY path""")
def a08(spark, sf):
    return H.churn(commits(spark, sf)).select("path", "commits", "added", "deleted", "days_active", F.round("churn_rate", 6).alias("churn_rate"), F.round("frequency", 6).alias("frequency"))


@query("a09_hotspots", _C + """SELECT path, round((sum(adds) + sum(dels)) / greatest(1, max(ts)::DATE - min(ts)::DATE)::DOUBLE, 6) AS churn_rate FROM commits WHERE ts >= TIMESTAMP '1997-01-01' GROUP BY path HAVING sum(adds) + sum(dels) >= 5 ORDER BY (sum(adds) + sum(dels)) / greatest(1, max(ts)::DATE - min(ts)::DATE)::DOUBLE DESC, path LIMIT 20""")
def a09(spark, sf):
    return H.hotspots(commits(spark, sf), F.lit("1997-01-01").cast("timestamp")).select("path", F.round("churn_rate", 6).alias("churn_rate"))


@query("a10_compare_periods", _C + """SELECT path, recent, previous, round(CASE WHEN previous = 0 THEN 0 ELSE (recent - previous) * 100.0 / previous END, 4)::DOUBLE AS percent FROM (SELECT path, coalesce(sum(CASE WHEN ts >= TIMESTAMP '1996-06-01' THEN adds + dels END), 0)::BIGINT AS recent, coalesce(sum(CASE WHEN ts < TIMESTAMP '1996-06-01' THEN adds + dels END), 0)::BIGINT AS previous FROM commits GROUP BY path)""")
def a10(spark, sf):
    return H.compare_periods(commits(spark, sf), F.lit("1996-06-01").cast("timestamp")).withColumn("percent", F.round("percent", 4))


@query("a11_co_change", _C + """, c AS (SELECT DISTINCT "commit", path FROM commits), n AS (SELECT path, count(*) AS n FROM c GROUP BY path), p AS (SELECT x.path AS a, y.path AS b, count(*) AS together FROM c x JOIN c y ON x."commit" = y."commit" AND x.path < y.path GROUP BY ALL)
SELECT a, b, together, round(together / (na.n + nb.n - together)::DOUBLE, 6) AS coupling, round(together / na.n::DOUBLE, 6) AS b_given_a, round(together / nb.n::DOUBLE, 6) AS a_given_b FROM p JOIN n na ON na.path = a JOIN n nb ON nb.path = b""")
def a11(spark, sf):
    return H.co_changes(commits(spark, sf)).select("a", "b", "together", *[F.round(c, 6).alias(c) for c in ("coupling", "b_given_a", "a_given_b")])


@query("j11_co_change_pairs", _C + """, c AS (SELECT DISTINCT "commit", path FROM commits) SELECT x.path AS a, y.path AS b, count(*) AS together FROM c x JOIN c y ON x."commit" = y."commit" AND x.path < y.path GROUP BY ALL HAVING count(*) > 1""")
def j11(spark, sf):
    return H.co_changes(commits(spark, sf)).where("together > 1").select("a", "b", "together")


@query("a12_strength", _C + """, c AS (SELECT DISTINCT "commit", path FROM commits) SELECT x.path AS a, y.path AS b, round(least(1.0, count(*) * 10.0 / 500), 6)::DOUBLE AS strength FROM c x JOIN c y ON x."commit" = y."commit" AND x.path < y.path GROUP BY ALL HAVING count(*) > 1""")
def a12(spark, sf):
    return H.strength(H.co_changes(commits(spark, sf)).where("together > 1"), 500).select("a", "b", F.round("strength", 6).alias("strength"))


@query("a13_weekly_growth", _C + """SELECT week, adds, paths, greatest(0, paths - coalesce(lag(paths) OVER (ORDER BY week), paths)) AS more, greatest(0, coalesce(lag(paths) OVER (ORDER BY week), paths) - paths) AS fewer FROM (SELECT date_trunc('week', ts)::TIMESTAMP AS week, sum(adds)::BIGINT AS adds, count(DISTINCT path) AS paths FROM commits GROUP BY 1)""")
def a13(spark, sf):
    return H.weekly(commits(spark, sf))


@query("a14_file_metrics", _C + """, b AS (SELECT path, author, count(DISTINCT "commit") AS n FROM commits GROUP BY ALL), m AS (SELECT path, first(author ORDER BY n DESC, author) AS main_author, count(*) AS authors FROM b GROUP BY path)
SELECT path, commits, authors, main_author, round(least(1.0, least(50, commits) * 0.05), 3)::DOUBLE AS churn, round(least(1.0, least(50, commits) * 0.05), 3) > 0.7 OR authors >= 5 AS hotspot FROM (SELECT path, count(DISTINCT "commit") AS commits FROM commits GROUP BY path) JOIN m USING (path)""")
def a14(spark, sf):
    return H.file_metrics(commits(spark, sf))


@query("j06_compare_commits", with_(SNAPSHOTS) + "SELECT coalesce(a.fqn, b.fqn) AS fqn, CASE WHEN a.fqn IS NULL THEN 'added' WHEN b.fqn IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.fqn = b.fqn WHERE a.fqn IS NULL OR b.fqn IS NULL OR a.content_hash <> b.content_hash")
def j06(spark, sf):
    return H.compare_snapshots(*snapshots(spark, sf))


@query("j07_symbol_changes", with_(SNAPSHOTS) + "SELECT coalesce(a.fqn, b.fqn) AS fqn, CASE WHEN a.fqn IS NULL THEN 'added' WHEN b.fqn IS NULL THEN 'deleted' ELSE 'signature_changed' END AS change FROM (SELECT * FROM a WHERE file IN ('1-URGENT', '2-HIGH')) a FULL JOIN (SELECT * FROM b WHERE file IN ('1-URGENT', '2-HIGH')) b ON a.fqn = b.fqn WHERE a.fqn IS NULL OR b.fqn IS NULL OR a.content_hash <> b.content_hash")
def j07(spark, sf):
    return H.symbol_changes(*snapshots(spark, sf), ["1-URGENT", "2-HIGH"])


@query("j08_base_delta_merge", with_(SNAPSHOTS) + "SELECT fqn, content_hash FROM (SELECT * FROM b WHERE file IN ('1-URGENT', '5-LOW')) UNION ALL SELECT fqn, content_hash FROM a WHERE file NOT IN ('1-URGENT', '5-LOW', '2-HIGH')")
def j08(spark, sf):
    from ..operators.incremental import merge_delta

    a, b = snapshots(spark, sf)
    delta = b.where(F.col("file").isin("1-URGENT", "5-LOW"))
    return merge_delta(a, delta, spark.createDataFrame([("2-HIGH",)], "file string")).select("fqn", "content_hash")


@query("j20_as_of", """SELECT o_orderkey, last(s.k ORDER BY s.at, s.k) AS last_key FROM orders o LEFT JOIN (SELECT o_custkey AS c, o_orderdate AS at, o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') s ON s.c = o.o_custkey AND s.at <= o.o_orderdate GROUP BY o_orderkey""")
def j20(spark, sf):
    o = read(spark, sf, "orders")
    events = o.select("o_orderkey", F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("ts"))
    done = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("commit_ts"), F.col("o_orderkey").alias("last_key"))
    return H.as_of(events, done, "c", value="last_key").select("o_orderkey", "last_key")


@query("w16_latest_version", "SELECT o_custkey AS repo_id, max(o_orderkey) AS version FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def w16(spark, sf):
    v = read(spark, sf, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    return H.latest_version(v)


@query("w17_retained_versions", "SELECT o_custkey AS repo_id, o_orderkey AS version FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3")
def w17(spark, sf):
    return H.retained_versions(read(spark, sf, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("version")), 3)


@query("t29_snapshot_gc", "SELECT repo_id, snapshot_id FROM (SELECT o_custkey AS repo_id, o_orderkey AS snapshot_id, (DATE '1999-12-31' - o_orderdate::DATE)::INT AS age, o_orderkey % 5 = 0 AS tagged, row_number() OVER (PARTITION BY o_custkey ORDER BY (DATE '1999-12-31' - o_orderdate::DATE), o_orderkey) AS r FROM orders) WHERE NOT tagged AND r > 10 AND age >= 30")
def t29(spark, sf):
    s = read(spark, sf, "orders").select(F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("snapshot_id"), F.datediff(F.lit("1999-12-31").cast("date"), "o_orderdate").alias("age_days"), (F.col("o_orderkey") % 5 == 0).alias("tagged"))
    return H.expired_snapshots(s).select("repo_id", "snapshot_id")


@query("d11_renames", """WITH f AS (SELECT p_partkey AS k, 'src/a/b/c/d/e/f/g/h/i' || p_size || '/x' || (p_partkey // 2) || '.py' AS path, 100 + p_size AS size FROM part), a AS (SELECT * FROM f WHERE k % 2 = 0), d AS (SELECT k, path, size, list_distinct(string_split(path, '/')) AS parts FROM f WHERE k % 2 = 1),
p AS (SELECT a.path, d.path AS old_path, len(list_intersect(list_distinct(string_split(a.path, '/')), d.parts)) / len(list_distinct(list_concat(string_split(a.path, '/'), d.parts)))::DOUBLE AS alike FROM a, d WHERE least(a.size, d.size) / greatest(a.size, d.size)::DOUBLE >= 0.9)
SELECT path, old_path, round(alike, 6) AS alike FROM p WHERE alike >= 0.75 QUALIFY row_number() OVER (PARTITION BY path ORDER BY alike DESC, old_path) = 1""")
def d11(spark, sf):
    k = F.col("p_partkey")
    f = read(spark, sf, "part").select(k.alias("k"), F.concat(F.lit("src/a/b/c/d/e/f/g/h/i"), F.col("p_size").cast("string"), F.lit("/x"), F.floor(k / 2).cast("string"), F.lit(".py")).alias("path"), (F.col("p_size") + 100).alias("size"))
    out = H.rename_pairs(f.where("k % 2 = 0"), f.where("k % 2 = 1"), alike_least=0.75)
    return out.select("path", "old_path", F.round("alike", 6).alias("alike"))
