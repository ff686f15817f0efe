"""Streams over the events table: windows, debouncing, idempotency, joins; run as Structured Streaming where named so."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..sources.tables import CHANGES, SNAPSHOTS, changes, read, snapshots, with_
from ..streaming import events as V
from .base import query

_C = with_(CHANGES)


@query("t01_leading_debounce", _C + "SELECT event_id, path FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS gap FROM changes) WHERE gap IS NULL OR gap > INTERVAL 6 HOUR")
def t01(spark, sf):
    return V.leading_debounce(changes(spark, sf), 6 * 3600).select("event_id", "path")


@query("t02_event_conversion", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' WHEN 3 THEN NULL ELSE CASE WHEN event_id % 2 = 0 THEN 'modified' ELSE 'deleted' END END AS op FROM events")
def t02(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, ("create", "modify_data", "remove", "metadata", "any"))), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", V.converted(raw, F.col("event_id") % 2 == 0).alias("op"))


@query("t03_trailing_debounce", _C + """, s AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id)) <= 36000000000 THEN 0 ELSE 1 END AS new FROM changes)),
p AS (SELECT *, floor((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY path, s))) / (86400 * 1e6)) AS part FROM s)
SELECT path, last(op ORDER BY ts, event_id) AS op, max(ts) AS ts, count(*) AS n FROM p GROUP BY path, s, part""")
def t03(spark, sf):
    return V.trailing_debounce(changes(spark, sf), "36000 seconds", 86_400).select("path", "op", F.col("ts").cast("timestamp_ntz").alias("ts"), "n")


@query("t04_change_set", _C + "SELECT path, op, count(*) AS n FROM (SELECT path, op FROM changes WHERE op <> 'moved' UNION ALL SELECT path, 'deleted' FROM changes WHERE op = 'moved' UNION ALL SELECT path || '.new', 'created' FROM changes WHERE op = 'moved') GROUP BY ALL")
def t04(spark, sf):
    return I.moved_as_pairs(changes(spark, sf).withColumn("dest", F.concat("path", F.lit(".new")))).groupBy("path", "op").agg(F.count("*").alias("n"))


@query("t05_rate_limit", "SELECT event_id FROM (SELECT event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 12 HOUR) AS n FROM events a) WHERE n < 3")
def t05(spark, sf):
    return V.rate_limited(changes(spark, sf), 3, 12 * 3600).select("event_id")


@query("t06_queue_dedup", _C + "SELECT path, last(op ORDER BY ts, event_id) AS op FROM changes GROUP BY path")
def t06(spark, sf):
    return changes(spark, sf).groupBy("path").agg(F.max_by("op", F.struct("ts", "event_id")).alias("op"))


@query("t07_idempotency", "SELECT event_id FROM events a WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_id % 2 = 1 AND b.user_id = a.user_id AND b.event_type = a.event_type AND b.ts >= a.ts - INTERVAL 24 HOUR)")
def t07(spark, sf):
    # what was seen at any time from a day before the request on counts as seen, key by key
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    seen = e.where("event_id % 2 = 1").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    asked = e.where("event_id % 2 = 0").join(seen, ["user_id", "event_type"], "left")
    return asked.where(F.col("last").isNull() | (F.col("last") < F.col("ts") - F.expr("interval 24 hours"))).select("event_id")


@query("t07_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def t07b(spark, sf):
    """The first event of each user and type."""
    e = read(spark, sf, "events").select("user_id", "event_type", "ts")
    return V.replay(spark, e, lambda s: V.deduplicated(s, ["user_id", "event_type"], "400 days")).select("user_id", "event_type")


@query("t08_transaction_delta", _C + "SELECT txn, path AS key, op FROM (SELECT event_id // 50 AS txn, path, first(op ORDER BY event_id) AS f, last(op ORDER BY event_id) AS op FROM (SELECT event_id, path, CASE op WHEN 'created' THEN 'add' WHEN 'deleted' THEN 'remove' ELSE 'update' END AS op FROM changes) GROUP BY ALL) WHERE NOT (f = 'add' AND op = 'remove')")
def t08(spark, sf):
    return I.session_delta(_ops(spark, sf).withColumn("txn", F.floor(F.col("seq") / 50)))


def _ops(spark, sf):
    op = F.when(F.col("op") == "created", "add").when(F.col("op") == "deleted", "remove").otherwise("update")
    return changes(spark, sf).select(F.col("path").alias("key"), F.col("event_id").alias("seq"), op.alias("op"))


@query("t08_conflicts", _C + "SELECT path AS key, count(DISTINCT event_id // 200) AS txns FROM changes GROUP BY path HAVING count(DISTINCT event_id // 200) > 1")
def t08b(spark, sf):
    return I.conflicts(I.session_delta(_ops(spark, sf).withColumn("txn", F.floor(F.col("seq") / 200))).unionByName(_ops(spark, sf).select(F.floor(F.col("seq") / 200).alias("txn"), "key", "op")).distinct())


@query("t09_virtual_layer", _C + "SELECT path AS key, last(op ORDER BY event_id) AS op FROM (SELECT event_id, path, CASE op WHEN 'created' THEN 'add' WHEN 'deleted' THEN 'remove' ELSE 'update' END AS op FROM changes) GROUP BY path HAVING last(op ORDER BY event_id) <> 'remove'")
def t09(spark, sf):
    return I.latest(_ops(spark, sf)).select("key", "op")


@query("s03_index_changes", _C + "SELECT path AS key, CASE WHEN f = 'add' THEN 'added' WHEN l = 'remove' THEN 'removed' ELSE 'modified' END AS change FROM (SELECT path, first(op ORDER BY event_id) AS f, last(op ORDER BY event_id) AS l FROM (SELECT event_id, path, CASE op WHEN 'created' THEN 'add' WHEN 'deleted' THEN 'remove' ELSE 'update' END AS op FROM changes) GROUP BY path) WHERE NOT (f = 'add' AND l = 'remove')")
def s03(spark, sf):
    return I.change_set(_ops(spark, sf))


@query("t10_update_strategy", "SELECT p_partkey, CASE WHEN r < 0.001 THEN 'skip' WHEN r > 0.5 THEN 'rebuild' WHEN r < 0.01 THEN 'sync' ELSE 'async' END AS strategy FROM (SELECT p_partkey, p_partkey / 2500.0 AS r FROM part)")
def t10(spark, sf):
    return read(spark, sf, "part").select("p_partkey", I.update_strategy(F.col("p_partkey"), F.lit(2500.0)).alias("strategy"))


@query("t12_changed_part", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'signature' WHEN o_orderkey % 3 = 0 THEN 'body' WHEN o_orderkey % 2 = 0 THEN 'doc' ELSE 'none' END AS part FROM orders")
def t12(spark, sf):
    k = F.col("o_orderkey")
    old = {p: F.lit("a") for p in ("signature", "body", "doc", "format")}
    new = {"signature": F.when(k % 5 == 0, "b").otherwise("a"), "body": F.when(k % 3 == 0, "b").otherwise("a"), "doc": F.when(k % 2 == 0, "b").otherwise("a"), "format": F.lit("a")}
    return read(spark, sf, "orders").select("o_orderkey", I.changed_part(old, new).alias("part"))


@query("t14_incremental_snapshot", with_(SNAPSHOTS) + "SELECT CASE WHEN a.content_hash = b.content_hash THEN 'skipped' ELSE 'analysed' END AS action, count(*) AS n FROM b LEFT JOIN a ON a.fqn = b.fqn GROUP BY 1")
def t14(spark, sf):
    a, b = snapshots(spark, sf)
    old = a.select("fqn", F.col("content_hash").alias("old"))
    return b.join(old, "fqn", "left").groupBy(F.when(F.col("content_hash") == F.col("old"), "skipped").otherwise("analysed").alias("action")).agg(F.count("*").alias("n"))


@query("t20_stale_versions", "SELECT o_orderkey, o_orderkey % 100 > 60 OR o_orderstatus <> 'F' AS stale FROM orders")
def t20(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select("o_orderkey", I.stale(k % 100, F.col("o_orderstatus"), F.lit("F")).alias("stale"))


@query("t21_job_states", _C + """, l AS (SELECT path AS job, event_id AS seq, CASE WHEN op = 'created' THEN 'start' WHEN op = 'modified' THEN 'fail' WHEN op = 'moved' AND event_id % 31 = 0 THEN 'cancel' ELSE 'note' END AS event FROM changes),
g AS (SELECT job, count(*) FILTER (event = 'start') AS tries, bool_or(event = 'cancel') AS cancelled, last(event ORDER BY seq) FILTER (event IN ('start', 'fail')) AS final FROM l GROUP BY job)
SELECT job, CASE WHEN cancelled THEN 'cancelled' WHEN final IS NULL THEN 'queued' WHEN final = 'start' AND tries <= 4 THEN 'running' ELSE 'failed' END AS state, tries FROM g""")
def t21(spark, sf):
    op = F.col("op")
    event = F.when(op == "created", "start").when(op == "modified", "fail").when((op == "moved") & (F.col("event_id") % 31 == 0), "cancel").otherwise("note")
    log = changes(spark, sf).select(F.col("path").alias("job"), F.col("event_id").alias("seq"), event.alias("event"))
    return V.job_state(log).select("job", "state", F.col("tries").cast("long").alias("tries"))


@query("t25_circuit_breaker", "SELECT event_id, sum(bad) OVER (PARTITION BY event_type ORDER BY event_id ROWS 4 PRECEDING) >= 5 OR (count(*) OVER w >= 20 AND sum(bad) OVER w / count(*) OVER w >= 0.5) AS open FROM (SELECT event_id, event_type, (value < 50)::INT AS bad FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS 19 PRECEDING)")
def t25(spark, sf):
    calls = read(spark, sf, "events").select("event_id", F.col("event_type").alias("service"), F.col("event_id").alias("seq"), (F.col("value") >= 50).alias("ok"))
    return V.breaker(calls).select("event_id", "open")


@query("t30_tumbling_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t30(spark, sf):
    return V.tumbling(read(spark, sf, "events"), "1 day", "event_type").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t30_sliding_window", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i) FOR i IN generate_series(0, 3)]) AS s FROM events) GROUP BY s")
def t30b(spark, sf):
    return V.sliding(read(spark, sf, "events"), "1 day", "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t30_session_window", "SELECT min(ts) AS start, user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def t30c(spark, sf):
    return V.sessions(read(spark, sf, "events"), "8 hours", "user_id").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t30_streaming_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t30d(spark, sf):
    e = read(spark, sf, "events").select("ts", "event_type", "value")
    return V.replay(spark, e, lambda s: V.tumbling(s, "1 day", "event_type", watermark="1 hour"), "complete").select("start", "event_type", "n").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t30_stream_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON b.user_id = a.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_id % 5 = 0 AND b.event_id % 5 = 1")
def t30e(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "ts")

    def plan(s):
        return V.joined(s.where("event_id % 5 = 0"), s.where("event_id % 5 = 1"), "user_id", "2 hours").select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))

    return V.replay(spark, e, plan)


@query("u07_change_algebra", with_(SNAPSHOTS) + ", ch AS (SELECT coalesce(a.fqn, b.fqn) AS p, a.fqn IS NULL AS added, b.fqn IS NULL AS deleted FROM a FULL JOIN b ON a.fqn = b.fqn WHERE a.fqn IS NULL OR b.fqn IS NULL), r AS (SELECT p AS path, 'o:' || (substr(p, 3)::INT + 1) AS old_path FROM ch WHERE added AND substr(p, 3)::INT % 20 = 10) SELECT path, 'renamed' AS change FROM r UNION ALL SELECT p, 'added' FROM ch WHERE added AND p NOT IN (SELECT path FROM r) UNION ALL SELECT p, 'deleted' FROM ch WHERE deleted AND p NOT IN (SELECT old_path FROM r)")
def u07(spark, sf):
    from ..operators.history import compare_snapshots

    c = compare_snapshots(*snapshots(spark, sf)).withColumnRenamed("fqn", "path")
    added, deleted = c.where("change = 'added'"), c.where("change = 'deleted'")
    n = F.substring("path", 3, 12).cast("int")
    renamed = added.where(n % 20 == 10).select("path", F.concat(F.lit("o:"), (n + 1).cast("string")).alias("old_path"))
    return I.classified(added, deleted, renamed)


@query("u08_change_sources", with_(SNAPSHOTS) + "SELECT fqn FROM (SELECT a.fqn FROM a JOIN b ON a.fqn = b.fqn WHERE a.content_hash <> b.content_hash UNION SELECT fqn FROM b WHERE file = '1-URGENT')")
def u08(spark, sf):
    from ..operators.history import compare_snapshots

    a, b = snapshots(spark, sf)
    by_hash = compare_snapshots(a, b).where("change = 'modified'").select("fqn")
    return by_hash.union(b.where("file = '1-URGENT'").select("fqn")).distinct()


@query("u09_tombstones", with_(SNAPSHOTS) + "SELECT fqn FROM a WHERE fqn NOT IN (SELECT fqn FROM b)")
def u09(spark, sf):
    a, b = snapshots(spark, sf)
    return a.join(b, "fqn", "left_anti").select("fqn")


@query("u13_index_consistency", 'SELECT "index", documents, (top - documents) / top::DOUBLE <= 0.05 AS consistent FROM (SELECT *, max(documents) OVER () AS top FROM (SELECT \'documents\' AS "index", count(*) AS documents FROM documents UNION ALL SELECT \'labels\', count(*) FROM labels UNION ALL SELECT \'pages\', count(*) FROM pages))')
def u13(spark, sf):
    out = None
    for name in ("documents", "labels", "pages"):
        one = read(spark, sf, name).agg(F.count("*").alias("documents")).withColumn("index", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return I.consistency(out)
