"""Change history: churn, hotspots, co-change, snapshots, as-of commits, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dealt, keep


def churn(commits: DataFrame) -> DataFrame:
    """One row a path: commits, added, deleted, first and last change, active days (1 at least), churn rate, frequency a week."""
    g = commits.groupBy("path").agg(F.countDistinct("commit").alias("commits"), F.sum("adds").alias("added"), F.sum("dels").alias("deleted"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    days = F.greatest(F.lit(1), F.datediff("last_ts", "first_ts"))
    g = g.withColumn("days_active", days)
    return g.withColumn("churn_rate", (F.col("added") + F.col("deleted")) / F.col("days_active")).withColumn("frequency", F.col("commits") / F.greatest(F.lit(1.0), F.col("days_active") / 7.0))


def hotspots(commits: DataFrame, since, top: int = 20, least: int = 5) -> DataFrame:
    """Paths with at least ``least`` changed lines since a time, by churn rate, ties by path."""
    c = churn(commits.where(F.col("ts") >= since)).where(F.col("added") + F.col("deleted") >= least)
    return c.orderBy(F.desc("churn_rate"), "path").limit(top)


def compare_periods(commits: DataFrame, middle) -> DataFrame:
    """Changes of each path after and before a time and the change in percent, 0 without earlier changes."""
    size = F.col("adds") + F.col("dels")
    g = commits.groupBy("path").agg(F.coalesce(F.sum(F.when(F.col("ts") >= middle, size)), F.lit(0)).alias("recent"), F.coalesce(F.sum(F.when(F.col("ts") < middle, size)), F.lit(0)).alias("previous"))
    return g.withColumn("percent", F.when(F.col("previous") == 0, 0.0).otherwise((F.col("recent") - F.col("previous")) * 100.0 / F.col("previous")))


#: Commits of one path that one task pairs.
TOGETHER = 1 << 20


def co_changes(commits: DataFrame, widest: int = 1000) -> DataFrame:
    """a, b (a < b), together, n_a, n_b, coupling, confidences of paths changed in the same commits.

    Pairs exist inside one commit only.  A commit that touches more than
    ``widest`` paths is a sweep and pairs nothing; the bound is part of the
    definition and keeps a commit's pairs from growing without end.  A path
    travels with the list of those it meets in a commit, so pairs are made and
    counted where they arrive; a path of many commits is dealt to several tasks.
    """
    c = keep(dealt(commits.select("commit", "path"), "commit", "path").distinct(), "co-changes")
    sizes = c.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n").between(2, widest))
    each = c.groupBy("path").agg(F.count("*").alias("n"))
    salts = F.pmod(F.xxhash64("commit"), F.ceil(F.col("n") / TOGETHER)).cast("int")
    lists = c.join(sizes.drop("n"), "commit").groupBy("commit").agg(F.collect_list("path").alias("paths"))
    often = keep(each.where(F.col("n") > TOGETHER), "co-changed-often")  # few: one of TOGETHER rows at most
    met = c.join(often, "path", "left").select("commit", F.col("path").alias("a"), F.coalesce(salts, F.lit(0)).alias("salt")).join(lists, "commit")
    met = met.select("a", "salt", F.filter("paths", lambda b: b > F.col("a")).alias("bs")).where("size(bs) > 0").repartition("a", "salt")
    counted = met.select("a", "salt", F.explode("bs").alias("b")).groupBy("a", "salt", "b").agg(F.count("*").alias("n"))
    pairs = counted.groupBy("a", "b").agg(F.sum("n").alias("together"))
    out = pairs.join(each.select(F.col("path").alias("a"), F.col("n").alias("n_a")), "a").join(each.select(F.col("path").alias("b"), F.col("n").alias("n_b")), "b")
    return out.select("a", "b", "together", "n_a", "n_b", (F.col("together") / (F.col("n_a") + F.col("n_b") - F.col("together"))).alias("coupling"), (F.col("together") / F.col("n_a")).alias("b_given_a"), (F.col("together") / F.col("n_b")).alias("a_given_b"))


def strength(pairs: DataFrame, contexts: int) -> DataFrame:
    """min(10 * together / contexts, 1) of co-occurring pairs."""
    return pairs.withColumn("strength", F.least(F.lit(1.0), F.col("together") * 10.0 / contexts))


def file_metrics(commits: DataFrame) -> DataFrame:
    """churn score min(0.05 * commits, 1), authors, hotspot (churn over 0.7 or five authors), main author (most commits, ties by name)."""
    by = commits.groupBy("path", "author").agg(F.countDistinct("commit").alias("n"))
    main = by.groupBy("path").agg(F.min_by("author", F.struct((-F.col("n")).alias("less"), "author")).alias("main_author"), F.count("*").alias("authors"))
    all_ = commits.groupBy("path").agg(F.countDistinct("commit").alias("commits"))
    score = F.round(F.least(F.lit(1.0), F.least(F.lit(50), F.col("commits")) * 0.05), 3)
    return all_.join(main, "path").select("path", "commits", "authors", "main_author", score.alias("churn"), ((score > 0.7) | (F.col("authors") >= 5)).alias("hotspot"))


def weekly(commits: DataFrame) -> DataFrame:
    """week, changes, and growth against the week before (added and deleted lines never negative)."""
    w = commits.groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.sum("adds").alias("adds"), F.countDistinct("path").alias("paths"))
    before = F.lag("paths").over(Window.orderBy("week"))  # one row a week
    return w.withColumn("more", F.greatest(F.lit(0), F.col("paths") - F.coalesce(before, F.col("paths")))).withColumn("fewer", F.greatest(F.lit(0), F.coalesce(before, F.col("paths")) - F.col("paths")))


def compare_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """fqn, change: added, deleted or modified (unlike content hashes); null names are ignored."""
    x, y = (df.where("fqn is not null").select("fqn", F.col("content_hash").alias(n)) for df, n in ((a, "old"), (b, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified")
    return x.join(y, "fqn", "full").select("fqn", change.alias("change")).where("change is not null")


def symbol_changes(a: DataFrame, b: DataFrame, files: list[str] | None = None) -> DataFrame:
    """Added and deleted names; signature_changed where both hashes are known and differ; in given files only."""
    if files is not None:
        a, b = (df.where(F.col("file").isin(*files)) for df in (a, b))
    out = compare_snapshots(a, b)
    return out.withColumn("change", F.when(F.col("change") == "modified", "signature_changed").otherwise(F.col("change")))


#: A path part of more deleted files than this is common.
COMMON = 64


def rename_pairs(added: DataFrame, deleted: DataFrame, least: float = 0.9, alike_least: float = 0.9) -> DataFrame:
    """path, old_path: each added file with its best deleted one of the same extension, by Jaccard of path parts and size ratio.

    Files that share a part of at most ``COMMON`` deleted files meet by it.  Else two
    files share common parts only, and their similarity is that of their classes
    (extension, size, number of parts, common parts), so only the first path
    of a class of deleted files can be the best one; two classes meet by one of
    the first f - s * n + 1 of their f common parts, the rarest first.
    """
    def parts(df, out):
        ps = F.array_distinct(F.split("path", "/"))
        return df.select("path", "size").distinct().select(F.col("path").alias(out), F.col("size").alias(f"{out}_size"), F.element_at(F.split("path", r"\."), -1).alias("ext"), ps.alias(f"{out}_parts"))

    a, d = parts(added, "path"), parts(deleted, "old_path")
    often = keep(d.select(F.explode("old_path_parts").alias("part")).groupBy("part").agg(F.count("*").alias("c")), "path-parts")
    near = (F.least("path_size", "old_path_size") / F.greatest("path_size", "old_path_size") >= least) | F.col("old_path_size").isNull()

    def keyed(df, name, which):
        return df.select(name, f"{name}_size", "ext", F.size(f"{name}_parts").alias(f"{name}_n"), F.explode(f"{name}_parts").alias("part")).join(often.where(which), "part")

    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    split = lambda c: F.array_distinct(F.split(c, "/"))
    met = keyed(a, "path", f"c <= {COMMON}").drop("c", "path_n").join(keyed(d, "old_path", f"c <= {COMMON}").drop("c", "old_path_n"), ["ext", "part"]).where(near)
    rare = met.select("path", "old_path", share(split("path"), split("old_path")).alias("alike"))

    def classes(df, name):
        common = keyed(df, name, f"c > {COMMON}").groupBy(name, f"{name}_size", "ext", f"{name}_n").agg(F.array_sort(F.collect_list(F.struct("c", "part"))).alias(f"{name}_common"))
        return common.withColumn(f"{name}_class", F.sha2(F.to_json(F.struct("ext", f"{name}_size", f"{name}_n", f"{name}_common")), 256))

    def spread(df, name):
        own = [f"{name}_class", f"{name}_size", f"{name}_n", f"{name}_common", "ext"]
        extra = [F.min(name).alias(name)] if name == "old_path" else []
        one = df.groupBy(f"{name}_class").agg(*[F.first(c).alias(c) for c in own[1:]], *extra)
        first = F.size(f"{name}_common") - F.greatest(F.lit(1), F.ceil(F.lit(float(alike_least)) * F.col(f"{name}_n") - 1e-9).cast("int")) + 1
        return one.withColumn("o", F.explode(F.slice(f"{name}_common", F.lit(1), F.greatest(F.lit(0), first)))).withColumn("part", F.col("o.part")).drop("o")

    ca, cd = keep(classes(a, "path"), "path-classes"), classes(d, "old_path")
    both = F.size(F.array_intersect("path_common", "old_path_common"))
    linked = spread(ca, "path").join(spread(cd, "old_path"), ["ext", "part"]).where(near).withColumn("alike", both / (F.col("path_n") + F.col("old_path_n") - both)).where(F.col("alike") >= alike_least)
    best = linked.groupBy("path_class").agg(F.min(F.struct((-F.col("alike")).alias("less"), F.col("old_path"))).alias("best"))
    plain = ca.select("path", "path_class").join(best, "path_class").select("path", F.col("best.old_path").alias("old_path"), (-F.col("best.less")).alias("alike"))
    kept = rare.where(F.col("alike") >= alike_least).unionByName(plain)
    one = kept.groupBy("path").agg(F.min(F.struct((-F.col("alike")).alias("less"), F.col("old_path"))).alias("best"))
    return one.select("path", F.col("best.old_path").alias("old_path"), (-F.col("best.less")).alias("alike"))


def as_of(events: DataFrame, commits: DataFrame, key: str, at: str = "ts", commit_at: str = "commit_ts", value: str = "commit") -> DataFrame:
    """``events`` with the latest ``value`` at or before each time, per key: one sort of both sides, no range join."""
    a = events.withColumn("_side", F.lit(1)).withColumn("_at", F.col(at)).withColumn("_value", F.lit(None).cast(commits.schema[value].dataType))
    b = commits.select(F.col(key), F.col(commit_at).alias("_at"), F.col(value).alias("_value")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy("_at", "_side", F.col("_value").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn(value, F.last("_value", ignorenulls=True).over(by)).where("_side = 1")
    return out.drop("_side", "_at", "_value")


def latest_version(versions: DataFrame) -> DataFrame:
    """The last completed version of each repository."""
    return versions.where("status = 'completed'").groupBy("repo_id").agg(F.max("version").alias("version"))


def retained_versions(versions: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy("repo_id").orderBy(F.desc("version"))
    return versions.withColumn("r", F.row_number().over(by)).where(F.col("r") <= n).drop("r")


def expired_snapshots(snapshots: DataFrame, keep: int = 10, days: int = 30) -> DataFrame:
    """Snapshots to delete: untagged, past the newest ``keep`` and at least ``days`` old (columns repo_id, snapshot_id, age_days, tagged)."""
    by = Window.partitionBy("repo_id").orderBy("age_days", "snapshot_id")
    return snapshots.withColumn("rank", F.row_number().over(by)).where((~F.col("tagged")) & (F.col("rank") > keep) & (F.col("age_days") >= days))
