"""Graph analyses: indexes, impact, slices, neighbourhoods, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import paths
from ..storage import keep


def degrees(edges: DataFrame) -> DataFrame:
    """node, outgoing, incoming."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    # ends that are null stay apart by their side
    sided = ends.select("e.*").groupBy("node", (F.col("node").isNull() & (F.col("o") == 1)).alias("side"))
    return sided.agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming")).drop("side")


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge enters."""
    return nodes.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def adjacency(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """node, kind, n and the first 100 neighbours in order: an index row; all neighbours are a filter on the edges."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    rank = F.row_number().over(Window.partitionBy(a, "kind").orderBy(b))
    top = edges.withColumn("r", rank)
    return top.groupBy(F.col(a).alias("node"), "kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= 100, F.col(b)))).alias("first"))


def impact(edges: DataFrame, changed: DataFrame, depth: int = 5) -> DataFrame:
    """start, direct, transitive: dependents (who reaches the changed node), by a bounded backward closure."""
    r = paths.reach(edges, changed, depth, backward=True)
    return r.groupBy("start").agg(F.sum((F.col("distance") == 1).cast("int")).alias("direct"), F.count("*").alias("transitive"))


def slice_(control: DataFrame, data: DataFrame, criterion: DataFrame, forward: bool = False, thin: bool = False, depth: int = 30) -> DataFrame:
    """Nodes of a backward or forward slice of the dependence graph; a thin slice follows data only."""
    e = data.select("src", "dst") if thin else data.select("src", "dst").unionByName(control.select("src", "dst"))
    return paths.reach(e, criterion, depth, backward=not forward).select("start", "node").unionByName(criterion.select(F.col("id").alias("start"), F.col("id").alias("node")))


def dependence_graph(control: DataFrame, data: DataFrame) -> DataFrame:
    """src, dst, kind: control, data, or both."""
    c, d = control.select("src", "dst").distinct().withColumn("c", F.lit(True)), data.select("src", "dst").distinct().withColumn("d", F.lit(True))
    kind = F.when(F.col("c") & F.col("d"), "both").when(F.col("c"), "control").otherwise("data")
    return c.join(d, ["src", "dst"], "full").fillna(False, ["c", "d"]).select("src", "dst", kind.alias("kind"))


def cheapest(edges: DataFrame, starts: DataFrame, most_cost: float = 30.0, depth: int = 5) -> DataFrame:
    """start, node, cost: least cost of a walk of at most ``depth`` edges (src, dst, cost), by rounds of relaxation."""
    e = keep(edges.select("src", "dst", F.col("cost").alias("step")), "costs")  # of parallel edges the least cost stays
    best = keep(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0.0).alias("cost")), "costs-now")
    for _ in range(depth):
        more = best.join(e, best["node"] == e["src"]).select("start", F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost")).where(F.col("cost") <= most_cost)
        best = keep(best.unionByName(more).groupBy("start", "node").agg(F.min("cost").alias("cost")), "costs-now")
    return best.where("node != start")


def edge_cost(kind, is_async=None, conditional=None, loop=None, relative=None, wildcard=None):
    """Base cost of a kind (5 if unknown) times factors of how the edge is used."""
    base = F.when(kind == "CALLS", 1.0).when(kind == "CONTAINS", 0.5).when(kind == "REFERENCES", 2.0).when(kind == "IMPORTS", 1.5).when(kind == "DATAFLOW", 1.2).otherwise(5.0)
    for flag, factor in ((is_async, 0.9), (conditional, 1.3), (loop, 1.2), (relative, 0.8), (wildcard, 1.5)):
        if flag is None:
            continue
        base = base * F.when(flag, factor).otherwise(1.0)
    return base


def expanded(edges: DataFrame, starts: DataFrame, depth: int = 3, most: int = 40) -> DataFrame:
    """start, node, score = max(0.3, 1 - 0.15 depth) of at most ``most`` nodes a start, nearer first."""
    r = paths.reach(edges, starts, depth)
    rank = F.row_number().over(Window.partitionBy("start").orderBy("distance", "node"))
    return r.withColumn("r", rank).where(F.col("r") <= most).select("start", "node", F.greatest(F.lit(0.3), 1 - 0.15 * F.col("distance")).alias("score"))


def both_ways(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """Forward 0.6 and backward 0.4 of the plain expansion's scores, the better of the two."""
    a = expanded(edges, starts, depth).withColumn("score", F.col("score") * 0.6)
    b = expanded(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), starts, depth).withColumn("score", F.col("score") * 0.4)
    return a.unionByName(b).groupBy("start", "node").agg(F.max("score").alias("score"))


def proximity(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, proximity: 1 for the same or neighbours, 0.5 ** (d - 1) up to three undirected steps, else 0."""
    e = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    r = paths.reach(e, pairs.select(F.col("a").alias("id")).distinct(), 3)
    out = pairs.join(r.select(F.col("start").alias("a"), F.col("node").alias("b"), "distance"), ["a", "b"], "left")
    return out.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).when(F.col("distance").isNotNull(), F.pow(F.lit(0.5), F.col("distance") - 1)).otherwise(0.0).alias("proximity"))


def tree_rollup(tree: DataFrame, values: DataFrame, depth: int | None = None) -> DataFrame:
    """node, total of a value over the node and all below it; ``tree``: id, parent."""
    up = paths.reach(tree.where("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst")), values.select("id"), depth)
    own = values.select(F.col("id").alias("node"), "value")
    above = up.join(values, up["start"] == values["id"]).select("node", "value")
    return own.unionByName(above).groupBy("node").agg(F.sum("value").alias("total"))


def tree_depth(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """node, depth under its root; nodes of a cycle have none."""
    roots = tree.where("parent is null").select("id")
    down = paths.reach(tree.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst")), roots, depth)
    return roots.select(F.col("id").alias("node"), F.lit(0).alias("depth")).unionByName(down.select("node", F.col("distance").alias("depth")))


def blend_weights(items: DataFrame) -> DataFrame:
    """node, weight for personal ranking from items (node, origin, weight): ide .4, query .3, git .2, history .1, others 1; at most 1."""
    w = F.when(F.col("origin") == "ide", 0.4).when(F.col("origin") == "query", 0.3).when(F.col("origin") == "git", 0.2).when(F.col("origin") == "history", 0.1).otherwise(1.0)
    return items.groupBy("node").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.col("weight") * w))).alias("weight"))
