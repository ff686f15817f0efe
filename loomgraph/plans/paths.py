"""Path search: bounded simple paths, breadth-first reachability, closures.

Edges are filtered before any step and prefixes die as soon as they repeat a
node, so Catalyst sees plain joins on the frontier.  Reachability steps remove
nodes already seen (anti join) and are written to the shared folder, which cuts
lineage; enumeration is bounded by depth and unrolls into one plan.
"""

from __future__ import annotations

import time
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dealt, discard, keep, tidy
from .selectors import UNLIMITED, Flow, NodeSelector

#: The search starts from the targets when they are so many times fewer than the sources.
FLIP = 10


def _ids(nodes: DataFrame, selector: NodeSelector) -> DataFrame:
    return nodes.where(selector.column()).select("id").distinct()


def run(flow: Flow, nodes: DataFrame, edges: DataFrame, flip: bool = True) -> DataFrame:
    """All simple paths of a flow: src, dst, depth, path (ids in order of the search), best first.

    Shorter paths come first, then by ids; ``limits.max_paths`` of them are
    kept.  A depth at which the steps exceed ``limits.max_expansions``, or that
    begins too late, ends the search with the paths found before it.  A path ends at the first target it meets.  Walking backward follows
    edges against their direction from the sources.  With far fewer targets than
    sources the same paths are found from the other end.
    """
    kept = dealt(edges.where(flow.edges.column()).select("src", "dst"), "src", "dst").distinct()
    if flow.edges.backward != flow.backward:
        kept = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if flow.without is not None:
        gone = _ids(nodes, flow.without)
        kept = kept.join(gone, kept["src"] == gone["id"], "left_anti").join(gone, F.col("dst") == gone["id"], "left_anti")
    if flow.inside is not None:
        scope = _ids(nodes, flow.inside)
        kept = kept.join(scope, kept["src"] == scope["id"], "left_semi").join(scope, F.col("dst") == scope["id"], "left_semi")
    if flow.longest > 1:
        kept = keep(kept, "path-edges")  # every depth reads them
    # written, so that the planner knows how few they are and does not sort all edges to meet them
    sources, targets = (keep(_ids(nodes, s), "path-ends") for s in (flow.source, flow.target))
    turned = flip and targets.count() * FLIP < sources.count()
    if turned:
        kept = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        sources, targets = targets, sources
    ends = targets.select(F.col("id").alias("end"))
    front = sources.select(F.col("id").alias("first"), F.col("id").alias("node"), F.array("id").alias("path"))
    found, limits, steps, began = None, flow.limits, 0, time.monotonic()
    bounded = min(limits.max_expansions, limits.timeout_ms) < UNLIMITED
    for depth in range(1, min(flow.longest, limits.max_length - 1 if limits.max_length else flow.longest) + 1):
        step = front.join(kept, front["node"] == kept["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.select("first", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        if bounded:
            step = keep(step, "path-steps")
            steps += step.count()
            if found is not None and (steps > limits.max_expansions or (time.monotonic() - began) * 1000 > limits.timeout_ms):
                break
        hit = step.join(ends, F.col("node") == F.col("end"), "left_semi").withColumn("depth", F.lit(depth))
        found = hit if found is None else found.unionByName(hit)
        # a path goes on past a node only if that is no end; walking from the far end, ends are the sources
        front = step if turned else step.join(ends, F.col("node") == F.col("end"), "left_anti")
    if turned:
        found = found.select(F.col("node").alias("first"), F.col("first").alias("node"), F.reverse("path").alias("path"), "depth")
        stops = sources.select(F.col("id").alias("stop"))
        inner = found.select("first", "node", "path", "depth", F.explode(F.slice("path", 2, F.greatest(F.lit(0), F.size("path") - 2))).alias("stop"))
        through = inner.join(stops, "stop", "left_semi").select("path").distinct()
        found = found.join(through, "path", "left_anti")
    found = found.where(F.col("depth") >= flow.shortest)
    if flow.through is not None:
        cleaned = _ids(nodes, flow.through).select(F.col("id").alias("mid"))
        passed = found.select("path", F.explode("path").alias("mid")).join(cleaned, "mid", "left_semi").select("path").distinct()
        found = found.join(passed, "path", "left_semi")
    for predicate in flow.predicates:
        found = found.where(predicate(F.col("path")))
    out = found.select(F.col("first").alias("src"), F.col("node").alias("dst"), "depth", "path")
    out = out.orderBy("depth", "path")
    # a limited sort holds that many rows in each task
    return out if flow.limits.max_paths >= UNLIMITED else out.limit(flow.limits.max_paths)


def any_path(flow: Flow, nodes: DataFrame, edges: DataFrame) -> bool:
    return not run(flow.limit_paths(1), nodes, edges).isEmpty()


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = 20, backward: bool = False) -> DataFrame:
    """start, node, distance of what each start (column id) reaches in at most ``depth`` steps (None: any), itself left out.

    Every step joins the frontier once and drops pairs already seen.
    """
    e = edges.select("src", "dst")  # an edge that is there twice leads to the same pairs
    if backward:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if "_stored_at" not in edges.__dict__:
        e = keep(e, "reach-edges")
    seen = keep(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance")).distinct(), "reach-front")
    front = seen
    for d in count(1) if depth is None else range(1, depth + 1):
        step = front.join(e, front["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = keep(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(d)), "reach-front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def meeting(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int = 10) -> DataFrame:
    """Nodes on a walk from a source to a target: reached forward from one and backward from the other.

    A node met has at most ``depth`` steps behind it and as many before it, so every
    edge of its walk leaves a node within twice the depth of a source.  The search
    from the targets is kept to these edges, however much reaches the targets.
    """
    e = keep(edges.select("src", "dst"), "meeting-edges")
    own = sources.select(F.col("id").alias("node"), F.lit(0).alias("distance"))
    far = keep(reach(e, sources, 2 * depth).select("node", "distance").unionByName(own).groupBy("node").agg(F.min("distance").alias("distance")), "meeting-ahead")
    inside = keep(e.join(far.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst"), "meeting-inside")
    back = reach(inside, targets, depth, backward=True).select("node").unionByName(targets.select(F.col("id").alias("node"))).distinct()
    return far.where(F.col("distance") <= depth).select("node").join(back, "node", "left_semi")


def one_shortest(paths: DataFrame) -> DataFrame:
    """The shortest path of each pair, ties by ids."""
    by = Window.partitionBy("src", "dst").orderBy("depth", "path")
    return paths.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def longest(paths: DataFrame) -> DataFrame:
    by = Window.partitionBy("src", "dst").orderBy(F.desc("depth"), "path")
    return paths.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def levels(edges: DataFrame) -> DataFrame:
    """node, level by Kahn's rounds (sources are level 0); a cycle is an error."""
    e = keep(edges.select("src", "dst").distinct(), "levels-edges")
    waiting = keep(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct(), "levels-nodes")
    done, level = None, 0
    while not waiting.isEmpty():
        ready = keep(waiting.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)), "levels-ready")
        if ready.isEmpty():
            raise ValueError("the edges have a cycle")
        done = ready if done is None else done.unionByName(ready)
        waiting = keep(waiting.join(ready, "node", "left_anti"), "levels-nodes")
        e = keep(e.join(ready.select(F.col("node").alias("src")), "src", "left_anti"), "levels-edges")
        level += 1
    return done if done is not None else waiting.withColumn("level", F.lit(0))


def rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, personal: DataFrame | None = None) -> DataFrame:
    """node, score: PageRank with the mass of dead ends spread by the (personal) restart weights.

    ``personal``: node, weight; weights are scaled to one.  Each round is one
    join on the edges and one aggregation; ranks are written every few rounds.
    """
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("n"))
    e = keep(e.join(out, "src"), "rank-edges")
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    if personal is None:
        weights = nodes.withColumn("weight", F.lit(1.0))
    else:
        weights = nodes.join(personal.select("node", "weight"), "node", "left").fillna({"weight": 0.0})
    total = weights.agg(F.sum("weight")).first()[0]
    base = keep(weights.select("node", (F.col("weight") / total).alias("start")), "rank-nodes")
    dead = keep(base.join(out.select(F.col("src").alias("node")), "node", "left_anti").select("node"), "rank-dead")
    now = base.withColumn("score", F.col("start"))
    for i in range(rounds):
        sent = e.join(now, e["src"] == now["node"]).groupBy("dst").agg(F.sum(F.col("score") / F.col("n")).alias("got"))
        lost = now.join(dead, "node", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        now = base.join(sent, base["node"] == sent["dst"], "left").crossJoin(F.broadcast(lost)).select("node", "start", ((1 - damping) * F.col("start") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("start"))).alias("score"))
        if i % 4 == 3 or i == rounds - 1:
            now = keep(now, "rank-now")
    return now.select("node", "score")


def hubs(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, hub, authority (HITS), each scaled to a length of one."""
    e = keep(edges.select("src", "dst").distinct(), "hits-edges")
    hub = e.select(F.col("src").alias("node")).distinct().withColumn("hub", F.lit(1.0))
    for _ in range(rounds):
        auth = e.join(hub, e["src"] == hub["node"]).groupBy("dst").agg(F.sum("hub").alias("a"))
        length = auth.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("l"))
        auth = auth.crossJoin(F.broadcast(length)).select(F.col("dst").alias("node"), (F.col("a") / F.col("l")).alias("authority"))
        hub = e.join(auth, e["dst"] == auth["node"]).groupBy("src").agg(F.sum("authority").alias("h"))
        length = hub.agg(F.sqrt(F.sum(F.col("h") * F.col("h"))).alias("l"))
        hub = keep(hub.crossJoin(F.broadcast(length)).select(F.col("src").alias("node"), (F.col("h") / F.col("l")).alias("hub")), "hits-hub")
    auth = e.join(hub, e["src"] == hub["node"]).groupBy("dst").agg(F.sum("hub").alias("a"))
    length = auth.agg(F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("l"))
    auth = auth.crossJoin(F.broadcast(length)).select(F.col("dst").alias("node"), (F.col("a") / F.col("l")).alias("authority"))
    return hub.join(auth, "node", "full").fillna(0.0, ["hub", "authority"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component, by rounds of stars; read from one written table."""
    e = keep(edges.where("src != dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "parts")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = keep(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "parts")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        after = keep(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "parts")
        discard(e, large)
        e = after
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            tidy(edges.sparkSession)
            out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
            out._stored_at = e._stored_at
            return out
        before = now


#: Edges up to which the steps of the strong components may broadcast one side of a join.
FEW = 1 << 14


def _settled(step, now: DataFrame, label: str, apart, unrolled: int = 8) -> DataFrame:
    """``step`` (node, value to node, value) applied until nothing changes, a few times between two writes; ``apart`` marks a side that is not to be broadcast."""
    while True:
        after = now
        for _ in range(unrolled):
            after = step(after)
        after = keep(after, label)
        if after.join(apart(now.withColumnRenamed("value", "was")), "node", "left").where("was IS NULL OR was != value").isEmpty():
            return after
        now = after


def strong_components(edges: DataFrame) -> DataFrame:
    """node, root of every strongly connected component of two nodes or more, and of self-loops; the root is the smallest id.

    Forward-backward colouring: nodes without an edge in or out are trimmed; the
    smallest id that reaches a node is its colour; what reaches the colour's own
    node inside the colour is a component.  It leaves, and the rest goes on,
    edges between colours dropped, until no edge is left.  All steps run to
    their fixpoint, so cycles may be of any length.  A broadcast goes through the
    driver, and each step would make several, so only few edges are joined by it.
    """
    every = edges.select("src", "dst").distinct()
    e = keep(every.where("src != dst"), "strong-edges")
    found = every.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("root"))
    while True:
        size = e.count()

        def apart(df, many=size > FEW):
            return df.hint("merge") if many else df

        trimmed = e
        for _ in range(2):  # each doubles the plan twice
            trimmed = trimmed.join(apart(trimmed.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(apart(trimmed.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi")
        e = keep(trimmed.select("src", "dst"), "strong-edges")
        left = e.count()
        if not left:
            return found.groupBy("node").agg(F.min("root").alias("root"))
        if left < size:
            continue
        own = keep(e.select(F.col("src").alias("node")).distinct().withColumn("value", F.col("node")), "strong-colours")
        # each node leads to itself as well, so a step reads the one before once and its plan does not double
        loops = e.unionByName(own.toDF("src", "dst"))

        def ahead(now, loops=loops, apart=apart):
            return now.join(apart(loops), now["node"] == loops["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("value").alias("value"))

        colour = _settled(ahead, own, "strong-colours", apart)
        inside = keep(e.join(apart(colour.toDF("src", "a")), "src").join(apart(colour.toDF("dst", "b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour")), "strong-inside")

        loops = inside.unionByName(colour.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.col("value").alias("colour")))

        def back(now, loops=loops, apart=apart):
            return apart(loops).join(now, loops["dst"] == now["node"]).select(F.col("src").alias("node"), F.col("colour").alias("value")).distinct()

        part = _settled(back, keep(colour.where("node = value"), "strong-parts"), "strong-parts", apart)
        found = found.unionByName(part.join(apart(part.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")), "value").select("node", F.col("value").alias("root")))
        gone = apart(part.select("node"))
        e = keep(inside.join(gone, inside["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti").select("src", "dst"), "strong-edges")
