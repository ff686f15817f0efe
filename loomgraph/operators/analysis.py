"""Dataflow analyses: points-to, effects, taint, typestate, definitions and uses, races, imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import paths
from ..storage import keep
from .pairs import expanded


def points_to_unified(constraints: DataFrame) -> DataFrame:
    """var, location by unification (kind, lhs, rhs): copies join the classes of both sides, each class points to its locations together."""
    copies = constraints.where("kind = 'COPY'").select(F.col("lhs").alias("src"), F.col("rhs").alias("dst"))
    root = paths.components(copies)
    alloc = constraints.where("kind = 'ALLOC'").select(F.col("lhs").alias("node"), F.col("rhs").alias("location"))
    every = constraints.where("kind = 'COPY'").select(F.explode(F.array("lhs", "rhs")).alias("node")).unionByName(alloc.select("node")).distinct()
    cls = every.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = alloc.join(cls, "node").select("root", "location").distinct()
    return cls.join(held, "root").select(F.col("node").alias("var"), "location")


def points_to(constraints: DataFrame) -> DataFrame:
    """var, location by inclusion: copies, loads (lhs = *rhs) and stores (*lhs = rhs) to a fixpoint.

    Semi-naive: each round joins only the facts that are new.
    """
    kind = lambda k: keep(constraints.where(F.col("kind") == k).select("lhs", "rhs").distinct(), f"pta-{k.lower()}")
    alloc, copy, load, store = (kind(k) for k in ("ALLOC", "COPY", "LOAD", "STORE"))
    known = keep(alloc.select(F.col("lhs").alias("var"), F.col("rhs").alias("location")), "pta-known")
    flow = copy.select(F.col("rhs").alias("src"), F.col("lhs").alias("dst"))
    while True:
        loads = load.join(known, load["rhs"] == known["var"]).select(F.col("location").alias("src"), F.col("lhs").alias("dst"))
        stores = store.join(known, store["lhs"] == known["var"]).select(F.col("rhs").alias("src"), F.col("location").alias("dst"))
        flow = keep(flow.unionByName(loads).unionByName(stores).distinct(), "pta-flow")
        more = flow.join(known, flow["src"] == known["var"]).select(F.col("dst").alias("var"), "location").distinct().join(known, ["var", "location"], "left_anti")
        more = keep(more, "pta-new")
        if more.isEmpty():
            return known
        known = keep(known.unionByName(more), "pta-known")


def aliases(pts: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs a < b with a common location: may; must where both have that one only."""
    size = pts.groupBy("var").agg(F.count("*").alias("n"))
    p = pts.join(size, "var")
    x, y = p.select(F.col("var").alias(a), "location", F.col("n").alias("na")), p.select(F.col("var").alias(b), "location", F.col("n").alias("nb"))
    both = x.join(y, "location").where(F.col(a) < F.col(b))
    return both.groupBy(a, b).agg((F.max("na") + F.max("nb") == 2).alias("must"))


def effects(own: DataFrame, calls: DataFrame) -> DataFrame:
    """fn, effect: own effects (fn, effect) and those of what a function calls (src, dst), to the fixpoint; an unknown callee is UNKNOWN.

    PURE goes where there is another effect.
    """
    fns = own.select("fn").distinct()
    unknown = calls.join(fns.select(F.col("fn").alias("dst")), "dst", "left_anti").select(F.col("src").alias("fn"), F.lit("UNKNOWN").alias("effect"))
    now = keep(own.select("fn", "effect").unionByName(unknown).distinct(), "effects")
    while True:
        more = keep(calls.join(now, calls["dst"] == now["fn"]).select(F.col("src").alias("fn"), "effect").distinct().join(now, ["fn", "effect"], "left_anti"), "effects-new")
        if more.isEmpty():
            break
        now = keep(now.unionByName(more), "effects")
    n = now.groupBy("fn").agg(F.count("*").alias("n"))
    return now.join(n, "fn").where((F.col("effect") != "PURE") | (F.col("n") == 1)).select("fn", "effect")


# Severity ordinals of effects.
EFFECT_SEVERITY = {"PURE": 0, "READ": 1, "LOG": 2, "WRITE": 4, "IO": 5, "NETWORK": 7, "DB_WRITE": 8, "UNKNOWN": 10}


def effect_severity(effect: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in EFFECT_SEVERITY.items() for x in (F.lit(k), F.lit(v))]), effect)


def effect_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """fn, effect, change: added or removed; an added effect of severity 5 or more is breaking."""
    a, b = old.withColumn("o", F.lit(True)), new.withColumn("n", F.lit(True))
    d = a.join(b, ["fn", "effect"], "full").where("o is null or n is null")
    added = F.col("o").isNull()
    return d.select("fn", "effect", F.when(added, "added").otherwise("removed").alias("change"), (added & (effect_severity(F.col("effect")) >= 5)).alias("breaking"))


def tainted(sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, flows: DataFrame, depth: int = 20) -> DataFrame:
    """source, sink, distance of flows that reach a sink without passing a sanitizer (all with column id)."""
    open_ = flows.join(sanitizers.select(F.col("id").alias("dst")), "dst", "left_anti").join(sanitizers.select(F.col("id").alias("src")), "src", "left_anti")
    r = paths.reach(open_.select("src", "dst"), sources, depth)
    return r.join(sinks.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("start").alias("source"), F.col("node").alias("sink"), "distance")


def finding_diff(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New findings (added) and those gone (fixed)."""
    added = new.join(base, key, "left_anti").select(*key).withColumn("change", F.lit("added"))
    return added.unionByName(base.join(new, key, "left_anti").select(*key).withColumn("change", F.lit("fixed")))


def reaching_definitions(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """Each use (fn, name, line, col) with the textually last definition of its name strictly before it: an as-of join by one sort."""
    a = uses.select("fn", "name", "line", "col", F.lit(0).alias("_side"), F.lit(None).cast("int").alias("_line"))
    b = defs.select("fn", "name", "line", "col", F.lit(1).alias("_side"), F.col("line").alias("_line"))
    by = Window.partitionBy("fn", "name").orderBy("line", "col", "_side").rowsBetween(Window.unboundedPreceding, -1)
    return a.unionByName(b).withColumn("def_line", F.last("_line", ignorenulls=True).over(by)).where("_side = 0").select("fn", "name", "line", "col", "def_line")


def innermost(points: DataFrame, spans: DataFrame, slot: int = 64) -> DataFrame:
    """Each point (file, line) with the smallest span (id, file, start, end) that holds it; ties by id, none: null.

    Spans of equal lines are one, by their smallest id, and are put into slots of
    lines, so the interval join is an equi join.
    """
    one = spans.groupBy("file", "start", "end").agg(F.min("id").alias("id"))
    s = one.select("id", "file", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor(F.col("end") / slot))).alias("slot"))
    p = points.select("file", "line").distinct().withColumn("slot", F.floor(F.col("line") / slot))
    hit = p.join(s, ["file", "slot"]).where(F.col("line").between(F.col("start"), F.col("end")))
    best = hit.groupBy("file", "line").agg(F.min_by("id", F.struct((F.col("end") - F.col("start")).alias("size"), "id")).alias("id"))
    return points.join(best, ["file", "line"], "left")


def holding(points: DataFrame, spans: DataFrame) -> DataFrame:
    """file, line, n: each different point with the number of spans (file, start, end) that hold it, also 0.

    A running total over the lines where spans begin and end; a file's task sees
    each of its lines once, however many spans and points lie there.
    """
    s = spans.where(F.col("start") <= F.col("end"))
    turns = s.select("file", F.col("start").cast("long").alias("line"), F.lit(1).alias("d")).unionByName(s.select("file", (F.col("end").cast("long") + 1).alias("line"), F.lit(-1).alias("d")))
    asked = points.select("file", F.col("line").cast("long").alias("line"), F.lit(0).alias("d"), F.lit(True).alias("asked"))
    each = turns.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("file", "line").agg(F.sum("d").alias("d"), F.max("asked").alias("asked"))
    total = F.sum("d").over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("n", total).where("asked").select("file", F.col("line").cast(points.schema["line"].dataType).alias("line"), "n")


def overlapping(spans: DataFrame, slot: int = 64) -> DataFrame:
    """Pairs a < b of spans of one file that share a line.

    Spans of equal lines are one class; classes meet in slots of lines, each pair of
    them in its first common slot only, and their members' pairs are made from lists.
    """
    s = keep(spans.where("file is not null").select("id", "file", "start", "end"), "spans")
    cls = F.struct("file", "start", "end")
    one = s.select("file", "start", "end").distinct().withColumn("cls", cls).withColumn("slot", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor(F.col("end") / slot))))
    x, y = (one.select("file", "slot", F.col("cls").alias(n), F.col("start").alias(f"s{n}"), F.col("end").alias(f"e{n}")) for n in ("x", "y"))
    met = (F.col("x") <= F.col("y")) & (F.col("sx") <= F.col("ey")) & (F.col("sy") <= F.col("ex")) & (F.col("slot") == F.floor(F.greatest("sx", "sy") / slot))
    links = x.join(y, ["file", "slot"]).where(met).select("x", "y", "file")
    return expanded(links, s.select(cls.alias("cls"), "id")).select("file", F.col("i").alias("a"), F.col("j").alias("b"))


def races(accesses: DataFrame) -> DataFrame:
    """var, a, b, severity: two accesses (id, var, write, lock, line) of one variable, one a write, not under the same lock.

    Read-read pairs are never made: writes meet all accesses of their variable.
    """
    w = accesses.where("write").select("var", F.col("id").alias("a"), F.col("lock").alias("la"))
    o = accesses.select("var", F.col("id").alias("b"), F.col("lock").alias("lb"), "write")
    pair = w.join(o, "var").where((F.col("a") != F.col("b")) & ~(F.coalesce(F.col("la") == F.col("lb"), F.lit(False))) & (~F.col("write") | (F.col("a") < F.col("b"))))
    return pair.select("var", "a", "b", F.when(F.col("write"), "critical").otherwise("high").alias("severity"))


def typestate(events: DataFrame, transitions: dict[tuple[str, str], str], start: str, final: set[str]) -> DataFrame:
    """object, state, violations: actions (object, seq, action) folded through a protocol; an action with no transition is a violation and keeps the state."""
    pairs = [x for (s, a), t in transitions.items() for x in (F.lit(f"{s}|{a}"), F.lit(t))]
    table = F.create_map(*pairs)
    one = events.groupBy("object").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "action"))), lambda e: e["action"]).alias("actions"))  # the life of one object

    def step(s, action):
        to = F.try_element_at(table, F.concat(s["state"], F.lit("|"), action))
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["violations"] + to.isNull().cast("int")).alias("violations"))

    out = one.select("object", F.aggregate("actions", F.struct(F.lit(start).alias("state"), F.lit(0).alias("violations")), step).alias("s"))
    return out.select("object", "s.state", "s.violations", (~F.col("s.state").isin(*final)).alias("leaked"))


def merged_states(branches: DataFrame, final: set[str]) -> DataFrame:
    """object, verdict over branch states (object, state): unknown, definite, may_be_leaked or may_be."""
    g = branches.groupBy("object").agg(F.array_sort(F.collect_set("state")).alias("states"))
    done = F.size(F.filter("states", lambda s: s.isin(*final)))
    verdict = F.when(F.size("states") == 0, "unknown").when(F.size("states") == 1, "definite").when((done > 0) & (done < F.size("states")), "may_be_leaked").otherwise("may_be")
    return g.select("object", verdict.alias("verdict"), F.array_join("states", ",").alias("states"))


def resolved_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """module, target, fqn, method: the first of exact name, suffix, relative (leading dots); unresolved otherwise.

    Suffixes meet in an equi join on the last part of the name.
    """
    i = imports.select("module", "target").distinct()
    names = symbols.select("fqn").distinct()
    exact = i.join(names, i["target"] == names["fqn"]).select("module", "target", "fqn", F.lit(1).alias("o"), F.lit("exact").alias("method"))
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    suffix = i.withColumn("k", last("target")).join(names.withColumn("k", last("fqn")), "k").where(F.endswith(F.col("fqn"), F.concat(F.lit("."), F.col("target")))).select("module", "target", "fqn", F.lit(2).alias("o"), F.lit("partial").alias("method"))
    rel = i.where(F.startswith(F.col("target"), F.lit("."))).withColumn("dots", F.length(F.regexp_extract("target", r"^(\.+)", 1)))
    parts = F.split("module", r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - F.col("dots"))), ".")
    full = F.concat_ws(".", F.when(base != "", base), F.regexp_replace("target", r"^\.+", ""))
    rel = rel.withColumn("full", full)
    rel = rel.join(names, rel["full"] == names["fqn"]).select("module", "target", "fqn", F.lit(3).alias("o"), F.lit("relative").alias("method"))
    found = reduce(DataFrame.unionByName, (exact, suffix, rel))
    best = found.groupBy("module", "target").agg(F.min(F.struct("o", "fqn", "method")).alias("b"))
    return i.join(best, ["module", "target"], "left").select("module", "target", "b.fqn", F.coalesce("b.method", F.lit("unresolved")).alias("method"))


def complexity_class(nesting: Column) -> Column:
    """By depth of nested loops: linear, quadratic, cubic, exponential; none: constant."""
    return F.when(nesting == 0, "constant").when(nesting == 1, "linear").when(nesting == 2, "quadratic").when(nesting == 3, "cubic").otherwise("exponential")


def chunk_ids(chunks: DataFrame, repo: str) -> DataFrame:
    """``chunk:repo:kind:fqn``; a repeat gets the first eight characters of its content hash (columns kind, fqn, content_hash, local_seq)."""
    base = F.concat_ws(":", F.lit("chunk"), F.lit(repo), "kind", "fqn")
    rank = F.row_number().over(Window.partitionBy("kind", "fqn").orderBy("local_seq"))
    return chunks.withColumn("chunk_id", F.when(rank == 1, base).otherwise(F.concat_ws(":", base, F.substring("content_hash", 1, 8))))


def repaired(patches: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Patches that compile and pass (columns compiles, passes), by weighted scorers, ties by id."""
    score = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    kept = patches.where("compiles and passes").withColumn("score", score)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def false_positive_score(features: dict[str, Column], weights: dict[str, float], bias: float) -> Column:
    return 1 / (1 + F.exp(-(sum((features[c] * w for c, w in weights.items()), F.lit(bias)))))


def semantic_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """fqn, change, parts of functions (fqn, signature, calls, effects; the last two sorted arrays) that differ; a lost or changed signature, or a new effect, is breaking."""
    both = old.select("fqn", F.struct("signature", "calls", "effects").alias("o")).join(new.select("fqn", F.struct("signature", "calls", "effects").alias("n")), "fqn", "full")
    parts = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), c) for c in ("signature", "calls", "effects")]))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("modified")
    more = F.size(F.array_except(F.coalesce("n.effects", F.array().cast("array<string>")), F.coalesce("o.effects", F.array().cast("array<string>")))) > 0
    out = both.select("fqn", change.alias("change"), F.when(change == "modified", F.array_join(parts, ",")).alias("parts"), more.alias("more"))
    out = out.where("change != 'modified' OR parts != ''")
    return out.select("fqn", "change", "parts", ((F.col("change") == "removed") | ((F.col("change") == "modified") & (F.contains("parts", F.lit("signature")) | F.col("more")))).alias("breaking"))


def taint_query(flows: DataFrame, cwe: str | None = None, severity: str | None = None, confidence: float = 0.0, source: str | None = None, sink: str | None = None) -> DataFrame:
    """Flows (source, sink, cwe, severity, confidence) of a weakness, at least as severe and as sure, source and sink like patterns."""
    order = ("info", "low", "medium", "high", "critical")
    out = flows.where(F.col("confidence") >= confidence)
    if cwe is not None:
        out = out.where(F.col("cwe") == cwe)
    if severity is not None:
        out = out.where(F.col("severity").isin(*order[order.index(severity) :]))
    for name, pattern in (("source", source), ("sink", sink)):
        if pattern is not None:
            out = out.where(F.regexp_like(name, F.lit(pattern)))
    return out


def propagated(start: DataFrame, edges: DataFrame) -> DataFrame:
    """node, value: the least value that reaches a node from the starts (node, value) over edges (src, dst, add), each of which adds to it; to the fixpoint.

    The meet of paths is their minimum; edges do not take from a value.
    """
    e = keep(edges.groupBy("src", "dst").agg(F.min("add").alias("add")), "ide-edges")
    known = keep(start.groupBy("node").agg(F.min("value").alias("value")), "ide-known")
    front = known
    while not front.isEmpty():
        sent = front.join(e, front["node"] == e["src"]).select(F.col("dst").alias("node"), (F.col("value") + F.col("add")).alias("sent")).groupBy("node").agg(F.min("sent").alias("sent"))
        better = sent.join(known, "node", "left").where(F.col("value").isNull() | (F.col("sent") < F.col("value")))
        front = keep(better.select("node", F.col("sent").alias("value")), "ide-front")
        known = keep(known.join(front.select("node"), "node", "left_anti").unionByName(front), "ide-known")
    return known
