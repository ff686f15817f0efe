"""Rule matching: atoms with wildcards over entities, by candidate tiers and predicate chains.

The theta join "pattern matches text" is split by the shape of the pattern:
exact patterns meet entities in an equi join, prefixes and suffixes in an equi
join on as many characters, and the rest by a trigram that every match has.
Candidates are then verified by the whole pattern, so no tier changes results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pattern_class, wildcard_match
from ..storage import keep
from .pairs import expanded

#: Parts that the entities of one character, or all of them, are dealt to.
SALTS = 64


def tier(type_pattern: Column, call_pattern: Column) -> Column:
    """1: two exact keys; 2: one exact key, or one wildcard beside it, or a lone simple prefix or suffix; else 3."""
    present = [F.coalesce(F.length(p) > 0, F.lit(False)) for p in (type_pattern, call_pattern)]
    wild = [present[i] & F.contains(p, F.lit("*")) for i, p in enumerate((type_pattern, call_pattern))]
    exact = sum(((present[i] & ~wild[i]).cast("int") for i in range(2)), F.lit(0))
    wilds = sum((w.cast("int") for w in wild), F.lit(0))
    lone = F.when(wild[0], type_pattern).otherwise(call_pattern)
    simple = pattern_class(lone).isin("prefix", "suffix")
    return F.when((wilds == 0) & (exact >= 2), 1).when((wilds == 0) & (exact == 1), 2).when((wilds == 1) & (exact >= 1), 2).when((wilds == 1) & simple, 2).otherwise(3)


def matches(rules: DataFrame, entities: DataFrame, text: str = "text", by: str | None = None) -> DataFrame:
    """All (rule_id, entity id) whose ``pattern`` matches ``text``, case-insensitively; empty sides never match.

    With ``by``, only rules and entities that agree in that column meet.  Entities
    are cut into keys, which no estimate of their size foresees, so these joins
    sort both sides; a broadcast of them would go through the driver.
    """
    own = [] if by is None else [by]
    same = [] if by is None else [F.col(f"p.{by}") == F.col(f"e.{by}")]
    p = rules.select("rule_id", "pattern", *own, F.lower("pattern").alias("low"), pattern_class(F.col("pattern")).alias("class"))
    p = p.withColumn("body", F.replace("low", F.lit("*"), F.lit(""))).where(F.length("pattern") > 0)
    e = entities.select("id", *own, F.col(text).alias("text"), F.lower(text).alias("low_text")).where(F.length(text) > 0)

    def met(x: DataFrame, y: DataFrame, *on: Column) -> DataFrame:
        return x.alias("p").hint("merge").join(y.alias("e"), reduce(Column.__and__, [*on, *same])).select("rule_id", "pattern", "id", "text")

    exact = met(p.where("class = 'exact'"), e, F.col("low") == F.col("low_text"))

    def by_edge(kind: str, cut):
        side = p.where(F.col("class") == kind).withColumn("n", F.length("body"))
        lengths = side.select(F.col("n").alias("m")).distinct()  # few: lengths of patterns
        keyed = e.join(F.broadcast(lengths), F.length("low_text") >= F.col("m")).withColumn("key", cut(F.col("low_text"), F.col("m")))
        return met(side, keyed, F.col("body") == F.col("key"), F.col("n") == F.col("m"))

    prefix = by_edge("prefix", lambda t, n: F.substring(t, F.lit(1), n))
    suffix = by_edge("suffix", lambda t, n: F.right(t, n))

    rest = p.where("class in ('contains', 'complex')")
    literal = F.filter(F.split("low", "\\*"), lambda x: F.length(x) >= 3)
    longest = F.array_max(F.transform(literal, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    keyed = rest.withColumn("gram", F.substring(longest, 1, 3))
    grams = e.withColumn("g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("low_text") - 2)), lambda i: F.substring("low_text", i, F.lit(3))))))
    gram = met(keyed.where("gram is not null"), grams, F.col("gram") == F.col("g")).where(wildcard_match(F.col("pattern"), F.col("text")))
    # without three literal characters in a row the first literal character is the key, none meets all
    tiny = keyed.where("gram is null").withColumn("first", F.substring("body", 1, 1)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    firsts = tiny.select(F.col("first").alias("c")).distinct()  # single characters
    chars = e.withColumn("c", F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.split("low_text", ""))))).join(F.broadcast(firsts), "c", "left_semi").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    small = met(tiny, chars, F.col("first") == F.col("c"), F.col("salt") == F.col("part")).where(wildcard_match(F.col("pattern"), F.col("text")))
    return reduce(DataFrame.unionByName, [x.select("rule_id", "id") for x in (exact, prefix, suffix, gram, small)])


# --- predicates: each gives (passed, confidence change) ---------------------


def verdict(passed: Column, delta: Column | float = 0.0) -> Column:
    ok = F.coalesce(passed, F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, delta if isinstance(delta, Column) else F.lit(float(delta))).otherwise(0.0).alias("delta"))


def is_const(arg: Column) -> Column:
    return verdict(F.regexp_like(arg, F.lit(r"^(\d+(\.\d+)?|'.*'|\".*\"|True|False|None)$")))


def is_not_const(arg: Column) -> Column:
    return verdict(arg.isNotNull() & ~is_const(arg)["ok"], 0.1)


def is_string_like(arg: Column) -> Column:
    return verdict(F.regexp_like(arg, F.lit(r"^[rbf]?['\"]")))


def is_int_like(arg: Column) -> Column:
    return verdict(F.regexp_like(arg, F.lit(r"^-?\d+$")))


def matches_regex(arg: Column, regex: str) -> Column:
    """Search, not full match; a broken expression fails."""
    import re

    try:
        re.compile(regex)
    except re.error:
        return verdict(F.lit(False))
    return verdict(F.regexp_like(arg, F.lit(regex)))


def length_bound(arg: Column, low: int, high: int) -> Column:
    return verdict(F.length(arg).between(low, high))


# Keyword arguments that raise confidence.
_RISKY = {("shell", "True"): 0.2, ("check_hostname", "False"): 0.15, ("verify", "False"): 0.15}


def kwarg(kwargs: Column, name: str, value: str) -> Column:
    """The keyword argument has the value; a missing one fails."""
    return verdict(F.try_element_at(kwargs, F.lit(name)) == value, _RISKY.get((name, value), 0.0))


def guard(guards: Column, kind: str, pattern: str) -> Column:
    """The first guard (kind, pattern, effect, multiplier) of the kind whose pattern contains ``pattern``: block fails, reduce lowers confidence."""
    found = F.try_element_at(F.filter(guards, lambda g: (g["kind"] == kind) & F.contains(g["pattern"], F.lit(pattern))), F.lit(1))
    ok = found.isNull() | (found["effect"] != "block")
    return F.struct(F.coalesce(ok, F.lit(True)).alias("ok"), F.when(found["effect"] == "reduce", -(1 - found["multiplier"])).otherwise(0.0).alias("delta"))


def chain(*verdicts: Column) -> Column:
    """AND of the parts in order; deltas count up to the first that fails."""
    ok, delta = F.lit(True), F.lit(0.0)
    for v in verdicts:
        delta = delta + F.when(ok, v["delta"]).otherwise(0.0)
        ok = ok & v["ok"]
    return F.struct(ok.alias("ok"), F.round(delta, 6).alias("delta"))


def call_startswith(call: Column, prefix: str) -> Column:
    return F.coalesce(call.startswith(prefix), F.lit(False))


def type_endswith(type_: Column, suffix: str) -> Column:
    return F.coalesce(type_.endswith(suffix), F.lit(False))


def has_arg_index(args: Column, i: int) -> Column:
    return F.size(args) > i


def confidence(base: Column, adjustments: list[tuple[str, float]]) -> Column:
    """add, mul and set in order, then clamped to 0..1."""
    out = base
    for op, x in adjustments:
        out = out + x if op == "add" else out * x if op == "mul" else F.lit(x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def shadowing(rules: DataFrame) -> DataFrame:
    """family, wide, narrow: rules of a family whose pattern another subsumes.

    Rules of equal patterns are one class.  A class meets what it subsumes once:
    its own rules, all others of the family if it is ``*``, else the literals that
    its wildcards match; pairs of rules are made from lists at the end.
    """
    r = keep(rules.where("family is not null").select("family", F.col("rule_id").alias("id"), "pattern"), "rules")
    cls = F.struct("family", "pattern").alias("cls")
    wide = r.where("pattern is not null").select(cls, "id")
    star = r.where("contains(pattern, '*') and pattern != '*'").select(F.struct("family", "pattern").alias("rule_id"), "family", "pattern").distinct()
    hit = matches(star, r.where("not contains(pattern, '*')").withColumnRenamed("pattern", "text"), by="family").withColumnRenamed("rule_id", "cls")
    all_ = r.where("pattern is null or pattern != '*'").join(r.where("pattern = '*'").select("family").distinct(), "family", "left_semi")
    rest = hit.select("cls", "id").unionByName(all_.select(F.struct("family", F.lit("*").alias("pattern")).alias("cls"), "id"))
    narrow = wide.unionByName(rest)
    links = wide.select("cls").distinct().select(F.col("cls").alias("x"), F.col("cls").alias("y"), F.col("cls.family").alias("family"))
    return expanded(links, wide, narrow).select("family", F.col("i").alias("wide"), F.col("j").alias("narrow"))


def arbitrated(claims: DataFrame) -> DataFrame:
    """claims (id, type, severity, basis) with ``suppressed``: weaker than the best basis of the same type and severity."""
    order = F.when(F.col("basis") == "PROVEN", 0).when(F.col("basis") == "INFERRED", 1).when(F.col("basis") == "HEURISTIC", 2).otherwise(3)
    ranked = claims.withColumn("_o", order)
    best = ranked.groupBy("type", "severity").agg(F.min("_o").alias("_best"))
    return ranked.join(best, ["type", "severity"]).withColumn("suppressed", F.col("_o") > F.col("_best")).drop("_o", "_best")


def ignored(path: Column, rule: Column, paths: list[str], rules: list[str]) -> Column:
    """Is a finding switched off by path glob or rule id?"""
    from ..functions.text import glob_regex

    by_path = reduce(Column.__or__, (F.regexp_like(path, F.lit(glob_regex(p))) for p in paths), F.lit(False))
    return by_path | rule.isin(*rules)


def policy_flows(findings: DataFrame, sources: list[str], sinks: list[str]) -> DataFrame:
    """Findings whose source and sink tags a policy names, unless a block condition (column blocked) holds."""
    return findings.where(F.col("source_tag").isin(*sources) & F.col("sink_tag").isin(*sinks) & ~F.coalesce(F.col("blocked"), F.lit(False)))


def rule_telemetry(matches_: DataFrame) -> DataFrame:
    """rule_id, matches, mean and highest latency, rate of false positives."""
    return matches_.groupBy("rule_id").agg(F.count("*").alias("matches"), F.avg("latency").alias("mean"), F.max("latency").alias("highest"), F.avg(F.col("false_positive").cast("int")).alias("fp_rate"))
