"""Scores as Column expressions: fusion features, decay, risk, vectors, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def recency_decay(days: Column) -> Column:
    """exp(-days / 90); 1 at no days."""
    return F.exp(-days / 90.0)


def recency_boost(score: Column, days: Column, weight: float) -> Column:
    """Up to ``weight`` more for what changed within 90 days."""
    return F.when(days < 90, score * (1 + (1 - days / 90.0) * weight)).otherwise(score)


def git_boost(intent: Column, days: Column, churn: Column, hotspot: Column) -> Column:
    """What a hit's history adds to its score, by intent."""
    flow = F.when(days <= 7, 0.2).when(days <= 30, 0.2 / (1 + (days - 7) / 10.0)).otherwise(0.0)
    code = F.when(hotspot, -0.1).when(churn < 0.3, 0.05).otherwise(0.0)
    symbol = F.when(hotspot, -0.05).otherwise(0.0)
    concept = F.when(churn < 0.3, 0.1).when(hotspot, -0.05).otherwise(0.0)
    overview = F.when(days <= 90, 0.05).otherwise(0.0)
    return F.when(intent == "flow", flow).when(intent == "code", code).when(intent == "symbol", symbol).when(intent == "concept", concept).when(intent == "overview", overview).otherwise(0.0)


def combined_importance(pagerank: Column, authority: Column, change: Column) -> Column:
    return 0.5 * pagerank + 0.3 * authority + 0.2 * change


def priority(fused: Column, repomap: Column, symbol: Column) -> Column:
    return clamp(0.55 * fused + 0.30 * repomap + 0.15 * symbol)


def correlation_adjusted(score: Column, lexical: Column, vector: Column, symbol: Column, graph: Column) -> Column:
    """Agreement of channels lifts a score, a lone vector hit lowers it."""
    out = score + F.when((lexical >= 0.7) & (symbol >= 0.7), 0.15).otherwise(0.0) + F.when((symbol >= 0.7) & (graph >= 0.7), 0.10).otherwise(0.0)
    out = F.when((vector >= 0.85) & (F.greatest(lexical, symbol) < 0.2), out * 0.6).when((vector >= 0.7) & (lexical < 0.3), out - 0.05).otherwise(out)
    return clamp(out)


def impact_risk(direct: Column, transitive: Column, total: Column) -> Column:
    return F.least(F.lit(1.0), F.least(F.lit(1.0), 10.0 * transitive / total) + F.least(F.lit(0.3), 5.0 * direct / total))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.3, "medium").otherwise("low")


def error_prone(churn: Column, authors: Column, coverage: Column, complexity: Column, days: Column) -> Column:
    """Weighted step functions of churn, authors, coverage, complexity and recency."""
    step = lambda c, *cuts: sum((F.when(c >= cut, 1.0 / len(cuts)).otherwise(0.0) for cut in cuts), F.lit(0.0))
    return 0.30 * step(churn, 0.3, 0.6, 0.9) + 0.20 * step(authors, 2, 4, 6) + 0.25 * (1 - clamp(coverage)) + 0.15 * step(complexity, 5, 10, 20) + 0.10 * F.when(days <= 30, 1.0).when(days <= 90, 0.5).otherwise(0.0)


# Severities as numbers.
SEVERITIES = {"critical": 9.5, "high": 8.0, "medium": 5.5, "low": 2.5, "info": 0.0}


def severity_number(name: Column) -> Column:
    out = F.lit(None).cast("double")
    for n, v in SEVERITIES.items():
        out = F.when(F.lower(name) == n, F.lit(v)).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: for each query vector its best dot product with the document's vectors, summed."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def low_rank(e: Column, a: list[list[float]], b: list[list[float]], scale: float) -> Column:
    """e + scale * (e A) B for constant matrices A (dim x r) and B (r x dim)."""
    rows = F.array(*[F.array(*map(F.lit, column)) for column in zip(*a, strict=True)])
    inner = F.transform(rows, lambda column: dot(e, column))
    outer = F.array(*[F.array(*map(F.lit, column)) for column in zip(*b, strict=True)])
    return F.zip_with(e, F.transform(outer, lambda column: dot(inner, column)), lambda x, d: x.cast("double") + scale * d)


def bucket(experiment: str, key: Column, allocation: dict[str, float]) -> Column:
    """Variant of an A/B experiment: md5 of ``experiment:key`` in ten thousandths against the cumulative allocation."""
    share = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{experiment}:"), key.cast("string"))), 1, 15), 16, 10).cast("long") % 10_000) / 10_000.0
    out, total = F.lit(list(allocation)[-1]), 1.0
    for name in reversed(list(allocation)):
        total -= allocation[name]
        out = F.when(share >= round(total, 9), out).otherwise(out) if name == list(allocation)[-1] else F.when(share < round(total + allocation[name], 9), F.lit(name)).otherwise(out)
    return out


def interval(op: str, a: Column, b: Column) -> Column:
    """Interval arithmetic over structs (lo, hi): intersect, union, add, sub, mul; an empty intersection is null."""
    lo, hi = "lo", "hi"
    if op == "intersect":
        low, high = F.greatest(a[lo], b[lo]), F.least(a[hi], b[hi])
        return F.when(low <= high, F.struct(low.alias(lo), high.alias(hi)))
    if op == "union":
        return F.struct(F.least(a[lo], b[lo]).alias(lo), F.greatest(a[hi], b[hi]).alias(hi))
    if op == "add":
        return F.struct((a[lo] + b[lo]).alias(lo), (a[hi] + b[hi]).alias(hi))
    if op == "sub":
        return F.struct((a[lo] - b[hi]).alias(lo), (a[hi] - b[lo]).alias(hi))
    if op == "mul":
        ends = [a[x] * b[y] for x in (lo, hi) for y in (lo, hi)]
        return F.struct(F.least(*ends).alias(lo), F.greatest(*ends).alias(hi))
    raise ValueError(f"unknown interval operation {op}")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Do two closed spans share a line?"""
    return ~((a_end < b_start) | (b_end < a_start))


def condition_holds(value: Column, op: Column, bound: Column) -> Column:
    """eq, neq, lt, gt, null and not_null checks of a path condition; an unknown operation never holds."""
    return F.coalesce(
        F.when(op == "eq", value == bound).when(op == "neq", value != bound).when(op == "lt", value < bound).when(op == "gt", value > bound).when(op == "null", value.isNull()).when(op == "not_null", value.isNotNull()),
        F.lit(False),
    )
