"""Plans as values, their cache and execution; stages as a graph; named plug-ins."""

from __future__ import annotations

import base64
import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import paths
from .selectors import BUDGETS, E, EdgeSelector, Flow, Q

#: Plans that become a flow, with the edges they follow.
KINDS: dict[str, EdgeSelector] = {"slice": EdgeSelector(("CALLS", "CONTAINS", "DATAFLOW")), "dataflow": E.dfg, "taint_proof": E.dfg, "call_chain": E.call, "data_dependency": E.dfg}


@dataclass(frozen=True)
class QueryPlan:
    """What to ask: a kind, node ids at both ends, a depth and a budget name."""

    kind: str
    sources: tuple[str, ...]
    targets: tuple[str, ...] = ()
    depth: int = 5
    budget: str = "default"

    def validate(self) -> None:
        if self.kind not in KINDS:
            raise NotImplementedError(f"plans of kind {self.kind} are not translated")
        if not self.sources or self.depth < 1 or self.budget not in BUDGETS:
            raise ValueError("a plan has sources, a positive depth and a known budget")

    def digest(self) -> str:
        """The first 16 hex digits of the SHA-256 of its JSON with sorted keys."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    def flow(self) -> Flow:
        self.validate()
        ends = Q.union(*map(Q.by_id, self.targets)) if self.targets else Q.any()
        _, _, most, _, _ = BUDGETS[self.budget]
        return (Q.union(*map(Q.by_id, self.sources)) >> ends).via(KINDS[self.kind]).depth(self.depth).limit_paths(most)

    def explain(self) -> str:
        return self.flow().explain()


class Cache:
    """Least recently used results under a key, with a time to live; counts hits."""

    def __init__(self, size: int = 128, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.rows: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str) -> Any:
        found = self.rows.get(key)
        if found and self.clock() - found[0] <= self.ttl:
            self.rows.move_to_end(key)
            self.hits += 1
            return found[1]
        self.rows.pop(key, None)
        self.misses += 1
        return None

    def put(self, key: str, value: Any) -> None:
        self.rows[key] = (self.clock(), value)
        self.rows.move_to_end(key)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)


class PlanExecutor:
    """validate, look up, translate, execute.  A cached result is a DataFrame: Catalyst's plan, not its rows."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, snapshot: str = "head", cache: Cache | None = None):
        self.nodes, self.edges, self.snapshot, self.cache = nodes, edges, snapshot, cache or Cache()

    def execute(self, plan: QueryPlan) -> DataFrame:
        plan.validate()
        key = f"{self.snapshot}:{plan.digest()}"
        found = self.cache.get(key)
        if found is None:
            found = paths.run(plan.flow(), self.nodes, self.edges)
            self.cache.put(key, found)
        return found

    def execute_all(self, plans: list[QueryPlan]) -> dict[str, DataFrame | str]:
        """Results by digest; a plan that fails is its error, the others still run."""
        out: dict[str, DataFrame | str] = {}
        for p in plans:
            try:
                out[p.digest()] = self.execute(p)
            except (ValueError, NotImplementedError) as e:
                out[p.digest()] = f"{type(e).__name__}: {e}"
        return out


@dataclass
class Stages:
    """Stages with dependencies, run in topological order, each a function from the results so far."""

    steps: dict[str, tuple[tuple[str, ...], Callable[[dict[str, Any]], Any]]] = field(default_factory=dict)

    def add(self, name: str, run: Callable[[dict[str, Any]], Any], after: tuple[str, ...] = ()) -> Stages:
        self.steps[name] = (after, run)
        return self

    def order(self) -> list[list[str]]:
        """Levels of stages that may run together; a cycle or an unknown stage is an error."""
        left, done, out = dict(self.steps), set(), []
        while left:
            ready = sorted(n for n, (after, _) in left.items() if set(after) <= done)
            if not ready:
                raise ValueError(f"stages that wait for each other or for unknown ones: {sorted(left)}")
            out.append(ready)
            done |= set(ready)
            for n in ready:
                del left[n]
        return out

    def run(self, done: dict[str, Any] | None = None) -> dict[str, Any]:
        """``done`` has results of stages that need not run again."""
        results = dict(done or {})
        for level in self.order():
            for name in level:
                if name not in results:
                    results[name] = self.steps[name][1](results)
        return results


class Registry:
    """Named plug-ins: retrievers, scorers, analyses, index plug-ins, stages."""

    def __init__(self):
        self.items: dict[str, Callable[..., Any]] = {}

    def register(self, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def add(f):
            if name in self.items:
                raise ValueError(f"{name} is taken")
            self.items[name] = f
            return f

        return add

    def __call__(self, name: str, *args: Any, **options: Any) -> Any:
        if name not in self.items:
            raise KeyError(f"no plug-in is called {name}; there are {sorted(self.items)}")
        return self.items[name](*args, **options)


def cursor(position: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"offset": position}).encode()).decode()


def page(df: DataFrame, order: list[str], size: int, at: str | None = None) -> tuple[DataFrame, str | None]:
    """Rows of one page and the cursor of the next, null at the end."""
    start = json.loads(base64.urlsafe_b64decode(at))["offset"] if at else 0
    ordered = df.orderBy(*order).offset(start)
    more = len(ordered.limit(size + 1).select(F.lit(1)).collect()) > size  # at most a page
    return ordered.limit(size), cursor(start + size) if more else None


def clamp_limit(n: int | None, default: int = 50, most: int = 1000) -> int:
    return default if n is None or n < 1 else min(n, most)


def escalated(query: str, strategies: list[tuple[str, Callable[[str], DataFrame]]], least: float) -> tuple[str, DataFrame]:
    """The first strategy whose best score (column score) reaches ``least``, else the last one's result."""
    name, result = "", None
    for name, run in strategies:
        result = run(query)
        best = result.agg(F.max("score")).first()[0]
        if best is not None and best >= least:
            break
    return name, result


def tuned(candidates: list[dict[str, float]], validator: Callable[[dict[str, float]], bool], score: Callable[[dict[str, float]], float]) -> tuple[dict[str, float], float] | None:
    """The valid candidate with the best score; a candidate whose scoring fails is skipped."""
    best = None
    for c in candidates:
        if validator(c):
            try:
                s = score(c)
            except (ValueError, ArithmeticError):
                continue
            if best is None or s > best[1]:
                best = (c, s)
    return best
