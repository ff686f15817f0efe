"""Selectors, factories and limits of the query language; every selector is a Column predicate over nodes or edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substrings of names that make a node a source or a sink.
SOURCES = {
    "request": ("input", "request", "get", "post"), "file": ("open", "read", "readline"), "env": ("environ", "getenv", "argv"),
    "socket": ("socket", "recv", "accept"), "database": ("query", "fetchone", "fetchall"),
}
SINKS = {
    "execute": ("eval", "exec", "system", "subprocess"), "sql": ("execute", "query", "executemany"), "file": ("write", "writelines", "dump"),
    "log": ("logger", "print", "log"), "network": ("send", "sendto"),
}
EDGE_SETS = {"dfg": ("DATAFLOW", "READS", "WRITES"), "cfg": ("CFG_NEXT", "CFG_BRANCH", "CFG_LOOP", "CFG_HANDLER"), "call": ("CALLS",)}


@dataclass(frozen=True)
class NodeSelector:
    """``|`` is union, ``&`` intersection; ``>>``, ``<<`` and ``>`` make flows."""

    where: Callable[[], Column]
    text: str = "any"

    def column(self) -> Column:
        return self.where()

    def __or__(self, other: NodeSelector) -> NodeSelector:
        return NodeSelector(lambda: self.column() | other.column(), f"({self.text} | {other.text})")

    def __and__(self, other: NodeSelector) -> NodeSelector:
        return NodeSelector(lambda: self.column() & other.column(), f"({self.text} & {other.text})")

    def __rshift__(self, other: NodeSelector) -> Flow:
        return Flow(self, other)

    def __lshift__(self, other: NodeSelector) -> Flow:
        return Flow(other, self, backward=True)

    def __gt__(self, other: NodeSelector) -> Flow:
        return Flow(self, other, longest=1)


@dataclass(frozen=True)
class EdgeSelector:
    kinds: tuple[str, ...] | None = None
    backward: bool = False
    longest: int = 10

    def column(self, kind: str = "kind") -> Column:
        return F.lit(True) if self.kinds is None else F.col(kind).isin(*self.kinds)

    def __or__(self, other: EdgeSelector) -> EdgeSelector:
        both = None if self.kinds is None or other.kinds is None else tuple(dict.fromkeys(self.kinds + other.kinds))
        return replace(self, kinds=both)

    def reversed(self) -> EdgeSelector:
        return replace(self, backward=not self.backward)

    def depth(self, longest: int) -> EdgeSelector:
        return replace(self, longest=longest)


class Q:
    """Node selector factories; a name is exact, no name means all of the kind."""

    @staticmethod
    def kind(kind: str, name: str | None = None) -> NodeSelector:
        def where() -> Column:
            out = F.lower(F.col("kind")) == kind.lower()
            return out if name is None else out & (F.col("name") == name)

        return NodeSelector(where, f"{kind}({name or ''})")

    @staticmethod
    def by_id(node: str) -> NodeSelector:
        return NodeSelector(lambda: F.col("id") == node, f"id({node})")

    @staticmethod
    def name(name: str, scope: str | None = None) -> NodeSelector:
        return NodeSelector(lambda: (F.col("name") == name) & (F.lit(True) if scope is None else F.col("file_path") == scope), f"name({name})")

    @staticmethod
    def in_file(path: str) -> NodeSelector:
        return NodeSelector(lambda: F.col("file_path") == path, f"file({path})")

    @staticmethod
    def like(pattern: str) -> NodeSelector:
        return NodeSelector(lambda: F.col("id").like(pattern), f"like({pattern})")

    @staticmethod
    def any() -> NodeSelector:
        return NodeSelector(lambda: F.lit(True))

    @staticmethod
    def union(*selectors: NodeSelector) -> NodeSelector:
        return reduce(NodeSelector.__or__, selectors)

    @staticmethod
    def _named(words: tuple[str, ...], text: str) -> NodeSelector:
        return NodeSelector(lambda: reduce(Column.__or__, (F.contains(F.col("name"), F.lit(w)) for w in words), F.lit(False)), text)

    @staticmethod
    def source(category: str = "request") -> NodeSelector:
        """Names that contain a word of the category; an unknown category selects nothing."""
        return Q._named(SOURCES.get(category, ()), f"source({category})")

    @staticmethod
    def sink(category: str = "execute") -> NodeSelector:
        return Q._named(SINKS.get(category, ()), f"sink({category})")


for _k in ("var", "func", "call", "block", "expr", "cls", "module", "field", "template_slot", "alias_of"):
    _names = {"var": "variable", "func": "function", "call": "function", "block": "block", "expr": "expression", "cls": "class", "module": "module", "field": "field", "template_slot": "templateslot", "alias_of": "alias"}
    setattr(Q, _k, staticmethod(lambda name=None, kind=_names[_k]: Q.kind(kind, name)))


class E:
    """Edge selector factories; default depth 10."""

    dfg = EdgeSelector(EDGE_SETS["dfg"])
    cfg = EdgeSelector(EDGE_SETS["cfg"])
    call = EdgeSelector(EDGE_SETS["call"])
    binds = EdgeSelector(("BINDS",))
    renders = EdgeSelector(("RENDERS",))
    escapes = EdgeSelector(("ESCAPES",))
    all = EdgeSelector()

    @staticmethod
    def kinds(*names: str) -> EdgeSelector:
        return EdgeSelector(names)


#: A limit that is none.
UNLIMITED = 2**31 - 1


@dataclass(frozen=True)
class Limits:
    """Bounds of a path search; zeros are rejected.  ``standard`` has the usual ones."""

    max_paths: int = 100
    max_expansions: int = UNLIMITED
    timeout_ms: int = UNLIMITED
    max_length: int | None = None

    def __post_init__(self):
        if min(self.max_paths, self.max_expansions, self.timeout_ms) <= 0:
            raise ValueError("limits are positive")

    @staticmethod
    def standard() -> Limits:
        return Limits(100, 10_000, 30_000)

    @staticmethod
    def unlimited() -> Limits:
        return Limits(UNLIMITED, UNLIMITED, UNLIMITED)


# Presets and budgets of a search.
#: Presets: longest path, paths, expansions.
PRESETS = {"realtime": (3, 10, 100), "pr": (10, 100, 1_000), "full": (20, 1_000, 10_000)}
BUDGETS = {"light": (100, 500, 10, 5, 5), "default": (1_000, 5_000, 100, 10, 30), "heavy": (10_000, 50_000, 500, 20, 120)}


@dataclass(frozen=True)
class Flow:
    """A path expression: refine it, then run it with ``paths.run``."""

    source: NodeSelector
    target: NodeSelector
    backward: bool = False
    edges: EdgeSelector = field(default_factory=EdgeSelector)
    shortest: int = 1
    longest: int = 10
    predicates: tuple[Callable[[Column], Column], ...] = ()
    without: NodeSelector | None = None
    through: NodeSelector | None = None
    inside: NodeSelector | None = None
    limits: Limits = field(default_factory=Limits)

    def via(self, edges: EdgeSelector) -> Flow:
        return replace(self, edges=edges)

    def depth(self, longest: int, shortest: int = 1) -> Flow:
        if not 1 <= shortest <= longest:
            raise ValueError("depths are positive and ordered")
        return replace(self, longest=longest, shortest=shortest)

    def where_path(self, predicate: Callable[[Column], Column]) -> Flow:
        """``predicate`` gets the path (an array of node ids)."""
        return replace(self, predicates=(*self.predicates, predicate))

    def excluding(self, nodes: NodeSelector) -> Flow:
        return replace(self, without=nodes)

    def cleansed_by(self, sanitizer: NodeSelector) -> Flow:
        """Keep only paths that pass through a sanitizer."""
        return replace(self, through=sanitizer)

    def within(self, scope: NodeSelector) -> Flow:
        return replace(self, inside=scope)

    def unlimited(self) -> Flow:
        return replace(self, limits=Limits.unlimited())

    def limit_paths(self, n: int) -> Flow:
        return replace(self, limits=replace(self.limits, max_paths=n))

    def bounded(self, limits: Limits) -> Flow:
        return replace(self, limits=limits)

    def preset(self, name: str) -> Flow:
        longest, paths, expansions = PRESETS[name]
        return replace(self, longest=longest, limits=replace(self.limits, max_paths=paths, max_expansions=expansions))

    def explain(self) -> str:
        arrow = "<<" if self.backward else ">>"
        kinds = "all" if self.edges.kinds is None else "|".join(self.edges.kinds)
        return f"{self.source.text} {arrow} {self.target.text} via {kinds} depth {self.shortest}..{self.longest} limit {self.limits.max_paths}"
