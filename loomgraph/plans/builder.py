"""The fluent node and edge queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_value(name: str) -> Column:
    """A node's field as text: name, kind, file_path, else the whole metadata; null is empty."""
    return F.coalesce(F.col(name if name in ("name", "kind", "file_path") else "metadata").cast("string"), F.lit(""))


@dataclass(frozen=True)
class NodeQuery:
    """Filters are ANDed, the last kind counts.  Aggregates ignore order, limit and offset."""

    nodes: DataFrame
    kind: str | None = None
    predicates: tuple[Column, ...] = ()
    order: tuple[str, bool] | None = None
    n: int | None = None
    skip: int = 0

    def filter(self, kind: str) -> NodeQuery:
        return replace(self, kind=kind)

    def where_field(self, name: str, value: str) -> NodeQuery:
        return self.where(field_value(name) == value)

    def where(self, predicate: Column | Callable[[], Column]) -> NodeQuery:
        return replace(self, predicates=(*self.predicates, predicate() if callable(predicate) else predicate))

    def order_by(self, name: str, descending: bool = False) -> NodeQuery:
        return replace(self, order=(name, descending))

    def limit(self, n: int) -> NodeQuery:
        return replace(self, n=n)

    def offset(self, n: int) -> NodeQuery:
        return replace(self, skip=n)

    def filtered(self) -> DataFrame:
        out = self.nodes if self.kind is None else self.nodes.where(F.col("kind") == self.kind)
        for p in self.predicates:
            out = out.where(p)
        return out

    def execute(self) -> DataFrame:
        """Sorted (ties by id), then offset, then limit."""
        out = self.filtered()
        if self.order or self.n is not None or self.skip:
            keys = []
            if self.order:
                key = F.col(self.order[0]) if self.order[0] == "value" else field_value(self.order[0])
                keys.append(key.desc_nulls_last() if self.order[1] else key.asc_nulls_first())
            out = out.orderBy(*keys, "id")
            if self.skip:
                out = out.offset(self.skip)
            if self.n is not None:
                out = out.limit(self.n)
        return out

    def aggregate(self, column: str = "metadata") -> DataFrame:
        """count of nodes; avg, sum, min and max of the column's values that are numbers (null if none)."""
        number = F.expr(f"try_cast({column} as double)")
        return self.filtered().agg(F.count("*").alias("count"), F.avg(number).alias("avg"), F.sum(number).alias("sum"), F.min(number).alias("min"), F.max(number).alias("max"))

    def stream(self, size: int) -> Iterator[list]:
        """Batches of ``size`` rows of the filtered nodes, pulled partition by partition; ignores order and limit."""
        if size < 1:
            raise ValueError("a batch has at least one row")
        batch: list = []
        for row in self.filtered().toLocalIterator():
            batch.append(row)
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch

    def for_each_batch(self, size: int, f: Callable[[list], None]) -> int:
        n = 0
        for batch in self.stream(size):
            f(batch)
            n += 1
        return n

    def take(self, n: int) -> DataFrame:
        return self.filtered().orderBy("id").limit(n)


#: Kinds that an edge query's kind stands for.
_EDGE_KINDS = {"CALLS": ("CALLS", "INVOKES")}


@dataclass(frozen=True)
class EdgeQuery:
    edges: DataFrame
    predicates: tuple[Column, ...] = ()

    def filter(self, kind: str) -> EdgeQuery:
        """CALLS also means INVOKES; ALL matches everything."""
        if kind == "ALL":
            return self
        return replace(self, predicates=(*self.predicates, F.col("kind").isin(*_EDGE_KINDS.get(kind, (kind,)))))

    def where_field(self, name: str, value: str) -> EdgeQuery:
        """source_id, target_id or kind; any other field is an empty text."""
        column = {"source_id": "src", "target_id": "dst", "kind": "kind"}.get(name)
        return replace(self, predicates=(*self.predicates, (F.col(column) if column else F.lit("")) == value))

    def callers_of(self, node: str) -> EdgeQuery:
        return self.filter("CALLS").where_field("target_id", node)

    def callees_of(self, node: str) -> EdgeQuery:
        return self.filter("CALLS").where_field("source_id", node)

    def references_to(self, node: str) -> EdgeQuery:
        return self.filter("REFERENCES").where_field("target_id", node)

    def dataflow_from(self, node: str) -> EdgeQuery:
        return self.filter("DATAFLOW").where_field("source_id", node)

    def dataflow_to(self, node: str) -> EdgeQuery:
        return self.filter("DATAFLOW").where_field("target_id", node)

    def execute(self) -> DataFrame:
        out = self.edges
        for p in self.predicates:
            out = out.where(p)
        return out
