"""The query graph: immutable nodes, edges and data nodes with their filters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from types import MappingProxyType


@dataclass(frozen=True)
class Node:
    id: int
    cls: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Edge:
    source: int
    target: int
    predicates: tuple[str, ...] = ()  # none: any
    hops: int = 1


@dataclass(frozen=True)
class Pattern:
    nodes: tuple[Node, ...] = ()
    edges: tuple[Edge, ...] = ()
    data: MappingProxyType = field(default_factory=lambda: MappingProxyType({}))  # node id: {predicate: value}
    pointer: int | None = None

    def fresh(self) -> int:
        return max((n.id for n in self.nodes), default=-1) + 1

    def with_node(self, cls: str | None, alias: str | None, data: dict | None = None) -> Pattern:
        node = Node(self.fresh(), cls, alias)
        filled = dict(self.data) | ({node.id: MappingProxyType(dict(data))} if data is not None else {})
        return replace(self, nodes=(*self.nodes, node), data=MappingProxyType(filled), pointer=node.id)

    def with_edge(self, source: int, target: int, predicates=(), hops: int = 1) -> Pattern:
        if hops < 1:
            raise ValueError("hops must be at least 1")
        return replace(self, edges=(*self.edges, Edge(source, target, tuple(dict.fromkeys(predicates or ())), hops)))

    def with_filter(self, node: int, predicate: str, value: object) -> Pattern:
        own = dict(self.data[node]) | {predicate: value}
        return replace(self, data=MappingProxyType(dict(self.data) | {node: MappingProxyType(own)}))

    def at(self, pointer: int) -> Pattern:
        return replace(self, pointer=pointer)

    def by_alias(self, alias: str) -> int:
        """The node of an alias; of several, the last one."""
        found = [n.id for n in self.nodes if n.alias == alias]
        if not found:
            raise ValueError(f"no node has the alias {alias!r}")
        return found[-1]

    def merged(self, other: Pattern) -> tuple[Pattern, dict[int, int]]:
        """Both patterns side by side, and the new ids of the other's nodes."""
        start = self.fresh()
        ids = {n.id: start + n.id for n in other.nodes}
        taken = {n.alias for n in other.nodes if n.alias}
        own = tuple(replace(n, alias=None) if n.alias in taken else n for n in self.nodes)
        return (
            replace(
                self,
                nodes=(*own, *(replace(n, id=ids[n.id]) for n in other.nodes)),
                edges=(*self.edges, *(replace(e, source=ids[e.source], target=ids[e.target]) for e in other.edges)),
                data=MappingProxyType(dict(self.data) | {ids[k]: v for k, v in other.data.items()}),
            ),
            ids,
        )
