"""The fluent builder: immutable queries that compile lazily."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import local_name
from ..operators.series import EMPTY, cast_values, limited, ranged, wide
from .compiler import Compiler, column
from .ir import Pattern


class Query:
    def __init__(self, engine, pattern: Pattern | None = None):
        self.engine, self.pattern = engine, pattern or Pattern()
        self._bindings: dict[bool, DataFrame] = {}

    def _new(self, pattern: Pattern) -> Query:
        return Query(self.engine, pattern)

    def _class(self, text: str | None) -> str | None:
        return self.engine.resolve(text, "class") if text is not None else None

    def _predicates(self, texts) -> list[str]:
        return [self.engine.resolve(t, "predicate") for t in ([texts] if isinstance(texts, str) else texts or ())]

    def _start(self, alias: str | None) -> int:
        if alias is not None:
            return self.pattern.by_alias(alias)
        if self.pattern.pointer is None:
            raise ValueError("the query has no node to start from")
        return self.pattern.pointer

    # building

    def find_entity(self, _class: str | None = None, alias: str | None = None) -> Query:
        return self._new(self.pattern.with_node(self._class(_class), alias))

    def find_related(self, _class: str | None = None, _from: str | None = None, predicates=None, hops: int = 3, multi_hop_predicates: bool = False, alias: str | None = None) -> Query:
        """A new node within ``hops`` steps; with predicates one step, unless ``multi_hop_predicates``."""
        start, preds = self._start(_from), self._predicates(predicates)
        grown = self.pattern.with_node(self._class(_class), alias)
        return self._new(grown.with_edge(start, grown.pointer, preds, 1 if preds and not multi_hop_predicates else hops))

    def relate_to(self, other: Query, predicates=None, hops: int = 3, _from: str | None = None, _to: str | None = None) -> Query:
        start, end = self._start(_from), other._start(_to)
        both, ids = self.pattern.merged(other.pattern)
        return self._new(both.with_edge(start, ids[end], self._predicates(predicates), hops).at(ids[other.pattern.pointer]))

    def find_data(self, _from: str | None = None, path: str | None = None, _class: str | None = None, filters: dict | None = None, alias: str | None = None) -> Query:
        """Data nodes one step from a node; ``*``: one for each entity."""
        starts = [n.id for n in self.pattern.nodes if n.id not in self.pattern.data] if _from in ("*", "all") else [self._start(_from)]
        if not starts:
            raise ValueError("the query has no node to find data from")
        names = {n.id: n.alias or column(n.id) for n in self.pattern.nodes}
        grown, preds = self.pattern, self._predicates([path] if path else None)
        for i, start in enumerate(starts):
            own = f"{names[start]}_data" if alias is None else alias if i == 0 else f"{alias}_{i}"
            grown = grown.with_node(self._class(_class), own, filters or {})
            grown = grown.with_edge(start, grown.pointer, preds, 1)
        return self._new(grown)

    def find_all_data(self, _class: str | None = None, filters: dict | None = None, alias: str | None = None) -> Query:
        if not self.pattern.nodes:
            return self._new(self.pattern.with_node(self._class(_class), alias or "data", filters or {}))
        return self.find_data("*", None, _class, filters, alias)

    def _data_nodes(self, which: str | None) -> list[int]:
        p = self.pattern
        if not p.data:
            raise ValueError("the query has no data nodes")
        if which in ("*", "all"):
            return list(p.data)
        if which is None:
            return [p.pointer] if p.pointer in p.data else list(p.data)
        node = p.by_alias(which)
        if node in p.data:
            return [node]
        near = [e.target for e in p.edges if e.source == node and e.target in p.data]
        if not near:
            raise ValueError(f"{which!r} has no data nodes")
        return near

    def filter_data_nodes(self, predicate: str, value: object, _from: str | None = None) -> Query:
        grown = self.pattern
        for node in self._data_nodes(_from):
            grown = grown.with_filter(node, predicate, value)
        return self._new(grown)

    def filter_by_unit(self, value: str, _from: str | None = None) -> Query:
        return self.filter_data_nodes(self.engine.vocab.has_unit, self.engine.resolve(value, "unit"), _from)

    def filter_by_medium(self, value: str, _from: str | None = None) -> Query:
        return self.filter_data_nodes(self.engine.vocab.has_medium, value, _from)

    def filter_by_substance(self, value: str, _from: str | None = None) -> Query:
        return self.filter_data_nodes(self.engine.vocab.of_substance, value, _from)

    def filter_by_quantity_kind(self, value: str, _from: str | None = None) -> Query:
        return self.filter_data_nodes(self.engine.vocab.has_quantity_kind, value, _from)

    def filter_by_enumeration_kind(self, value: str, _from: str | None = None) -> Query:
        return self.filter_data_nodes(self.engine.vocab.has_enumeration_kind, value, _from)

    # results

    def execute(self, use_union: bool = False) -> DataFrame:
        if use_union not in self._bindings:
            self._bindings[use_union] = Compiler(self.engine.store.graph(use_union), self.engine.vocab).compile(self.pattern)
        return self._bindings[use_union]

    def metadata(self, use_union: bool = False) -> DataFrame:
        """Bindings with aliases as columns and local names as values."""
        names = {column(n.id): n.alias or column(n.id) for n in self.pattern.nodes}
        return self.execute(use_union).select(*[local_name(F.col(c)).alias(a) for c, a in names.items()])

    def bound_points(self, use_union: bool = False) -> DataFrame:
        """Distinct ``point_uri`` of all data nodes."""
        cols = [column(k) for k in self.pattern.data]
        return self.execute(use_union).select(F.explode(F.array(*cols)).alias("point_uri")).distinct()

    def dataframe(self, start=None, end=None, limit: int | None = None, order: str = "asc", use_union: bool = False, shape: str = "narrow", cast_value: str | None = "str") -> DataFrame:
        """Series of the bound points: ``time, value, id``, or one column for each point."""
        if shape not in ("narrow", "wide") or order not in ("asc", "desc"):
            raise ValueError("shape is narrow or wide, order asc or desc")
        if not self.pattern.data:
            return self.engine.spark.createDataFrame([], EMPTY)
        points = self.bound_points(use_union)
        rows = limited(ranged(self.engine.series.frame(), start, end).join(points, "point_uri"), limit, order)
        rows = cast_values(rows, cast_value)
        uris = sorted(r.point_uri for r in points.collect()) if shape == "wide" else None
        if uris is not None:
            return wide(rows, uris)
        return rows.select(F.col("ts").alias("time"), "value", local_name(F.col("point_uri")).alias("id")).orderBy("time", "id")

    def latest_data(self, limit: int = 1, shape: str = "wide", cast_value: str | None = "str") -> DataFrame:
        return self.dataframe(limit=limit, order="desc", shape=shape, cast_value=cast_value)

    def data_head(self, k: int = 5, **options) -> DataFrame:
        return self.dataframe(**options).limit(k)

    def metadata_head(self, limit: int = 5) -> DataFrame:
        return self.metadata().limit(limit)

    def to_dict(self) -> dict:
        p = self.pattern
        return {"nodes": [{"id": n.id, "class": n.cls, "alias": n.alias} for n in p.nodes], "edges": [{"source": e.source, "target": e.target, "predicates": list(e.predicates), "hops": e.hops} for e in p.edges], "data_nodes": {k: dict(v) for k, v in p.data.items()}, "pointer": p.pointer}

    def show_query_graph(self) -> str:
        names = {n.id: f"{n.alias or column(n.id)}:{n.cls or 'any'}" for n in self.pattern.nodes}
        return "\n".join([*names.values(), *(f"{names[e.source]} -[{'|'.join(e.predicates) or 'any'}*1..{e.hops}]-> {names[e.target]}" for e in self.pattern.edges)])

    def to_sparql(self) -> str:
        """The same pattern as SPARQL text."""
        v, lines = self.engine.vocab, []
        for n in self.pattern.nodes:
            if n.cls is not None:
                lines.append(f"?{column(n.id)} <{v.type}> <{n.cls}> .")
        for k, e in enumerate(self.pattern.edges):
            steps = "|".join(f"<{p}>" for p in e.predicates)
            a, b = column(e.source), column(e.target)
            if steps:
                chains = "|".join("/".join([f"({steps})"] * h) for h in range(1, e.hops + 1))
                lines.append(f"?{a} {chains} ?{b} .")
            else:
                ways = []
                for h in range(1, e.hops + 1):
                    ends = [a, *(f"m{k}_{h}_{i}" for i in range(1, h)), b]
                    ways.append("{ " + " ".join(f"?{x} ?q{k}_{h}_{i} ?{y} ." for i, (x, y) in enumerate(zip(ends, ends[1:], strict=False))) + " }")
                lines.append(" UNION ".join(ways))
        for k, filters in self.pattern.data.items():
            lines.append(f"?{column(k)} <{v.external_reference}> ?ext{k} .")
            for p, x in filters.items():
                if x is not None:
                    obj = f"<{x}>" if "://" in str(x) or str(x).startswith("urn:") else '"' + str(x).replace('"', '\\"') + '"'
                    lines.append(f"?{column(k)} <{p}> {obj} .")
        return "SELECT DISTINCT " + " ".join(f"?{column(n.id)}" for n in self.pattern.nodes) + " WHERE {\n  " + "\n  ".join(lines) + "\n}"
