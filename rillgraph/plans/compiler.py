"""From a query graph to a DataFrame of bindings.

Every node becomes a set of candidates (class, reference and filters are semi-joins on the triples), every edge a seeded
k-hop expansion. Nodes are joined along edges, so that each step is an equi-join with what is bound already; a node
without a link to the rest comes last and is the one case of a Cartesian product, which is what the pattern then means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import is_name
from ..operators.hops import reachable, step_edges
from ..vocab import XSD, Vocabulary
from .ir import Pattern


def column(node: int) -> str:
    return f"v{node}"


class Compiler:
    def __init__(self, triples: DataFrame, vocab: Vocabulary):
        self.triples, self.vocab = triples, vocab

    def candidates(self, pattern: Pattern, node) -> DataFrame | None:
        """Column ``v{id}`` with what the node may be by its own clauses; None if it has none."""
        t, name = self.triples, column(node.id)
        sets = []
        if node.cls is not None:
            sets.append(t.where((F.col("p") == self.vocab.type) & (F.col("o") == node.cls) & (F.col("o_kind") != "lit")))
        if node.id in pattern.data:
            sets.append(t.where(F.col("p") == self.vocab.external_reference))
            for predicate, value in pattern.data[node.id].items():
                if value is None:
                    continue
                same = F.col("o_kind") == "iri" if is_name(value) else (F.col("o_kind") == "lit") & (F.col("o_datatype") == XSD + "string")
                sets.append(t.where((F.col("p") == predicate) & (F.col("o") == str(value)) & same))
        if not sets:
            return None
        out = sets[0].select(F.col("s").alias(name)).distinct()
        for more in sets[1:]:
            out = out.join(more.select(F.col("s").alias(name)).distinct(), name, "left_semi")
        return out

    def anything(self, node) -> DataFrame:
        both = self.triples.select(F.col("s").alias(column(node.id))).union(self.triples.select("o"))
        return both.distinct()

    def compile(self, pattern: Pattern) -> DataFrame:
        """Distinct bindings, one string column ``v{id}`` for each node in order."""
        if not pattern.nodes:
            raise ValueError("the query has no nodes")
        own = {n.id: self.candidates(pattern, n) for n in pattern.nodes}
        by_id = {n.id: n for n in pattern.nodes}
        out: DataFrame | None = None
        bound: set[int] = set()
        left = list(pattern.edges)
        while len(bound) < len(by_id) or left:
            # edges with a bound end first, then an unbound part of the pattern
            edge = next((e for e in left if e.source in bound or e.target in bound), None)
            if edge is None:
                linked = [e for e in left if own[e.source] is not None] or left
                start = linked[0].source if linked else next(n.id for n in pattern.nodes if n.id not in bound)
                part = own[start] if own[start] is not None else self.anything(by_id[start])
                out = part if out is None else out.crossJoin(part)  # unlinked parts multiply, by definition
                bound.add(start)
                continue
            left.remove(edge)
            a, b = column(edge.source), column(edge.target)
            target = own[edge.target]
            ends = None if target is None else target.select(F.col(b).alias("dst"))
            if edge.hops == 1:  # the join below keeps to what is bound, so nothing needs to be seeded
                pairs = step_edges(self.triples, list(edge.predicates), literals=target is None)
                pairs = (pairs if ends is None else pairs.join(ends, "dst", "left_semi")).select("src", "dst").toDF(a, b)
            else:
                seeds = own[edge.source]
                if seeds is None:
                    seeds = out.select(a).distinct() if edge.source in bound else self.triples.select(F.col("s").alias(a)).distinct()
                pairs = reachable(self.triples, seeds.select(F.col(a).alias("src")), edge.hops, list(edge.predicates), ends, literals=target is None).toDF(a, b)
            if edge.source in bound and edge.target in bound:
                out = out.join(pairs, [a, b], "left_semi")
            else:
                if edge.source not in bound and own[edge.source] is not None:
                    pairs = pairs.join(own[edge.source], a, "left_semi")
                out = out.join(pairs, a if edge.source in bound else b)
            bound |= {edge.source, edge.target}
        return out.select(*[column(n.id) for n in pattern.nodes]).distinct()
