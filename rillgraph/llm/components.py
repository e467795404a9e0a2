"""Connected components by repeated contraction, with every step a join or an aggregation.

Each round points every node to its smallest neighbour (itself if it is the smallest), follows the pointers to their
ends by doubling, and replaces edges by edges between those ends. A round at least halves the nodes of every component
that still has edges, so there are at most log2(n) rounds. Each step is written to the shared folder, so lineage stays
short, lost executors cost one step, and every join reads two plain tables, whose hot keys adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has an edge to another one; ``component`` is the smallest node reachable.

    Nulls and loops are ignored. No edges: no rows.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    e = saved(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo.alias("a"), hi.alias("b")).distinct(), "edges")
    nodes = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "pointers")
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("end"))
            nxt = saved(up.join(above, "up").select("node", F.col("end").alias("up"), (F.col("end") != F.col("up")).alias("moved")), "pointers")
            moved = not nxt.where("moved").isEmpty()
            up = nxt.select("node", "up")
            if not moved:
                break
        ends = up.select(F.col("node").alias("component"), F.col("up").alias("end"))
        nodes = up.withColumnRenamed("up", "component") if nodes is None else nodes.join(ends, "component", "left").select("node", F.coalesce("end", "component").alias("component"))
        nodes = saved(nodes, "components")
        of_a, of_b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        e = saved(e.join(of_a, "a").join(of_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return nodes if nodes is not None else e.select(F.col("a").alias("node"), F.col("b").alias("component"))
