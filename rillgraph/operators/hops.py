"""Bounded reachability: pairs joined by a walk of 1 to k directed steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """All pairs ``src, dst`` joined by a walk of any length of at least 1, from the seeds (column ``src``) if given.

    Semi-naive rounds until nothing is new; each is checkpointed, so the plan stays short and lost executors cost a round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    onward = edges.select(F.col("src").alias("via"), F.col("dst").alias("next"))
    newest = edges if seeds is None else edges.join(seeds.select("src").distinct(), "src", "left_semi")
    found = newest = newest.distinct().checkpoint()
    while not newest.isEmpty():
        stepped = newest.join(onward, newest.dst == onward.via).select("src", F.col("next").alias("dst")).distinct()
        newest = stepped.join(found, ["src", "dst"], "left_anti").checkpoint()
        found = found.unionByName(newest)
    return found


def step_edges(triples: DataFrame, predicates: list[str] | None = None, literals: bool = False) -> DataFrame:
    """Distinct ``src, dst``; with ``literals`` they count as ends too (a typed target is never one)."""
    rows = triples if not predicates else triples.where(F.col("p").isin(*dict.fromkeys(predicates)))
    rows = rows if literals else rows.where("o_kind <> 'lit'")
    return rows.select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


def reachable(triples: DataFrame, seeds: DataFrame, hops: int, predicates: list[str] | None = None, targets: DataFrame | None = None, literals: bool = False) -> DataFrame:
    """Distinct ``src, dst`` for seeds (column ``src``).

    The plan is unrolled: each step joins the pairs of the one before with the edges, and the pairs of all steps are made
    distinct once, at the end. So a step's plan holds that of the one before and no more, and scans grow with the square
    of the hops at most, most of them shared exchanges. Seeding first and the semi-join with targets keep the frontier to
    what the pattern can use; hub nodes are expanded once per source and step.
    """
    if hops < 1:
        raise ValueError("hops must be at least 1")
    edges = step_edges(triples, predicates, literals)
    onward = edges.select(F.col("src").alias("via"), F.col("dst").alias("next"))  # literals are never subjects, so walks end there
    found = newest = edges.join(seeds.select("src").distinct(), "src", "left_semi")
    for _ in range(2, hops + 1):
        newest = newest.join(onward, newest.dst == onward.via).select("src", F.col("next").alias("dst")).distinct()
        found = found.unionByName(newest)
    found = found if targets is None else found.join(targets.select(F.col("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return found if hops == 1 else found.distinct()
