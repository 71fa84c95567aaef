"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.scratch import discard, written

#: Rounds grow with the logarithm of the longest path; more than these mean an error, never a partial result.
MAX_ROUNDS = 200


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) both ways; each node's neighbours are linked to the least of them and it."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = both.where("a <> b")
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("_m", "_a").alias("m"))
    hung = both.join(least, F.col("a") == F.col("_a"))
    out = hung.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least if not large else least.where("m <> _a")
    return out.union(own.select(F.col("_a").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: stars, one a component."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for all nodes of edges (a, b)."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.where("a <> b").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if _is_done(edges):
            break
        edges, before = written(_star(_star(edges, True), False), "edges"), edges
        discard(before)
    else:
        raise RuntimeError(f"components are not connected after {MAX_ROUNDS} rounds")
    labelled = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labelled.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
