"""Structured blocks (doc_id, block_id, order, kind, depth, ordered, text, heading_path): ordinals, rendering, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import strings as S


def list_ordinals(blocks: DataFrame) -> DataFrame:
    """Add `ordinal` of ordered list items: per depth, started anew by other blocks, shallower or unordered items.

    The counter of a depth is reset by any block that isn't a list item, by an item of a lesser depth, and by an
    unordered item of its own.
    """
    item = F.col("kind") == "list-item"
    depth = F.greatest(F.coalesce("depth", F.lit(0)), F.lit(0))
    rows = blocks.select(F.struct(*blocks.columns).alias("_row"), "doc_id", "order", "block_id", F.when(item, depth).otherwise(-1).alias("_d"), (item & F.coalesce("ordered", F.lit(False))).alias("_on"))
    # Each depth that a document numbers sees the blocks at or above it; those that aren't its own ordered items reset it.
    # A block stands once for itself, and with no more than its place for each deeper one: nothing is joined back.
    levels = F.collect_set(F.when(F.col("_on"), F.col("_d"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("_levels", levels).withColumn("_level", F.explode(F.array_union(F.array("_d"), F.filter("_levels", lambda x: x > F.col("_d")))))
    self = F.col("_level") == F.col("_d")
    own = self & F.col("_on")
    seen = rows.select("doc_id", "order", "block_id", "_level", self.alias("_self"), own.alias("_own"), F.when(self, F.col("_row")).alias("_row"))
    upto = Window.partitionBy("doc_id", "_level").orderBy("order", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    # Own items so far, less those at the last reset: both windows share one sort.
    seen = seen.withColumn("_n", F.count_if("_own").over(upto))
    seen = seen.withColumn("_before", F.coalesce(F.max(F.when(~F.col("_own"), F.col("_n"))).over(upto), F.lit(0)))
    return seen.where("_self").select("_row.*", F.when(F.col("_own"), F.col("_n") - F.col("_before")).alias("ordinal"))


def render_item(text: Column, depth: Column, ordered: Column, ordinal: Column) -> Column:
    lines = F.split(S.normalize_line_ends(F.coalesce(text, F.lit(""))), "\n", -1)
    indent = F.repeat(F.lit("  "), F.greatest(F.coalesce(depth, F.lit(0)), F.lit(0)))
    mark = F.when(F.coalesce(ordered, F.lit(False)), F.concat(F.coalesce(ordinal, F.lit(1)).cast("string"), F.lit(". "))).otherwise("- ")
    return F.array_join(F.transform(lines, lambda x, i: F.when(i == 0, F.concat(indent, mark, F.regexp_replace(x, r"^\s*(?:[-*+•◦]|\d+[.)])\s+", ""))).otherwise(F.concat(indent, F.lit("   "), x))), "\n")


def first_claims(claims: DataFrame) -> DataFrame:
    """Of source ids named by several drafts (doc_id, draft_no, source_id), the first draft's claim."""
    first = Window.partitionBy("doc_id", "source_id").orderBy("draft_no")
    return claims.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def claim_mismatches(expected: DataFrame, consumed: DataFrame) -> DataFrame:
    """doc_id, n: source ids whose expected and consumed counts differ or exceed one."""
    # Counted side by side: no row is joined to another.
    e = expected.select("doc_id", "source_id", F.lit(1).alias("e"), F.lit(0).alias("c"))
    c = consumed.select("doc_id", "source_id", F.lit(0).alias("e"), F.lit(1).alias("c"))
    both = e.unionByName(c).groupBy("doc_id", "source_id").agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
    return both.where("e <> c or e > 1 or c > 1").groupBy("doc_id").agg(F.count("*").alias("n"))
