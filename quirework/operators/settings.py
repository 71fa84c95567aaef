"""Header ranges that a user sets for workbook tables, joined to their blocks by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_header_ranges(blocks: DataFrame, updates: DataFrame) -> DataFrame:
    """blocks (doc_id, block_id, first_row, last_row, header_start, header_end, ...) with the updates' header rows.

    updates (doc_id, block_id, header_start, header_end) count where exactly one names the block and its range lies in
    the block's used rows in order; such headers come from `manual`, others stay as `detected`.
    """
    one = updates.groupBy("doc_id", "block_id").agg(F.count("*").alias("_n"), F.first("header_start").alias("_s"), F.first("header_end").alias("_e"))
    rows = blocks.join(one, ["doc_id", "block_id"], "left")
    ok = F.coalesce((F.col("_n") == 1) & (F.col("_s") <= F.col("_e")) & (F.col("_s") >= F.col("first_row")) & (F.col("_e") <= F.col("last_row")), F.lit(False))
    rows = rows.withColumn("header_start", F.when(ok, F.col("_s")).otherwise(F.col("header_start"))).withColumn("header_end", F.when(ok, F.col("_e")).otherwise(F.col("header_end")))
    return rows.withColumn("header_source", F.when(ok, "manual").otherwise("detected")).drop("_n", "_s", "_e")


def rejected_updates(blocks: DataFrame, updates: DataFrame) -> DataFrame:
    """doc_id, block_id, reason of updates that don't count: unknown block, named twice, or out of range."""
    n = updates.groupBy("doc_id", "block_id").agg(F.count("*").alias("_n"), F.min("header_start").alias("_s"), F.max("header_end").alias("_e"))
    rows = n.join(blocks.select("doc_id", "block_id", "first_row", "last_row"), ["doc_id", "block_id"], "left")
    reason = F.when(F.col("first_row").isNull(), "unknown-block").when(F.col("_n") > 1, "duplicate").when((F.col("_s") > F.col("_e")) | (F.col("_s") < F.col("first_row")) | (F.col("_e") > F.col("last_row")), "out-of-range")
    return rows.withColumn("reason", reason).where("reason is not null").select("doc_id", "block_id", "reason")


def _level(span: Column) -> Column:
    """The least power of two above a span: areas of that side meet two of its blocks at most."""
    return F.when(span > 0, F.length(F.bin(span))).otherwise(0).cast("int")


def containing_merge(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Each header cell (doc_id, row, col) with the first merge (merge_no, top, left, bottom, right) of its document that holds it.

    A merge lies in up to four blocks of its own height and width, each rounded up to a power of two; a cell asks the one
    block that holds it of each such size in its document.
    """
    c = F.col
    sides = [c(s).cast("long").alias(s) for s in ("top", "left", "bottom", "right")]
    areas = merges.select("doc_id", F.struct("merge_no", "top", "left").alias("anchor"), *sides).where("bottom >= top and right >= left")
    areas = areas.withColumn("_size", F.struct(_level(c("bottom") - c("top")).alias("h"), _level(c("right") - c("left")).alias("w")))
    sizes = areas.groupBy("doc_id").agg(F.collect_set("_size").alias("_sizes"))
    for block, low, high, level in (("_y", "top", "bottom", "h"), ("_x", "left", "right", "w")):
        ends = F.expr(f"array_distinct(array(shiftright({low}, _size.{level}), shiftright({high}, _size.{level})))")
        areas = areas.withColumn(block, F.explode(ends))
    own = cells.select("doc_id", "row", "col").distinct()
    asked = own.join(sizes.hint("merge"), "doc_id").select("doc_id", "row", "col", F.explode("_sizes").alias("_size"))
    asked = asked.withColumns({"_y": F.expr("shiftright(cast(row as long), _size.h)"), "_x": F.expr("shiftright(cast(col as long), _size.w)")})
    held = asked.join(areas.hint("merge"), ["doc_id", "_size", "_y", "_x"]).where("row between top and bottom and col between left and right")
    first = held.groupBy("doc_id", "row", "col").agg(F.min("anchor").alias("anchor"))
    found = own.join(first.hint("merge"), ["doc_id", "row", "col"], "left")
    return found.select("doc_id", "row", "col", F.coalesce("anchor.top", "row").alias("anchor_row"), F.coalesce("anchor.left", "col").alias("anchor_col"))
