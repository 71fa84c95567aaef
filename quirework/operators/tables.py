"""Tables as rows: regions, headers, greedy packing under a repeated header, and fragments of long rows.

A row table has (doc_id, table_no, row_no, cells). A table's regions lie between empty rows; the first row of each is
its header, which is repeated in every draft.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import strings as S
from quirework.operators.split import greedy_groups, split_text

TABLE = ["doc_id", "table_no"]


def is_empty_row(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: ~S.is_blank(F.coalesce(c, F.lit(""))))


def markdown_rows(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows of the tables marked in a line table, with kept columns; the separator line is no row."""
    rows = lines.where(F.col("table_no").isNotNull() & (F.col("pos") != F.col("table_no") + 1))
    return rows.select(*TABLE, *(keep or []), F.when(F.col("pos") == F.col("table_no"), 0).otherwise(F.col("pos") - F.col("table_no") - 1).alias("row_no"), S.row_cells(F.col("line")).alias("cells"))


def line_numbers(table_no: Column, row_nos: Column) -> Column:
    """The text lines of a Markdown table's rows (see markdown_rows); its separator line is none of them."""
    return F.transform(row_nos, lambda r: F.when(r == 0, table_no.cast("int")).otherwise((table_no + r + 1).cast("int")))


def regions(rows: DataFrame) -> DataFrame:
    """Filled rows with region (from 1) and their place in it (from 0)."""
    upto = Window.partitionBy(*TABLE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_empty", is_empty_row(F.col("cells"))).withColumn("_cut", F.sum(F.col("_empty").cast("int")).over(upto))
    rows = rows.where("not _empty")
    rows = rows.withColumn("region", F.dense_rank().over(Window.partitionBy(*TABLE).orderBy("_cut")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*TABLE, "region").orderBy("row_no")) - 1).drop("_empty", "_cut")


def table_issues(rows: DataFrame) -> DataFrame:
    """doc_id, table_no, code, n, locations: several tables in one, and rows of another width than their header."""
    found = regions(rows)
    many = found.groupBy(*TABLE).agg(F.max("region").cast("long").alias("n")).where("n > 1").select(*TABLE, F.lit("MULTIPLE_TABLES").alias("code"), "n", F.lit(None).cast("array<string>").alias("locations"))
    width = F.first(F.size("cells")).over(Window.partitionBy(*TABLE, "region").orderBy("place"))
    odd = found.withColumn("_w", width).where((F.size("cells") != F.col("_w")) & (F.col("place") > 0))
    odd = odd.groupBy(*TABLE).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("row_no")), lambda r: F.concat(F.lit("row "), (r + 1).cast("string"))).alias("locations"))
    return many.unionByName(odd.select(*TABLE, F.lit("IRREGULAR_COLUMNS").alias("code"), "n", "locations"))


def table_drafts(rows: DataFrame, context_length: DataFrame, limit: int = S.CHUNK_LIMIT) -> DataFrame:
    """doc_id, table_no, region, part, body, blocked, row_nos of row tables; context_length (doc_id, table_no, context_length).

    Rows that fit are packed greedily. A longer row becomes fragments under the header and the row's first filled
    cell. A table whose frame leaves no space is one blocked draft without body. row_nos names the rows that a draft is
    the first to hold: a region's header in its first draft, a row in its own or in its first fragment's.
    """
    return packed_drafts(framed_rows(rows.join(context_length, TABLE), limit), limit)


def framed_rows(rows: DataFrame, limit: int = S.CHUNK_LIMIT) -> DataFrame:
    """Rows (doc_id, table_no, row_no, cells, context_length, ...) with what their region's frame is and leaves: the input of packed_drafts."""
    found = regions(rows)
    region = Window.partitionBy(*TABLE, "region").orderBy("place")
    found = found.withColumn("header", F.first("cells").over(region)).withColumn("head_no", F.first("row_no").over(region))
    found = found.withColumn("start", S.render_table_start(F.col("header")))
    found = found.withColumn("room", F.lit(limit) - F.col("context_length") - S.u16_length(F.col("start")))
    has_rows = F.max("place").over(Window.partitionBy(*TABLE, "region")) > 0
    found = found.withColumn("_bad", (F.col("room") < 0) | (has_rows & (F.col("room") < 2))).withColumn("blocked", F.max("_bad").over(Window.partitionBy(*TABLE)))
    found = found.withColumn("row", S.render_row(F.col("cells"))).withColumn("_n", S.u16_length(F.col("row")) + 1)
    return found.withColumn("_single", ~has_rows)


def packed_drafts(alone: DataFrame, limit: int = S.CHUNK_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """table_drafts of framed_rows, with kept columns of their tables. Rows of each kind are read apart: store many of them first."""
    keys = [*TABLE, *(keep or [])]
    region = Window.partitionBy(*TABLE, "region").orderBy("place")
    heads = alone.where("_single and not blocked").select(*keys, "region", F.lit(0).alias("place"), F.lit(0).alias("part"), F.col("start").alias("body"), "head_no", F.array().cast("array<int>").alias("row_nos"))
    data = alone.where("place > 0 and not blocked")
    # Runs of rows that fit, between rows that don't.
    run = F.sum(F.when(F.col("_n") > F.col("room"), 1).otherwise(0)).over(region.rowsBetween(Window.unboundedPreceding, 0))
    short = data.withColumn("_run", run).where("_n <= room")
    packed = short.groupBy(*keys, "region", "_run", "start", "room", "head_no").agg(F.array_sort(F.collect_list(F.struct("place", "row", "_n", F.col("row_no").cast("int").alias("row_no")))).alias("r"))
    packed = packed.withColumn("g", greedy_groups(F.transform("r", lambda x: x["_n"]), F.col("room")))
    packed = packed.select(*keys, "region", "_run", "start", "head_no", F.explode(F.arrays_zip("r", "g")).alias("x"))
    packed = packed.groupBy(*keys, "region", "_run", "start", "head_no", F.col("x.g").alias("g")).agg(F.min("x.r.place").alias("place"), F.array_sort(F.collect_list("x.r")).alias("r"))
    packed = packed.select(*keys, "region", "place", F.lit(0).alias("part"), F.concat("start", F.lit("\n"), F.array_join(F.transform("r", lambda x: x["row"]), "\n")).alias("body"), "head_no", F.transform("r", lambda x: x["row_no"]).alias("row_nos"))
    drafts = heads.unionByName(packed).unionByName(_fragments(data.where("_n > room"), limit, keys))
    framed = alone.where("blocked").select(*keys).distinct().select(*keys, F.lit(0).alias("region"), F.lit(0).alias("place"), F.lit(0).alias("part"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("int").alias("head_no"), F.array().cast("array<int>").alias("row_nos"))
    drafts = drafts.unionByName(framed).withColumn("blocked", F.max(F.col("body").isNull()).over(Window.partitionBy(*TABLE)))
    first = F.row_number().over(Window.partitionBy(*TABLE).orderBy(F.col("body").isNotNull(), "region", "place", "part"))
    drafts = drafts.withColumn("_k", first).where("not blocked or _k = 1").drop("_k")
    opens = F.row_number().over(Window.partitionBy(*TABLE, "region").orderBy("place", "part")) == 1
    own = F.when(F.col("blocked"), F.array().cast("array<int>")).when(opens, F.array_insert("row_nos", 1, F.col("head_no").cast("int"))).otherwise(F.col("row_nos"))
    return drafts.withColumn("row_nos", own).drop("head_no")


def _fragments(rows: DataFrame, limit: int, columns: list[str]) -> DataFrame:
    """Drafts of rows too long for one chunk; body is null where even a fragment's frame doesn't fit."""
    cells = F.transform(F.col("cells"), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    filled = F.filter(cells, lambda x: ~S.is_blank(F.coalesce(x["c"], F.lit(""))))
    rows = rows.withColumn("_f", filled).withColumn("_room", F.greatest(F.lit(1), F.col("room") - 1))
    name = F.concat(F.lit("행 분할: "), S.escape_cell(F.col("_f")[0]["c"]))
    rows = rows.withColumn("_id", name).withColumn("_use", S.u16_length(name) + 2 <= F.col("_room"))
    rows = rows.withColumn("_limit", F.when(F.col("_use"), F.greatest(F.lit(1), F.col("_room") - S.u16_length(F.col("_id")) - 1)).otherwise(F.col("_room")))
    rest = F.when(F.col("_use"), F.slice("_f", 2, F.greatest(F.size("_f") - 1, F.lit(0)))).otherwise(F.col("_f"))
    each = rows.select(*columns, "region", "place", "start", "header", "context_length", "head_no", "row_no", "_id", "_use", "_limit", F.explode_outer(rest).alias("x"))
    head = S.trim(F.coalesce(F.get("header", F.col("x.i")), F.lit("")))
    label = F.concat(F.lit("행 분할: "), S.escape_cell(F.when(head == "", F.concat(F.lit("열 "), (F.col("x.i") + 1).cast("string"))).otherwise(head)), F.lit(": "))
    each = each.withColumn("_label", label)
    # A line end grows to four characters, the most that escaping can do.
    room = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), F.col("_limit") - S.u16_length(F.col("_label"))) / 4)).cast("int")
    each = each.withColumn("_parts", split_text(S.normalize_line_ends(F.coalesce("x.c", F.lit(""))), room))
    each = each.select("*", F.posexplode_outer("_parts").alias("_k", "_part"))
    line = F.when(F.col("x.i").isNull(), F.col("_id")).otherwise(F.concat("_label", S.escape_cell(F.coalesce("_part", F.lit("")))))
    base = F.when(F.col("_use") & F.col("x.i").isNotNull(), F.concat("start", F.lit("\n"), "_id")).otherwise(F.col("start"))
    each = each.withColumn("_line", line).withColumn("_base", base).withColumn("_room", F.lit(limit) - F.col("context_length") - S.u16_length(base))
    keys = [*columns, "region", "place", "_base", "head_no", "row_no"]
    packed = each.groupBy(*keys, "_room").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("x.i", F.lit(0)).alias("i"), F.coalesce("_k", F.lit(0)).alias("k"), F.col("_line").alias("line")))).alias("r"))
    packed = packed.withColumn("_sizes", F.transform("r", lambda x: S.u16_length(x["line"]) + 1))
    packed = packed.withColumn("g", greedy_groups(F.col("_sizes"), F.col("_room"))).withColumn("_over", F.exists("_sizes", lambda n: n > F.col("_room")))
    packed = packed.select(*keys, "_over", F.posexplode(F.arrays_zip("r", "g")).alias("k", "x"))
    packed = packed.groupBy(*keys, "_over", F.col("x.g").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "x.r.line"))), lambda x: x["line"]), "\n").alias("lines"))
    rows = F.when(F.col("part") == 0, F.array(F.col("row_no").cast("int"))).otherwise(F.array().cast("array<int>"))
    return packed.select(*columns, "region", "place", "part", F.when(~F.col("_over"), F.concat("_base", F.lit("\n"), "lines")).alias("body"), "head_no", rows.alias("row_nos"))
