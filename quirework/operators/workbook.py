"""Workbook sheets to chunks: regions between empty rows, titles, continuations, and tables numbered by sheet.

A sheet table has (doc_id, name, sheet_no, sheet, row_no, cells). Texts of workbooks are cut into segments first: prose
and Markdown tables in their order, or one delimited table. Several tables of a text lie on one sheet, so sheet_no tells
them apart and their numbers run on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import strings as S
from quirework.operators import claims as C
from quirework.operators import lines as L
from quirework.operators import tables as T
from quirework.operators.storage import cut, parts

SHEET = ["doc_id", "sheet_no"]
# What a cell of data looks like.
DATA_CELL = (
    r"^(?:[-+]?[\d,]+(?:\.\d+)?\s*(?:%|℃|°C|㎜|mm|cm|m|kg|t|kW|MW|kV|V|A|Hz|bar|MPa|kPa|시간|분|초|회|명|개|건|호기)?"
    r"|\d{4}[-./년]\s?\d{1,2}(?:[-./월]\s?\d{1,2}일?)?|\d{1,2}[:시]\d{2}분?)\z"
)


def populated(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: ~S.is_blank(F.coalesce(c, F.lit("")))))


def is_data_row(cells: Column) -> Column:
    return F.exists(cells, lambda c: S.trim(F.coalesce(c, F.lit(""))).rlike(DATA_CELL))


def header_line(cells: Column) -> Column:
    """Filled cells, white space collapsed, joined by bars."""
    filled = F.transform(cells, lambda c: S.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)(?:<br\s*/?>|{S.SPACE})+", " ")))
    return F.array_join(F.filter(filled, lambda c: c != ""), " | ")


def sheet_tables(sheets: DataFrame) -> DataFrame:
    """Rows with number (of the table in its sheet), titles (rows above its header), merged (rows of a continued table) and starts (a table's first row).

    A region without titles that starts with data continues the table before it, if that has the same width and its
    header isn't data. Once one region fails, those after it do too, up to the next region with a header.
    A region is judged at its first row, in windows of the sheet: nothing is joined back to the rows.
    """
    keyed = sheets.withColumn("table_no", F.col("sheet_no"))
    rows = T.regions(keyed)
    region = Window.partitionBy(*SHEET, "region")
    # Rows before the first one with several filled cells are titles, however many there are.
    head = F.min(F.when(populated(F.col("cells")) >= 2, F.col("place"))).over(region)
    rows = rows.withColumn("_title", F.col("place") < F.coalesce(head, F.lit(0)))
    above = F.array_sort(F.collect_list(F.when(F.col("_title"), F.struct("place", header_line(F.col("cells")).alias("line")))).over(region))
    rows = rows.withColumn("titles", F.transform(above, lambda x: x["line"])).where("not _title")
    c = F.col
    first = F.row_number().over(Window.partitionBy(*SHEET, "region").orderBy("place")) == 1
    rows = rows.withColumn("_first", first).withColumn("_n", F.count("*").over(region))
    rows = rows.withColumn("_data", F.when(c("_first"), is_data_row(c("cells")))).withColumn("_opens", F.when(c("_first"), ~c("_data") | (F.size("titles") > 0)))
    upto = Window.partitionBy(*SHEET).orderBy("region", "place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_g", F.sum(F.when(c("_opens"), 1).otherwise(0)).over(upto))
    group = Window.partitionBy(*SHEET, "_g").orderBy("region", "place").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.first(F.struct(c("_opens").alias("opens"), c("_data").alias("data"), c("_n").alias("n"), F.size("cells").alias("w"))).over(group)
    rows = rows.withColumn("_lead", lead)
    fits = c("_opens") | (c("_lead.opens") & ~c("_lead.data") & (c("_lead.n") >= 2) & (F.size("cells") == c("_lead.w")))
    rows = rows.withColumn("_fits", F.when(c("_first"), fits))
    rows = rows.withColumn("_merged", F.when(c("_first"), ~c("_opens") & F.min("_fits").over(group))).withColumn("starts", F.coalesce(~c("_merged"), F.lit(False)))
    rows = rows.withColumn("merged", F.last("_merged", True).over(upto)).withColumn("number", F.sum(c("starts").cast("int")).over(upto))
    own = F.first("titles").over(Window.partitionBy(*SHEET, "number").orderBy("region", "place"))
    return rows.withColumn("titles", own).drop("_title", "table_no", "_first", "_n", "_data", "_opens", "_g", "_lead", "_fits", "_merged")


DRAFT = ["pos", "region", "place", "part"]


def numbered(rows: DataFrame) -> DataFrame:
    """rows of sheet_tables with numbers that run on over the tables of one sheet name, in order of sheet_no."""
    upto = Window.partitionBy("doc_id", "sheet").orderBy("sheet_no", "region", "place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("number", F.sum(F.col("starts").cast("int")).over(upto)).drop("starts")


def workbook_drafts(sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts (doc_id, draft_no, context, body, row_nos) and issues of sheet tables; tables of different sheets or regions never share a chunk."""
    lines = F.array(F.concat(F.lit("[파일] "), "name"), F.concat(F.lit("[시트] "), "sheet"))
    context = F.concat(lines, F.transform("titles", lambda x: F.concat(F.lit("[머리행] "), x)), F.array(F.concat(F.lit("[표] "), F.col("number").cast("string"))))
    rows = numbered(sheet_tables(sheets)).withColumns({"table_no": F.struct("sheet_no", "number"), "context": context, "sheet_region": F.col("region")})
    rows = rows.withColumn("context_length", S.u16_length(F.array_join("context", "\n")) + 1).drop("name", "sheet", "titles", "region", "place")
    # Stored with their frames and contexts, so that neither is worked out again for each kind of rows nor joined to them.
    rows = cut(T.framed_rows(rows), "sheet-rows")
    table_rows = rows.select("doc_id", "table_no", "row_no", "cells")
    packed = cut(T.packed_drafts(rows, keep=["context"]), "sheet-drafts")
    drafts = packed.where("not blocked").select("doc_id", F.struct(F.col("table_no.sheet_no").alias("pos"), F.col("table_no.number").alias("region"), "place", "part").alias("draft_no"), "context", "body", "row_nos")
    regions = rows.groupBy(*SHEET).agg(F.countDistinct("number").alias("n"), F.countDistinct(F.when(F.col("merged"), F.col("sheet_region"))).alias("m"))
    warning = lambda found, code, n: found.select("doc_id", F.lit(code).alias("code"), F.lit("warning").alias("severity"), F.col(n).cast("long").alias("n"))
    issues = warning(regions.where("n > 1"), "MULTIPLE_TABLES", "n").unionByName(warning(regions.where("m > 0"), "TABLE_CONTINUATION_MERGED", "m"))
    issues = issues.unionByName(warning(T.table_issues(table_rows).where("code = 'IRREGULAR_COLUMNS'"), "IRREGULAR_COLUMNS", "n"))
    return drafts, issues.unionByName(blocked_issues(packed))


def blocked_issues(packed: DataFrame) -> DataFrame:
    """An error for each table whose frame leaves no space for its rows."""
    return packed.where("blocked").select("doc_id", F.lit("TABLE_FRAMING_EXCEEDS_LIMIT").alias("code"), F.lit("error").alias("severity"), F.lit(1).cast("long").alias("n"))


#: A pipe line before a line of dashes: texts without one hold no Markdown table.
_MAY_HOLD_TABLE = r"(?m)\|[^\n]*\n[^\n]*---"


def segment_lines(docs: DataFrame) -> DataFrame:
    """Lines (doc_id, name, pos, line) of texts with segment, table_no (the table's first line; null in prose) and tabled (whether the text has a table).

    A table is a whole run of pipe lines whose second line is a separator; other runs are prose.
    """
    c = F.col
    lines = L.explode_lines(docs, ["name"]).withColumn("_pipe", S.is_pipe_line(c("line"))).withColumn("_sep", c("_pipe") & S.is_separator_line(c("line")))
    lines = lines.withColumn("_open", c("_pipe") & ~F.coalesce(F.lag("_pipe").over(L.by_pos()), F.lit(False))).withColumn("_next", F.coalesce(F.lead("_sep").over(L.by_pos()), F.lit(False)))
    lines = lines.withColumn("_run", F.last(F.when(c("_open"), F.struct("pos", "_next")), True).over(L.upto()))
    lines = lines.withColumn("table_no", F.when(c("_pipe") & c("_run._next"), c("_run.pos")))
    lines = lines.withColumn("tabled", F.max(c("table_no")).over(L.in_doc()).isNotNull())
    same = c("table_no").eqNullSafe(F.lag("table_no").over(L.by_pos())) & (c("pos") > 0)
    return lines.withColumn("segment", F.sum(F.when(same, 0).otherwise(1)).over(L.upto())).drop("_pipe", "_sep", "_open", "_next", "_run")


def prose_drafts(lines: DataFrame) -> DataFrame:
    """Drafts of the prose between tables: the lines of a segment under their file and sheet, which bears the file's name."""
    row = F.struct("pos", "line", (~S.is_blank(F.col("line"))).alias("filled"))
    rows = lines.where("table_no is null").groupBy("doc_id", "name", "segment").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(row)).alias("_l"))
    body = S.trim(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"))
    own = F.transform(F.filter("_l", lambda x: x["filled"]), lambda x: x["pos"])
    context = F.array(F.concat(F.lit("[파일] "), "name"), F.concat(F.lit("[시트] "), "name"))
    rows = rows.select("doc_id", F.struct("pos", *[F.lit(0).alias(k) for k in DRAFT[1:]]).alias("draft_no"), context.alias("context"), body.alias("body"), own.alias("sources"))
    return rows.where(~S.is_blank(F.col("body")))


def delimited_rows(docs: DataFrame) -> DataFrame:
    """Sheet rows of delimited texts, all as wide as the widest; a text whose cells are all empty has none."""
    from quirework.sources.files import csv_sheets

    rows = csv_sheets(docs).withColumn("sheet", F.col("name")).withColumn("sheet_no", F.lit(0))
    doc = Window.partitionBy("doc_id")
    rows = rows.withColumn("_w", F.max(F.size("cells")).over(doc)).withColumn("_any", F.max(F.exists("cells", lambda x: x != "")).over(doc)).where("_any")
    return rows.withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), F.col("_w") - F.size("cells")))).select("doc_id", "name", "sheet_no", "sheet", "row_no", "cells")


def text_drafts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts and issues of workbook texts (doc_id, name, text): Markdown tables with the prose between them, else one delimited table."""
    may = F.coalesce(F.col("text").rlike(_MAY_HOLD_TABLE), F.lit(False))
    lines = cut(segment_lines(docs.where(may)), "segment-lines")
    rows = T.markdown_rows(lines, ["name"])
    marked = rows.select("doc_id", "name", F.col("table_no").alias("sheet_no"), F.col("name").alias("sheet"), F.col("row_no").cast("int").alias("row_no"), "cells")
    # Lines of texts that turned out to hold no table are the texts again; no text is held against ids.
    flat = docs.where(~may).select("doc_id", "name", "text").unionByName(L.join_lines(lines.where("not tabled"), ["name"]))
    # Until drafts are made, sheet -1 tells delimited texts from the tables at a line.
    delimited = delimited_rows(flat.where(~S.is_blank(F.col("text")))).withColumn("sheet_no", F.lit(-1))
    # A text is one row as it comes; dealt by it, all windows over its tables find their rows together. Where lines are
    # many, so are the parts: their rows compress to few bytes, by which Spark would join them into few tasks.
    both, n = marked.unionByName(delimited), parts(lines)
    many = n > lines.sparkSession.sparkContext.defaultParallelism
    drafts, issues = workbook_drafts(both.repartition(n, "doc_id") if many else both.repartition("doc_id"))
    # Rows of delimited texts aren't lines.
    at = F.col("draft_no.pos")
    drafts = drafts.withColumn("sources", F.when(at >= 0, T.line_numbers(at, F.col("row_nos"))).otherwise(C.no_sources()))
    place = F.struct(F.greatest(at, F.lit(0)).cast("int").alias("pos"), *[F.col(f"draft_no.{k}").cast("int").alias(k) for k in DRAFT[1:]]).alias("draft_no")
    prose = prose_drafts(lines.where("tabled"))
    both = prose.unionByName(drafts.select(*prose.columns))
    return cut(both.select("doc_id", place, "context", "body", "sources"), "workbook-drafts"), issues
