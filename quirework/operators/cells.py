"""Workbook cells as a table: used ranges, displayed rows, header rows, formulas, comments, merges, and their drafts.

cells: doc_id, sheet_no, row, col (from 1), value (null where nothing is stored), formula (null if none), comment (flag).
merges: doc_id, sheet_no, merge_no, top, left, bottom, right. names: doc_id, sheet_no (null: whole workbook), name, ref.
What a sheet holds once (its merges, its first rows) is one array a sheet; cells and rows stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import strings as S
from quirework.operators import tables as T
from quirework.operators.storage import cut
from quirework.operators.workbook import SHEET, blocked_issues, populated

# Rows in which a header is looked for, and addresses that a summary of comments names.
HEADER_ROWS, COMMENT_PLACES = 20, 20
PRINT_TITLES = "_xlnm.Print_Titles"
ITEM_LABEL = r"(?i)^(?:item|항목)\s*[:：]\s*(.+)\z"


def column_label(col: Column) -> Column:
    """A, B, ... Z, AA, ... of columns counted from 1."""
    start = F.struct(col.cast("long").alias("n"), F.lit("").alias("label"))

    def digit(done: Column, _: Column) -> Column:
        n = done["n"] - 1
        more = F.struct(F.floor(n / 26).cast("long").alias("n"), F.concat(F.char(65 + n % 26), done["label"]).alias("label"))
        return F.when(done["n"] > 0, more).otherwise(done)

    # Fourteen letters hold any long.
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, digit, lambda d: d["label"])


def address(row: Column, col: Column) -> Column:
    return F.concat(column_label(col), row.cast("string"))


def merge_ranges(merges: DataFrame) -> DataFrame:
    """merges with `range`, such as A1:B2."""
    c = F.col
    return merges.withColumn("range", F.concat(address(c("top"), c("left")), F.lit(":"), address(c("bottom"), c("right"))))


def _matched(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by sorting: cells are estimated by the bytes of the file that they are exploded from, and would be sent whole."""
    return rows.join(other.hint("merge"), on, how)


def _merge_lists(merges: DataFrame) -> DataFrame:
    one = F.struct("merge_no", "top", "left", "bottom", "right")
    return merges.groupBy(*SHEET).agg(F.array_sort(F.collect_list(one)).alias("merges"))


def used_ranges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """doc_id, sheet_no, top, left, bottom, right, merges: the box of cells that hold something, grown by each merge that
    meets it, in order."""
    held = cells.where("value is not null or formula is not null")
    box = held.groupBy(*SHEET).agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"))
    none = F.array().cast("array<struct<merge_no:int,top:int,left:int,bottom:int,right:int>>")
    rows = _matched(box, _merge_lists(merges), SHEET, "left").withColumn("merges", F.coalesce("merges", none))
    sides = ["top", "left", "bottom", "right"]
    start = F.struct(*[F.col(s).cast("int").alias(s) for s in sides])

    def grown(b: Column, m: Column) -> Column:
        meets = (m["top"] <= b["bottom"]) & (m["bottom"] >= b["top"]) & (m["left"] <= b["right"]) & (m["right"] >= b["left"])
        pick = {"top": F.least, "left": F.least, "bottom": F.greatest, "right": F.greatest}
        return F.struct(*[F.when(meets, pick[s](b[s], m[s].cast("int"))).otherwise(b[s]).alias(s) for s in sides])

    return rows.withColumn("_b", F.aggregate("merges", start, grown)).select(*SHEET, "_b.*", "merges")


def displayed_rows(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, sheet_no, row_no (from 0), cells: all rows of the used range, cells under a merge blank but for its first."""
    inside = _matched(cells.where("value is not null"), ranges, SHEET)
    c = F.col
    under = F.exists("merges", lambda m: c("row").between(m["top"], m["bottom"]) & c("col").between(m["left"], m["right"]) & ~((c("row") == m["top"]) & (c("col") == m["left"])))
    shown = inside.where(c("row").between(c("top"), c("bottom")) & ~under)
    filled = shown.groupBy(*SHEET, (c("row") - c("top")).cast("int").alias("row_no")).agg(F.map_from_entries(F.collect_list(F.struct((c("col") - c("left")).cast("int"), "value"))).alias("_v"))
    grid = ranges.select(*SHEET, (c("right") - c("left")).cast("int").alias("_w"), F.explode(F.sequence(F.lit(0), (c("bottom") - c("top")).cast("int"))).alias("row_no"))
    rows = _matched(grid, filled, [*SHEET, "row_no"], "left")
    value = lambda i: F.coalesce(F.try_element_at(c("_v"), i), F.lit(""))
    return rows.select(*SHEET, "row_no", F.transform(F.sequence(F.lit(0), c("_w")), value).alias("cells"))


def print_titles(names: DataFrame, sheets: DataFrame) -> DataFrame:
    """doc_id, sheet_no, first, last: repeated rows that the workbook itself names, for the sheet or for all."""
    n = names.where(F.col("name") == PRINT_TITLES).select("doc_id", F.col("sheet_no").alias("_s"), "ref", "name_no")
    both = _matched(sheets.select(*SHEET), n, ["doc_id"]).where(F.col("_s").isNull() | (F.col("_s") == F.col("sheet_no")))
    ref = both.groupBy(*SHEET).agg(F.min_by("ref", "name_no").alias("ref"))
    found = F.regexp_extract("ref", r"!\$(\d+):\$(\d+)(?:,|$)", 1), F.regexp_extract("ref", r"!\$(\d+):\$(\d+)(?:,|$)", 2)
    rows = ref.select(*SHEET, F.nullif(found[0], F.lit("")).cast("int").alias("first"), F.nullif(found[1], F.lit("")).cast("int").alias("last"))
    return rows.where("first >= 1 and last >= first")


def _header_of(rows: Column, top: Column, left: Column, merges: Column) -> Column:
    """struct<first, last> in sheet rows: a band of merged titles over column titles, else the fullest early row."""
    counts = F.transform(rows, populated)

    def band(m: Column) -> Column:
        start = (m["top"] - top).cast("int")
        bottom = F.array_max(F.transform(F.filter(merges, lambda x: x["top"] == m["top"]), lambda x: x["bottom"]))
        end = (bottom - top).cast("int")
        end = F.when((end == start) & (F.coalesce(F.get(counts, end + 1), F.lit(0)) >= 2), end + 1).otherwise(end)
        titles = F.filter(F.slice(F.coalesce(F.get(rows, end), F.array().cast("array<string>")), (m["left"] - left + 1).cast("int"), (m["right"] - m["left"] + 1).cast("int")), lambda x: ~S.is_blank(x))
        early = (m["right"] > m["left"]) & (start >= 0) & (start < F.least(F.size(rows), F.lit(HEADER_ROWS)))
        free = ~F.exists(F.slice(counts, 1, F.greatest(start, F.lit(0))), lambda n: n >= 2)
        ok = early & free & (end > start) & (F.coalesce(F.get(counts, end), F.lit(0)) >= 2) & (F.size(titles) >= 2)
        return F.struct(ok.alias("ok"), (start + top).cast("int").alias("first"), (end + top).cast("int").alias("last"))

    ordered = F.array_sort(F.transform(merges, lambda m, i: F.struct(m["top"].alias("top"), i.alias("i"), m["left"].alias("left"), m["right"].alias("right"))))
    bands = F.filter(F.transform(ordered, band), lambda b: b["ok"])
    early = F.transform(F.slice(counts, 1, HEADER_ROWS), lambda n, i: F.struct(n.alias("n"), (-i).alias("i")))
    dense = F.array_max(F.filter(early, lambda x: x["n"] >= 2))
    some = F.array_max(F.transform(F.filter(early, lambda x: x["n"] > 0), lambda x: x["i"]))
    row = (top - F.coalesce(dense["i"], some)).cast("int")
    first = F.get(bands, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["first"].alias("first"), first["last"].alias("last"))).when(row.isNotNull(), F.struct(row.alias("first"), row.alias("last")))


def header_rows(ranges: DataFrame, rows: DataFrame, names: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, sheet_no, first, last, source of each sheet's header: print titles, else detected, else its first formula's row."""
    # Rows that a band may reach: the first ones, and as far down as a merge that begins there goes, and one more.
    reach = F.array_max(F.transform(F.filter("merges", lambda m: m["top"] - F.col("top") < HEADER_ROWS), lambda m: m["bottom"] - F.col("top") + 2))
    far = ranges.select(*SHEET, F.greatest(F.lit(HEADER_ROWS), F.coalesce(reach, F.lit(0))).alias("_far"))
    early = _matched(rows, far, SHEET).where("row_no < _far").groupBy(*SHEET).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"]).alias("rows"))
    formula = cells.where("formula is not null").groupBy(*SHEET).agg(F.min("row").cast("int").alias("_f"))
    titles = print_titles(names, ranges).select(*SHEET, F.struct("first", "last").alias("_p"))
    found = _matched(_matched(_matched(ranges, early, SHEET), formula, SHEET, "left"), titles, SHEET, "left")
    found = found.withColumn("_h", _header_of(F.col("rows"), F.col("top"), F.col("left"), F.col("merges")))
    found = found.withColumn("_r", F.coalesce("_p", "_h", F.when(F.col("_f").isNotNull(), F.struct(F.col("_f").alias("first"), F.col("_f").alias("last")))))
    return found.where("_r is not null").select(*SHEET, "_r.*", F.when(F.col("_p").isNotNull(), "print-titles").otherwise("detected").alias("source"))


def formula_cells(cells: DataFrame) -> DataFrame:
    """doc_id, sheet_no, formulas: an array in order of place, each formula with its leading =."""
    text = F.when(F.startswith("formula", F.lit("=")), F.col("formula")).otherwise(F.concat(F.lit("="), "formula"))
    one = F.struct("row", "col", text.alias("formula"), F.col("value").isNotNull().alias("has_result"))
    return cells.where("formula is not null and formula <> ''").groupBy(*SHEET).agg(F.array_sort(F.collect_list(one)).alias("formulas"))


def annotate_formulas(rows: DataFrame, ranges: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with each formula after its displayed value, or alone where nothing is displayed."""
    text = F.when(F.startswith("formula", F.lit("=")), F.col("formula")).otherwise(F.concat(F.lit("="), "formula"))
    at = _matched(cells.where("formula is not null and formula <> ''"), ranges, SHEET)
    at = at.groupBy(*SHEET, (F.col("row") - F.col("top")).cast("int").alias("row_no")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("col") - F.col("left")).cast("int"), text))).alias("_f"))

    def noted(value: Column, i: Column) -> Column:
        f = F.try_element_at(F.col("_f"), i)
        note = F.concat(F.lit("(수식: "), f, F.lit(")"))
        return F.when(f.isNull(), value).when(S.is_blank(value), note).otherwise(F.concat(value, F.lit(" "), note))

    joined = _matched(rows, at, [*SHEET, "row_no"], "left")
    return joined.withColumn("cells", F.when(F.col("_f").isNull(), F.col("cells")).otherwise(F.transform("cells", noted))).drop("_f")


def comment_summary(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """doc_id, n, locations: commented cells, and the first of them by sheet, row and column; contents are not exported.

    sheets: doc_id, sheet_no, sheet.
    """
    marked = _matched(cells.where("comment"), sheets, SHEET)
    place = Window.partitionBy(*SHEET).orderBy("row", "col")
    first = marked.withColumn("_k", F.row_number().over(place)).where(F.col("_k") <= COMMENT_PLACES)
    named = first.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("sheet_no", "row", "col", F.concat("sheet", F.lit("!"), address(F.col("row"), F.col("col"))).alias("at")))), 1, COMMENT_PLACES).alias("l"))
    counts = marked.groupBy("doc_id").agg(F.count("*").alias("n"))
    return _matched(counts, named, ["doc_id"]).select("doc_id", "n", F.transform("l", lambda x: x["at"]).alias("locations"))


def workbook_issues(cells: DataFrame, merges: DataFrame, sheets: DataFrame) -> DataFrame:
    """doc_id, code, severity, n, locations: merged cells a sheet, formulas without a stored result, commented cells."""
    warning = F.lit("warning").alias("severity")
    at = lambda: F.concat("sheet", F.lit("!"), address(F.col("row"), F.col("col")))
    ranges = _matched(merge_ranges(merges), sheets, SHEET)
    merged = ranges.groupBy(*SHEET).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("merge_no", F.concat("sheet", F.lit("!"), "range").alias("at")))).alias("l"))
    merged = merged.select("doc_id", F.lit("MERGED_CELLS").alias("code"), warning, "n", F.transform("l", lambda x: x["at"]).alias("locations"))
    missing = _matched(cells.where("formula is not null and formula <> '' and value is null"), sheets, SHEET)
    missing = missing.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("sheet_no", "row", "col", at().alias("at")))).alias("l"))
    missing = missing.select("doc_id", F.lit("FORMULA_RESULT_MISSING").alias("code"), warning, "n", F.transform("l", lambda x: x["at"]).alias("locations"))
    noted = comment_summary(cells, sheets).select("doc_id", F.lit("EXCEL_CELL_COMMENTS_UNSUPPORTED").alias("code"), warning, "n", "locations")
    return merged.unionByName(missing).unionByName(noted)


def _segment(value: Column) -> Column:
    return S.trim(F.regexp_replace(F.coalesce(value, F.lit("")), rf"(?i)(?:<br\s*/?\s*>|{S.SPACE})+", " "))


def item_label(cells: Column) -> Column:
    """The label of a row whose only filled cell names an item; null otherwise."""
    filled = F.filter(F.transform(cells, lambda c: S.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    label = S.trim(F.regexp_extract(F.get(filled, F.lit(0)), ITEM_LABEL, 1))
    return F.when((F.size(filled) == 1) & (label != ""), label)


def context_line(cells: Column) -> Column:
    """Filled cells joined by bars; null for an empty row."""
    line = F.array_join(F.filter(F.transform(cells, lambda c: S.trim(F.coalesce(c, F.lit("")))), lambda c: c != ""), " | ")
    return F.nullif(line, F.lit(""))


def layout_heads(ranges: DataFrame, rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Sheets with a header: doc_id, sheet_no, _z (its last row), context (lines above it), header, complex (several header
    rows, or merges that meet them), header_merges, bare (columns without a title).

    Title rows (one filled cell, fuller rows below) leave the header, however many there are. Header rows are joined by
    column, merged ones read at their first cell.
    """
    c = F.col
    span = _matched(ranges, headers, SHEET).select(*SHEET, "top", "left", "merges", "first", "last", "source")
    span = span.withColumn("_a", (c("first") - c("top")).cast("int")).withColumn("_z", (c("last") - c("top")).cast("int"))
    above = _matched(rows, span.select(*SHEET, "_z"), SHEET).where("row_no <= _z")
    heads = above.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("h"))
    heads = _matched(heads, span, SHEET).where("_a >= 0 and _z >= _a")
    band = F.filter("h", lambda x: (x["row_no"] >= c("_a")) & (populated(x["cells"]) > 0))
    heads = heads.withColumn("_band", band).where(F.size("_band") > 0)
    within = F.filter("merges", lambda m: (m["top"] >= c("first")) & (m["bottom"] <= c("last")))
    heads = heads.withColumn("_in", within)
    counts = F.transform("_band", lambda x: populated(x["cells"]))
    # The first band row that isn't a title: it has several cells, or no fuller row follows, or none is left.
    opens = F.filter(F.sequence(F.lit(0), F.size("_band") - 1), lambda i: (F.get(counts, i) != 1) | (i == F.size("_band") - 1) | ~F.exists(F.slice(counts, i + 2, F.size("_band")), lambda n: n >= 2))
    peels = (c("source") != "manual") & (F.size("_in") == 0)
    heads = heads.withColumn("_k", F.when(peels, F.array_min(opens)).otherwise(F.lit(0)))
    used = F.slice("_band", c("_k") + 1, F.size("_band"))
    titles = F.slice("_band", F.lit(1), c("_k"))
    heads = heads.withColumn("_used", used).withColumn("_titles", titles)

    def shown(row: Column, i: Column) -> Column:
        """The cell's text, read at the first cell of the merge in the header that holds it."""
        r, k = row["row_no"] + c("top"), i + c("left")
        m = F.get(F.filter("_in", lambda m: r.between(m["top"], m["bottom"]) & k.between(m["left"], m["right"])), F.lit(0))
        source = F.get(F.filter("h", lambda x: x["row_no"] == F.coalesce(m["top"] - c("top"), row["row_no"])), F.lit(0))
        return _segment(F.get(source["cells"], F.coalesce((m["left"] - c("left")).cast("int"), i)))

    def title(i: Column) -> Column:
        parts = F.filter(F.transform("_used", lambda row: shown(row, i)), lambda x: x != "")
        return F.array_join(F.filter(parts, lambda x, k: (k == 0) | (x != F.get(parts, k - 1))), " > ")

    width = F.array_max(F.transform("h", lambda x: F.size(x["cells"])))
    heads = heads.withColumn("header", F.transform(F.sequence(F.lit(0), width - 1), title)).where(F.exists("header", lambda x: x != ""))
    lines = F.concat(F.filter("h", lambda x: x["row_no"] < c("_a")), c("_titles"))
    heads = heads.withColumn("context", F.filter(F.transform(lines, lambda x: context_line(x["cells"])), lambda x: x.isNotNull()))
    meets = F.filter("merges", lambda m: (m["bottom"] >= c("first")) & (m["top"] <= c("last")))
    bare = F.filter(F.transform("header", lambda x, i: F.when(x == "", (i + c("left")).cast("int"))), lambda i: i.isNotNull())
    heads = heads.withColumn("header_merges", meets).withColumn("bare", bare).withColumn("complex", (F.size("_used") > 1) | (F.size("header_merges") > 0))
    return cut(heads.select(*SHEET, "_z", "context", "header", "complex", "header_merges", "bare"), "sheet-headers")


def layout_tables(ranges: DataFrame, rows: DataFrame, headers: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Sheets with a header as tables: doc_id, sheet_no, section, item, context (lines above the header), header, row_no, cells.

    Empty rows and item labels cut the data; a label holds until the next. A sheet without data has one row with null
    cells.
    """
    c = F.col
    heads = (layout_heads(ranges, rows, headers) if heads is None else heads).select(*SHEET, "_z", "context", "header")
    data = _matched(rows, heads.select(*SHEET, "_z"), SHEET).where("row_no > _z")
    upto = Window.partitionBy(*SHEET).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    data = data.withColumn("_item", item_label(c("cells"))).withColumn("_cut", (T.is_empty_row(c("cells")) | c("_item").isNotNull()))
    data = data.withColumn("item", F.last("_item", True).over(upto)).withColumn("_g", F.sum(c("_cut").cast("int")).over(upto)).where("not _cut")
    data = data.withColumn("section", F.dense_rank().over(Window.partitionBy(*SHEET).orderBy("_g")))
    out = _matched(heads, data.select(*SHEET, "section", "item", "row_no", "cells"), SHEET, "left")
    return out.withColumn("section", F.coalesce("section", F.lit(1))).select(*SHEET, "section", "item", "context", "header", "row_no", "cells")


def layout_drafts(tables: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts (doc_id, draft_no, context, body) and issues of layout tables; sheets: doc_id, sheet_no, name, sheet."""
    c = F.col
    keyed = _matched(tables, sheets, SHEET).withColumn("table_no", F.struct("sheet_no", "section"))
    lines = F.concat(F.array(F.concat(F.lit("[파일] "), "name"), F.concat(F.lit("[시트] "), "sheet")), F.transform("context", lambda x: F.concat(F.lit("[머리행] "), x)), F.array(F.coalesce(F.concat(F.lit("[항목] "), "item"), F.concat(F.lit("[표] "), c("section").cast("string")))))
    keyed = cut(keyed.withColumn("_lines", lines), "layout-rows")
    framed = keyed.groupBy("doc_id", "table_no").agg(F.first("_lines").alias("context"), F.first("header").alias("cells"))
    rows = framed.select("doc_id", "table_no", F.lit(-1).alias("row_no"), "cells").unionByName(keyed.where("cells is not null").select("doc_id", "table_no", c("row_no").cast("int").alias("row_no"), "cells"))
    lengths = framed.select("doc_id", "table_no", (S.u16_length(F.array_join("context", "\n")) + 1).alias("context_length"))
    packed = cut(T.table_drafts(rows, lengths), "layout-drafts").join(framed.select("doc_id", "table_no", "context"), ["doc_id", "table_no"])
    number = F.struct(c("table_no.sheet_no").alias("pos"), c("table_no.section").alias("region"), "place", "part")
    return packed.where("not blocked").select("doc_id", number.alias("draft_no"), "context", "body"), blocked_issues(packed)


def layout_issues(heads: DataFrame, sheets: DataFrame) -> DataFrame:
    """doc_id, code, severity, n, locations of layout heads: headers of several rows or with merges, and columns without a title."""
    c = F.col
    named = _matched(heads, sheets.select(*SHEET, "sheet"), SHEET)
    corner = lambda row, col: F.concat(column_label(col), row.cast("string"))
    areas = F.transform("header_merges", lambda m: F.concat("sheet", F.lit("!"), corner(m["top"], m["left"]), F.lit(":"), corner(m["bottom"], m["right"])))
    columns = F.transform("bare", lambda k: F.concat("sheet", F.lit("!"), column_label(k), F.lit(":"), column_label(k)))
    warning = F.lit("warning").alias("severity")
    own = F.when(F.size("header_merges") > 0, areas).otherwise(F.array("sheet"))
    odd = named.where("complex").select("doc_id", F.lit("COMPLEX_EXCEL_HEADER").alias("code"), warning, F.nullif(F.size("header_merges"), F.lit(0)).cast("long").alias("n"), own.alias("locations"))
    return odd.unionByName(named.where(F.size("bare") > 0).select("doc_id", F.lit("EMPTY_EXCEL_HEADER").alias("code"), warning, F.size("bare").cast("long").alias("n"), columns.alias("locations")))
