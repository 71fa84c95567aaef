"""Queries of structured documents, workbooks, contracts and delegation rules over the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import strings as S
from quirework.operators import cells as C
from quirework.operators import claims, contracts, delegation, documents, drafts, sections, spans, stored
from quirework.operators.storage import cut, parts, spread
from quirework.plans.queries import table, text_of
from quirework.plans import workbooks
from quirework.plans.preprocess import preprocess, raw_documents
from quirework.sources import delimited, markup, statutes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# --- workbooks: 200 suppliers are a workbook, those of a nation in it are a sheet ---

_SHEET = "WITH s AS (SELECT s_suppkey // 200 AS doc_id, n_nationkey AS sheet_no, s_suppkey, s_name, s_acctbal, row_number() OVER (PARTITION BY s_suppkey // 200, n_nationkey ORDER BY s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) "


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, folder, "supplier").join(table(spark, folder, "nation").select("n_nationkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    doc = F.floor(F.col("s_suppkey") / 200).cast("long")
    k = F.row_number().over(Window.partitionBy(doc, "n_nationkey").orderBy("s_suppkey"))
    return rows.select(doc.alias("doc_id"), F.col("n_nationkey").alias("sheet_no"), "s_suppkey", "s_name", k.cast("int").alias("k"))


_NO_MERGES = "doc_id long, sheet_no long, merge_no int, top int, left int, bottom int, right int"


def _sheet(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Cells and merges: row 3 is a merged title over B3:D3, row 4 has column titles, data from row 5 on, a formula in D."""
    s = _numbered(spark, folder)
    sheet_type = s.schema["sheet_no"].dataType
    row = F.col("k") + 4
    none = F.lit(None).cast("string")
    cell = lambda r, c, v, f=none, m=F.lit(False): F.struct(r.cast("int").alias("row"), F.lit(c).alias("col"), v.alias("value"), f.alias("formula"), m.alias("comment"))
    odd = F.col("k") % 2 == 1
    data = s.select("doc_id", "sheet_no", F.explode(F.array(
        cell(row, 2, F.col("s_name"), m=F.col("s_suppkey") % 5 == 0), cell(row, 3, F.col("s_suppkey").cast("string")),
        cell(row, 4, F.when(odd, F.col("k").cast("string")), F.concat(F.lit("ROW()-"), F.lit("4"))),
    )).alias("x"))
    sheets = s.select("doc_id", "sheet_no").distinct()
    three, four = F.lit(3), F.lit(4)
    heads = sheets.select("doc_id", "sheet_no", F.explode(F.array(cell(three, 2, F.lit("Suppliers")), cell(three, 3, F.lit("hidden")), cell(four, 2, F.lit("name")), cell(four, 3, F.lit("key")), cell(four, 4, F.lit("place")), cell(F.lit(1), 1, none, m=F.lit(True)))).alias("x"))
    cells = data.unionByName(heads).select("doc_id", F.col("sheet_no").cast(sheet_type).alias("sheet_no"), "x.*")
    merges = sheets.select("doc_id", "sheet_no", F.lit(1).alias("merge_no"), three.alias("top"), F.lit(2).alias("left"), three.alias("bottom"), F.lit(5).alias("right"))
    return cells, merges


@query(_SHEET + "SELECT doc_id, sheet_no, 3 AS top, 2 AS left, CAST(max(k) + 4 AS INT) AS bottom, 5 AS right FROM s GROUP BY 1, 2")
def used_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The box of cells that hold something, grown by the merge that meets it; a cell with only a comment doesn't count."""
    return C.used_ranges(*_sheet(spark, folder)).drop("merges")


@query(_SHEET + """SELECT doc_id, sheet_no, CAST(k + 1 AS INT) AS row_no, s_name || '|' || s_suppkey || '|' || CASE WHEN k % 2 = 1 THEN CAST(k AS VARCHAR) ELSE '' END || '|' AS line FROM s
UNION ALL SELECT DISTINCT doc_id, sheet_no, 0, 'Suppliers|||' FROM s UNION ALL SELECT DISTINCT doc_id, sheet_no, 1, 'name|key|place|' FROM s""")
def displayed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the used range; what lies under a merge is blank."""
    cells, merges = _sheet(spark, folder)
    rows = C.displayed_rows(cells, C.used_ranges(cells, merges))
    return rows.select("doc_id", "sheet_no", "row_no", F.array_join("cells", "|").alias("line"))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """Print titles for every third sheet."""
    sheets = _numbered(spark, folder).select("doc_id", "sheet_no").distinct()
    return sheets.where("sheet_no % 3 = 0").select("doc_id", "sheet_no", F.lit(C.PRINT_TITLES).alias("name"), F.lit("'S'!$A:$B,'S'!$1:$4").alias("ref"), F.lit(1).alias("name_no"))


@query(_SHEET + """SELECT DISTINCT doc_id, sheet_no, CASE WHEN sheet_no % 3 = 0 THEN 1 ELSE 3 END AS first, 4 AS last, CASE WHEN sheet_no % 3 = 0 THEN 'print-titles' ELSE 'detected' END AS source FROM s""")
def header_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Header rows: print titles where the workbook names them, else the merged band over its column titles."""
    cells, merges = _sheet(spark, folder)
    ranges = C.used_ranges(cells, merges)
    return C.header_rows(ranges, C.displayed_rows(cells, ranges), _names(spark, folder), cells)


@query("""SELECT c_custkey AS doc_id, 0 AS sheet_no, CASE c_custkey % 3 WHEN 0 THEN 3 ELSE 2 END AS first, CASE c_custkey % 3 WHEN 0 THEN 3 ELSE 2 END AS last, 'detected' AS source FROM customer""")
def densest_header(spark: SparkSession, folder: str) -> DataFrame:
    """Without merges and names the fullest early row is the header, of equally full ones the first: a sheet a customer."""
    customer = table(spark, folder, "customer")
    counts = F.array(F.lit(1), (F.col("c_custkey") % 3 + 2).cast("int"), F.lit(3), F.lit(2))
    rows = customer.select(F.col("c_custkey").alias("doc_id"), "c_name", F.posexplode(counts).alias("r", "n"))
    cells = rows.select("doc_id", F.lit(0).alias("sheet_no"), (F.col("r") + 1).alias("row"), F.explode(F.sequence(F.lit(1), "n")).alias("col"), F.col("c_name").alias("value"), F.lit(None).cast("string").alias("formula"), F.lit(False).alias("comment"))
    ranges = C.used_ranges(cells, spark.createDataFrame([], _NO_MERGES))
    names = spark.createDataFrame([], "doc_id long, sheet_no int, name string, ref string, name_no int")
    return C.header_rows(ranges, C.displayed_rows(cells, ranges), names, cells)


@query(_SHEET + """SELECT doc_id, sheet_no, string_agg('D' || (k + 4) || '=ROW()-4 ' || CASE WHEN k % 2 = 1 THEN 'true' ELSE 'false' END, ',' ORDER BY k) AS formulas FROM s GROUP BY 1, 2""")
def formula_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Formulas in order of place, with a leading = and whether a result is stored."""
    cells, _ = _sheet(spark, folder)
    text = F.transform("formulas", lambda x: F.concat(C.address(x["row"], x["col"]), x["formula"], F.lit(" "), x["has_result"].cast("string")))
    return C.formula_cells(cells).select("doc_id", "sheet_no", F.array_join(text, ",").alias("formulas"))


@query(_SHEET + """SELECT doc_id, sheet_no, CAST(k + 1 AS INT) AS row_no, CASE WHEN k % 2 = 1 THEN k || ' (수식: =ROW()-4)' ELSE '(수식: =ROW()-4)' END AS cell FROM s""")
def formula_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Formulas written after their results, or alone where none is stored."""
    cells, merges = _sheet(spark, folder)
    ranges = C.used_ranges(cells, merges)
    rows = C.annotate_formulas(C.displayed_rows(cells, ranges), ranges, cells)
    return rows.where("row_no > 1").select("doc_id", "sheet_no", "row_no", F.col("cells")[2].alias("cell"))


def _sheet_names(spark: SparkSession, folder: str) -> DataFrame:
    return _numbered(spark, folder).select("doc_id", "sheet_no").distinct().withColumn("sheet", F.concat(F.lit("S"), F.col("sheet_no").cast("string"))).withColumn("name", F.lit("suppliers.xlsx"))


@query(_SHEET + """, m AS (SELECT doc_id, sheet_no, 1 AS row, 1 AS col FROM s GROUP BY 1, 2 UNION ALL SELECT doc_id, sheet_no, k + 4, 2 FROM s WHERE s_suppkey % 5 = 0),
r AS (SELECT *, 'S' || sheet_no || '!' || CASE col WHEN 1 THEN 'A' ELSE 'B' END || row AS place,
  row_number() OVER (PARTITION BY doc_id, sheet_no ORDER BY row, col) AS p FROM m),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sheet_no, row, col) AS q FROM r WHERE p <= 20)
SELECT doc_id, CAST((SELECT count(*) FROM m WHERE m.doc_id = f.doc_id) AS BIGINT) AS n, string_agg(place, ',' ORDER BY q) AS places FROM f WHERE q <= 20 GROUP BY doc_id""")
def comment_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Commented cells a workbook, and the first twenty of them (of twenty a sheet)."""
    cells, _ = _sheet(spark, folder)
    return C.comment_summary(cells, _sheet_names(spark, folder)).select("doc_id", "n", F.array_join("locations", ",").alias("places"))


@query(_SHEET + """SELECT doc_id, 'MERGED_CELLS' AS code, CAST(1 AS BIGINT) AS n, 'S' || sheet_no || '!B3:E3' AS first_place FROM s GROUP BY doc_id, sheet_no
UNION ALL SELECT doc_id, 'FORMULA_RESULT_MISSING', count(*), arg_min('S' || sheet_no || '!D' || (k + 4), sheet_no * 1000000 + k) FROM s WHERE k % 2 = 0 GROUP BY doc_id
UNION ALL SELECT doc_id, 'EXCEL_CELL_COMMENTS_UNSUPPORTED', count(DISTINCT sheet_no) + count(*) FILTER (s_suppkey % 5 = 0), 'S' || min(sheet_no) || '!A1' FROM s GROUP BY doc_id""")
def workbook_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Merged cells a sheet, formulas without a result and commented cells a workbook, with their places."""
    cells, merges = _sheet(spark, folder)
    issues = C.workbook_issues(cells, merges, _sheet_names(spark, folder))
    return issues.select("doc_id", "code", "n", F.col("locations")[0].alias("first_place"))


@query("""WITH n AS (SELECT p_partkey, p_size, p_partkey AS a, p_partkey - 26 AS b, p_partkey - 702 AS c, p_partkey - 18278 AS d FROM part)
SELECT p_partkey, CASE WHEN a < 26 THEN chr(CAST(65 + a AS INT)) WHEN b < 676 THEN chr(CAST(65 + b // 26 AS INT)) || chr(CAST(65 + b % 26 AS INT))
WHEN c < 17576 THEN chr(CAST(65 + c // 676 AS INT)) || chr(CAST(65 + c // 26 % 26 AS INT)) || chr(CAST(65 + c % 26 AS INT))
ELSE chr(CAST(65 + d // 17576 AS INT)) || chr(CAST(65 + d // 676 % 26 AS INT)) || chr(CAST(65 + d // 26 % 26 AS INT)) || chr(CAST(65 + d % 26 AS INT)) END || '7:' || 'B' || (7 + p_size) AS range FROM n""")
def merge_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of merged areas."""
    part = table(spark, folder, "part")
    merges = part.select("p_partkey", F.lit(7).alias("top"), (F.col("p_partkey") + 1).alias("left"), (F.col("p_size") + 7).cast("int").alias("bottom"), F.lit(2).alias("right"))
    return C.merge_ranges(merges).select("p_partkey", "range")


_ITEMS = """WITH s AS (SELECT s_suppkey // 50 AS doc_id, s_suppkey, s_name, row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) AS k FROM supplier),
g AS (SELECT *, (k - 1) // 3 AS item FROM s) """


def _items(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Used ranges, rows and headers of sheets with two title rows, a header of two rows, and an item label before each three rows."""
    from pyspark.sql.window import Window

    supplier = table(spark, folder, "supplier")
    doc = F.floor(F.col("s_suppkey") / 50).cast("long")
    k = F.row_number().over(Window.partitionBy(doc).orderBy("s_suppkey")) - 1
    s = supplier.select(doc.alias("doc_id"), "s_suppkey", "s_name", k.alias("k"))
    at = (F.col("k") + F.floor(F.col("k") / 3) + 5).cast("int")
    data = s.select("doc_id", at.alias("row_no"), F.array("s_name", F.col("s_suppkey").cast("string")).alias("cells"))
    labels = s.where("k % 3 = 0").select("doc_id", (at - 1).alias("row_no"), F.array(F.lit(""), F.concat(F.lit("항목 : i"), (F.col("k") / 3).cast("int").cast("string"))).alias("cells"))
    fixed = F.array(F.array(F.lit("Report"), F.lit("")), F.array(F.lit("of all"), F.lit("")), F.array(F.lit("who"), F.lit("who")), F.array(F.lit("name"), F.lit("key")))
    heads = s.select("doc_id").distinct().select("doc_id", F.posexplode(fixed).alias("row_no", "cells"))
    rows = data.unionByName(labels).unionByName(heads).withColumn("sheet_no", F.lit(1))
    none = F.array().cast("array<struct<merge_no:int,top:int,left:int,bottom:int,right:int>>")
    ranges = rows.groupBy("doc_id", "sheet_no").agg(F.lit(1).alias("top"), F.lit(1).alias("left"), (F.max("row_no") + 1).alias("bottom"), F.lit(2).alias("right")).withColumn("merges", none)
    headers = ranges.select("doc_id", "sheet_no", F.lit(1).alias("first"), F.lit(4).alias("last"), F.lit("print-titles").alias("source"))
    return ranges, rows, headers


@query(_ITEMS + """SELECT doc_id, CAST(item + 1 AS BIGINT) AS section, 'i' || item AS item, 'Report / of all' AS context, 'who > name,who > key' AS header, string_agg(s_name, ',' ORDER BY s_suppkey) AS names FROM g GROUP BY doc_id, item""")
def layout_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Title rows leave the header, header rows are joined by column, labels cut the rows and name what follows."""
    tables = C.layout_tables(*_items(spark, folder))
    rows = tables.groupBy("doc_id", F.col("section").cast("long").alias("section"), "item", F.array_join("context", " / ").alias("context"), F.array_join("header", ",").alias("header")).agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("r"))
    return rows.select("doc_id", "section", "item", "context", "header", F.array_join(F.transform("r", lambda x: x["cells"][0]), ",").alias("names"))


@query(_ITEMS + """SELECT doc_id, '[파일] s.xlsx' || chr(10) || '[시트] one' || chr(10) || '[머리행] Report' || chr(10) || '[머리행] of all' || chr(10) || '[항목] i' || item AS context,
'| who > name | who > key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || s_name || ' | ' || s_suppkey || ' |', chr(10) ORDER BY s_suppkey) AS body FROM g GROUP BY doc_id, item""")
def layout_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The same sheets as drafts under their file, sheet, titles and item."""
    tables = C.layout_tables(*_items(spark, folder))
    sheets = table(spark, folder, "supplier").select(F.floor(F.col("s_suppkey") / 50).cast("long").alias("doc_id"), F.lit(1).alias("sheet_no"), F.lit("s.xlsx").alias("name"), F.lit("one").alias("sheet")).distinct()
    return C.layout_drafts(tables, sheets)[0].select("doc_id", F.array_join("context", "\n").alias("context"), "body")


_TEXT = """WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 3 AS k, c_name AS n, c_mktsegment AS g, '[파일] b.xlsx' || chr(10) || '[시트] b.xlsx' || chr(10) AS f, '| --- | --- |' || chr(10) AS r FROM customer) """


@query(_TEXT + """SELECT doc_id, f || '설명 ' || n AS chunk FROM c WHERE k = 0 UNION ALL SELECT doc_id, f || '[표] 1' || chr(10) || '| k | v |' || chr(10) || r || '| ' || n || ' | ' || g || ' |' FROM c WHERE k = 0
UNION ALL SELECT doc_id, f || '끝 ' || n || chr(10) || '| one run |' FROM c WHERE k = 0
UNION ALL SELECT doc_id, f || '[표] 1' || chr(10) || '| name | note |' || chr(10) || r || '| ' || n || ' | a,b |' || chr(10) || '| last |  |' FROM c WHERE k = 1
UNION ALL SELECT doc_id, f || '[표] 1' || chr(10) || '| k | v |' || chr(10) || r || '| ' || n || ' | x |' FROM c WHERE k = 2
UNION ALL SELECT doc_id, f || '[표] 2' || chr(10) || '| q | r |' || chr(10) || r || '| z | ' || n || ' |' FROM c WHERE k = 2""")
def workbook_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of workbooks: tables with the prose around them in order, a delimited table, and tables whose numbers run on."""
    k = F.pmod("c_custkey", F.lit(3))
    rule = "\n| --- | --- |\n"
    mixed = F.concat(F.lit("설명 "), "c_name", F.lit("\n\n| k | v |" + rule + "| "), "c_name", F.lit(" | "), "c_mktsegment", F.lit(" |\n\n끝 "), "c_name", F.lit("\n| one run |"))
    flat = F.concat(F.lit("name,note\n"), "c_name", F.lit(',"a,b"\nlast'))
    two = F.concat(F.lit("| k | v |" + rule + "| "), "c_name", F.lit(" | x |\n\n| q | r |" + rule + "| z | "), "c_name", F.lit(" |"))
    text = F.when(k == 0, mixed).when(k == 1, flat).otherwise(two)
    dealt = spread(table(spark, folder, "customer"), "c_custkey", 4).select(F.col("c_custkey").alias("doc_id"), text.alias("text"), F.lit("b.xlsx").alias("name"))
    # Stored where they were dealt: Spark would push the tests of their texts below the dealing, into the few tasks of the scan.
    docs = cut(raw_documents(dealt, name="name"), "workbook-docs")
    return preprocess(docs, "excel")[0].select("doc_id", "chunk")


@query(_SHEET + """SELECT doc_id, '[파일] suppliers.xlsx' || chr(10) || '[시트] S' || sheet_no || chr(10) || '[표] 1' || chr(10) || '| Suppliers > name | Suppliers > key | Suppliers > place | Suppliers |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)
|| string_agg('| ' || s_name || ' | ' || s_suppkey || ' | ' || CASE WHEN k % 2 = 1 THEN k || ' ' ELSE '' END || '(수식: =ROW()-4) |  |', chr(10) ORDER BY k) AS chunk FROM s GROUP BY doc_id, sheet_no""")
def workbook_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Workbooks from their cells to chunks: used ranges, merged headers found and joined, formulas noted."""
    parts = _parts(spark, folder)
    found, _ = workbooks.workbook_drafts(parts, formulas=True)
    return drafts.finalize(found).select("doc_id", "chunk")


@query(_SHEET + """SELECT doc_id, 'COMPLEX_EXCEL_HEADER' AS code, CAST(1 AS BIGINT) AS n, 'S' || sheet_no || '!B3:E3' AS places FROM s GROUP BY doc_id, sheet_no UNION ALL SELECT doc_id, 'MERGED_CELLS', 1, 'S' || sheet_no || '!B3:E3' FROM s GROUP BY doc_id, sheet_no
UNION ALL SELECT doc_id, 'FORMULA_RESULT_MISSING', count(*), string_agg('S' || sheet_no || '!D' || (k + 4), ',' ORDER BY sheet_no, k) FROM s WHERE k % 2 = 0 GROUP BY doc_id""")
def workbook_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """What a workbook's reader and its layout warn of, with all places; comments are another query's."""
    _, issues = workbooks.workbook_drafts(_parts(spark, folder))
    return issues.where("code <> 'EXCEL_CELL_COMMENTS_UNSUPPORTED'").select("doc_id", "code", "n", F.array_join("locations", ",").alias("places"))


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """The sheets of _sheet as a workbook reader gives them, without print titles."""
    cells, merges = _sheet(spark, folder)
    keys = ["doc_id", "sheet_no"]
    # Numbers are stored under a style that shows them as they are.
    kind = F.when(F.col("value").rlike(r"^\d+\z"), "n").otherwise("s").alias("kind")
    own = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "col", "value", "formula", "comment", kind, F.lit(0).alias("style"), F.lit(None).cast("int").alias("shared")))).alias("cells"))
    areas = merges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("merge_no", "top", "left", "bottom", "right"))).alias("merges"))
    return own.join(areas, keys).join(_sheet_names(spark, folder), keys).withColumns({"titles": F.array().cast("array<string>"), "formats": F.array(F.struct(F.lit(0).alias("style"), F.lit("0").alias("code"))), "epoch": F.lit(1900)})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '=SUM($A$1:B' || (l_linenumber + 7) || ')*C$2+''A1 x''!D' || (l_linenumber + 5) || '&"A1"&LOG10(E' || (l_linenumber + 4) || ')' AS down,
'=SUM($A$1:' || chr(CAST(66 + l_linenumber AS INT)) || '7)*' || chr(CAST(67 + l_linenumber AS INT)) || '$2+''A1 x''!' || chr(CAST(68 + l_linenumber AS INT)) || '5&"A1"&LOG10(' || chr(CAST(69 + l_linenumber AS INT)) || '4)' AS across FROM lineitem""")
def shared_formulas(spark: SparkSession, folder: str) -> DataFrame:
    """A group's formula in a cell below and in one to the right of its first cell: an order's line number is the distance."""
    lines = table(spark, folder, "lineitem")
    first = "=SUM($A$1:B7)*C$2+'A1 x'!D5&\"A1\"&LOG10(E4)"
    # A sheet for each line: the group's first cell has the text, two others have none.
    place = F.explode(F.array(*[F.struct(r.cast("int").alias("row"), k.cast("int").alias("col"), F.lit(f).alias("formula")) for r, k, f in ((F.lit(10), F.lit(10), first), (F.col("l_linenumber") + 10, F.lit(10), ""), (F.lit(10), F.col("l_linenumber") + 10, ""))])).alias("x")
    keyed = lines.withColumn("_id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"))
    cells = keyed.select(F.col("_id").alias("doc_id"), F.lit(1).alias("sheet_no"), place).select("doc_id", "sheet_no", "x.*", F.lit(1).alias("shared"))
    rows = stored.share_formulas(cells).where("row > 10 or col > 10").groupBy(F.xxhash64("doc_id").alias("_hash"), "doc_id").agg(F.max(F.when(F.col("row") > 10, F.col("formula"))).alias("down"), F.max(F.when(F.col("col") > 10, F.col("formula"))).alias("across"))
    return rows.select("doc_id.l_orderkey", "doc_id.l_linenumber", "doc_id.l_partkey", "doc_id.l_suppkey", "down", "across")


_CODES = {0: "0", 1: "#,##0", 2: "0.00", 3: "0%", 4: "yyyy-mm-dd", 5: "#,##0;(#,##0)", 6: "[h]:mm", 7: "General"}


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_orderkey % 100000 AS n FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN format('{:,}', n) WHEN 2 THEN n || '.00' WHEN 3 THEN n || '00%' WHEN 4 THEN strftime(DATE '1899-12-30' + CAST(n + 100 AS INT), '%Y-%m-%d')
WHEN 5 THEN '(' || format('{:,}', n + 1) || ')' WHEN 6 THEN (24 * n + 12) || ':00' ELSE n || '.5' END AS shown FROM o""")
def displayed_values(spark: SparkSession, folder: str) -> DataFrame:
    """Stored numbers under eight format codes, as their cells show them."""
    k, n = F.pmod("o_orderkey", F.lit(8)), F.col("o_orderkey") % 100_000
    value = F.when(k == 4, (n + 100).cast("string")).when(k == 5, F.concat(F.lit("-"), (n + 1).cast("string"))).when(k.isin(6, 7), F.concat(n.cast("string"), F.lit(".5"))).otherwise(n.cast("string"))
    cells = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("sheet_no"), F.lit(1).alias("row"), F.lit(1).alias("col"), value.alias("value"), F.lit(None).cast("string").alias("formula"), F.lit(False).alias("comment"), F.lit("n").alias("kind"), k.cast("int").alias("style"))
    codes = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    formats = cells.select("doc_id", "sheet_no", F.lit(1900).alias("epoch"), codes.alias("codes"))
    return stored.display_cells(cells, formats).select(F.col("doc_id").alias("o_orderkey"), F.col("value").alias("shown"))


# --- spans, contracts, delegation rules ---


@query("""SELECT o_orderkey AS doc_id, 'k' || o_orderkey || '|' || o_orderstatus || '||x' AS row_0, '|a|b|x2' AS row_1, 'c||d|' AS row_2, 'A1:A2,B1:C1,A3:B3,C3:D3' AS merges FROM orders""")
def span_grids(spark: SparkSession, folder: str) -> DataFrame:
    """Tables with cells that span rows and columns, as rectangular grids, and the merged places."""
    cell = lambda text, down=1, across=1: F.struct(text.alias("text"), F.lit(down).alias("rowspan"), F.lit(across).alias("colspan"))
    key = F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))
    rows = F.array(F.array(cell(key, 2), cell(F.col("o_orderstatus"), 1, 2), cell(F.lit("x"))), F.array(cell(F.lit("a")), cell(F.lit("b")), cell(F.lit("x2"))), F.array(cell(F.lit("c"), 1, 2), cell(F.lit("d"), 1, 2)))
    orders = table(spark, folder, "orders")
    tables = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("table_no"), rows.alias("rows"))
    # Grids and merges of a document are made where its cells lie.
    placed = spans.placed_cells(tables).repartition(parts(orders), "doc_id")
    grid = spans.grid_rows(placed).groupBy("doc_id").agg(*[F.max(F.when(F.col("row_no") == k, F.array_join("cells", "|"))).alias(f"row_{k}") for k in range(3)])
    merges = C.merge_ranges(spans.grid_merges(placed)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("merge_no", "range"))).alias("m"))
    return grid.join(merges.hint("merge"), "doc_id").select("doc_id", "row_0", "row_1", "row_2", F.array_join(F.transform("m", lambda x: x["range"]), ",").alias("merges"))


_CONTRACT = "WITH p AS (SELECT p_partkey // 5 AS doc_id, row_number() OVER (PARTITION BY p_partkey // 5 ORDER BY p_partkey) AS k, p_name, p_brand, p_size FROM part) "


def _contract(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts of up to five parts: a preamble, a list of contents, and an article with a list item and a table for each."""
    from pyspark.sql.window import Window

    part = table(spark, folder, "part")
    doc = F.floor(F.col("p_partkey") / 5).cast("long")
    p = part.select(doc.alias("doc_id"), F.row_number().over(Window.partitionBy(doc).orderBy("p_partkey")).alias("k"), "p_name", "p_brand", "p_size")
    none, flat = F.lit(None).cast("array<array<string>>"), F.lit(None).cast("boolean")
    head = F.concat(F.lit("제"), F.col("k").cast("string"), F.lit("조("), "p_brand", F.lit(")"))
    block = lambda place, kind, text, ordered=flat, rows=none: F.struct(place.alias("order"), F.lit(kind).alias("kind"), F.lit(0).alias("depth"), ordered.alias("ordered"), text.alias("text"), rows.alias("rows"))
    null = F.lit(None).cast("string")
    at = F.col("k") * 10
    cells = F.array(F.array(F.lit("a|b"), F.lit("size")), F.array(F.col("p_size").cast("string")))
    body = p.select("doc_id", F.explode(F.array(block(F.col("k") + 1, "paragraph", head), block(at + 100, "heading", head), block(at + 101, "paragraph", F.col("p_name")), block(at + 102, "list-item", F.lit("1) item"), F.lit(True)), block(at + 103, "table", null, flat, cells))).alias("b"))
    front = p.select("doc_id").distinct().select("doc_id", block(F.lit(0), "paragraph", F.lit(" 계약 서문 ")).alias("b"))
    rows = body.unionByName(front).select("doc_id", F.lit("c.docx").alias("name"), "b.*")
    return rows.withColumn("block_id", F.concat(F.lit("b"), F.col("order").cast("string")))


@query(_CONTRACT + """SELECT doc_id, '[문서] c.docx' || chr(10) || '[조문 범위] 제1조 ~ 제' || count(*) || '조' AS context, '계약 서문' || chr(10) || chr(10) || string_agg('제' || k || '조(' || p_brand || ')' || chr(10) || p_name || chr(10) || '1. item' || chr(10) || '| a\\|b | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_size || ' |  |', chr(10) || chr(10) ORDER BY k) AS body
FROM p GROUP BY doc_id HAVING count(*) >= 3""".replace("\\\\", "\\"))
def contract_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts whose articles fit one chunk with the preamble; the list of contents goes."""
    found, _, _ = contracts.contract_drafts(_contract(spark, folder))
    return found.select("doc_id", F.array_join("context", "\n").alias("context"), "body")


@query(_CONTRACT + """SELECT doc_id, CAST(1 + 4 * count(*) AS BIGINT) AS n_sources FROM p GROUP BY doc_id HAVING count(*) >= 3""")
def contract_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks that a contract's drafts account for, each once."""
    _, _, held = contracts.contract_drafts(_contract(spark, folder))
    return held.groupBy("doc_id").agg(F.countDistinct("source_id").alias("n_sources"))


@query("""SELECT c_custkey, '| x\\|y | ' || c_name || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| a<br>b |  |' AS shown, '| x|y | ' || c_name || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| a |' AS plain FROM customer""".replace("\\\\", "\\"))
def block_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of blocks: padded and escaped in contracts, as they are in delegation rules."""
    head = F.array(F.lit("x|y"), F.col("c_name"))
    return table(spark, folder, "customer").select("c_custkey", contracts.render_table(F.array(head, F.array(F.lit("a\r\nb")))).alias("shown"), delegation.plain_table(F.array(head, F.array(F.lit("a")))).alias("plain"))


_RULES = """WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
f AS (SELECT o_custkey * 1000 + i // 9 AS doc_id, o_orderkey, i % 9 AS k FROM s), d AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 2) """


@query(_RULES + """SELECT f.doc_id, '[위임전결규정 매뉴얼]' || chr(10) || chr(CAST(65 + k AS INT)) || '. order ' || o_orderkey || chr(10) || 'about ' || o_orderkey || chr(10) || '| task | who |' || chr(10) || '| --- | --- |' || chr(10) || '| t | ' || k || ' |' AS chunk FROM f JOIN d USING (doc_id)
UNION ALL SELECT doc_id, 'before' FROM d UNION ALL SELECT doc_id, '[위임전결규정 매뉴얼]' || chr(10) || 'legend' FROM d""")
def delegation_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Delegation rules for each nine orders of a customer, as lettered categories with a text and a table; one category isn't enough."""
    from pyspark.sql.window import Window

    orders = table(spark, folder, "orders")
    # An order is five lines.
    n = parts(orders, 40_000)
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = orders.repartition(n, "o_custkey").select("o_custkey", F.col("o_orderkey").cast("string").alias("key"), k.alias("i"))
    rows = rows.select((F.col("o_custkey") * 1000 + F.floor(F.col("i") / 9)).cast("long").alias("doc_id"), "key", (F.col("i") % 9).alias("k"))
    line = F.concat(F.char(65 + F.col("k")), F.lit(". order "), "key", F.lit("\nabout "), "key", F.lit("\n| task | who |\n| --- | --- |\n| t | "), F.col("k").cast("string"), F.lit(" |"))
    text = text_of(rows.repartition(n, "doc_id"), line)
    docs = raw_documents(text.select("doc_id", F.concat(F.lit("before\n" + delegation.TITLE + "\nlegend\n"), "text").alias("text")))
    found, _, _ = delegation.delegation_drafts(docs)
    lines = F.concat(F.array_join("context", "\n"), F.when(F.size("context") > 0, "\n").otherwise(""), "body")
    return found.select("doc_id", lines.alias("chunk"))


_SPANS = """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS source_id, CAST(sum(l_quantity) OVER w - l_quantity AS INT) AS a, CAST(sum(l_quantity) OVER w AS INT) AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)),
p AS (SELECT doc_id, k AS piece_no, 40 * k AS a, 40 * k + 40 AS b FROM (SELECT l_orderkey AS doc_id, unnest(range(0, CAST(ceil(sum(l_quantity) / 40) AS BIGINT))) AS k FROM lineitem GROUP BY 1)) """


@query(_SPANS + "SELECT DISTINCT p.doc_id, CAST(piece_no AS INT) AS piece_no, source_id FROM p JOIN s ON p.doc_id = s.doc_id AND s.a < p.b AND s.b > p.a AND s.a < s.b")
def piece_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an order whose characters lie in the pieces of its text."""
    from pyspark.sql.window import Window

    upto = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("source_id"), F.sum("l_quantity").over(upto).cast("int").alias("end"), F.col("l_quantity").cast("int").alias("n"))
    pieces = lines.groupBy("doc_id").agg(F.max("end").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 40).cast("int") - 1)).alias("piece_no")).withColumn("start", F.col("piece_no") * 40).withColumn("end", F.col("piece_no") * 40 + 40)
    return claims.piece_sources(pieces, lines.withColumn("start", F.col("end") - F.col("n")), bucket=64)


# --- delimited text ---


@query("""WITH s AS (SELECT s_suppkey // 40 AS doc_id, s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 1 ELSE 2 END AS n_lines FROM supplier),
p AS (SELECT *, 2 + coalesce(sum(n_lines) OVER (PARTITION BY doc_id ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM s)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg('row ' || CAST(line AS BIGINT), ',' ORDER BY line) AS places FROM p WHERE s_suppkey % 4 = 0 GROUP BY doc_id""")
def irregular_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Records narrower than the header, named by the line at which they begin: others hold a line end in quotes."""
    line = F.when(F.col("s_suppkey") % 4 == 0, F.concat_ws(",", "s_suppkey", "s_name")).otherwise(F.concat_ws(",", "s_suppkey", "s_name", F.lit('"x,\n""y"""')))
    text = text_of(table(spark, folder, "supplier").select(F.floor(F.col("s_suppkey") / 40).cast("long").alias("doc_id"), F.col("s_suppkey").alias("k"), "s_suppkey", "s_name"), line)
    lines = delimited.text_lines(text.select("doc_id", F.concat(F.lit("key,name,note\n"), "text").alias("text")))
    found = delimited.irregular_records(delimited.records(lines))
    return found.select("doc_id", "n", F.array_join("locations", ",").alias("places"))


# --- web pages ---


@query(r"""WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS x FROM pages),
b AS (SELECT page_id, 0 AS k, 'heading' AS kind, regexp_extract(x, '<h1>(.*?)</h1>', 1, 's') AS t FROM a
  UNION ALL SELECT page_id, k, 'paragraph', regexp_replace(part, '</p>.*', '', 's') FROM (SELECT page_id, unnest(string_split(x, '<p>')[2:]) AS part, generate_subscripts(string_split(x, '<p>')[2:], 1) AS k FROM a)),
c AS (SELECT page_id, k, kind, replace(replace(replace(replace(replace(regexp_replace(replace(t, '<br>', chr(10)), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, k, kind, trim(regexp_replace(regexp_replace(t, '[ 	]+', ' ', 'g'), ' *
 *', chr(10), 'g'), ' ' || chr(10)) AS t FROM c)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS place, kind, t AS text, first_value(t) OVER (PARTITION BY page_id ORDER BY k) AS path FROM d WHERE t <> ''""")
def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Headings and paragraphs of all web pages, with the heading above each; paragraphs often lack their end."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "html")
    rows = markup.html_blocks(pages)
    return rows.select(F.col("doc_id").alias("page_id"), F.col("order").alias("place"), "kind", "text", F.array_join("heading_path", " > ").alias("path"))


# --- manuals: what safety labels go with; lines and the drafts that hold them ---

_ORDERS = "WITH o AS (SELECT o_custkey, o_orderkey, 'order ' || o_orderkey AS t, o_orderkey % 6 AS kind FROM orders) "


def _label_manual(spark: SparkSession, folder: str) -> DataFrame:
    """A manual for each order, with a label before a step, after a step, before a table, after one, alone, or alone in a section on safety."""
    t = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    kind = F.pmod("o_orderkey", F.lit(6))
    label, step, cells = F.concat(F.lit("[주의] "), t), F.concat(F.lit("2) "), t, F.lit(" 처리한다.")), F.concat(F.lit("| k | v |\n| --- | --- |\n| "), t, F.lit(" | x |"))
    body = F.when(kind == 0, F.array(label, step)).when(kind == 1, F.array(step, label)).when(kind == 2, F.array(label, cells)).when(kind == 3, F.array(cells, label)).otherwise(F.array(label))
    text = F.concat(F.when(kind == 5, "안전 수칙").otherwise("점검"), F.lit("\n"), F.array_join(body, "\n"))
    orders = table(spark, folder, "orders")
    return raw_documents(orders.repartition(parts(orders, 50_000), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))


@query(_ORDERS + """SELECT o_orderkey AS doc_id, '[문서] 텍스트 문서.txt' || chr(10) || CASE kind WHEN 5 THEN '[섹션] 안전 수칙' ELSE '[섹션] 점검' END || chr(10) || CASE kind
WHEN 0 THEN '[주의] ' || t || chr(10) || '2) ' || t || ' 처리한다.' WHEN 1 THEN '2) ' || t || ' 처리한다.' || chr(10) || '[주의] ' || t
WHEN 2 THEN '[주의] ' || t || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || t || ' | x |' WHEN 3 THEN '[주의] ' || t || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || t || ' | x |'
ELSE '[주의] ' || t END AS chunk, CASE kind WHEN 4 THEN 'review' ELSE 'ready' END AS status FROM o""")
def safety_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels stay with the step before or after, frame the table before or after, or are content: a warning outside of sections on safety."""
    docs = _label_manual(spark, folder)
    chunks, issues, _ = preprocess(docs, "manual")
    status = drafts.results(docs, chunks, issues).select("doc_id", "status")
    return chunks.select("doc_id", "chunk").join(status, "doc_id")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey AS doc_id, CAST(4 * (k - 1) + j AS INT) AS source_id, '[위치] 제' || k || '조(' || o_orderpriority || ')' AS location,
CASE j WHEN 1 THEN 'line ' || o_orderkey WHEN 2 THEN '' ELSE 'last ' || o_orderkey END AS line FROM o, (SELECT unnest([1, 3]) AS j)""")
def line_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The draft that holds each filled line of a statute, orders being its articles of two lines with an empty one between."""
    from pyspark.sql.window import Window

    # Named before they are numbered: Spark would deal the rows again for a key that is renamed after.
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderpriority")
    rows = orders.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey"))).withColumn("key", F.col("o_orderkey").cast("string"))
    line = F.concat(F.lit("제"), F.col("k").cast("string"), F.lit("조("), "o_orderpriority", F.lit(")\nline "), "key", F.lit("\n\nlast "), "key")
    docs = raw_documents(text_of(rows, line))
    found, _ = sections.law_drafts(docs)
    lines = docs.select(F.col("doc_id").alias("_d"), F.posexplode(F.split("text", "\n", -1)).alias("_k", "line"))
    held = claims.claims(found.withColumn("location", F.col("context")[1]), ["location"])
    # Lines are judged by the stored table's few bytes and would be sent whole; they are sorted instead.
    return held.join(lines.hint("merge"), (F.col("doc_id") == F.col("_d")) & (F.col("source_id") == F.col("_k"))).select("doc_id", "source_id", "location", "line")


# --- structured records, issues, sources ---


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """A record for each customer, by key sound or with one fault."""
    kind = F.pmod("c_custkey", F.lit(8))
    path = F.array(F.lit("top"))
    block = F.struct(F.lit("b1").alias("id"), F.when(kind == 1, "poem").otherwise("paragraph").alias("kind"), F.lit(0).alias("order"), path.alias("headingPath"), F.when(kind == 2, "  ").otherwise(F.col("c_name")).alias("text"))
    head = F.struct(F.when(kind == 3, "b1").otherwise("t1").alias("id"), F.lit("table").alias("kind"), F.lit(1).alias("order"), path.alias("headingPath"), F.array(F.array(F.when(kind == 2, "").otherwise("cell"), F.lit("")), F.array(F.lit(""))).alias("rows"))
    wide = F.struct(F.lit("t2").alias("id"), F.lit("table").alias("kind"), F.lit(2).alias("order"), path.alias("headingPath"), F.array(F.array_repeat(F.lit("x"), F.when(kind == 5, 513).otherwise(2))).alias("rows"))
    warning = F.struct(F.lit("W").alias("code"), F.when(kind == 6, "loud").otherwise("warning").alias("severity"), F.lit("m").alias("message"))
    parts = {"version": F.when(kind == 4, 2).otherwise(1), "fileName": F.concat(F.lit("dir/"), "c_name", F.lit(".txt")), "sourceFormat": F.lit("txt"), "extractionMethod": F.lit("local-text")}
    json = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.when(F.lit(k == "version"), v.cast("string")).otherwise(F.concat(F.lit('"'), v.cast("string"), F.lit('"')))) for k, v in parts.items()]), F.lit(',"blocks":['), F.concat_ws(",", F.to_json(block), F.to_json(head), F.when(kind != 2, F.to_json(wide))), F.lit('],"warnings":['), F.to_json(warning), F.lit("]}"))
    json = F.when(kind == 7, F.concat(F.lit('{"version":1,"blocks":"'), "c_name", F.lit('"}'))).otherwise(json)
    return spread(table(spark, folder, "customer"), "c_custkey", 4).select(F.col("c_custkey").alias("doc_id"), json.alias("json"))


@query("""SELECT c_custkey AS doc_id, CASE c_custkey % 8 WHEN 1 THEN 'INVALID_BLOCK' WHEN 2 THEN 'EMPTY_INPUT' WHEN 3 THEN 'INVALID_BLOCK' WHEN 4 THEN 'INVALID_DOCUMENT' WHEN 5 THEN 'INPUT_TOO_LARGE' WHEN 6 THEN 'INVALID_DOCUMENT' WHEN 7 THEN 'INVALID_DOCUMENT' END AS error,
CASE WHEN c_custkey % 8 = 0 THEN c_name || '.txt' END AS file_name FROM customer""")
def record_faults(spark: SparkSession, folder: str) -> DataFrame:
    """The first fault of structured records: shape, size, issues, blocks, repeated ids, no content."""
    return documents.validate(_records(spark, folder))


_SOUND = "WITH c AS (SELECT c_custkey AS doc_id, length(c_name) AS n, c_custkey % 8 AS k FROM customer) "


@query(_SOUND + """SELECT doc_id, CAST(CASE k WHEN 7 THEN 0 ELSE (4 + n + 4) + 3 + (1 + 1) + (2 + 3 + CASE k WHEN 2 THEN 2 ELSE n END) + (2 + 3 + CASE k WHEN 2 THEN 0 ELSE 4 END) + CASE k WHEN 2 THEN 0 WHEN 5 THEN 2 + 3 + 513 ELSE 2 + 3 + 2 END END AS BIGINT) AS n_text,
CAST(CASE k WHEN 7 THEN 0 WHEN 2 THEN 2 + 1 + 1 + (1 + 2 + 3) WHEN 5 THEN 3 + 1 + 1 + (1 + 2 + 3) + (1 + 1 + 513) ELSE 3 + 1 + 1 + (1 + 2 + 3) + (1 + 1 + 2) END AS BIGINT) AS n_items, k = 5 AS over_budget FROM c""")
def record_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Text and structure of records, sound or not, against their budgets; a table of 513 columns is over."""
    return documents.document_sums(_records(spark, folder))


@query(_SOUND + """SELECT doc_id, CAST(CASE k WHEN 2 THEN 2 ELSE n + 4 + CASE k WHEN 5 THEN 513 ELSE 2 END END AS BIGINT) AS n FROM c WHERE k <> 7""")
def source_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of texts and cells before anything is prepared; a record without a list of blocks has none."""
    return documents.source_length(documents.document_blocks(_records(spark, folder)))


@query("""SELECT l_suppkey AS doc_id, l_returnflag AS code, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem) GROUP BY 1, 2""")
def distinct_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issues of equal code, severity, message, count and places once each."""
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.struct("l_orderkey", "l_linenumber").alias("at"), F.col("l_returnflag").alias("code"), F.lit("warning").alias("severity"), F.lit("m").alias("message"), F.col("l_linenumber").cast("long").alias("n"), F.array("l_linestatus").alias("locations"))
    return documents.distinct_issues(rows).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '오류 확인 필요' WHEN 'O' THEN 'MISO 등록 가능' WHEN 'P' THEN '원문 확인 필요' END AS label, o_orderstatus <> 'F' AS allows_download, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 3 = 0 THEN 'blocked' WHEN o_orderstatus = 'P' OR o_orderkey % 3 = 1 THEN 'review' ELSE 'ready' END AS status FROM orders""")
def status_labels(spark: SparkSession, folder: str) -> DataFrame:
    """What a status is called, and what further issues make of it."""
    status = F.when(F.col("o_orderstatus") == "F", "blocked").when(F.col("o_orderstatus") == "P", "review").otherwise("ready")
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), status.alias("status"))
    rows = rows.withColumn("can_download", F.col("status") != "blocked").withColumn("p", documents.presentation(F.col("status")))
    issues = rows.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "error").otherwise("warning").alias("severity"))
    return documents.with_issues(rows, issues).select(F.col("doc_id").alias("o_orderkey"), "p.label", "p.allows_download", "status")


@query("""SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'remote ' || s_name END AS text, CASE s_suppkey % 4 WHEN 0 THEN 'local-docx' WHEN 1 THEN 'miso' END AS method, CASE s_suppkey % 4 WHEN 1 THEN 'DOCX_FALLBACK: bad zip' END AS warning, CASE s_suppkey % 4 WHEN 2 THEN 'timeout; local: bad zip' WHEN 3 THEN 'aborted' END AS error FROM supplier""")
def local_first(spark: SparkSession, folder: str) -> DataFrame:
    """Texts read locally, from the remote reader where that failed, or neither."""
    kind = F.pmod("s_suppkey", F.lit(4))
    files = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("doc_id"), F.when(kind == 0, F.col("s_name")).alias("local_text"), F.when(kind > 0, "bad zip").alias("local_error"), (kind == 3).alias("aborted"),
        F.when(kind != 2, F.concat(F.lit("remote "), "s_name")).alias("remote_text"), F.when(kind == 2, "timeout").alias("remote_error"),
    )
    return documents.prefer_local(files).select("doc_id", "text", "method", "warning", "error")


@query("""SELECT item_id AS doc_id, CASE WHEN item_id % 2 = 0 THEN '{"success":true,"data":{"item_id":' || item_id || ',"n":' || length(text) || '}}' ELSE '{"success":false,"error":{"code":"EMPTY_INPUT","message":"nothing"}}' END AS body FROM benchmark""")
def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Results as an interface answers them."""
    bad = F.col("item_id") % 2 != 0
    rows = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.struct("item_id", F.length("text").alias("n")).alias("data"), F.when(bad, "EMPTY_INPUT").alias("error_code"), F.when(bad, "nothing").alias("error_message"))
    return documents.envelope(rows)


def _searches(spark: SparkSession, folder: str) -> DataFrame:
    """A search answer for each seven suppliers, who are its laws, one alone as an object, every fifth without a date."""
    kept = F.when(F.col("s_suppkey") % 5 != 0, "20240101")
    law = F.struct(F.col("s_suppkey").alias("법령일련번호"), F.col("s_name").alias("법령명한글"), kept.alias("시행일자"), F.struct(F.lit("부처").alias("content")).alias("소관부처명"))
    rows = table(spark, folder, "supplier").groupBy(F.floor(F.col("s_suppkey") / 7).cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", law.alias("l")))).alias("x"))
    laws = F.transform("x", lambda x: x["l"])
    code = F.when(F.col("doc_id") % 7 == 6, "01").otherwise("00")
    one = F.to_json(F.struct(F.struct(code.alias("resultCode"), laws[0].alias("law"), F.lit("45").alias("totalCnt"), F.lit(1).alias("page")).alias("LawSearch")))
    many = F.to_json(F.struct(F.struct(code.alias("resultCode"), laws.alias("law"), F.lit("45").alias("totalCnt"), F.lit(1).alias("page")).alias("LawSearch")))
    return rows.select("doc_id", F.when(F.size("x") == 1, one).otherwise(many).alias("json"))


@query("""SELECT s_suppkey // 7 AS doc_id, CAST(s_suppkey AS VARCHAR) AS mst, s_name AS name, '부처' AS ministry FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey // 7 % 7 <> 6""")
def statute_search(spark: SparkSession, folder: str) -> DataFrame:
    """Laws of search answers; those without a date, and answers with an error code, give none."""
    return statutes.search_items(_searches(spark, folder)).select("doc_id", "mst", "name", "ministry")


@query("""SELECT DISTINCT s_suppkey // 7 AS doc_id, CAST(p AS INT) AS page FROM supplier, (SELECT unnest([2, 3]) AS p) WHERE s_suppkey // 7 % 7 <> 6""")
def search_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that a search has beyond its first: 45 laws at 20 a page."""
    return statutes.next_pages(statutes.search_pages(_searches(spark, folder)))


def _appendices(spark: SparkSession, folder: str) -> DataFrame:
    """A statute for each forty suppliers, who are its appendices, every third without a text, and an addendum."""
    bare = F.col("s_suppkey") % 3 == 0
    unit = F.struct(F.col("s_name").alias("별표제목"), F.when(~bare, F.array(F.concat(F.lit("내용 "), "s_name"))[0]).alias("별표내용"))
    rows = table(spark, folder, "supplier").groupBy(F.floor(F.col("s_suppkey") / 40).cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", unit.alias("u")))).alias("x"))
    law = F.struct(F.struct(F.lit("법").alias("법령명_한글")).alias("기본정보"), F.struct(F.struct(F.lit("부칙 &amp;lt;1&gt;").alias("부칙내용")).alias("부칙단위")).alias("부칙"), F.struct(F.transform("x", lambda x: x["u"]).alias("별표단위")).alias("별표"))
    return rows.select("doc_id", F.to_json(F.struct(law.alias("법령"))).alias("json"))


@query("""SELECT s_suppkey // 40 AS doc_id, '부칙 <1>' || chr(10) || string_agg(CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '내용 ' || s_name END, chr(10) ORDER BY s_suppkey) AS text,
CAST(count(*) FILTER (s_suppkey % 3 = 0) AS BIGINT) AS n_bare, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey) FILTER (s_suppkey % 3 = 0), '') AS bare FROM supplier GROUP BY 1""")
def statute_appendices(spark: SparkSession, folder: str) -> DataFrame:
    """Addenda and appendices of statutes; a title stands for a missing text, and is told."""
    rows = _appendices(spark, folder)
    warned = statutes.appendix_warnings(rows)
    both = statutes.statute_text(rows).join(warned, "doc_id", "left")
    return both.select("doc_id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n_bare"), F.coalesce(F.array_join("titles", ","), F.lit("")).alias("bare"))
