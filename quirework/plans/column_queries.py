"""Queries of single columns and small table operators over the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import headings as H
from quirework.functions import strings as S
from quirework.operators import blocks as B
from quirework.operators import drafts as D
from quirework.operators import edits, settings
from quirework.plans.queries import table, text_of
from quirework.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _pick(key: str, *choices: str):
    """One of the choices by key."""
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(F.col(key), F.lit(len(choices))) + 1).cast("int"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN (c_custkey || ':0') WHEN 1 THEN (c_custkey || ':' || c_nationkey) END AS key FROM customer""")
def article_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Article numbers of headings, with and without a branch number; a citation in a sentence has none."""
    key, branch = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    kind = F.pmod("c_custkey", F.lit(3))
    text = F.when(kind == 0, F.concat(F.lit(" 제 "), key, F.lit(" 조 (목적) "))).when(kind == 1, F.concat(F.lit("제"), key, F.lit("조의"), branch)).otherwise(F.concat(F.lit("제"), key, F.lit("조에 따라 정한다")))
    return table(spark, folder, "customer").select("c_custkey", H.article_key(text).alias("key"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'dash-' || p_size WHEN 1 THEN 'arabic' WHEN 2 THEN 'bare-arabic' WHEN 3 THEN 'step' END AS family,
CASE WHEN p_partkey % 5 < 4 THEN CAST(p_partkey AS INT) END AS value FROM part""")
def line_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers that open lines, by their family."""
    key = F.col("p_partkey").cast("string")
    kind = F.pmod("p_partkey", F.lit(5))
    text = (
        F.when(kind == 0, F.concat(F.col("p_size").cast("string"), F.lit("-"), key, F.lit(" x"))).when(kind == 1, F.concat(key, F.lit(") x"))).when(kind == 2, F.concat(key, F.lit(" x")))
        .when(kind == 3, F.concat(F.lit("Step "), key, F.lit(": x"))).otherwise(F.concat(F.lit("no "), key))
    )
    rows = table(spark, folder, "part").select("p_partkey", H.ordinal(text).alias("o"))
    return rows.select("p_partkey", "o.family", "o.value")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN s_nationkey || '.' || s_suppkey END AS prefix, CASE WHEN s_suppkey % 3 < 2 THEN 2 END AS depth FROM supplier""")
def dotted_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Dotted titles; work steps in sentence form aren't titles."""
    text = F.concat(F.col("s_nationkey").cast("string"), F.lit("."), F.col("s_suppkey").cast("string"), F.lit(" "), _pick("s_suppkey", "설비 개요", "Pump check", "밸브를 닫는다."))
    rows = table(spark, folder, "supplier").select("s_suppkey", H.dotted_heading(text).alias("h"))
    return rows.select("s_suppkey", "h.prefix", "h.depth")


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'safety' WHEN 1 THEN 'safety' WHEN 2 THEN 'step' WHEN 3 THEN 'section' WHEN 4 THEN 'section' ELSE 'paragraph' END AS class FROM orders""")
def manual_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Safety lines, steps, sections and paragraphs of manuals."""
    line = _pick("o_orderkey", "[주의] 고온", "※ 확인", "2. 밸브를 연다.", "작업 절차", "3. 준비 단계", "그 밖의 설명")
    return table(spark, folder, "orders").select("o_orderkey", H.manual_class(line).alias("class"))


@query(r"""SELECT c_custkey, '| ' || c_name || ' \| \\ | a<br>b |' AS line, c_name || ' | \' AS first_cell FROM customer""")
def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown rows with pipes, backslashes and line ends in their cells, rendered and read again."""
    row = S.render_row(F.array(F.concat("c_name", F.lit(" | \\")), F.lit("a\r\nb")))
    rows = table(spark, folder, "customer").select("c_custkey", row.alias("line"))
    return rows.withColumn("first_cell", S.row_cells(F.col("line"))[0])


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || '.txt' WHEN 1 THEN 'a_b_' || n_name WHEN 2 THEN n_name ELSE 'document.txt' END AS name FROM nation""")
def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    """File names without paths, control and unsafe characters."""
    kind = F.pmod("n_nationkey", F.lit(4))
    name = F.when(kind == 0, F.concat(F.lit("C:\\x/y/"), "n_name", F.lit(".txt"))).when(kind == 1, F.concat(F.lit("a:b?"), "n_name")).when(kind == 2, F.concat(F.lit(" "), "n_name", F.lit("\x07. ."))).otherwise(F.lit("/ ."))
    return table(spark, folder, "nation").select("n_nationkey", S.safe_file_name(name).alias("name"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'law' WHEN 1 THEN 'manual' WHEN 2 THEN 'general' WHEN 3 THEN 'excel' ELSE 'general' END AS type FROM customer""")
def document_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", S.doc_type(_pick("c_custkey", "law", "research_paper", "memo", "excel", "general")).alias("type"))


@query("""SELECT o_orderkey, o_orderkey % 5 < 3 AS is_page, o_orderkey % 5 = 3 AS is_decoration FROM orders""")
def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Page numbers, and short lines that may be a page's header."""
    key = F.col("o_orderkey").cast("string")
    kind = F.pmod("o_orderkey", F.lit(5))
    line = F.when(kind == 0, F.concat(key, F.lit(" - "), key)).when(kind == 1, F.concat(F.lit("- "), key, F.lit(" -"))).when(kind == 2, F.concat(F.lit("Page "), key, F.lit(" of 9"))).when(kind == 3, F.concat(F.lit("Quarterly report "), key)).otherwise(F.concat(F.lit("- bullet "), key))
    return table(spark, folder, "orders").select("o_orderkey", S.is_page_number(line).alias("is_page"), S.is_decoration_candidate(line).alias("is_decoration"))


def _order_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, chunks: twelve suppliers as the chunks of a document, in order."""
    rows = table(spark, folder, "supplier").groupBy(F.floor(F.col("s_suppkey") / 12).cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("l"))
    return rows.select("doc_id", F.transform("l", lambda x: x["s_name"]).alias("chunks"))


_CHUNKS = "WITH c AS (SELECT s_suppkey // 12 AS doc_id, list(s_name ORDER BY s_suppkey) AS chunks FROM supplier GROUP BY 1) "


@query("""SELECT doc_id, CAST(i AS INT) AS index, s_name AS chunk FROM (SELECT s_suppkey // 12 AS doc_id, s_name, row_number() OVER (PARTITION BY s_suppkey // 12 ORDER BY s_suppkey) - 1 AS i FROM supplier)
WHERE contains(lower(s_name), '7') OR contains('#' || CASE WHEN i < 999 THEN lpad(CAST(i + 1 AS VARCHAR), 3, '0') ELSE CAST(i + 1 AS VARCHAR) END, '7')""")
def chunk_search(spark: SparkSession, folder: str) -> DataFrame:
    return edits.search(_order_chunks(spark, folder), "7")


@query(_CHUNKS + """SELECT doc_id, CASE WHEN len(chunks) > 1 THEN array_to_string(chunks[1:1] || chunks[3:], ',') ELSE array_to_string(chunks, ',') END AS deleted,
CASE WHEN len(chunks) > 1 THEN array_to_string([chunks[1] || chr(10) || chr(10) || chunks[2]] || chunks[3:], ',') ELSE array_to_string(chunks, ',') END AS merged,
CASE WHEN len(chunks) > 1 THEN array_to_string([chunks[1] || chunks[2][1:4], chunks[2][5:]] || chunks[3:], ',') ELSE array_to_string(chunks, ',') END AS moved FROM c""")
def chunk_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The second chunk deleted, joined to the first, or with four characters moved to the first."""
    c = F.col("chunks")
    return _order_chunks(spark, folder).select(
        "doc_id", F.array_join(edits.delete(c, F.lit(1)), ",").alias("deleted"), F.array_join(edits.merge_next(c, F.lit(0)), ",").alias("merged"), F.array_join(edits.move_boundary(c, F.lit(0), F.lit(4)), ",").alias("moved"),
    )


@query("""SELECT o_custkey AS doc_id, o_orderkey AS version FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 50""")
def undo_versions(spark: SparkSession, folder: str) -> DataFrame:
    return edits.last_versions(table(spark, folder, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("version")))


@query("""SELECT l_orderkey AS doc_id, string_agg('line ' || l_linenumber || ' of ' || l_partkey, chr(10) || '@@@' || chr(10) ORDER BY l_linenumber, l_partkey) AS processed_text FROM lineitem GROUP BY 1""")
def serialized_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """An order's lines as chunks, joined by the consumer's separator."""
    text = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_partkey").cast("string"))
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey").alias("draft_no"), F.lit(0).alias("piece"), text.alias("chunk"))
    return D.serialize(rows)


@query("""SELECT l_orderkey, l_linenumber, repeat('  ', CAST(l_linenumber % 3 AS INT)) || CASE WHEN l_linenumber % 2 = 0 THEN (l_linenumber || '. ') ELSE '- ' END || l_linestatus || chr(10) || repeat('  ', CAST(l_linenumber % 3 AS INT)) || '   ' || l_returnflag AS item FROM lineitem""")
def list_items(spark: SparkSession, folder: str) -> DataFrame:
    """List items with their depth's indent, their own mark replaced, and a second line."""
    n = F.col("l_linenumber")
    text = F.concat(F.lit("* "), "l_linestatus", F.lit("\r\n"), "l_returnflag")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", B.render_item(text, F.pmod(n, F.lit(3)).cast("int"), n % 2 == 0, n).alias("item"))


@query("""SELECT s_suppkey // 40 AS doc_id, CAST(count(*) FILTER (s_suppkey % 4 = 0) AS BIGINT) AS n FROM supplier GROUP BY 1 HAVING count(*) FILTER (s_suppkey % 4 = 0) > 0""")
def irregular_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Delimited records narrower than the first one."""
    line = F.when(F.col("s_suppkey") % 4 == 0, F.concat_ws(",", "s_suppkey", "s_name")).otherwise(F.concat_ws(",", "s_suppkey", "s_name", F.lit('"x, y"')))
    text = text_of(table(spark, folder, "supplier").select(F.floor(F.col("s_suppkey") / 40).cast("long").alias("doc_id"), F.col("s_suppkey").alias("k"), "s_suppkey", "s_name"), line)
    rows = files.csv_sheets(text.select("doc_id", F.lit("s.csv").alias("name"), F.concat(F.lit("key,name,note\n"), "text").alias("text")))
    return files.irregular_records(rows).select("doc_id", "n")


@query("""SELECT p_partkey AS block_id, CASE WHEN p_partkey % 4 = 1 THEN 2 ELSE 1 END AS header_start, CASE WHEN p_partkey % 4 = 1 THEN 3 ELSE 1 END AS header_end,
CASE WHEN p_partkey % 4 = 1 THEN 'manual' ELSE 'detected' END AS header_source, CASE p_partkey % 4 WHEN 2 THEN 'duplicate' WHEN 3 THEN 'out-of-range' END AS reason FROM part""")
def header_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Manual header rows: one good update for a block, two for one block, one beyond the block's rows, or none."""
    part = table(spark, folder, "part")
    blocks = part.select(F.lit(1).alias("doc_id"), F.col("p_partkey").alias("block_id"), F.lit(1).alias("first_row"), F.lit(9).alias("last_row"), F.lit(1).alias("header_start"), F.lit(1).alias("header_end"))
    kind = F.pmod("p_partkey", F.lit(4))
    ends = F.when(kind == 1, F.array(F.lit(3))).when(kind == 2, F.array(F.lit(3), F.lit(4))).when(kind == 3, F.array(F.lit(12))).otherwise(F.array().cast("array<int>"))
    updates = part.select(F.lit(1).alias("doc_id"), F.col("p_partkey").alias("block_id"), F.lit(2).alias("header_start"), F.explode(ends).alias("header_end"))
    rows = settings.apply_header_ranges(blocks, updates).join(settings.rejected_updates(blocks, updates), ["doc_id", "block_id"], "left")
    return rows.select("block_id", "header_start", "header_end", "header_source", "reason")


@query("""SELECT c_nationkey AS doc_id, CAST(c_custkey AS INT) AS row, 2 AS col, CAST(CASE WHEN c_custkey % 10 < 3 THEN c_custkey - c_custkey % 10 ELSE c_custkey END AS INT) AS anchor_row, CASE WHEN c_custkey % 10 < 3 THEN 1 ELSE 2 END AS anchor_col FROM customer""")
def merged_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Cells and the merged areas of three rows that hold them."""
    customer = table(spark, folder, "customer")
    cells = customer.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").cast("int").alias("row"), F.lit(2).alias("col"))
    top = (F.col("c_custkey") - F.col("c_custkey") % 10).cast("int")
    merges = customer.select(F.col("c_nationkey").alias("doc_id"), top.alias("top")).distinct().select("doc_id", F.col("top").alias("merge_no"), "top", F.lit(1).alias("left"), (F.col("top") + 2).alias("bottom"), F.lit(3).alias("right"))
    return settings.containing_merge(cells, merges)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber * 100000000 + l_partkey AS k, CASE l_returnflag WHEN 'A' THEN '' ELSE l_returnflag || l_linestatus END AS m FROM lineitem),
f AS (SELECT l_orderkey, m, min(k) AS k FROM l WHERE m <> '' GROUP BY 1, 2)
SELECT o.l_orderkey, coalesce(string_agg(m, ',' ORDER BY k, m), '') AS marks FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN f ON o.l_orderkey = f.l_orderkey GROUP BY 1""")
def distinct_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Marks of an order once each, in the order in which its lines name them; one flag counts as empty."""
    mark = F.when(F.col("l_returnflag") == "A", "").otherwise(F.concat("l_returnflag", "l_linestatus"))
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", mark.alias("m")))).alias("l"))
    return rows.select("l_orderkey", F.array_join(S.ordered_distinct(F.transform("l", lambda x: x["m"])), ",").alias("marks"))
