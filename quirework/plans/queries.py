"""Queries of the preprocessing operators over the shared tables, and their SQL.

The tables hold prose, so structured texts are generated from the star schema and parsed again; the SQL states the
answer from the tables, without a parser.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import strings as S
from quirework.operators import blocks as B
from quirework.operators import drafts as D
from quirework.operators import lines as L
from quirework.operators import manuals, sections, tables, workbook
from quirework.operators.storage import parts, spread
from quirework.plans import reports
from quirework.plans.preprocess import preprocess, preprocess_results, raw_documents
from quirework.sources import files, statutes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(rows: DataFrame, line) -> DataFrame:
    """doc_id, text of ordered lines (doc_id, k, line columns)."""
    got = rows.select("doc_id", F.struct("k", line.alias("line")).alias("l")).groupBy("doc_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return got.select("doc_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


# Texts without headings, tables and page numbers, as all of these tables are, have a closed form: one section, whose text
# is cut after the last blank line that fits, else the last line end, sentence or blank. The SQL states that, step by step.
_PIECES = r"""WITH RECURSIVE t AS (SELECT doc_id, lang, rtrim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), ' ' || chr(9) || chr(10)) AS x FROM documents),
e AS (SELECT doc_id, CAST((length(x) - length(replace(x, '@@@', ''))) / 3 AS BIGINT) AS marks, replace(regexp_replace(x, '^([ \t]*\n)+', ''), '@@@', '＠＠＠') AS x FROM t WHERE regexp_matches(x, '\S')),
p AS (SELECT '[문서] 텍스트 문서.txt' || chr(10) || '[섹션] 전문' || chr(10) AS head),
s AS (SELECT doc_id, marks, 0 AS piece, CAST(NULL AS VARCHAR) AS body, x AS rest, CAST(0 AS BIGINT) AS cut FROM e
  UNION ALL
  SELECT doc_id, marks, CAST(piece + (body IS NOT NULL)::INT AS INT), left(rest, n), substr(rest, n + 1), n FROM (
    SELECT doc_id, marks, piece, body, rest, CASE WHEN length(rest) <= lim THEN length(rest)
      WHEN contains(w, chr(10) || chr(10)) THEN lim - instr(reverse(w), chr(10) || chr(10)) + 1
      WHEN contains(w, chr(10)) THEN lim - instr(reverse(w), chr(10)) + 1
      WHEN sentence > 0 THEN sentence WHEN contains(w, ' ') THEN lim - instr(reverse(w), ' ') + 1 ELSE lim END AS n
    FROM (SELECT *, length(regexp_extract(CASE WHEN regexp_matches(substr(rest, lim + 1, 1), '\s') THEN rtrim(w) ELSE w END, '^(.*[.!?。！？]+\s+)', 1, 's')) AS sentence
      FROM (SELECT s.*, 3800 - length(head) AS lim, left(rest, 3800 - length(head)) AS w FROM s, p WHERE rest <> ''))))
"""
_RESULTS = _PIECES.rstrip() + r""",
c AS (SELECT doc_id, count(*) AS n, max(length(head || body)) AS longest, sum(length(head || body)) + 5 * (count(*) - 1) AS total, any_value(marks) AS marks FROM s, p WHERE body IS NOT NULL GROUP BY doc_id),
r AS (SELECT t.doc_id, t.lang, CAST(coalesce(n, 0) AS BIGINT) AS chunk_count, CAST(coalesce(longest, 0) AS BIGINT) AS longest_chunk, CAST(coalesce(total, 0) AS BIGINT) AS processed_length, CAST(coalesce(marks, 0) AS BIGINT) AS source_collisions,
  CASE WHEN n IS NULL THEN '[{"code":"empty-result","severity":"error","n":1}]' WHEN marks > 0 THEN '[{"code":"source-separator-replaced","severity":"warning","n":' || marks || '}]' ELSE '[]' END AS issues,
  CASE WHEN n IS NULL THEN 'blocked' WHEN marks > 0 THEN 'review' ELSE 'ready' END AS status FROM t LEFT JOIN c ON t.doc_id = c.doc_id)
"""


@query(_PIECES + "SELECT doc_id, 0 AS pos, 0 AS region, 0 AS place, 0 AS part, piece, head || body AS chunk FROM s, p WHERE body IS NOT NULL")
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all documents as general reports."""
    chunks, _, _ = preprocess(raw_documents(spread(table(spark, folder, "documents"), "doc_id")))
    return chunks.select("doc_id", F.col("draft_no.pos").alias("pos"), "draft_no.region", "draft_no.place", "draft_no.part", "piece", "chunk")


@query(_RESULTS + """SELECT doc_id, chunk_count, longest_chunk, processed_length, CAST(0 AS BIGINT) AS over_safe_limit, CAST(0 AS BIGINT) AS over_consumer_limit, CAST(0 AS BIGINT) AS empty_chunks, CAST(0 AS BIGINT) AS unresolved_collisions,
source_collisions, issues, status, status <> 'blocked' AS can_download FROM r""")
def document_results(spark: SparkSession, folder: str) -> DataFrame:
    """Counters and status of all documents."""
    return preprocess_results(raw_documents(spread(table(spark, folder, "documents"), "doc_id"))).withColumn("issues", F.to_json("issues"))


@query(_RESULTS + "SELECT lang, status, count(*) AS documents, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM r GROUP BY ROLLUP (lang, status)")
def status_report(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and chunks by language and status, with subtotals."""
    docs = table(spark, folder, "documents")
    return reports.status_by(preprocess_results(raw_documents(spread(docs, "doc_id"))), docs, "lang")


@query(r"""SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5
FROM (SELECT doc_id, rtrim(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), ' ' || chr(9) || chr(10)) AS t FROM documents)""")
def prepare_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = L.prepare(raw_documents(spread(table(spark, folder, "documents"), "doc_id")))
    return docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(r"""SELECT conv_id, turn, replace(text || '@@@' || role, '@@@', '＠＠＠') AS escaped,
CAST((length(text || '@@@' || role) - length(replace(text || '@@@' || role, '@@@', ''))) / 3 AS BIGINT) AS n FROM conversations""")
def separator_escape(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat("text", F.lit("@@@"), "role")
    return table(spark, folder, "conversations").select("conv_id", "turn", S.escape_separator(text).alias("escaped"), S.count_separators(text).alias("n"))


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'local-text' WHEN 1 THEN 'local-excel' WHEN 2 THEN 'local-docx' WHEN 3 THEN 'miso' ELSE 'unsupported' END AS route FROM nation""")
def file_routes(spark: SparkSession, folder: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in ("a.CSV", "b.xlsx", "c.docx", "d.tar.pdf", "e.hwp")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return table(spark, folder, "nation").select("n_nationkey", S.file_route(F.concat("n_name", F.lit("."), ext)).alias("route"))


LAW_SQL = """SELECT c_custkey // 40 AS doc_id, '[위치] 제' || (r_regionkey + 1) || '편 ' || r_name || ' > 제' || (n_nationkey + 1) || '장 ' || n_name || ' > 제' || c_custkey || '조(' || c_name || ')' AS location,
c_mktsegment || ' 고객' AS body FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(LAW_SQL)
def law_articles(spark: SparkSession, folder: str) -> DataFrame:
    """A statute for each forty customers, who are its articles; regions are parts, nations are chapters."""
    region, nation, customer = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    rows = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("doc_id", F.floor(F.col("c_custkey") / 40).cast("long"))
    key = lambda *parts: F.struct(*[F.coalesce(F.col(p), F.lit(-1)).cast("long").alias(f"k{i}") if p else F.lit(-1).cast("long").alias(f"k{i}") for i, p in enumerate(parts)]).alias("k")
    article = rows.select("doc_id", key("r_regionkey", "n_nationkey", "c_custkey"), F.concat(F.lit("제"), F.col("c_custkey").cast("string"), F.lit("조("), "c_name", F.lit(") "), "c_mktsegment", F.lit(" 고객")).alias("line"))
    chapter = rows.select("doc_id", key("r_regionkey", "n_nationkey", None), F.concat(F.lit("제"), (F.col("n_nationkey") + 1).cast("string"), F.lit("장 "), "n_name").alias("line")).distinct()
    part = rows.select("doc_id", key("r_regionkey", None, None), F.concat(F.lit("제"), (F.col("r_regionkey") + 1).cast("string"), F.lit("편 "), "r_name").alias("line")).distinct()
    docs = raw_documents(text_of(article.unionByName(chapter).unionByName(part), F.col("line")))
    drafts, _ = sections.law_drafts(docs)
    return drafts.select("doc_id", F.col("context")[1].alias("location"), "body")


@query("""SELECT n_regionkey AS doc_id, '[섹션] ' || n_name AS section, 'nation ' || n_nationkey || ' lies here' AS body FROM nation""")
def general_sections(spark: SparkSession, folder: str) -> DataFrame:
    """One report a region: nations are sections under Markdown headings."""
    nation = table(spark, folder, "nation")
    line = F.concat(F.lit("## "), "n_name", F.lit("\nnation "), F.col("n_nationkey").cast("string"), F.lit(" lies here"))
    docs = raw_documents(text_of(nation.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("k"), "n_name", "n_nationkey"), line))
    drafts, _ = sections.general_drafts(docs)
    return drafts.select("doc_id", F.col("context")[1].alias("section"), "body")


@query("""SELECT o_custkey AS doc_id, '# ' || o_orderpriority AS section, '※ 주의' || chr(10) || string_agg('주문 ' || o_orderkey || ' 처리한다.', chr(10) ORDER BY o_orderkey) AS body FROM orders GROUP BY 1, 2""")
def manual_steps(spark: SparkSession, folder: str) -> DataFrame:
    """A manual for each customer: order priorities are sections, orders are steps; a safety line opens each section."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "doc_id")
    n_parts = parts(orders, 100_000)
    key = lambda n: F.struct("o_orderpriority", n.cast("long").alias("n")).alias("k")
    step = orders.select("doc_id", key(F.col("o_orderkey")), F.concat(F.lit("주문 "), F.col("o_orderkey").cast("string"), F.lit(" 처리한다.")).alias("line"))
    head = orders.select("doc_id", "o_orderpriority").distinct().select("doc_id", key(F.lit(-1)), F.concat(F.lit("# "), "o_orderpriority", F.lit("\n※ 주의")).alias("line"))
    drafts, _ = manuals.manual_drafts(raw_documents(text_of(step.unionByName(head).repartition(n_parts, "doc_id"), F.col("line"))))
    return drafts.select("doc_id", F.regexp_replace(F.col("context")[1], r"^\[섹션\] ", "").alias("section"), "body")


@query("""SELECT s_suppkey AS doc_id, '[문서] 텍스트 문서.txt' || chr(10) || CASE s_suppkey % 4 WHEN 0 THEN '[위치] 제' || s_suppkey || '조(목적)' || chr(10) || '본문 ' || s_name WHEN 1 THEN '[섹션] # 절차' || chr(10) || s_name || ' 처리한다.' WHEN 2 THEN '[섹션] 머리' || chr(10) || 'plain ' || s_name ELSE '[섹션] 전문' || chr(10) || 'memo ' || s_name END AS chunk FROM supplier""")
def routed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of four document types in one table, each row by its own chunker."""
    supplier = table(spark, folder, "supplier")
    kind = F.pmod("s_suppkey", F.lit(4))
    law = F.concat(F.lit("제"), F.col("s_suppkey").cast("string"), F.lit("조(목적) 본문 "), "s_name")
    text = F.when(kind == 0, law).when(kind == 1, F.concat(F.lit("# 절차\n"), "s_name", F.lit(" 처리한다."))).when(kind == 2, F.concat(F.lit("## 머리\nplain "), "s_name")).otherwise(F.concat(F.lit("memo "), "s_name"))
    of = F.when(kind == 0, "law").when(kind == 1, "research_paper").when(kind == 2, "general").otherwise("letter")
    docs = raw_documents(supplier.select("s_suppkey", text.alias("text"), of.alias("type")), "s_suppkey", kind="type")
    return preprocess(docs)[0].select("doc_id", "chunk")


@query("""SELECT s_suppkey // 40 AS doc_id, CAST(CASE WHEN count(*) < 2 THEN 0 ELSE count(*) + greatest(count(*) - 2, 0) END AS BIGINT) AS n_removed FROM supplier GROUP BY 1""")
def page_decoration(spark: SparkSession, folder: str) -> DataFrame:
    """A paged text for each forty suppliers, who are pages with one header and their number."""
    supplier = table(spark, folder, "supplier")
    page = F.concat(F.lit("Supplier report\n"), "s_name", F.lit(" delivers.\n- "), F.col("s_suppkey").cast("string"), F.lit(" -"))
    docs = raw_documents(text_of(supplier.select(F.floor(F.col("s_suppkey") / 40).cast("long").alias("doc_id"), F.col("s_suppkey").alias("k"), "s_name", "s_suppkey"), page))
    return L.prepare(docs).select("doc_id", "n_removed")


@query("""SELECT p_partkey // 500 AS doc_id, p_brand AS sheet, CAST(dense_rank() OVER (PARTITION BY p_partkey // 500, p_brand ORDER BY p_type) AS BIGINT) AS number, CAST(count(*) + 1 AS BIGINT) AS n_rows, p_type || '/of ' || p_brand AS titles FROM part GROUP BY 1, p_brand, p_type""")
def sheet_regions(spark: SparkSession, folder: str) -> DataFrame:
    """A workbook for each 500 parts: brands are sheets, types are tables with two title rows, an empty row lies between them."""
    part = table(spark, folder, "part").withColumn("doc", F.floor(F.col("p_partkey") / 500).cast("long"))
    from pyspark.sql.window import Window

    place = Window.partitionBy("doc", "p_brand").orderBy("p_type", "o", "p_partkey")
    data = part.select("doc", "p_brand", "p_type", F.lit(4).alias("o"), "p_partkey", F.array(F.concat(F.lit("name "), "p_name"), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("cells"))
    brands = part.select("doc", "p_brand", "p_type").distinct()
    extra = brands.select("doc", "p_brand", "p_type", F.explode(F.array(
        F.struct(F.lit(0).alias("o"), F.array(F.lit(""), F.lit("")).alias("cells")), F.struct(F.lit(1).alias("o"), F.array(F.col("p_type"), F.lit("")).alias("cells")), F.struct(F.lit(2).alias("o"), F.array(F.lit(""), F.concat(F.lit("of "), "p_brand")).alias("cells")), F.struct(F.lit(3).alias("o"), F.array(F.lit("name"), F.lit("size")).alias("cells")),
    )).alias("x")).select("doc", "p_brand", "p_type", "x.o", F.lit(-1).cast(part.schema["p_partkey"].dataType).alias("p_partkey"), "x.cells")
    sheets = data.unionByName(extra).withColumn("row_no", F.row_number().over(place))
    sheets = sheets.select(F.col("doc").alias("doc_id"), F.lit("parts.xlsx").alias("name"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("sheet_no"), F.col("p_brand").alias("sheet"), "row_no", "cells")
    return workbook.sheet_tables(sheets).groupBy("doc_id", "sheet", F.col("number").cast("long").alias("number"), F.array_join("titles", "/").alias("titles")).agg(F.count("*").alias("n_rows"))


# Rows of equal length, so that the place of each chunk's end is plain arithmetic.
@query("""WITH r AS (SELECT c_custkey // 200 AS doc_id, c_custkey, row_number() OVER (PARTITION BY c_custkey // 200 ORDER BY c_custkey) - 1 AS i FROM customer)
SELECT doc_id, '| name | segment |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ' | ' || repeat('s', 80) || ' |', chr(10) ORDER BY c_custkey) AS body
FROM r GROUP BY doc_id, i // ((3800 - 40 - 34) // 98)""")
def table_packing(spark: SparkSession, folder: str) -> DataFrame:
    """A table for each 200 customers, who are its rows, packed into chunks under a repeated header."""
    from pyspark.sql.window import Window

    doc = F.floor(F.col("c_custkey") / 200).cast("long").alias("doc_id")
    customer = table(spark, folder, "customer").select(doc, "c_custkey")
    cells = F.array(F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")), F.lit("s" * 80))
    rows = customer.select("doc_id", F.lit(0).alias("table_no"), F.row_number().over(Window.partitionBy("doc_id").orderBy("c_custkey")).alias("row_no"), cells.alias("cells"))
    head = customer.select("doc_id").distinct().select("doc_id", F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), F.array(F.lit("name"), F.lit("segment")).alias("cells"))
    lengths = head.select("doc_id", "table_no", F.lit(40).alias("context_length"))
    return tables.table_drafts(rows.unionByName(head), lengths).select("doc_id", "body")


@query("""WITH l AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)
SELECT doc_id, CAST(2 * k AS INT) AS block_id, CAST(k // 3 AS BIGINT) AS ordinal FROM l WHERE k % 3 = 0
UNION ALL SELECT doc_id, CAST(2 * k AS INT), CAST(CASE k % 3 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) FROM l WHERE k % 3 <> 0
UNION ALL SELECT doc_id, CAST(2 * k + 1 AS INT), CAST(1 AS BIGINT) FROM l""")
def list_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of three depths, the deepest below ten others: a shallower item starts the numbers under it anew."""
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    lineitem = table(spark, folder, "lineitem")
    # A line is two blocks, which stay where its order lies.
    lines = lineitem.repartition(parts(lineitem), "l_orderkey").select(F.col("l_orderkey").alias("doc_id"), k.alias("k"))
    top = F.struct((F.col("k") * 2).alias("block_id"), F.when(F.col("k") % 3 == 0, 0).otherwise(9).alias("depth"))
    deep = F.struct((F.col("k") * 2 + 1).alias("block_id"), F.lit(12).alias("depth"))
    blocks = lines.select("doc_id", F.explode(F.array(top, deep)).alias("b")).select("doc_id", "b.*", F.col("b.block_id").alias("order"), F.lit("list-item").alias("kind"), F.lit(True).alias("ordered"))
    return B.list_ordinals(blocks).select("doc_id", "block_id", "ordinal")


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_suppkey AS doc_id, l_partkey, count(*) AS c FROM lineitem GROUP BY 1, 2) WHERE c > 1 GROUP BY 1""")
def claim_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that a supplier's lines claim more often than once."""
    lineitem = table(spark, folder, "lineitem")
    claims = lineitem.select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("source_id")).repartition(parts(lineitem), "doc_id", "source_id")
    return B.claim_mismatches(claims.distinct(), claims)


@query("""SELECT l_partkey AS doc_id, l_suppkey AS source_id, min(l_orderkey) AS draft_no FROM lineitem GROUP BY 1, 2""")
def first_claims(spark: SparkSession, folder: str) -> DataFrame:
    claims = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("draft_no"))
    return B.first_claims(claims)


@query("""SELECT r_regionkey AS doc_id, r_name AS name, string_agg('제' || n_nationkey || '조(' || n_name || ')' || chr(10) || '항 ' || n_nationkey || chr(10) || '호 <' || n_name || '>', chr(10) ORDER BY n_nationkey) AS text
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def statute_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """One statute payload a region, nations as articles with one paragraph (an object, not a list) and one item."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    key = F.col("n_nationkey").cast("string")
    point = F.array(F.struct(F.concat(F.lit("호 &lt;"), "n_name", F.lit("&gt;")).alias("호내용")))
    article = F.struct(F.concat(F.lit("제"), key, F.lit("조("), "n_name", F.lit(")")).alias("조문내용"), F.struct(F.concat(F.lit("항 "), key).alias("항내용"), point.alias("호")).alias("항"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", article.alias("a")))), lambda x: x["a"]).alias("l"))
    json = F.to_json(F.struct(F.struct(F.struct(F.col("r_name").alias("법령명_한글")).alias("기본정보"), F.struct(F.col("l").alias("조문단위")).alias("조문")).alias("법령")))
    return statutes.statute_text(rows.select(F.col("r_regionkey").alias("doc_id"), json.alias("json")))


@query("""SELECT s_suppkey // 40 AS doc_id, CAST(row_number() OVER (PARTITION BY s_suppkey // 40 ORDER BY s_suppkey) AS INT) AS row_no, s_suppkey || '|' || s_name || '|a' || chr(10) || '"b", ' || s_name AS cells FROM supplier
UNION ALL SELECT DISTINCT s_suppkey // 40, 0, 'key|name|note' FROM supplier""")
def csv_records(spark: SparkSession, folder: str) -> DataFrame:
    """A delimited text for each forty suppliers, with quoted line ends, read as sheet rows."""
    line = F.concat_ws(",", "s_suppkey", "s_name", F.concat(F.lit('"a\n""b"", '), "s_name", F.lit('"')))
    text = text_of(table(spark, folder, "supplier").select(F.floor(F.col("s_suppkey") / 40).cast("long").alias("doc_id"), F.col("s_suppkey").alias("k"), "s_suppkey", "s_name"), line)
    rows = files.csv_sheets(text.select("doc_id", F.lit("s.csv").alias("name"), F.concat(F.lit("key,name,note\n"), "text").alias("text")))
    return rows.select("doc_id", "row_no", F.array_join("cells", "|").alias("cells"))


@query("""SELECT item_id, CAST(length(text) AS BIGINT) AS longest_chunk, CAST(0 AS BIGINT) AS over_safe_limit, 'ready' AS status FROM benchmark""")
def edited_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts as edited chunks, validated and not split again."""
    rows = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("draft_no"), F.col("text").alias("chunk"))
    return D.revalidate(rows).select(F.col("doc_id").alias("item_id"), "longest_chunk", "over_safe_limit", "status")
