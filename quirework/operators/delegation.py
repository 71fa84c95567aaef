"""Delegation rules: a titled manual with lettered categories and tables, chunked by category under the title.

A document counts if a line is the manual's title, the lettered lines after it are A, B, C, ... without a gap, and a
Markdown table follows the title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import strings as S
from quirework.operators import claims as C
from quirework.operators import lines as L
from quirework.operators import tables as T
from quirework.operators.split import greedy_groups, split_text
from quirework.operators.storage import cut, parts

# The manual's title and its categories.
TITLE = "[위임전결규정 매뉴얼]"
CATEGORY = r"^([A-J])\.\s+\S"


def plain_table(rows: Column) -> Column:
    """A Markdown table of rows as they are; nothing is escaped."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.transform(F.get(rows, F.lit(0)), lambda x: F.lit("---"))
    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(line(rule)), F.slice(lines, 2, F.size(rows))), "\n")).otherwise("")


def delegation_lines(docs: DataFrame) -> DataFrame:
    """Lines (doc_id, name, pos, line, table_no) of the documents (doc_id, name, text) that count, with `_title` (the
    title's place) and `category` (0 before the first)."""
    c = F.col
    # A plain text test first: no other document is cut into lines.
    some = docs.where(F.contains("text", F.lit(TITLE)))
    lines = L.mark_tables(L.explode_lines(some, ["name"]))
    doc = L.in_doc()
    lines = lines.withColumn("_title", F.min(F.when(S.trim(c("line")) == TITLE, c("pos"))).over(doc)).where("_title is not null")
    letter = F.regexp_extract(S.trim(c("line")), CATEGORY, 1)
    lines = lines.withColumn("_letter", F.when((c("pos") > c("_title")) & (letter != ""), letter))
    lines = lines.withColumn("category", F.count("_letter").over(L.upto()).cast("int"))
    # A document's n-th lettered line has the n-th letter.
    wrong = F.max(c("_letter").isNotNull() & (F.ascii("_letter") != 64 + c("category"))).over(doc)
    tabled = F.max((c("pos") > c("_title")) & (c("table_no") == c("pos"))).over(doc)
    lines = lines.withColumn("_ok", (F.max("category").over(doc) >= 2) & ~F.coalesce(wrong, F.lit(False)) & F.coalesce(tabled, F.lit(False)))
    return lines.where("_ok").drop("_ok")


def delegation_drafts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts and issues of the documents that count, and their doc_ids."""
    c = F.col
    lines = cut(delegation_lines(docs), "delegation-lines")
    # Each step below is dealt by a count that grows with the lines, whatever few bytes they take.
    n = parts(lines)
    lines = lines.repartition(n, "doc_id")
    names = F.max(F.when(c("_letter").isNotNull(), S.trim(c("line")))).over(Window.partitionBy("doc_id", "category"))
    marks = lines.where("_letter is not null").select("doc_id", c("category").alias("_group"), F.concat(F.lit(TITLE + "\n"), S.trim(c("line"))).alias("prefix"), "pos")
    lines = lines.withColumn("_name", names).where("_letter is null and pos <> _title")
    front = c("pos") < c("_title")
    prefix = F.when(front, "").when(c("category") == 0, TITLE).otherwise(F.concat(F.lit(TITLE + "\n"), "_name"))
    lines = lines.withColumn("prefix", prefix).withColumn("_group", F.when(front, -1).otherwise(c("category")))
    # Tables only count within categories; elsewhere they are text.
    lines = lines.withColumn("table_no", F.when(c("_group") > 0, c("table_no")))
    group = Window.partitionBy("doc_id", "_group").orderBy("pos")
    lines = lines.withColumn("_seg", F.sum(F.when(c("table_no").eqNullSafe(F.lag("table_no").over(group)), 0).otherwise(1)).over(group))
    keys = ["doc_id", "_group", "prefix"]
    room = F.lit(S.CHUNK_LIMIT) - F.when(c("prefix") == "", 0).otherwise(S.u16_length(c("prefix")) + 1)
    line = F.struct("pos", "line", (~S.is_blank(c("line"))).alias("filled"))
    text = lines.where("table_no is null").groupBy(*keys, "_seg").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(line)).alias("_l"))
    own = F.transform(F.filter("_l", lambda x: x["filled"]), lambda x: x["pos"])
    text = text.select(*keys, "pos", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("body"), own.alias("sources"))
    zero = F.lit(0)
    place = [c("pos").cast("int").alias("pos"), zero.alias("region"), zero.alias("place")]
    fits = S.u16_length(c("body")) <= room
    short = text.where(fits).select(*keys, *place, zero.alias("part"), "body", "sources")
    long = cut(text.where(~fits).withColumn("parts", split_text(c("body"), F.greatest(F.lit(1), room).cast("int"))), "delegation-parts")
    held = C.split_sources(long.where("size(sources) > 0"), ["doc_id", "pos"])
    long = long.select(*keys, "pos", F.posexplode("parts").alias("part", "body")).join(held.withColumnRenamed("piece_no", "part"), ["doc_id", "pos", "part"], "left")
    text = short.unionByName(long.select(*keys, *place, "part", "body", F.coalesce("sources", C.no_sources()).alias("sources")))
    rows = T.markdown_rows(lines.where("table_no is not null")).repartition(n, *T.TABLE)
    owners = lines.where("pos = table_no").select("table_no", *keys)
    lengths = owners.select("doc_id", "table_no", (S.u16_length(c("prefix")) + 1).alias("context_length"))
    packed = cut(T.table_drafts(rows, lengths), "delegation-tables")
    issues = T.table_issues(rows).select("doc_id", "code", F.lit("warning").alias("severity"), "n")
    issues = issues.unionByName(packed.where("blocked").select("doc_id", F.lit("TABLE_FRAMING_EXCEEDS_LIMIT").alias("code"), F.lit("error").alias("severity"), F.lit(1).cast("long").alias("n")))
    tables = packed.where("not blocked").repartition(n, *T.TABLE).join(owners, ["doc_id", "table_no"]).select(*keys, c("table_no").cast("int").alias("pos"), *[c(k).cast("int").alias(k) for k in ("region", "place", "part")], "body", T.line_numbers(c("table_no"), c("row_nos")).alias("sources"))
    # A category without content is its title alone.
    heads = _bare_categories(marks, lines).select("doc_id", "_group", F.lit("").alias("prefix"), c("pos").cast("int").alias("pos"), zero.alias("region"), zero.alias("place"), zero.alias("part"), c("prefix").alias("body"), C.no_sources().alias("sources"))
    pieces = text.where(F.when(c("_group") == 0, ~S.is_blank(c("body"))).otherwise(c("body") != "")).unionByName(tables)
    drafts = _joined(pieces, n).unionByName(heads)
    context = F.when(c("prefix") == "", F.array().cast("array<string>")).otherwise(F.array("prefix"))
    drafts = cut(drafts.select("doc_id", F.struct("pos", "region", "place", "part").alias("draft_no"), context.alias("context"), "body", "sources"), "delegation-drafts")
    blocked = packed.where("blocked").select("doc_id", "table_no").distinct()
    issues = issues.unionByName(C.lost_issues(L.expected_lines(lines.where(~S.is_blank(c("line"))), blocked), drafts))
    return drafts, issues, lines.select("doc_id").distinct()


def _bare_categories(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, _group, prefix, pos of categories all of whose lines are empty."""
    filled = lines.where("_group > 0 and line <> ''").select("doc_id", "_group").distinct()
    several = lines.where("_group > 0").groupBy("doc_id", "_group").count().where("count > 1").select("doc_id", "_group")
    return marks.join(filled.union(several).distinct(), ["doc_id", "_group"], "left_anti")


def _joined(pieces: DataFrame, n: int) -> DataFrame:
    """Pieces of a category joined by line ends as long as they fit one chunk under its title; others stay as they are."""
    c = F.col
    order = F.struct("pos", "region", "place", "part")
    own = pieces.where("_group > 0").repartition(n, "doc_id", "_group").groupBy("doc_id", "_group", "prefix").agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), S.u16_length(c("body")).alias("n"), c("body").alias("t"), "sources"))).alias("r"))
    own = own.withColumn("g", greedy_groups(F.transform("r", lambda x: (x["n"] + 1).cast("int")), (F.lit(S.CHUNK_LIMIT) - S.u16_length(c("prefix"))).cast("int")))
    own = own.select("doc_id", "_group", "prefix", F.explode(F.arrays_zip("r", "g")).alias("x"))
    own = own.groupBy("doc_id", "_group", "prefix", c("x.g").alias("g")).agg(F.array_sort(F.collect_list("x.r")).alias("r"))
    own = own.select("doc_id", "_group", "prefix", c("r")[0]["k"].alias("k"), F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("body"), F.flatten(F.transform("r", lambda x: x["sources"])).alias("sources"))
    return own.select("doc_id", "_group", "prefix", "k.*", "body", "sources").unionByName(pieces.where("_group <= 0").select("doc_id", "_group", "prefix", "pos", "region", "place", "part", "body", "sources"))
