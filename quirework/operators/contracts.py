"""Contracts: structured documents whose articles are found by their headings, packed whole into chunks.

blocks: doc_id, name, block_id, order, kind, depth, ordered, text, rows. A document counts as a contract if it has no
raw text, at least three article headings and two articles with a body. A list of contents is left out: it ends where
article numbers begin to repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import headings as H
from quirework.functions import strings as S
from quirework.operators import blocks as B
from quirework.operators import tables as T
from quirework.operators.storage import cut

LEAST_ARTICLES, LEAST_BODIES = 3, 2
#: A list of contents repeats at least this many numbers within so many headings, and is at least so dense.
REPEATS, AHEAD, DENSITY = 3, 12, 0.6


def render_table(rows: Column) -> Column:
    """A Markdown table as wide as its widest row; bars are escaped, line ends become breaks."""
    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    cell = lambda r, i: F.regexp_replace(F.replace(F.coalesce(F.get(r, i), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r\n?|\n", "<br>")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: cell(r, i)), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    return F.when(width > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(rows), F.lit(1)))), "\n")).otherwise("")


def has_source(kind: Column, text: Column, rows: Column) -> Column:
    filled = F.exists(rows, lambda r: F.exists(r, lambda c: ~S.is_blank(F.coalesce(c, F.lit("")))))
    return F.coalesce(F.when(kind == "table", filled).otherwise(~S.is_blank(F.coalesce(text, F.lit("")))), F.lit(False))


def rendered(blocks: DataFrame) -> DataFrame:
    """Blocks with `shown`, the text they give, from their ordinals."""
    c = F.col
    item = B.render_item(c("text"), c("depth"), c("ordered"), c("ordinal"))
    shown = F.when(c("kind") == "table", render_table(c("rows"))).when(c("kind") == "list-item", item).otherwise(S.trim(F.coalesce("text", F.lit(""))))
    return B.list_ordinals(blocks).withColumn("shown", shown).drop("ordinal")


def articles(blocks: DataFrame) -> DataFrame:
    """Filled blocks of contracts with at (place in the document), unit (article from 1, 0 before) and heading."""
    c = F.col
    doc = Window.partitionBy("doc_id")
    rows = blocks.withColumn("_raw", F.max(c("kind") == "raw-text").over(doc)).where("not _raw").drop("_raw")
    rows = rows.where(has_source(c("kind"), c("text"), c("rows"))).withColumn("at", F.row_number().over(doc.orderBy("order", "block_id")) - 1)
    key = F.when(~c("kind").isin("table", "raw-text"), H.article_key(F.coalesce("text", F.lit(""))))
    rows = cut(rows.withColumn("_key", key), "contract-blocks")
    by = doc.orderBy("at")
    heads = rows.where("_key is not null").select("doc_id", "at", "_key").withColumn("i", F.row_number().over(by) - 1)
    heads = heads.withColumn("_first", F.min("i").over(Window.partitionBy("doc_id", "_key")))
    heads = heads.withColumn("_kinds", F.count_if(c("_first") == c("i")).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    ahead = F.collect_list("_first").over(by.rowsBetween(0, AHEAD - 1))
    heads = heads.withColumn("_again", F.size(F.filter(F.slice(ahead, F.lit(1), F.greatest(F.least(F.lit(AHEAD), c("_kinds")), F.lit(1)).cast("int")), lambda x: x < c("i"))))
    heads = heads.withColumn("_list", F.first("at").over(by))
    dense = c("i") / F.greatest(c("at") - c("_list"), F.lit(1)) >= DENSITY
    starts = (c("_first") < c("i")) & (c("_kinds") >= REPEATS) & (c("_again") >= REPEATS) & dense
    heads = heads.withColumn("_start", F.min(F.when(starts, c("i"))).over(doc))
    heads = heads.where(c("i") >= F.coalesce("_start", F.lit(0)))
    heads = heads.withColumn("unit", F.row_number().over(by)).withColumn("_n", F.count("*").over(doc)).where(c("_n") >= LEAST_ARTICLES)
    opens = heads.where("unit = 1").select("doc_id", c("at").alias("_from"), F.when(c("_start").isNotNull(), c("_list")).otherwise(c("at")).alias("_to"))
    rows = rows.join(opens, "doc_id").where("at >= _from or at < _to")
    rows = rows.join(heads.select("doc_id", "at", "unit"), ["doc_id", "at"], "left").withColumn("heading", c("unit").isNotNull())
    return rows.withColumn("unit", F.coalesce(F.last("unit", True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_key", "_from", "_to")


def _label(heading: Column) -> Column:
    return S.trim(F.regexp_replace(heading, r"\s*\([^()\n]*\)\s*\z", ""))


def _range(first: Column, last: Column) -> Column:
    return F.concat(F.lit("[조문 범위] "), F.when(first == last, first).otherwise(F.concat(first, F.lit(" ~ "), last)))


def _packs(units: DataFrame) -> DataFrame:
    """Add `pack`: consecutive articles that fit one chunk share one, a longer article has its own. Only lengths are folded."""
    c = F.col
    listed = units.groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(F.struct("unit", "label", "n"))).alias("u"))
    head = S.u16_length(F.concat(F.lit("[문서] "), c("name"))) + 2

    def fits(first: Column, last: Column, n: Column) -> Column:
        return head + S.u16_length(_range(first, last)) + n <= S.CHUNK_LIMIT

    start = F.struct(F.lit(0).alias("pack"), F.lit(None).cast("string").alias("first"), F.lit(0).cast("int").alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        alone = fits(x["label"], x["label"], x["n"])
        joins = alone & s["first"].isNotNull() & fits(F.coalesce(s["first"], x["label"]), x["label"], s["n"] + 2 + x["n"])
        pack = F.when(joins, s["pack"]).otherwise(s["pack"] + 1)
        first = F.when(joins, s["first"]).when(alone, x["label"])
        return F.struct(pack.alias("pack"), first.alias("first"), F.when(joins, s["n"] + 2 + x["n"]).otherwise(x["n"]).cast("int").alias("n"), F.concat(s["out"], F.array(pack)).alias("out"))

    packs = listed.withColumn("p", F.aggregate("u", start, step, lambda s: s["out"])).select("doc_id", F.explode(F.arrays_zip(F.transform("u", lambda x: x["unit"]).alias("unit"), c("p").alias("pack"))).alias("x"))
    own = units.join(packs.select("doc_id", c("x.unit").alias("unit"), c("x.pack").alias("pack")), ["doc_id", "unit"])
    return own.withColumn("whole", fits(c("label"), c("label"), c("n")))


def contract_drafts(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts and issues of the documents that are contracts, and claims (doc_id, draft_no, source_id) of their blocks."""
    c = F.col
    rows = cut(rendered(articles(blocks)), "contract-rows")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~c("heading") & (c("shown") != ""), F.struct("at", "shown")))), lambda x: x["shown"]), "\n")
    title = F.max(F.when(c("heading"), S.trim(F.regexp_replace("text", r"\s+", " "))))
    units = rows.where("unit > 0").groupBy("doc_id", "name", "unit").agg(F.min("at").alias("at"), title.alias("heading"), text.alias("body"))
    units = units.withColumn("_b", F.count_if(~S.is_blank(c("body"))).over(Window.partitionBy("doc_id"))).where(c("_b") >= LEAST_BODIES)
    units = units.withColumn("shown", F.when(c("body") == "", c("heading")).otherwise(F.concat("heading", F.lit("\n"), "body")))
    units = units.withColumn("label", _label(c("heading"))).withColumn("n", S.u16_length(c("shown")).cast("int"))
    units = cut(_packs(units), "contract-units")
    zero, document = F.lit(0), F.concat(F.lit("[문서] "), c("name"))
    packed = units.where("whole").groupBy("doc_id", "name", "pack").agg(F.min("at").alias("pos"), F.array_sort(F.collect_list(F.struct("unit", "label", "shown"))).alias("u"))
    packed = packed.withColumn("context", F.array(document, _range(c("u")[0]["label"], F.element_at("u", -1)["label"]))).withColumn("body", F.array_join(F.transform("u", lambda x: x["shown"]), "\n\n"))
    packed = packed.select("doc_id", "name", "pos", zero.alias("region"), zero.alias("place"), zero.alias("part"), "context", "body", F.lit(True).alias("pack"))
    long, issues = _long_articles(rows, units.where("not whole"))
    drafts = packed.unionByName(long.withColumn("pack", F.lit(False)))
    # What stands before the articles goes into the first pack if it fits, else before it.
    before = rows.join(units.select("doc_id").distinct(), "doc_id").where("unit = 0 and shown <> ''")
    before = before.groupBy("doc_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]), "\n\n").alias("_before"))
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "region", "place", "part")) == 1
    drafts = drafts.withColumn("_first", first).join(before.drop("name"), "doc_id", "left")
    room = S.u16_length(F.array_join("context", "\n")) + 1 + S.u16_length(c("_before")) + 2 + S.u16_length(c("body")) <= S.CHUNK_LIMIT
    drafts = cut(drafts.withColumn("_merges", F.coalesce(c("_first") & c("pack") & room, F.lit(False))), "contract-drafts")
    alone = before.join(drafts.where("_merges").select("doc_id"), "doc_id", "left_anti")
    alone = alone.select("doc_id", F.lit(-1).alias("pos"), zero.alias("region"), zero.alias("place"), zero.alias("part"), F.array(document, F.lit("[섹션] 전문")).alias("context"), c("_before").alias("body"))
    body = F.when(c("_merges"), F.concat("_before", F.lit("\n\n"), "body")).otherwise(c("body"))
    out = drafts.withColumn("body", body).select(*alone.columns).unionByName(alone)
    out = out.select("doc_id", F.struct(*[c(k).cast("int").alias(k) for k in ("pos", "region", "place", "part")]).alias("draft_no"), "context", "body")
    # Each block belongs to the last draft that begins at or before it; the preamble to the first of all.
    lead = out.groupBy("doc_id", c("draft_no.pos").alias("pos")).agg(F.min("draft_no").alias("draft_no"))
    marks = lead.select("doc_id", c("pos").alias("at"), F.lit(None).cast(rows.schema["block_id"].dataType).alias("source_id"), "draft_no")
    member = rows.join(units.select("doc_id").distinct(), "doc_id").select("doc_id", "at", c("block_id").alias("source_id"), F.lit(None).cast(out.schema["draft_no"].dataType).alias("draft_no"))
    order = Window.partitionBy("doc_id").orderBy("at", F.col("source_id").isNotNull())
    claims = marks.unionByName(member).withColumn("draft_no", F.coalesce(F.last("draft_no", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("draft_no", True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return out, issues, claims.where("source_id is not null").select("doc_id", "draft_no", "source_id")


def _long_articles(rows: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts of articles longer than a chunk: texts between tables, and tables under their repeated header; and issues."""
    c = F.col
    context = F.array(F.concat(F.lit("[문서] "), "name"), F.concat(F.lit("[조문] "), c("heading")))
    framed = units.select("doc_id", "unit", "name", c("at").alias("_head"), context.alias("context"))
    inside = rows.where("not heading").drop("name").join(framed, ["doc_id", "unit"])
    run = F.sum((c("kind") == "table").cast("int")).over(Window.partitionBy("doc_id", "unit").orderBy("at"))
    text = inside.withColumn("_run", run).where("kind <> 'table' and shown <> ''").groupBy("doc_id", "name", "unit", "_run", "context").agg(F.min("at").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]), "\n").alias("body"))
    zero = F.lit(0)
    columns = ["doc_id", "name", "pos", "region", "place", "part", "context", "body"]
    text = text.where(~S.is_blank(c("body"))).select("doc_id", "name", "pos", zero.alias("region"), zero.alias("place"), zero.alias("part"), "context", "body")
    tables = inside.where("kind = 'table'").withColumn("table_no", c("at"))
    cells = tables.select("doc_id", "table_no", F.posexplode("rows").alias("row_no", "cells"))
    lengths = tables.select("doc_id", "table_no", (S.u16_length(F.array_join("context", "\n")) + 1).alias("context_length"))
    packed = cut(T.table_drafts(cells, lengths), "contract-tables")
    issues = T.table_issues(cells).select("doc_id", "code", F.lit("warning").alias("severity"), "n")
    issues = issues.unionByName(packed.where("blocked").select("doc_id", F.lit("TABLE_FRAMING_EXCEEDS_LIMIT").alias("code"), F.lit("error").alias("severity"), F.lit(1).cast("long").alias("n")))
    packed = packed.where("not blocked").join(tables.select("doc_id", "table_no", "name", "context"), ["doc_id", "table_no"]).withColumnRenamed("table_no", "pos")
    out = text.unionByName(packed.select(*columns))
    empty = framed.join(inside.select("doc_id", "unit").distinct(), ["doc_id", "unit"], "left_anti")
    empty = empty.select("doc_id", "name", c("_head").alias("pos"), zero.alias("region"), zero.alias("place"), zero.alias("part"), "context", F.lit("").alias("body"))
    return out.unionByName(empty), issues
