"""HTML pages as blocks: headings, paragraphs, list items and tables, in order, with the path of headings above each.

A page is a row of tokens, and what a reader's tree would hold is windows over them: a text belongs to the block that
opened last, unless something has closed it since. So end tags may lack or come twice: a paragraph ends where the next
block begins, an item where the next item or list does, a cell where the next cell or row does. Subtrees that hold no
content (scripts, navigation, page footers) are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import strings as S
from quirework.operators import spans
from quirework.operators.storage import cut

# Elements whose text is kept in place, those that are blocks, and those whose content is none.
INLINE = ["a", "b", "code", "del", "em", "i", "s", "span", "strong", "sub", "sup", "u"]
HEADINGS = [f"h{k}" for k in range(1, 7)]
SKIPPED = ["head", "nav", "footer", "aside", "form", "noscript", "template", "select", "button", "svg", "iframe"]
_RAW = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\z)|<![^>]*>|<\?[^>]*>"
_TOKEN = r"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<|[^<]+"
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}


def unescape(text: Column) -> Column:
    """Character references as characters: numbers, and the names that markup itself needs. An unknown name stays."""
    code = lambda x: F.when(F.lower(F.substring(x, 3, 1)) == "x", F.conv(F.regexp_extract(x, r"^&#[xX]0*([0-9A-Fa-f]{1,6});\z", 1), 16, 10)).otherwise(F.regexp_extract(x, r"^&#0*([0-9]{1,7});\z", 1)).cast("string")

    def one(x: Column) -> Column:
        n = F.nullif(code(x), F.lit("")).try_cast("long")
        known = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(F.startswith(x, F.lit("&#")), F.when(known, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")).otherwise("�")).otherwise(x)

    numbers = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(&#[0-9]{1,9};|&#[xX][0-9A-Fa-f]{1,9};|[^&]+|&)"), F.lit(1)), one), "")
    out = F.when(F.contains(text, F.lit("&#")), numbers).otherwise(text)
    for name, character in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(character))
    return out


def tokens(pages: DataFrame, html: str = "html") -> DataFrame:
    """doc_id, pos, text (null for a tag), tag (lower case), ends, attrs, lists and tables (open ones) of pages (doc_id, html); no token of skipped subtrees."""
    c = F.col
    bare = F.regexp_replace(F.coalesce(c(html), F.lit("")), _RAW, " ")
    rows = pages.select("doc_id", F.posexplode(F.regexp_extract_all(bare, F.lit(f"({_TOKEN})"), F.lit(1))).alias("pos", "_t"))
    name = F.lower(F.regexp_extract("_t", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    rows = rows.withColumn("tag", F.when(F.startswith("_t", F.lit("<")) & (name != ""), name)).withColumn("ends", F.startswith("_t", F.lit("</")))
    rows = rows.withColumn("text", F.when(c("tag").isNull(), c("_t"))).withColumn("attrs", F.when(c("tag").isNotNull() & ~c("ends"), c("_t"))).drop("_t")
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # Each kind of skipped element is counted by itself: a stray end tag opens nothing.
    step = F.when(c("tag").isin(SKIPPED), F.when(c("ends"), -1).otherwise(1)).otherwise(0)
    level = F.sum(step).over(upto)
    low = F.min("_level").over(upto)
    rows = rows.withColumn("_level", level).withColumn("_depth", c("_level") - F.least(F.lit(0), low))
    rows = rows.where(c("_depth") <= 0).where(F.coalesce(~c("tag").isin(SKIPPED), F.lit(True))).drop("_level", "_depth")

    def inside(tags: list[str]) -> Column:
        return F.greatest(F.lit(0), F.sum(F.when(c("tag").isin(tags), F.when(c("ends"), -1).otherwise(1)).otherwise(0)).over(upto)).cast("int")

    return rows.withColumn("lists", inside(["ul", "ol"])).withColumn("tables", inside(["table"]))


def _span(name: str) -> Column:
    n = F.regexp_extract("attrs", rf"(?i)\b{name}\s*=\s*[\"']?\s*(\d{{1,6}})", 1)
    return F.greatest(F.lit(1), F.coalesce(F.nullif(n, F.lit("")).cast("int"), F.lit(1)))


def html_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """doc_id, order, kind, level, depth, ordered, heading_path, text, rows of pages (doc_id, html)."""
    c = F.col
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tags = cut(tokens(pages, html), "tokens")
    is_list = c("tag").isin("ul", "ol")
    in_table = c("tables") > 0
    rows = tags.withColumn("_table", F.last(F.when((c("tag") == "table") & ~c("ends"), c("pos")), True).over(upto))
    # Within a table only its cells are blocks; elsewhere headings, paragraphs and items are. Other tags close what is open.
    item = (c("tag") == "li") & (c("lists") > 0)
    opens = F.when(c("ends"), None).when(in_table, F.when(c("tag").isin("td", "th"), "cell")).when(c("tag").isin(HEADINGS), "heading").when(c("tag") == "p", "paragraph").when(item, "list-item")
    held = c("tag").isNull() | c("tag").isin([*INLINE, "br"]) | (in_table & c("tag").isin(*HEADINGS, "p", "div", "ul", "ol", "li"))
    rows = rows.withColumn("_block", F.last(F.when(~held, F.struct(opens.alias("kind"), "pos", "tag", "lists", "_table")), True).over(upto))
    # A paragraph within an item belongs to the item's text.
    rows = rows.withColumn("_item", F.last(F.when(item | is_list, F.struct(F.when(item & ~c("ends"), c("pos")).alias("pos"), "lists")), True).over(upto))
    within = (c("_block.tag") == "p") & c("_block.kind").isNotNull() & c("_item.pos").isNotNull() & ~in_table
    block = F.when(within, F.struct(F.lit("list-item").alias("kind"), c("_item.pos").alias("pos"), F.lit("li").alias("tag"), c("_item.lists").alias("lists"), c("_block._table").alias("_table"))).otherwise(c("_block"))
    piece = F.when(c("tag") == "br", F.lit("\n")).when(c("text").isNotNull(), unescape(c("text"))).when(c("tag").isin("p", *HEADINGS, "div", "li"), F.lit(" "))
    rows = rows.withColumn("_block", block).where(c("_block.kind").isNotNull()).withColumn("_piece", piece)
    pieces = F.array_sort(F.collect_list(F.when(c("_piece").isNotNull(), F.struct("pos", "_piece"))))
    texts = rows.groupBy("doc_id", c("_block.pos").alias("at"), c("_block.kind").alias("kind"), c("_block.tag").alias("tag"), c("_block.lists").alias("lists"), c("_block._table").alias("table")).agg(F.array_join(F.transform(pieces, lambda x: x["_piece"]), "").alias("_x"))
    flat_space = S.SPACE.replace(r"\n", "") + "+"
    clean = S.trim(F.regexp_replace(F.regexp_replace(S.normalize_line_ends(c("_x")), flat_space, " "), r" *\n *", "\n"))
    texts = texts.withColumn("text", clean).drop("_x")
    flat = _ordered(texts.where((c("kind") != "cell") & (c("text") != "")).select("doc_id", "at", "kind", "tag", "lists", "text"), tags).withColumn("rows", F.lit(None).cast("array<array<string>>"))
    tables = _tables(texts.where("kind = 'cell'"), tags)
    return _pathed(flat.unionByName(tables.select("doc_id", "at", F.lit("table").alias("kind"), F.lit("table").alias("tag"), F.lit(0).alias("lists"), F.lit(None).cast("string").alias("text"), "rows", F.lit(None).cast("boolean").alias("ordered"))))


def _ordered(flat: DataFrame, tags: DataFrame) -> DataFrame:
    """Add `ordered` of list items: the last list opened at their depth is an ol."""
    c = F.col
    opened = tags.where(c("tag").isin("ul", "ol") & ~c("ends")).select("doc_id", c("pos").alias("at"), "lists", c("tag").alias("_list"))
    rows = flat.withColumn("_list", F.lit(None).cast("string")).unionByName(opened, allowMissingColumns=True)
    same = Window.partitionBy("doc_id", "lists").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_list", F.last("_list", True).over(same)).where("kind is not null")
    return rows.withColumn("ordered", F.when(c("kind") == "list-item", c("_list") == "ol")).drop("_list")


def _tables(cells: DataFrame, tags: DataFrame) -> DataFrame:
    """doc_id, at, rows of tables: cells (doc_id, at, table, text) placed on a grid by their spans."""
    c = F.col
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    place = tags.withColumn("row", F.sum(F.when((c("tag") == "tr") & ~c("ends"), 1).otherwise(0)).over(upto)).where(c("tag").isin("td", "th") & ~c("ends"))
    place = place.select("doc_id", c("pos").alias("at"), "row", _span("rowspan").alias("rowspan"), _span("colspan").alias("colspan"))
    one = cells.join(place, ["doc_id", "at"]).groupBy("doc_id", "table", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text", "rowspan", "colspan"))), lambda x: F.struct(x["text"].alias("text"), x["rowspan"].alias("rowspan"), x["colspan"].alias("colspan"))).alias("cells"))
    whole = one.groupBy("doc_id", c("table").alias("table_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("rows"))
    grid = spans.grid_rows(spans.placed_cells(whole))
    rows = grid.groupBy("doc_id", "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"]).alias("rows"))
    return rows.where(F.exists("rows", lambda r: F.exists(r, lambda x: x != ""))).select("doc_id", c("table_no").alias("at"), "rows")


def _pathed(blocks: DataFrame) -> DataFrame:
    """Number the blocks and add the path of the headings that are open: a heading closes those of its level and below."""
    c = F.col
    upto = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(c("kind") == "heading", F.substring("tag", 2, 1).cast("int"))
    rows = blocks.withColumn("level", level)
    for k in range(1, 7):
        rows = rows.withColumn(f"_h{k}", F.last(F.when(c("level") == k, F.struct("at", "text")), True).over(upto))
    newest = [F.coalesce(F.col(f"_h{k}.at"), F.lit(-1)) for k in range(1, 7)]
    open_ = [F.when(newest[k] > (F.greatest(F.lit(-1), *newest[:k]) if k else F.lit(-1)), F.col(f"_h{k + 1}.text")) for k in range(6)]
    path = F.filter(F.array(*open_), lambda x: x.isNotNull())
    order = (F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).alias("order")
    depth = F.when(c("kind") == "list-item", c("lists") - 1).alias("depth")
    return rows.select("doc_id", order, "kind", "level", depth, "ordered", path.alias("heading_path"), "text", "rows")
