"""Section recognition on line tables: general and legal documents to drafts.

All state that a reader would carry from line to line (the open heading, levels that reset each other, pending titles)
is a window over the document's lines. Drafts carry `sources`, the filled lines whose text they hold (operators.claims).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import headings as H
from quirework.functions import strings as S
from quirework.operators import claims as C
from quirework.operators import lines as L
from quirework.operators import tables as T
from quirework.operators.split import greedy_groups, split_text
from quirework.operators.storage import cut

NO_PATH = "전문"

#: Lines that may be a heading, table, or numbering of any kind; texts without one are a single section.
_STRUCTURE = r"(?mu)^[ \t]*(?:\||#|\*\*|__|~~|`|제\s*\d|\d|\[|■|부\s?칙|별표|별지|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫIVX]+[.\s]|[^a-z\n]{4,80}$|(?i:Section|Chapter|Part|Volume|Appendix|Annex|Attachment)\s)"


def may_have_structure(text: Column) -> Column:
    return text.rlike(_STRUCTURE)


def _trimmed(text: Column) -> Column:
    """Without blank lines at its ends."""
    space = S.SPACE.replace(r"\n", "")
    return F.regexp_replace(text, rf"\A(?:{space}*\n)+|(?:\n{space}*)+\z", "")


def context_lines(name: Column, label: str, path: Column, none: str) -> Column:
    return F.array(F.concat(F.lit("[문서] "), name), F.concat(F.lit(f"[{label}] "), F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise(none)))


def with_units(lines: DataFrame) -> DataFrame:
    """Add `unit`, which changes with each section and at the edges of tables, from columns section, table_no."""
    same = (F.col("section") == F.lag("section").over(L.by_pos())) & F.col("table_no").eqNullSafe(F.lag("table_no").over(L.by_pos()))
    return lines.withColumn("unit", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(L.upto()))


def _text_drafts(lines: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, keys, unit, pos, body, sources of the text units; `body_line` null marks a line that gives none."""
    line = F.struct("pos", "body_line", (~S.is_blank(F.col("body_line"))).alias("filled"))
    rows = lines.where("table_no is null").groupBy("doc_id", *keys, "unit").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.when(F.col("body_line").isNotNull(), line))).alias("_l"))
    own = F.transform(F.filter("_l", lambda x: x["filled"]), lambda x: x["pos"])
    return rows.withColumn("body", _trimmed(F.array_join(F.transform("_l", lambda x: x["body_line"]), "\n"))).withColumn("sources", own).drop("_l")


def drafts_with_tables(lines: DataFrame, text: DataFrame, context: Column, keys: list[str], n: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drafts (doc_id, pos, region, place, part, kind, context, body, sources) of text units and tables, the tables' issues, and the blocked tables (doc_id, table_no).

    text: doc_id, keys, pos, body, sources[, part]. n: in how many partitions tables are dealt, if Spark is not to choose.
    """
    number = ["pos", "region", "place", "part"]
    tables = lines.where("pos = table_no").select("doc_id", "table_no", *keys).withColumn("context", context)
    deal = lambda df: df.repartition(n, *T.TABLE) if n else df
    rows = deal(T.markdown_rows(lines))
    lengths = tables.select("doc_id", "table_no", (S.u16_length(F.array_join("context", "\n")) + 1).alias("context_length"))
    packed = deal(cut(T.table_drafts(rows, lengths), "table-drafts")).join(tables.select("doc_id", "table_no", "context"), ["doc_id", "table_no"])
    issues = T.table_issues(rows).select("doc_id", "code", F.lit("warning").alias("severity"), "n")
    issues = issues.unionByName(packed.where("blocked").select("doc_id", F.lit("TABLE_FRAMING_EXCEEDS_LIMIT").alias("code"), F.lit("error").alias("severity"), F.lit(1).cast("long").alias("n")))
    drafts = packed.select("doc_id", F.col("table_no").alias("pos"), "region", "place", "part", F.lit("table").alias("kind"), "context", "body", T.line_numbers(F.col("table_no"), F.col("row_nos")).alias("sources"))
    text = text if "part" in text.columns else text.withColumn("part", F.lit(0))
    text = text.withColumn("context", context).withColumns({"region": F.lit(0), "place": F.lit(0), "kind": F.lit("text")}).select(*drafts.columns)
    both = text.unionByName(drafts.where(F.col("body").isNotNull()))
    return both.select("doc_id", *[F.col(k).cast("int").alias(k) for k in number], "kind", "context", "body", "sources"), issues, packed.where("blocked").select("doc_id", "table_no")


def numbered(drafts: DataFrame) -> DataFrame:
    return drafts.select("doc_id", F.struct("pos", "region", "place", "part").alias("draft_no"), "context", "body", "sources")


def lost_issues(lines: DataFrame, drafts: DataFrame, blocked: DataFrame) -> DataFrame:
    """Issues of documents whose finished drafts don't hold each filled body line of lines (doc_id, pos, line, table_no, body_line) once.

    blocked: doc_id, table_no of tables without drafts, which are issues of their own.
    """
    body = F.when(F.col("table_no").isNull(), F.col("body_line")).otherwise(F.col("line"))
    filled = lines.where(body.isNotNull() & ~S.is_blank(body))
    return C.lost_issues(L.expected_lines(filled, blocked), drafts)


def general_lines(lines: DataFrame) -> DataFrame:
    """Line table (doc_id, name, pos, line) with accepted headings, path, section and table of each line."""
    lines = L.mark_tables(lines)
    lines = L.mark_siblings(lines, L.arabic_number(F.col("line")), F.lit("arabic"))
    lines = H.with_general_heading(H.with_legal_heading(lines, "_legal"), "_legal", "_h0").drop("_legal").withColumnRenamed("_h0", "_h")
    usable = F.col("table_no").isNull() & F.col("_h.kind").isNotNull() & ~((F.col("_h.kind") == "numbered") & F.col("sibling"))
    lines = lines.withColumn("_kind", F.when(usable, F.col("_h.kind")))
    # Weak headings don't count while the last strong one is an article.
    strong = F.last(F.when(~F.col("_h.weak"), F.col("_kind")), True).over(L.before())
    lines = lines.withColumn("kind", F.when(~(F.col("_h.weak") & (F.coalesce(strong, F.lit("")) == "article")), F.col("_kind")))
    heading = F.col("kind").isNotNull()
    lines = lines.withColumn("section", F.sum(heading.cast("int")).over(L.upto()))
    # A numbered heading lies under a Roman one, unless another kind came between.
    holder = F.last(F.when(heading & (F.col("kind") != "numbered"), F.struct("kind", F.col("_h.text").alias("text"))), True).over(L.upto())
    own = F.last(F.when(heading, F.struct("kind", F.col("_h.text").alias("text"))), True).over(L.upto())
    lines = lines.withColumn("_o", own).withColumn("_r", holder)
    path = F.when(F.col("_o").isNull(), F.array().cast("array<string>")).when((F.col("_o.kind") == "numbered") & (F.col("_r.kind") == "roman-parent"), F.array("_r.text", "_o.text")).otherwise(F.array("_o.text"))
    inline = F.nullif(F.col("_h.inline"), F.lit(""))
    return lines.withColumn("path", path).withColumn("roman", F.coalesce(F.col("_o.kind") == "roman-parent", F.lit(False))).withColumn("body_line", F.when(heading, inline).otherwise(F.col("line"))).drop("_h", "_kind", "_o", "_r", "sibling")


def fold_titles(drafts: DataFrame) -> DataFrame:
    """Titles without text go before the next draft's text, or stay together where a table or nothing follows.

    drafts: doc_id, pos, region, place, part, kind, title, body. Blank drafts and the draft after them form a group.
    """
    order = Window.partitionBy("doc_id").orderBy(F.desc("pos"), F.desc("region"), F.desc("place"), F.desc("part"))
    blank = S.is_blank(F.col("body"))
    ends = ~blank | F.coalesce(F.lag(F.col("kind") == "table").over(order), F.lit(True))
    rows = drafts.withColumn("_end", ends).withColumn("_g", F.sum(F.col("_end").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("doc_id", "_g")
    titles = F.array_sort(F.collect_list(F.when(~F.col("_end"), F.struct("pos", "title"))).over(group))
    rows = rows.withColumn("_t", F.array_join(F.transform(titles, lambda x: x["title"]), "\n")).where("_end")
    body = F.when(F.col("_t") == "", F.col("body")).when(S.is_blank(F.col("body")), F.col("_t")).otherwise(F.concat("_t", F.lit("\n"), "body"))
    return rows.withColumn("body", body).drop("_end", "_g", "_t")


def general_drafts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts and issues of prepared docs (doc_id, name, text). Texts without structure skip the line table."""
    structured = F.coalesce(may_have_structure(F.col("text")), F.lit(False))
    none = F.array().cast("array<string>")
    plain = docs.where(~structured & F.col("text").isNotNull()).withColumn("body", _trimmed(F.col("text"))).where(~S.is_blank(F.col("body")))
    zero = F.lit(0)
    plain = plain.select("doc_id", zero.alias("pos"), zero.alias("region"), zero.alias("place"), zero.alias("part"), context_lines(F.col("name"), "섹션", none, NO_PATH).alias("context"), "body", F.sequence(F.lit(0), F.size(F.split("text", "\n", -1)) - 1).alias("sources"))
    lines = cut(with_units(general_lines(L.explode_lines(docs.where(structured), ["name"]))), "general-lines")
    keys = ["name", "section", "path"]
    text = _text_drafts(lines, [*keys, "roman"])
    # Of a section without text, one unit keeps the title, unless a table follows it at once.
    first = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("pos")) == 1
    tabled = lines.groupBy("doc_id", "section").agg(F.min("table_no").alias("_table"), F.max(F.col("table_no").isNull() & F.coalesce(~S.is_blank(F.col("body_line")), F.lit(False))).alias("_texts"))
    text = text.withColumn("_first", first).join(tabled, ["doc_id", "section"])
    text = text.where(~S.is_blank(F.col("body")) | (F.col("_first") & (F.col("section") > 0) & ~F.col("roman") & F.col("_table").isNull() & ~F.col("_texts")))
    drafts, issues, blocked = drafts_with_tables(lines, text, context_lines(F.col("name"), "섹션", F.col("path"), NO_PATH), keys)
    drafts = fold_titles(drafts.withColumn("title", F.regexp_replace(F.col("context")[1], r"^\[섹션\] ", ""))).drop("title", "kind")
    done = cut(numbered(plain.unionByName(drafts.select(*plain.columns))), "general-drafts")
    # Texts without structure are one draft, so only line tables are held against their drafts.
    lost = lost_issues(lines, done.join(lines.select("doc_id").distinct(), "doc_id", "left_semi"), blocked)
    return done, issues.unionByName(lost)


LEVELS = ["part", "chapter", "section", "subsection"]
ROOTS = ["addendum", "appendix", "form"]


def law_lines(lines: DataFrame) -> DataFrame:
    """Line table with kind and heading of lines that open a section, and section and body_line of each line."""
    lines = H.with_legal_heading(L.mark_tables(lines), "_h")
    lines = lines.withColumn("kind", F.when(F.col("table_no").isNull(), F.col("_h.kind")))
    opens = F.col("kind").isNotNull()
    lines = lines.withColumn("heading", F.when(opens, F.col("_h.heading"))).withColumn("section", F.sum(opens.cast("int")).over(L.upto()))
    return lines.withColumn("body_line", F.when(opens, F.nullif(F.col("_h.inline"), F.lit(""))).otherwise(F.col("line"))).drop("_h")


def with_location(units: DataFrame) -> DataFrame:
    """Units (doc_id, pos, kind, heading: of the line that opens a section) with location (an array) and opened_by.

    A level holds until a level above it or a special root comes; a root until a level comes; an article until any.
    """

    def last(kinds: list[str]) -> Column:
        return F.last(F.when(F.col("kind").isin(kinds), F.struct("pos", F.col("heading").alias("text"))), True).over(L.upto())

    units = units.withColumns({f"_{k}": last([k]) for k in LEVELS} | {"_root": last(ROOTS), "_article": last(["article"]), "opened_by": F.last("kind", True).over(L.upto())})
    at = lambda k: F.coalesce(F.col(f"_{k}.pos"), F.lit(-1))
    parts = []
    for i, k in enumerate(LEVELS):
        above = F.greatest(F.lit(-1), at("root"), *[at(x) for x in LEVELS[:i]])
        parts.append(F.when(at(k) > above, F.col(f"_{k}.text")))
    levels = F.greatest(*[at(k) for k in LEVELS])
    parts.append(F.when(at("root") > levels, F.col("_root.text")))
    parts.append(F.when(at("article") > F.greatest(levels, at("root")), F.col("_article.text")))
    return units.withColumn("location", F.filter(F.array(*parts), lambda x: x.isNotNull())).drop("kind", "heading", *[f"_{k}" for k in [*LEVELS, "root", "article"]])


# Starts of 항, 호 and 목, the levels at which a long article breaks.
BREAKS = [r"(?m)(?=^[①-⑳]\s*)", r"(?m)(?=^\d+[.)]\s*)", r"(?m)(?=^[가-힣][.)]\s*)"]


def with_room(drafts: DataFrame, limit: int = S.CHUNK_LIMIT) -> DataFrame:
    """Drafts with _room, the units that their context leaves, and _fits: whether a body fits or there is no room at all."""
    rows = drafts.withColumn("_room", (F.lit(limit) - S.u16_length(F.array_join("context", "\n")) - 1).cast("int"))
    return rows.withColumn("_fits", (S.u16_length(F.col("body")) <= F.col("_room")) | (F.col("_room") < 1))


def split_article(rows: DataFrame) -> DataFrame:
    """Drafts of with_room that don't fit broken at 항, then 호, then 목, then anywhere; neighbours that fit are joined again."""
    drafts, short = rows.drop("_room", "_fits"), rows.where("_fits")
    long = rows.where("not _fits").drop("_fits").withColumn("_p", F.array("body"))
    for pattern in BREAKS:
        long = long.withColumn("_p", F.flatten(F.transform("_p", lambda x, p=pattern: F.when(S.u16_length(x) > F.col("_room"), F.filter(F.split(x, p, -1), lambda y: y != "")).otherwise(F.array(x)))))
    long = long.select("*", F.posexplode("_p").alias("_i", "_x"))
    small = long.where(S.u16_length(F.col("_x")) <= F.col("_room")).withColumn("_s", F.array("_x"))
    large = long.where(S.u16_length(F.col("_x")) > F.col("_room")).withColumn("_s", split_text(F.col("_x"), F.col("_room")))
    keys = [c for c in drafts.columns if c not in ("part", "body", "sources")]
    first = ["doc_id", "pos", "region", "place"]
    whole = long.select(*first, "body", "sources")
    all_ = small.unionByName(large).select(*keys, "_room", "_i", F.posexplode("_s").alias("_j", "_t"))
    packed = all_.groupBy(*keys, "_room").agg(F.array_sort(F.collect_list(F.struct("_i", "_j", "_t"))).alias("r"))
    packed = packed.withColumn("g", greedy_groups(F.transform("r", lambda x: S.u16_length(x["_t"]).cast("int")), F.col("_room")))
    packed = packed.select(*keys, F.posexplode(F.arrays_zip("r", "g")).alias("k", "x")).groupBy(*keys, F.col("x.g").alias("part")).agg(F.array_sort(F.collect_list(F.struct("k", F.col("x.r._t").alias("t")))).alias("r"))
    packed = cut(packed.withColumn("body", F.array_join(F.transform("r", lambda x: x["t"]), "")).drop("r", "_room"), "article-parts")
    parts = packed.groupBy(*first).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "body"))), lambda x: x["body"]).alias("parts"))
    held = C.split_sources(whole.join(parts, first), first).withColumnRenamed("piece_no", "part")
    packed = packed.join(held, [*first, "part"], "left").withColumn("sources", F.coalesce("sources", C.no_sources()))
    return short.select(*drafts.columns).unionByName(cut(packed.select(*drafts.columns), "article-sources"))


def law_units(lines: DataFrame) -> DataFrame:
    """Units (doc_id, section, unit, name, location, opened_by, pos, table_no, held) of law_lines: a line table with a row a unit.

    held: the unit's lines in order. A document's lines already lie together, so that they are grouped where they are.
    Text units have body and sources; bare marks a title's unit in a section without text and without a table.
    """
    c = F.col
    line = F.struct("pos", "line", "body_line")
    # A line that opens a section is its unit's first; what holds there holds for the unit, so fewer rows are looked through.
    own = [F.first("name").alias("name"), F.first("kind", True).alias("kind"), F.first("heading", True).alias("heading")]
    units = with_units(lines).groupBy("doc_id", "section", "unit").agg(*own, F.min("pos").alias("pos"), F.min("table_no").alias("table_no"), F.array_sort(F.collect_list(line)).alias("held"))
    units = with_location(units)
    text = F.filter("held", lambda x: x["body_line"].isNotNull())
    units = units.withColumn("body", F.when(c("table_no").isNull(), _trimmed(F.array_join(F.transform(text, lambda x: x["body_line"]), "\n"))))
    units = units.withColumn("sources", F.when(c("table_no").isNull(), F.transform(F.filter(text, lambda x: ~S.is_blank(x["body_line"])), lambda x: x["pos"])))
    in_section = Window.partitionBy("doc_id", "section")
    first = F.row_number().over(in_section.orderBy(c("table_no").isNotNull(), "pos")) == 1
    empty = (F.max(F.size("sources")).over(in_section) <= 0) & F.min("table_no").over(in_section).isNull()
    return units.withColumn("bare", first & empty)


def law_drafts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One draft an article or special root of prepared docs; blank ones fold into later drafts of their location."""
    units = cut(law_units(law_lines(L.explode_lines(docs, ["name"]))), "law-units")
    keys = ["name", "section", "location", "opened_by"]
    strong = F.col("opened_by").isin("article", *ROOTS)
    text = units.where(F.col("table_no").isNull() & (~S.is_blank(F.col("body")) | (F.col("bare") & strong)))
    context = context_lines(F.col("name"), "위치", F.col("location"), NO_PATH)
    opened = lambda rows: rows.select("doc_id", *keys, "table_no", F.explode("held").alias("_x")).select("doc_id", *keys, "table_no", "_x.*")
    drafts, issues, blocked = drafts_with_tables(opened(units.where("table_no is not null")), text, context, keys)
    drafts = drafts.withColumn("_loc", F.col("context")[1])
    order = Window.partitionBy("doc_id").orderBy("pos", "region", "place", "part")
    after = F.lead("_loc").over(order)
    near = (after == F.col("_loc")) | F.startswith(after, F.concat("_loc", F.lit(" > ")))
    drafts = drafts.withColumn("_blank", S.is_blank(F.col("body"))).withColumn("_near", F.coalesce(near, F.lit(False)))
    drafts = drafts.where("not (_blank and _near)")
    # A title also goes where a later draft with text ends in it.
    leaf = F.element_at(F.split(F.regexp_replace("_loc", r"^\[위치\] ", ""), " > "), -1)
    drafts = drafts.withColumn("_leaf", leaf)
    later = F.max(F.when(~F.col("_blank"), F.col("pos"))).over(Window.partitionBy("doc_id", "_leaf"))
    drafts = drafts.withColumn("_later", later).where("not (_blank and coalesce(_later > pos, false))")
    # Stored once, since what is short, what is long and what is a table are read from it apart.
    drafts = cut(with_room(drafts.drop("_loc", "_blank", "_near", "_leaf", "_later")), "law-folded")
    text, rest = drafts.where("kind = 'text'").drop("kind"), drafts.where("kind = 'table'").drop("kind", "_room", "_fits")
    done = numbered(split_article(text).unionByName(rest))
    return done, issues.unionByName(lost_issues(opened(units), done, blocked))
