"""Manuals: sections, steps, and safety labels that stay with what they belong to.

A section's lines fall into stretches between its tables. In a stretch, a step is a unit of its own; other lines form
units with their neighbours. A safety label goes with the unit before it. Labels that open a stretch wait: they go
before the first step or text that follows, or frame the table that follows, or else the table before. Labels that
find none of these are content; outside of sections on safety they are a warning.

Units are packed into drafts up to the limit. A longer step with labels is split so that those before it stay with its
first piece and those after it with its last. Longer text is split if sentences or words end where it breaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quirework.functions import headings as H
from quirework.functions import strings as S
from quirework.operators import claims as C
from quirework.operators import lines as L
from quirework.operators.sections import context_lines, drafts_with_tables, lost_issues, numbered, with_units
from quirework.operators.split import pieces_of
from quirework.operators.storage import cut, parts

NO_SECTION = "전체"
# What sections on safety are about.
SAFETY_SECTION = "안전|주의|수칙|경고|위험"
UNPAIRED, DEEP = "manual-safety-without-adjacent-instruction", "manual-deep-numbering-unstructured"
TOO_LONG, NO_ROOM = "manual-non-step-exceeds-limit", "manual-step-safety-prefix-exceeds-limit"
_DEPTHS = (1, 2, 3, 4)


def manual_lines(lines: DataFrame) -> DataFrame:
    """Line table with class, accepted sections, their paths, and `orphan`: dotted titles whose parent isn't open.

    A dotted title of depth d counts if its parent number is the open one of depth d - 1; depth 1 always does. Other
    section titles close all dotted ones.
    """
    lines = L.mark_tables(lines).withColumn("class", H.manual_class(F.col("line"))).withColumn("_d", H.dotted_heading(F.col("line")))
    ordinal = H.ordinal(F.col("line"))
    listed = F.col("class").isin("section", "step")
    lines = L.mark_siblings(lines, F.when(listed, ordinal["value"]), F.when(listed, ordinal["family"]))
    free = F.col("table_no").isNull()
    # Sibling runs are lists, whether dotted or not.
    lines = lines.withColumn("_dot", F.when(free & ~F.col("sibling"), F.col("_d"))).drop("_d")
    other = free & (F.col("class") == "section") & ~F.col("sibling") & F.col("_dot").isNull() & ~H.has_dotted_prefix(F.col("line"))
    title = S.trim(F.col("line"))
    lines = lines.withColumn("_other", other).withColumn("_plain", F.last(F.when(other, F.struct("pos", title.alias("text"))), True).over(L.upto()))
    closed = F.coalesce(F.col("_plain.pos"), F.lit(-1))
    for depth in _DEPTHS:
        prefix = F.col("_dot.prefix")
        here = F.col("_dot.depth") == depth
        if depth > 1:
            parent = F.array_join(F.slice(F.split(prefix, "[.]"), 1, depth - 1), ".")
            here = here & (F.col(f"_open{depth - 1}.prefix") == parent)
        mine = F.when(here, F.struct("pos", prefix.alias("prefix"), S.trim(F.col("line")).alias("text")))
        lines = lines.withColumn(f"_own{depth}", mine)
        lines = lines.withColumn("_last", F.last(f"_own{depth}", True).over(L.upto()))
        above = F.col(f"_open{depth - 1}.pos") if depth > 1 else closed
        lines = lines.withColumn(f"_open{depth}", F.when((F.col("_last.pos") > above) & (F.col("_last.pos") > closed), F.col("_last"))).drop("_last")
    dotted = F.coalesce(*[F.col(f"_own{k}.pos") for k in _DEPTHS]).isNotNull()
    path = F.filter(F.array(*[F.col(f"_open{k}.text") for k in _DEPTHS]), lambda x: x.isNotNull())
    path = F.when(F.col("_open1").isNotNull(), path).when(F.col("_plain").isNotNull(), F.array("_plain.text")).otherwise(F.array().cast("array<string>"))
    lines = lines.withColumn("heading", dotted | F.col("_other")).withColumn("orphan", F.col("_dot").isNotNull() & ~dotted).withColumn("path", path)
    lines = lines.withColumn("section", F.sum(F.col("heading").cast("int")).over(L.upto()))
    return lines.withColumn("body_line", F.when(~F.col("heading"), F.col("line"))).drop("_dot", "_plain", "_other", *[f"_{w}{k}" for w in ("own", "open") for k in _DEPTHS])


def with_labels(lines: DataFrame) -> DataFrame:
    """Body lines of stretches with `role` (safety, step, text or blank), their unit_no, and the fate of labels.

    fate: null for lines that keep their place, else before (what follows), table (target is its table_no) or alone.
    """
    c = F.col
    near = lines.withColumn("_next", F.when(F.lead("section").over(L.by_pos()) == c("section"), F.lead("table_no").over(L.by_pos())))
    near = near.withColumn("_prev", F.when(F.lag("section").over(L.by_pos()) == c("section"), F.lag("table_no").over(L.by_pos())))
    stretch = Window.partitionBy("doc_id", "unit")
    order = stretch.orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = near.where("table_no is null").withColumn("_next", F.max("_next").over(stretch)).withColumn("_prev", F.max("_prev").over(stretch))
    rows = rows.where("not heading")
    role = F.when(c("sibling"), "step").when(c("class") == "safety", "safety").when(c("class") == "step", "step").when(S.is_blank(c("line")), "blank").otherwise("text")
    rows = rows.withColumn("role", role)
    rows = rows.withColumn("_first", F.min(F.when(c("role").isin("step", "text"), c("pos"))).over(stretch)).withColumn("_opens", F.first("role").over(upto))
    opening = c("_first").isNull() | (c("pos") < c("_first"))
    label = (c("role") == "safety") & opening & (c("_opens") == "safety")
    table = F.coalesce(F.when(c("_first").isNull(), F.coalesce("_next", "_prev")))
    fate = F.when(label, F.when(c("_first").isNotNull(), "before").when(table.isNotNull(), "table").otherwise("alone"))
    rows = rows.withColumn("fate", fate).withColumn("target", F.when(c("fate") == "table", table))
    # A step opens a unit; so does other text after a step. Safety lines belong to the unit before them.
    last = F.last(F.when(c("role") != "safety", c("role")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_last", last)
    starts = (c("role") == "step") | (c("role").isin("text", "blank") & (c("_last").isNull() | (c("_last") == "step")))
    rows = rows.withColumn("_unit", F.sum(starts.cast("int")).over(upto))
    # Waiting labels stand right before the first step or text; blank lines between come before them.
    blanks = F.max(((c("role") == "blank") & opening).cast("int")).over(stretch)
    rows = rows.withColumn("_blanks", blanks).withColumn("_at", F.max(F.when(c("pos") == c("_first"), c("_unit"))).over(stretch))
    unit = F.when(c("fate") == "before", c("_at")).when(c("fate") == "alone", c("_blanks") + 1).otherwise(F.greatest(c("_unit"), F.lit(1)))
    place = F.when(c("fate") == "before", F.struct(c("_first").alias("a"), F.lit(0).alias("b"), c("pos").alias("c"))).when(c("fate") == "alone", F.struct(F.lit(2**31 - 1).alias("a"), F.lit(0).alias("b"), c("pos").alias("c"))).otherwise(F.struct(c("pos").alias("a"), F.lit(1).alias("b"), c("pos").alias("c")))
    return rows.withColumn("unit_no", unit).withColumn("place", place).drop("_next", "_prev", "_opens", "_last", "_unit", "_at")


_FRAGMENTS = T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("code", T.StringType())])


def fragments_of(text: str, before: int, after: int, limit: int, framed: bool) -> tuple[list[str] | None, str | None]:
    """Pieces of a unit that is too long, and the code of its issue. before and after: characters of the labels at its ends."""
    if not framed:
        pieces = pieces_of(text, limit)
        clean = len(pieces) > 1 and all(p[-1:].isspace() or p[-1:] in ".!?。！？" for p in pieces[:-1])
        return (pieces, None) if clean else ([text], TOO_LONG)
    head, tail, middle = text[:before], text[len(text) - after :], text[before : len(text) - after]
    if not before and not after:
        return pieces_of(text, limit), None
    room = limit - max(len(x.encode("utf-16-le")) // 2 for x in (head, tail))
    pieces = pieces_of(middle, room) if room >= 1 and middle else []
    if len(pieces) == 1:
        pieces = [middle[:-1], middle[-1:]]
    if len(pieces) < 2 or not pieces[0]:
        return None, NO_ROOM
    return [head + pieces[0], *pieces[1:-1], pieces[-1] + tail], None


@F.pandas_udf(_FRAGMENTS)
def _fragments(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for columns in batches:
        yield pd.DataFrame([fragments_of(t, int(a), int(b), int(n), bool(f)) for t, a, b, n, f in zip(*columns, strict=True)], columns=["texts", "code"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _packs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for lengths, limits in batches:
        out = []
        for row, limit in zip(lengths, limits, strict=True):
            group, used, ids = 0, 0, []
            for n in row:
                # Joined by line ends; an empty start takes none.
                if used and used + 1 + n > limit:
                    group, used = group + 1, 0
                used += n + (1 if used else 0)
                ids.append(group)
                if used >= limit:
                    group, used = group + 1, 0
            out.append(ids)
        yield pd.Series(out)


def units(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Units of labelled lines: keys, unit, unit_no, pos, text, sources, before and after (characters of labels), framed."""
    c = F.col
    line = F.struct("place", "line", "role", "fate", (c("role") != "blank").alias("filled"), "pos")
    kept = rows.where("fate is null or fate <> 'table'")
    # A first text with blank lines before it takes its labels in without being framed by them.
    framed = F.max((c("fate") == "before") & ((c("_blanks") == 0) | (c("_step_first")))).alias("_pre")
    kept = kept.withColumn("_step_first", F.max((c("pos") == c("_first")) & (c("role") == "step")).over(Window.partitionBy("doc_id", "unit")))
    out = kept.groupBy("doc_id", *keys, "unit", "unit_no").agg(F.array_sort(F.collect_list(line)).alias("_l"), F.min("pos").alias("pos"), framed, F.max((c("role") == "step").cast("int")).alias("_step"), F.max(((c("role") == "safety") & c("fate").isNull()).cast("int")).alias("_post"))
    text = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    before = F.when(F.coalesce("_pre", F.lit(False)), F.aggregate(F.filter("_l", lambda x: F.coalesce(x["fate"] == "before", F.lit(False))), F.lit(0), lambda n, x: n + F.char_length(x["line"]) + 1)).otherwise(0)
    # Labels at the end: those after the last line of another role.
    last = F.coalesce(F.array_max(F.transform("_l", lambda x, i: F.when(x["role"] != "safety", i))), F.lit(-1))
    after = F.when(c("_post") == 1, F.aggregate(F.slice("_l", last + 2, F.size("_l")), F.lit(0), lambda n, x: n + F.char_length(x["line"]) + 1)).otherwise(0)
    sources = F.transform(F.filter("_l", lambda x: x["filled"]), lambda x: x["pos"])
    return out.select("doc_id", *keys, "unit", "unit_no", "pos", text.alias("text"), sources.alias("sources"), before.alias("before"), after.alias("after"), ((c("_step") == 1) | F.coalesce("_pre", F.lit(False)) | (c("_post") == 1)).alias("framed"))


def manual_drafts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts and issues of prepared docs (doc_id, name, text)."""
    c = F.col
    none = F.array().cast("array<string>")
    lines = cut(with_units(manual_lines(L.explode_lines(docs, ["name"]))), "manual-lines")
    # Steps by document stay where its lines lie, in parts that grow with the lines.
    n = parts(lines)
    lines = lines.repartition(n, "doc_id")
    rows = cut(with_labels(lines), "manual-roles").repartition(n, "doc_id")
    keys = ["name", "section", "path"]
    own = context_lines(c("name"), "섹션", c("path"), NO_SECTION)
    limit = F.greatest(F.lit(1), F.lit(S.CHUNK_LIMIT) - S.u16_length(F.array_join(own, "\n")) - 1).cast("int")
    found = units(rows, keys).withColumn("limit", limit)
    fits = S.u16_length(c("text")) <= c("limit")
    long = cut(found.where(~fits).withColumn("_f", _fragments("text", "before", "after", "limit", "framed")), "manual-long-units")
    errors = long.where("_f.code is not null").groupBy("doc_id", c("_f.code").alias("code")).agg(F.count("*").alias("n"))
    one = ["doc_id", "unit", "unit_no"]
    split = long.where("_f.texts is not null")
    held = C.split_sources(split.select(*one, c("text").alias("body"), "sources", c("_f.texts").alias("parts")), one).withColumnRenamed("piece_no", "k")
    columns = ["doc_id", *keys, "unit", "unit_no", "pos", "limit", "k", "text", "sources"]
    fragments = split.drop("text", "sources").select("*", F.posexplode("_f.texts").alias("k", "text")).join(held, [*one, "k"], "left")
    each = found.where(fits).withColumn("k", F.lit(0)).select(*columns).unionByName(fragments.select(*columns))
    first = F.coalesce("sources", C.no_sources()).alias("sources")
    packed = each.repartition(n, "doc_id").groupBy("doc_id", *keys, "unit", "limit").agg(F.array_sort(F.collect_list(F.struct("unit_no", "k", "pos", "text", first))).alias("r"))
    packed = packed.withColumn("g", _packs(F.transform("r", lambda x: S.u16_length(x["text"]).cast("int")), c("limit")))
    packed = packed.select("doc_id", *keys, "unit", F.posexplode(F.arrays_zip("r", "g")).alias("i", "x"))
    packed = packed.groupBy("doc_id", *keys, "unit", c("x.g").alias("part")).agg(F.array_sort(F.collect_list(F.struct("i", c("x.r.text").alias("text"), c("x.r.sources").alias("sources"), c("x.r.pos").alias("pos")))).alias("r"))
    # Blank lines that begin a draft are left out.
    filled = F.coalesce(F.array_min(F.transform("r", lambda x, i: F.when(x["text"] != "", i))), F.size("r"))
    packed = packed.withColumn("r", F.slice("r", filled + 1, F.size("r"))).where(F.size("r") > 0)
    text = packed.select("doc_id", *keys, "part", F.array_min(F.transform("r", lambda x: x["pos"])).alias("pos"), F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("body"), F.flatten(F.transform("r", lambda x: x["sources"])).alias("sources"), none.alias("frame"))
    # A manual that ends in a title keeps it as a draft without text.
    tail = Window.partitionBy("doc_id").orderBy(F.desc("pos"))
    bare = lines.withColumn("_k", F.row_number().over(tail)).where("_k = 1 and heading").select("doc_id", *keys, F.lit(0).alias("part"), "pos", F.lit("").alias("body"), F.array().cast("array<int>").alias("sources"), none.alias("frame"))
    frames = rows.where("fate = 'table'").groupBy("doc_id", c("target").alias("table_no")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_fr"))
    framed = lines.join(frames, ["doc_id", "table_no"], "left").withColumn("frame", F.coalesce(F.transform("_fr", lambda x: x["line"]), none))
    drafts, issues, blocked = drafts_with_tables(framed, text.unionByName(bare), F.concat(own, c("frame")), [*keys, "frame"], n)
    done = cut(numbered(drafts), "manual-drafts")

    def issue(found: DataFrame, code: Column, severity: str) -> DataFrame:
        return found.select("doc_id", code.alias("code"), F.lit(severity).alias("severity"), "n")

    alone = rows.where((c("fate") == "alone") & ~F.exists("path", lambda x: x.rlike(SAFETY_SECTION))).groupBy("doc_id").agg(F.countDistinct("unit").alias("n"))
    deep = lines.where("orphan").groupBy("doc_id").agg(F.lit(1).cast("long").alias("n"))
    issues = issues.unionByName(issue(alone, F.lit(UNPAIRED), "warning")).unionByName(issue(deep, F.lit(DEEP), "warning")).unionByName(issue(errors, c("code"), "error"))
    # Labels that frame a table stand in its context; units without room are issues of their own.
    framing = rows.where("fate = 'table'").select("doc_id", "pos")
    dropped = long.where("_f.texts is null").select("doc_id", F.explode("sources").alias("pos"))
    body = lines.join(framing.unionByName(dropped), ["doc_id", "pos"], "left_anti")
    return done, issues.unionByName(lost_issues(body, done, blocked))
