"""Documents as line tables, and the windows over them.

A line table has (doc_id, pos, line). Windows are partitioned by document: a document's lines meet in one task, and
different documents spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quirework.functions import strings as S


def in_doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def by_pos() -> WindowSpec:
    return in_doc().orderBy("pos")


def before() -> WindowSpec:
    return by_pos().rowsBetween(Window.unboundedPreceding, -1)


def upto() -> WindowSpec:
    return by_pos().rowsBetween(Window.unboundedPreceding, 0)


def explode_lines(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, kept columns, pos, line of docs (doc_id, text); a null text has no lines."""
    return docs.select("doc_id", *(keep or []), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def join_lines(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The text of each document's lines."""
    rows = lines.groupBy("doc_id", *(keep or [])).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_l"))
    return rows.select("doc_id", *(keep or []), F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def mark_decoration(lines: DataFrame) -> DataFrame:
    """Add `noise`: page number lines where a document has several, and later copies of lines that stand by them.

    A line stands by a page number if it is within three filled lines of it and only candidates lie between.
    """
    value = F.regexp_replace(S.trim(F.col("line")), f"{S.SPACE}+", " ")
    filled = lines.where(~S.is_blank(F.col("line"))).withColumn("_v", value)
    filled = filled.withColumn("_page", S.is_page_number(F.col("_v"))).withColumn("_cand", S.is_decoration_candidate(F.col("_v")))
    near = F.lit(False)
    for step in (F.lag, F.lead):
        clear = F.lit(True)
        for k in (1, 2, 3):
            near = near | (clear & F.coalesce(step("_page", k).over(by_pos()), F.lit(False)))
            clear = clear & F.coalesce(step("_cand", k).over(by_pos()), F.lit(False))
    filled = filled.withColumn("_near", near & F.col("_cand"))
    pages = F.count_if("_page").over(in_doc())
    copy = F.row_number().over(Window.partitionBy("doc_id", "_v", "_near").orderBy("pos"))
    noise = filled.select("doc_id", "pos", ((F.col("_page") & (pages >= 2)) | (F.col("_near") & (copy > 1))).alias("noise")).where("noise")
    return lines.join(noise, ["doc_id", "pos"], "left").withColumn("noise", F.coalesce("noise", F.lit(False)))


def may_have_pages(text: Column) -> Column:
    """Whether any line may be a page number: documents without one pass untouched, without windows."""
    return text.rlike(r"(?imu)^[ \t]*(?:\d+\s*[-–—]\s*\d+|[-–—]\s*\d+\s*[-–—]|(?:page|페이지)\s*\d+(?:\s*(?:/|of)\s*\d+)?)[ \t]*$")


def prepare(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with cleaned texts, and n_removed lines of page decoration."""
    clean = docs.withColumn("text", S.clean_text(F.col("text")))
    paged = F.coalesce(may_have_pages(F.col("text")), F.lit(False))
    plain = clean.where(~paged).withColumn("n_removed", F.lit(0).cast("long"))
    marked = mark_decoration(explode_lines(clean.where(paged).select("doc_id", "text")))
    kept = join_lines(marked.where("not noise")).withColumnRenamed("text", "_t")
    counts = marked.groupBy("doc_id").agg(F.count_if("noise").alias("n_removed"))
    rest = clean.where(paged).drop("text").join(counts, "doc_id").join(kept, "doc_id", "left")
    return plain.unionByName(rest.withColumn("text", F.coalesce("_t", F.lit(""))).select(*plain.columns))


def mark_tables(lines: DataFrame) -> DataFrame:
    """Add `table_no`, the first pos of the Markdown table a line belongs to (null outside tables).

    A table begins at a pipe line before a separator line and lasts as long as pipe lines follow.
    """
    lines = lines.withColumn("_pipe", S.is_pipe_line(F.col("line"))).withColumn("_sep", S.is_separator_line(F.col("line")))
    lines = lines.withColumn("_run", F.sum(F.when(F.col("_pipe"), 0).otherwise(1)).over(upto()))
    lines = lines.withColumn("_head", F.col("_pipe") & F.coalesce(F.lead("_sep").over(by_pos()), F.lit(False)))
    # The newest run with a table, and the first place in it where one begins: all windows share one order.
    start = F.max(F.when(F.col("_head"), F.struct("_run", (-F.col("pos")).alias("at")))).over(upto())
    lines = lines.withColumn("_start", start)
    return lines.withColumn("table_no", F.when(F.col("_pipe") & (F.col("_start._run") == F.col("_run")), -F.col("_start.at"))).drop("_pipe", "_sep", "_run", "_head", "_start")


def mark_siblings(lines: DataFrame, number: Column, family: Column) -> DataFrame:
    """Add `sibling`: numbered lines whose next or previous filled line has the next or previous number of one family."""
    # Blank lines carry no value, so the last value before a line, in either direction, is its filled neighbour's.
    filled = ~S.is_blank(F.col("line"))
    lines = lines.withColumn("_v", F.when(filled, F.struct(number.alias("n"), family.alias("f"))))
    order = "IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY pos)"
    lines = lines.withColumn("_later", F.expr(f"lead(_v) {order}")).withColumn("_earlier", F.expr(f"lag(_v) {order}"))
    own, later, earlier = F.col("_v"), F.col("_later"), F.col("_earlier")
    next_one = (later["n"] == own["n"] + 1) & (later["f"] == own["f"])
    previous = (earlier["n"] == own["n"] - 1) & (earlier["f"] == own["f"])
    return lines.withColumn("sibling", F.coalesce(next_one, F.lit(False)) | F.coalesce(previous, F.lit(False))).drop("_v", "_later", "_earlier")


def expected_lines(filled: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """doc_id, sources of filled body lines (doc_id, pos, line, table_no).

    Of tables, separator lines and empty rows aren't expected in a draft, nor are the lines of blocked ones (doc_id, table_no).
    """
    row = F.col("table_no").isNull() | (F.coalesce(F.col("line").rlike(r"[^|\s]"), F.lit(False)) & (F.col("pos") != F.col("table_no") + 1))
    rows = filled.where(row).select("doc_id", "pos", "table_no")
    if blocked is not None:
        rows = rows.join(blocked, ["doc_id", "table_no"], "left_anti")
    return rows.groupBy("doc_id").agg(F.collect_list(F.col("pos").cast("int")).alias("sources"))


def arabic_number(line: Column) -> Column:
    return F.when(line.rlike(r"^\d+[.)]\s+\S"), F.regexp_extract(line, r"^(\d+)", 1).cast("decimal(20,0)"))
