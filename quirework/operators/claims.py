"""Which lines of a text each draft holds, and whether every line is held exactly once.

Drafts of flat texts carry `sources`: the places of the filled lines whose text they are the first to hold. Headings are
not among them: they stand in the drafts' contexts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import strings as S
from quirework.operators.blocks import first_claims

#: Characters of a bucket in which pieces and spans of a long text meet.
BUCKET = 4096


def no_sources() -> Column:
    return F.array().cast("array<int>")


def piece_sources(pieces: DataFrame, spans: DataFrame, keys: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """keys, piece_no, source_id: the sources whose characters lie in a piece. Both have start and end, past-the-end.

    An empty span lies in no piece. Ranges meet in the buckets of positions they touch, so a long text isn't one task
    and not every piece of it is held against every span.
    """
    keys = keys or ["doc_id"]

    def dealt(ranges: DataFrame, last: str) -> DataFrame:
        filled = ranges.where("start < end")
        return filled.select(*keys, F.col("start").alias(f"{last}_start"), F.col("end").alias(f"{last}_end"), last, F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))).alias("_bucket"))

    both = dealt(pieces, "piece_no").join(dealt(spans, "source_id"), [*keys, "_bucket"])
    met = both.where("source_id_start < piece_no_end and source_id_end > piece_no_start")
    return met.select(*keys, "piece_no", "source_id").distinct()


def placed(parts: DataFrame, keys: list[str], part: str, number: str) -> DataFrame:
    """parts (keys, number, part) that join to a text, with start and end in characters."""
    upto = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("end", F.sum(F.char_length(part)).over(upto))
    return rows.withColumn("start", F.col("end") - F.char_length(part))


def split_sources(split: DataFrame, keys: list[str]) -> DataFrame:
    """keys, piece_no, sources of texts (keys, body, sources, parts) that were split into parts: a line that goes on in the next part is held by the first.

    sources are the filled lines of body in order.
    """
    pieces = placed(split.select(*keys, F.posexplode("parts").alias("piece_no", "_p")), keys, "_p", "piece_no")
    # Each line takes its line end along.
    lines = split.select(*keys, F.posexplode(F.split("body", "\n", -1)).alias("_k", "_line")).withColumn("_line", F.concat("_line", F.lit("\n")))
    filled = placed(lines, keys, "_line", "_k").where(~S.is_blank(F.col("_line")))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_k"))
    spans = filled.select(*keys, nth.alias("_n"), "start", (F.col("end") - 1).alias("end")).join(split.select(*keys, "sources"), keys)
    spans = spans.select(*keys, F.get("sources", F.col("_n") - 1).alias("source_id"), "start", "end")
    met = piece_sources(pieces, spans, keys)
    first = met.groupBy(*keys, "source_id").agg(F.min("piece_no").alias("piece_no"))
    return first.groupBy(*keys, "piece_no").agg(F.array_sort(F.collect_list("source_id")).alias("sources"))


def claims(drafts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, draft_no, kept columns, source_id of drafts with sources; where several name a line, the first draft's claim counts."""
    rows = drafts.select("doc_id", "draft_no", *(keep or []), F.explode("sources").alias("source_id"))
    return first_claims(rows)


def lost_lines(expected: DataFrame, drafts: DataFrame) -> DataFrame:
    """doc_id, n: lines that are expected (doc_id, sources) but not in just one draft, or in one and not expected.

    Each document is one array of line numbers on either side, so no row a line is shuffled.
    """
    held = drafts.groupBy("doc_id").agg(F.flatten(F.collect_list("sources")).alias("_held"))
    both = expected.select("doc_id", F.col("sources").alias("_expected")).join(held, "doc_id", "full")
    e, h = (F.coalesce(c, no_sources()) for c in ("_expected", "_held"))
    n = F.size(F.array_except(e, h)) + F.size(F.array_except(h, e)) + F.size(h) - F.size(F.array_distinct(h))
    return both.select("doc_id", n.cast("long").alias("n")).where("n > 0")


def lost_issues(expected: DataFrame, drafts: DataFrame) -> DataFrame:
    """Issues (doc_id, code, severity, n) of documents that lose or double a line."""
    return lost_lines(expected, drafts).select("doc_id", F.lit("source-block-consumption-mismatch").alias("code"), F.lit("error").alias("severity"), "n")
