"""Delimited text as records without holding a file in one task: quotes may span lines, and lines may be anywhere.

Where a line ends, outside of quotes or within, depends on where it begins; so each line is a function of two states:
it always ends outside or within, keeps the state or turns it. Blocks of lines compose theirs into one such function,
few rows then say in which state each block begins, and the lines of a block find theirs from that. A record is the
lines from one that begins outside of quotes to the next; its first line is its physical line.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quirework.functions import strings as S
from quirework.operators import lines as L
from quirework.operators.storage import cut

#: Lines of a block.
BLOCK_LINES = 1 << 12
_KEEPS, _TURNS, _OUTSIDE, _WITHIN = 0, 1, 2, 3
_RECORD = T.ArrayType(T.StringType())


def ends_within(line: str, within: bool) -> bool:
    """Whether a line that begins outside of or within quotes ends within. A quote opens at a field's start only."""
    at, n = 0, len(line)
    while True:
        if not within:
            # To the next field that begins with a quote.
            if at < n and line[at] == '"':
                at += 1
            else:
                found = line.find(',"', at)
                if found < 0:
                    return False
                at = found + 2
            within = True
        close = line.find('"', at)
        while close >= 0 and line[close + 1 : close + 2] == '"':
            close = line.find('"', close + 2)
        if close < 0:
            return True
        # What follows a closing quote belongs to the field up to its comma.
        comma = line.find(",", close + 1)
        if comma < 0:
            return False
        at, within = comma + 1, False


@F.pandas_udf(T.IntegerType())
def _effect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    of = {(False, True): _KEEPS, (True, False): _TURNS, (False, False): _OUTSIDE, (True, True): _WITHIN}
    for lines in batches:
        yield pd.Series([of[ends_within(t, False), ends_within(t, True)] for t in lines], dtype="int32")


@F.pandas_udf(_RECORD)
def _cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for records in batches:
        yield pd.Series([next(csv.reader(io.StringIO(r, newline="")), []) for r in records])


def _state(effect: Column, by: Window, start: Column | None = None) -> Column:
    """Whether a row begins within quotes: the last effect before it that doesn't depend on the state, and the turns since."""
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((effect == _TURNS).cast("int")).over(before), F.lit(0))
    fixed = F.last(F.when(effect >= _OUTSIDE, F.struct(effect.alias("e"), "_turned")), True).over(before)
    base = F.when(fixed.isNotNull(), (fixed["e"] == _WITHIN).cast("int")).otherwise(F.lit(0) if start is None else start.cast("int"))
    return (base + turns - F.coalesce(fixed["_turned"], F.lit(0))) % 2 == 1


def records(lines: DataFrame) -> DataFrame:
    """doc_id, record_no (from 0), start_line (from 1), cells of lines (doc_id, line_no from 0, line); blank lines are records without cells."""
    c = F.col
    # Lines without quotes never pass through Python: they keep the state.
    quoted = F.contains("line", F.lit('"'))
    rows = lines.withColumn("block", F.floor(c("line_no") / BLOCK_LINES))
    rows = rows.where(~quoted).withColumn("effect", F.lit(_KEEPS)).unionByName(rows.where(quoted).withColumn("effect", _effect("line")))
    rows = cut(rows, "csv-lines")
    by_line = Window.partitionBy("doc_id", "block").orderBy("line_no")
    upto = by_line.rowsBetween(Window.unboundedPreceding, 0)
    turned = F.sum((c("effect") == _TURNS).cast("int")).over(upto)
    # A block is one such function: its last fixed effect and the turns after it, or its turns alone.
    ends = rows.withColumn("_turned", turned).groupBy("doc_id", "block").agg(F.max(F.when(c("effect") >= _OUTSIDE, F.struct("line_no", "effect", "_turned"))).alias("f"), F.max("_turned").alias("t"))
    odd = (c("t") - F.coalesce("f._turned", F.lit(0))) % 2 == 1
    whole = F.when(c("f").isNull(), F.when(odd, _TURNS).otherwise(_KEEPS)).when((c("f.effect") == _WITHIN) != odd, _WITHIN).otherwise(_OUTSIDE)
    blocks = ends.select("doc_id", "block", whole.alias("effect"))
    by_block = Window.partitionBy("doc_id").orderBy("block")
    blocks = blocks.withColumn("_turned", F.sum((c("effect") == _TURNS).cast("int")).over(by_block.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("_start", _state(c("effect"), by_block)).select("doc_id", "block", "_start")
    rows = rows.join(blocks, ["doc_id", "block"]).withColumn("_turned", turned)
    rows = rows.withColumn("_within", _state(c("effect"), by_line, c("_start"))).withColumn("_opens", (~c("_within")).cast("int"))
    # Records are numbered in blocks, and blocks by the records before them.
    counts = rows.groupBy("doc_id", "block").agg(F.sum("_opens").alias("_n"))
    counts = counts.select("doc_id", "block", F.coalesce(F.sum("_n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = rows.join(counts, ["doc_id", "block"]).withColumn("record_no", c("_before") + F.sum("_opens").over(upto) - 1)
    whole = rows.groupBy("doc_id", "record_no").agg((F.min("line_no") + 1).alias("start_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("record"))
    plain = F.when(c("record") == "", F.array().cast("array<string>")).otherwise(F.split("record", ",", -1))
    simple = ~F.contains("record", F.lit('"'))
    return whole.where(simple).withColumn("cells", plain).unionByName(whole.where(~simple).withColumn("cells", _cells("record"))).select("doc_id", "record_no", "start_line", "cells")


def text_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines (doc_id, line_no, line) of texts (doc_id, text); a line end at the end opens no further line."""
    whole = F.regexp_replace(S.normalize_line_ends(F.coalesce(F.col(text), F.lit(""))), r"\n\z", "")
    return L.explode_lines(docs.select("doc_id", whole.alias("text")).where("text <> ''")).withColumnRenamed("pos", "line_no")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (doc_id: the file's path, line_no, line) of text files, however Spark splits them."""
    c = F.col
    rows = spark.read.text(path).select(c("_metadata.file_path").alias("doc_id"), c("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_at"), c("value").alias("line"))
    rows = cut(rows, "file-lines")
    before = Window.partitionBy("doc_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("doc_id", "_part").agg(F.count("*").alias("_n"))
    parts = parts.select("doc_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("doc_id", "_part").orderBy("_at")) - 1
    return rows.join(parts, ["doc_id", "_part"]).select("doc_id", (c("_before") + within).alias("line_no"), "line")


def irregular_records(found: DataFrame) -> DataFrame:
    """doc_id, n, locations of records whose width differs from their first filled one's, named by physical line."""
    c = F.col
    filled = found.where(F.size("cells") > 0).withColumn("w", F.size("cells"))
    first = filled.groupBy(c("doc_id").alias("_d")).agg(F.min_by("w", "record_no").alias("_w"))
    odd = filled.join(first, c("doc_id") == c("_d")).where("w <> _w")
    return odd.groupBy("doc_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("start_line")), lambda r: F.concat(F.lit("row "), r.cast("string"))).alias("locations"))
