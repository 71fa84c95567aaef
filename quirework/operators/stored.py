"""Cells as a workbook stores them to cells as it shows them: shared formulas written out for each cell, values by their format codes.

stored: doc_id, sheet_no, row, col, value, formula, comment, kind (n, s, b or e), style, shared (the formula's group).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions.formats import displayed

CELL = ["doc_id", "sheet_no", "row", "col", "value", "formula", "comment"]
# The largest sheet.
LAST_ROW, LAST_COLUMN = 1_048_576, 16_384

_REF = r"\$?[A-Za-z]{1,3}\$?[1-9][0-9]*"
_COLUMNS, _ROWS = r"\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}", r"\$?[0-9]+:\$?[0-9]+"
#: Parts of a formula in order: texts, quoted and plain sheet names and functions, brackets, whole columns and rows, places, other words.
_TOKENS = (
    r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|\[[^\]]*\]|[A-Za-z_\\][A-Za-z0-9_.\\]*\s*[(!]"
    rf"|{_COLUMNS}(?![A-Za-z0-9_.(!])|{_ROWS}(?![A-Za-z0-9_.])|{_REF}(?![A-Za-z0-9_.(!])|[A-Za-z0-9_.$\\]+|[\s\S]"
)


#: A place within a formula: a column, a row or both, each held by a dollar sign or not.
_PLACE = re.compile(r"(\$?)([A-Za-z]*)(\$?)([0-9]*)\Z")
_TOKEN = re.compile(f"({_TOKENS})", re.ASCII)
_MOVES = re.compile(rf"(?:{_REF}|{_COLUMNS}|{_ROWS})\Z", re.ASCII)


def _letters(n: int) -> str:
    label = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        label = chr(65 + k) + label
    return label


@lru_cache(4096)
def _parts(formula: str) -> tuple[str | tuple, ...]:
    """The formula's texts, and for what moves a tuple of places (held column, column, held row, row; 0 where it has none)."""
    out: list[str | tuple] = []
    for token in _TOKEN.findall(formula):
        if _MOVES.match(token):
            places = []
            for held_col, letters, held_row, digits in (_PLACE.match(x).groups() for x in token.split(":")):
                # Of a row alone the first group has the dollar sign.
                held_col, held_row = (held_col, held_row) if letters else ("", held_col + held_row)
                places.append((held_col, reduce(lambda n, c: n * 26 + ord(c) - 64, letters.upper(), 0) if letters else None, held_row, int(digits) if digits else None))
            out.append(tuple(places))
        elif out and isinstance(out[-1], str):
            out[-1] += token
        else:
            out.append(token)
    return tuple(out)


def _moved(places: tuple, down: int, across: int) -> str:
    """Places, each moved unless a dollar sign holds it; #REF! where that leaves the sheet."""
    out = []
    for held_col, col, held_row, row in places:
        col = col if col is None or held_col else col + across
        row = row if row is None or held_row else row + down
        gone = (col is not None and not 1 <= col <= LAST_COLUMN) or (row is not None and not 1 <= row <= LAST_ROW)
        out.append("#REF!" if gone else f"{'' if col is None else held_col + _letters(col)}{'' if row is None else held_row + str(row)}")
    return ":".join(out)


@lru_cache(65_536)
def _text(formula: str, down: int, across: int) -> str:
    return "".join(x if isinstance(x, str) else _moved(x, down, across) for x in _parts(formula))


@F.pandas_udf(T.StringType())
def _translated(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, downs, across in batches:
        rows = zip(texts, downs, across, strict=True)
        yield pd.Series([None if t is None or d != d or a != a else _text(t, int(d), int(a)) for t, d, a in rows], dtype=object)


def translate_formula(formula: Column, down: Column, across: Column) -> Column:
    """formula as it reads so many rows down and columns across: relative places move, texts, names and functions stay."""
    return _translated(formula, down.cast("int"), across.cast("int"))


def share_formulas(stored: DataFrame) -> DataFrame:
    """stored with the formulas of shared groups in each of their cells, taken from the group's first cell that has a text.

    Only cells without a text of their own meet their group, and pass through Python.
    """
    c = F.col
    # Sorts compare the number first: groups by wide ids are slow to compare.
    group = ["_hash", "doc_id", "sheet_no", "shared"]
    hashed = stored.withColumn("_hash", F.xxhash64(*group[1:]))
    masters = hashed.where("shared is not null and formula <> ''").groupBy(*group).agg(F.min_by(F.struct("row", "col", "formula"), F.struct("row", "col")).alias("_m"))
    lacks = F.coalesce(c("shared").isNotNull() & (c("formula") == ""), F.lit(False))
    met = hashed.where(lacks).join(masters.hint("merge"), group, "left")
    text = translate_formula(c("_m.formula"), c("row") - c("_m.row"), c("col") - c("_m.col"))
    return stored.where(~lacks).unionByName(met.withColumn("formula", F.coalesce(text, "formula")).select(*stored.columns))


def display_cells(stored: DataFrame, formats: DataFrame) -> DataFrame:
    """CELL of stored cells, values as displayed; formats: doc_id, sheet_no, epoch, codes (a map from style to code).

    Texts under a plain code, and cells without a value, never pass through Python.
    """
    c = F.col
    rows = stored.join(formats, ["doc_id", "sheet_no"], "left").withColumn("_code", F.coalesce(F.try_element_at(c("codes"), c("style")), F.lit("General")))
    by_code = c("value").isNotNull() & ((c("kind") == "n") | ((c("kind") == "s") & F.contains("_code", F.lit("@")) & (c("_code") != "@")))
    plain = rows.where(~F.coalesce(by_code, F.lit(False))).select(*CELL)
    coded = rows.where(F.coalesce(by_code, F.lit(False))).withColumn("value", displayed(c("value"), c("kind"), c("_code"), F.coalesce("epoch", F.lit(1900))))
    return plain.unionByName(coded.select(*CELL))
