"""Length-bounded splitting: the two small Arrow helpers that columns can't express."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SENTENCE = re.compile(r"[.!?。！？]+(?:[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+|\Z)")


def pieces_of(text: str, limit: int) -> list[str]:
    """Pieces of at most limit UTF-16 units whose concatenation is the text.

    A piece ends after the last blank line that fits, else the last line end, else the last sentence, else the last
    blank; without any it is as long as whole characters allow. Lengths are taken on a string with two places for
    each astral character, so offsets are UTF-16 offsets.
    """
    if limit < 1:
        return [text] if text else []
    wide = any(c > "\uffff" for c in text) if not text.isascii() else False
    s = "".join(c + "\0" if c > "\uffff" else c for c in text) if wide else text
    out, at, n = [], 0, len(s)
    while n - at > limit:
        end = at + limit
        cut = -1
        for mark in ("\n\n", "\n"):
            # A window shorter than the mark still takes a mark at its start.
            found = s.rfind(mark, at, max(end, at + len(mark)))
            if found >= 0:
                cut = found + len(mark)
                break
        if cut < 0:
            for m in _SENTENCE.finditer(s, at):
                if m.end() > end:
                    break
                cut = m.end()
        if cut < 0:
            found = s.rfind(" ", at, end)
            cut = found + 1 if found >= 0 else -1
        if cut < 0:
            cut = end - 1 if wide and s[end] == "\0" and s[end - 1] > "\uffff" else end
            if cut == at:
                break
        out.append(s[at:cut])
        at = cut
    if at < n:
        out.append(s[at:])
    return [p.replace("\0", "") for p in out] if wide else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, limits in batches:
        yield pd.Series([None if t is None else pieces_of(t, int(n)) for t, n in zip(texts, limits, strict=True)])


def split_text(text: Column, limit: Column | int) -> Column:
    """The pieces of text; call it on rows that need it, since Python sees every row."""
    return _split(text, F.lit(limit) if isinstance(limit, int) else limit)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _groups(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for lengths, limits in batches:
        out = []
        for row, limit in zip(lengths, limits, strict=True):
            group, used, ids = 0, 0, []
            for n in row:
                if ids and used + n > limit:
                    group, used = group + 1, 0
                used += n
                ids.append(group)
            out.append(ids)
        yield pd.Series(out)


def greedy_groups(lengths: Column, limit: Column) -> Column:
    """Group numbers of consecutive items, each group filled up to limit before the next is opened."""
    return _groups(lengths, limit)
