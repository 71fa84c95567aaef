"""Edits of finished chunks, held as one array a document: search, delete, move a boundary, merge, undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions import strings as S

HISTORY = 50


def search(docs: DataFrame, query: str) -> DataFrame:
    """doc_id, index, chunk of the chunks that hold query in any case, or whose number it is (#001)."""
    rows = docs.select("doc_id", F.posexplode("chunks").alias("index", "chunk"))
    number = F.concat(F.lit("#"), F.lpad((F.col("index") + 1).cast("string"), 3, "0"))
    return rows.where(F.contains(F.lower("chunk"), F.lit(query.lower())) | F.contains(number, F.lit(query)))


def delete(chunks: Column, index: Column) -> Column:
    """Without chunk index; the last chunk of a document stays, as does everything for a bad index."""
    ok = (F.size(chunks) > 1) & (index >= 0) & (index < F.size(chunks))
    return F.when(ok, F.filter(chunks, lambda c, i: i != index)).otherwise(chunks)


def merge_next(chunks: Column, index: Column) -> Column:
    """Chunk index and the next as one, with a blank line between; null-safe for a bad index."""
    ok = (index >= 0) & (index < F.size(chunks) - 1)
    joined = F.concat(F.regexp_replace(F.get(chunks, index), r"\s+\z", ""), F.lit("\n\n"), F.regexp_replace(F.get(chunks, index + 1), r"\A\s+", ""))
    return F.when(ok, F.filter(F.transform(chunks, lambda c, i: F.when(i == index, joined).otherwise(c)), lambda c, i: i != index + 1)).otherwise(chunks)


def move_boundary(chunks: Column, index: Column, offset: Column) -> Column:
    """The first offset characters of chunk index + 1 go to the end of chunk index; an emptied chunk goes."""
    ok = (index >= 0) & (index < F.size(chunks) - 1)
    after = F.get(chunks, index + 1)
    head, rest = F.substring(after, F.lit(1), offset), F.substring(after, offset + 1, F.length(after))
    moved = F.transform(chunks, lambda c, i: F.when(i == index, F.concat(c, head)).when(i == index + 1, rest).otherwise(c))
    return F.when(ok, F.filter(moved, lambda c, i: ~((i == index + 1) & S.is_blank(c)))).otherwise(chunks)


def split_edited(text: Column) -> Column:
    """Chunks of an edited serialization: split at the separator, nothing trimmed."""
    return F.split(text, S.SEPARATOR, -1)


def last_versions(history: DataFrame) -> DataFrame:
    """The newest versions (doc_id, version, ...) that undo can reach."""
    newest = Window.partitionBy("doc_id").orderBy(F.desc("version"))
    return history.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= HISTORY).drop("_k")
