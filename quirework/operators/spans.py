"""Table cells that span rows and columns, placed on a grid.

A span table has (doc_id, table_no, rows): rows is an array of rows of struct<text, rowspan, colspan>.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The largest grid.
MAX_ROWS, MAX_COLUMNS, MAX_CELLS = 5_000, 512, 100_000


def place(rows: list[list[tuple[str, int, int]]]) -> list[tuple[int, int, int, int, str]] | None:
    """row, col, bottom, right, text of each cell, from 0; None if the grid would be too large.

    A cell takes the first free run of columns of its row; cells of rows above that reach down hold theirs.
    """
    taken: dict[int, set[int]] = {}
    out: list[tuple[int, int, int, int, str]] = []
    height, width = len(rows), 0
    for r, row in enumerate(rows):
        held = taken.pop(r, set())
        col = 0
        for text, down, across in row:
            if down < 1 or across < 1 or r + down > MAX_ROWS:
                return None
            while (hit := max((c for c in range(col, min(col + across, MAX_COLUMNS)) if c in held), default=-1)) >= 0:
                col = hit + 1
            if col + across > MAX_COLUMNS:
                return None
            for below in range(r + 1, r + down):
                taken.setdefault(below, set()).update(range(col, col + across))
            out.append((r, col, r + down - 1, col + across - 1, text))
            height, width = max(height, r + down), max(width, col + across)
            if height * width > MAX_CELLS:
                return None
            col += across
    return out if height <= MAX_ROWS else None


_NAMES = ("row", "col", "bottom", "right")
_PLACE = pa.list_(pa.struct([(n, pa.int32()) for n in _NAMES]))


def _place_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, the cells' spans, replaced by their places: tables of one shape in a batch are placed once."""
    for batch in batches:
        shapes = batch.column(batch.num_columns - 1).dictionary_encode()
        out = []
        for shape in shapes.dictionary.to_pylist():
            rows = [[("", *map(int, cell.split("x"))) for cell in row.split()] for row in shape.split("/")[:-1]]
            places = place(rows)
            out.append(None if places is None else [dict(zip(_NAMES, at[:4], strict=True)) for at in places])
        columns = [*batch.columns[:-1], pa.array(out, _PLACE).take(shapes.indices)]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "_places"])


def placed_cells(tables: DataFrame) -> DataFrame:
    """doc_id, table_no, n_rows, placed of span tables; placed is null where the grid would be too large."""
    # A table's shape, such as "2x1 1x2 /1x1 /", decides where its cells stand; their texts needn't be read for it.
    filled = F.transform(F.coalesce("rows", F.array().cast(tables.schema["rows"].dataType)), lambda r: F.coalesce(r, F.array().cast(tables.schema["rows"].dataType.elementType)))
    texts = F.transform(F.flatten(filled), lambda c: c["text"])
    shape = F.array_join(F.transform(filled, lambda r: F.concat(F.array_join(F.transform(r, lambda c: F.concat(c["rowspan"].cast("string"), F.lit("x"), c["colspan"].cast("string"))), " ", "0x0"), F.lit("/"))), "")
    rows = tables.select("doc_id", "table_no", F.size("rows").alias("n_rows"), texts.alias("_texts"), shape.alias("_shape"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:4]]
    found = rows.mapInArrow(_place_all, ", ".join([*kinds, f"_places array<struct<{','.join(f'{n}:int' for n in _NAMES)}>>"]))
    placed = F.transform("_places", lambda c, i: F.struct(*[c[n].alias(n) for n in _NAMES], F.get("_texts", i).alias("text")))
    return found.select("doc_id", "table_no", "n_rows", placed.alias("placed"))


def grid_rows(placed: DataFrame) -> DataFrame:
    """doc_id, table_no, row_no, cells: the rectangular grid; a cell's text stands at its first place, the rest is blank."""
    size = placed.where("placed is not null").withColumn("_h", F.greatest("n_rows", F.coalesce(F.array_max(F.transform("placed", lambda c: c["bottom"])) + 1, F.lit(0)))).withColumn("_w", F.coalesce(F.array_max(F.transform("placed", lambda c: c["right"])) + 1, F.lit(0)))
    size = size.where("_h > 0")
    rows = size.select("doc_id", "table_no", "_w", "placed", F.explode(F.sequence(F.lit(0), F.col("_h") - 1)).alias("row_no"))
    own = F.map_from_entries(F.transform(F.filter("placed", lambda c: c["row"] == F.col("row_no")), lambda c: F.struct(c["col"], c["text"])))
    cells = F.when(F.col("_w") > 0, F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit("")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("_m", own).select("doc_id", "table_no", "row_no", cells.alias("cells"))


def grid_issues(placed: DataFrame) -> DataFrame:
    """An error for each document with tables whose grid would be too large: they give no rows."""
    found = placed.where("placed is null").groupBy("doc_id").agg(F.count("*").alias("n"))
    return found.select("doc_id", F.lit("DOCX_TABLE_LIMIT").alias("code"), F.lit("error").alias("severity"), "n")


def grid_merges(placed: DataFrame) -> DataFrame:
    """doc_id, table_no, merge_no, top, left, bottom, right (from 1) of the cells that span more than one place."""
    cells = placed.where("placed is not null").select("doc_id", "table_no", F.posexplode("placed").alias("merge_no", "c"))
    wide = cells.where("c.bottom > c.row or c.right > c.col")
    return wide.select("doc_id", "table_no", "merge_no", *[(F.col(f"c.{k}") + 1).alias(n) for k, n in (("row", "top"), ("col", "left"), ("bottom", "bottom"), ("right", "right"))])
