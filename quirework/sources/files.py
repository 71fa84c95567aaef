"""Files as documents: text with its encoding found, delimited text, workbooks and word-processor documents.

Files come through Spark's binaryFile source: routes and sizes are filtered before contents are read. Each parser is
a small function of one file's bytes; Spark deals the files.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions import strings as S
from quirework.functions.formats import BUILT_IN
from quirework.operators import spans
from quirework.operators.cells import merge_ranges
from quirework.operators.storage import cut
from quirework.operators.stored import display_cells, share_formulas

DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("n_replaced", T.LongType())])
ROWS = T.ArrayType(T.StructType([T.StructField("sheet_no", T.IntegerType()), T.StructField("sheet", T.StringType()), T.StructField("row_no", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))]))
CELL = T.StructType([T.StructField("text", T.StringType()), T.StructField("rowspan", T.IntegerType()), T.StructField("colspan", T.IntegerType())])
BLOCKS = T.ArrayType(
    T.StructType([
        T.StructField("order", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("depth", T.IntegerType()),
        T.StructField("ordered", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("cells", T.ArrayType(T.ArrayType(CELL))),
    ])
)


def files(spark: SparkSession, path: str, route: str) -> DataFrame:
    """path, name, content of files of one route within the size limit."""
    rows = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return rows.where((S.file_route(F.col("name")) == route) & (F.col("length") <= S.MAX_FILE_BYTES)).select("path", "name", "content")


def decode_bytes(raw: bytes, encoding: str | None = None) -> tuple[str, str, int]:
    """Text, encoding and replaced characters: a byte order mark, then strict UTF-8, then Korean; or the one given."""
    codec = {"utf-8": "utf-8", "euc-kr": "cp949"}
    if encoding is None:
        if raw.startswith(b"\xef\xbb\xbf"):
            encoding = "utf-8"
        else:
            try:
                return raw.decode("utf-8"), "utf-8", 0
            except UnicodeDecodeError:
                encoding = "euc-kr"
    text = raw.removeprefix(b"\xef\xbb\xbf").decode(codec.get(encoding, encoding), errors="replace")
    return text, encoding, text.count("�")


def with_text(df: DataFrame, content: str = "content", encoding: str | None = None) -> DataFrame:
    """Add `decoded`: text, encoding, n_replaced."""

    @F.pandas_udf(DECODED)
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raw in batches:
            yield pd.DataFrame([decode_bytes(bytes(r), encoding) for r in raw], columns=["text", "encoding", "n_replaced"])

    return df.withColumn("decoded", decode(content))


def csv_records(text: str) -> list[dict]:
    return [{"sheet_no": 1, "sheet": "Sheet1", "row_no": i, "cells": row} for i, row in enumerate(csv.reader(io.StringIO(text)))]


def csv_sheets(df: DataFrame, text: str = "text") -> DataFrame:
    """Sheet rows of delimited texts (doc_id, name, text); records may hold line ends in quotes, blank ones stay."""

    @F.pandas_udf(ROWS)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([csv_records(t or "") for t in texts])

    return df.select("doc_id", "name", F.inline(parse(text)))


def irregular_records(sheets: DataFrame) -> DataFrame:
    """doc_id, n, locations of filled records whose width differs from the first filled one."""
    from pyspark.sql.window import Window

    filled = sheets.where(F.exists("cells", lambda c: c != ""))
    width = F.first(F.size("cells")).over(Window.partitionBy("doc_id", "sheet_no").orderBy("row_no"))
    odd = filled.withColumn("_w", width).where(F.size("cells") != F.col("_w"))
    return odd.groupBy("doc_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("row_no")), lambda r: F.concat(F.lit("row "), (r + 1).cast("string"))).alias("locations"))


_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


CELLS = (
    "sheet_no int, sheet string, cells array<struct<row:int,col:int,value:string,formula:string,comment:boolean,kind:string,style:int,shared:int>>, "
    "merges array<struct<merge_no:int,top:int,left:int,bottom:int,right:int>>, titles array<string>, formats array<struct<style:int,code:string>>, epoch int"
)


def _place(address: str) -> tuple[int, int]:
    """Row and column, from 1, of an address such as B7."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", address)
    if not m:
        return 0, 0
    column = 0
    for letter in m[1]:
        column = column * 26 + ord(letter) - 64
    return int(m[2]), column


def workbook_parts(raw: bytes) -> list[dict]:
    """Sheets of an OOXML or OpenDocument workbook: cells as they are stored (values, formulas or the group of a shared one, style), comments; merges; print titles; format codes by style."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        if "content.xml" in names:
            return open_parts(raw)
        read = lambda name: ElementTree.fromstring(z.read(name)) if name in names else None
        strings = read("xl/sharedStrings.xml")
        shared = [] if strings is None else ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in strings]
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        book = read("xl/workbook.xml")
        formats = cell_formats(read("xl/styles.xml"))
        epoch = 1904 if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_M}workbookPr")) else 1900
        named = [(n.get("localSheetId"), n.text or "") for n in book.iter(f"{_M}definedName") if n.get("name") == "_xlnm.Print_Titles"]
        out = []
        for k, sheet in enumerate(book.iter(f"{_M}sheet"), 1):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            root = read(path)
            cells: dict[tuple[int, int], dict] = {}
            for c in root.iter(f"{_M}c"):
                at = _place(c.get("r", ""))
                value, formula = c.find(f"{_M}v"), c.find(f"{_M}f")
                text = "".join(t.text or "" for t in c.iter(f"{_M}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                if c.get("t") == "b" and text is not None:
                    text = "TRUE" if text == "1" else "FALSE"
                if at[0] and (text is not None or formula is not None):
                    kind = c.get("t", "n")
                    shared = formula.get("si") if formula is not None and formula.get("t") == "shared" else None
                    cells[at] = {
                        "value": text, "formula": None if formula is None else formula.text or "", "comment": False,
                        "kind": kind if kind in "nbe" else "s", "style": int(c.get("s", 0)), "shared": None if shared is None else int(shared),
                    }
            folder, file = path.rsplit("/", 1)
            links = read(f"{folder}/_rels/{file}.rels")
            for link in [] if links is None else links:
                if link.get("Type", "").endswith("/comments"):
                    notes = read(posixpath.normpath(posixpath.join(folder, link.get("Target", ""))))
                    for note in [] if notes is None else notes.iter(f"{_M}comment"):
                        at = _place(note.get("ref", ""))
                        cells.setdefault(at, {"value": None, "formula": None, "kind": None, "style": None, "shared": None})["comment"] = True
            merges = []
            for m in root.iter(f"{_M}mergeCell"):
                ends = [_place(x) for x in m.get("ref", "").split(":")]
                merges.append({"merge_no": len(merges), "top": ends[0][0], "left": ends[0][1], "bottom": ends[-1][0], "right": ends[-1][1]})
            titles = [ref for scope, ref in named if scope is None or scope == str(k - 1)]
            listed = [{"row": r, "col": c, **cells[r, c]} for r, c in sorted(cells) if r]
            out.append({"sheet_no": k, "sheet": sheet.get("name"), "cells": listed, "merges": merges, "titles": titles, "formats": formats, "epoch": epoch})
        return out


_O = {k: "{urn:oasis:names:tc:opendocument:xmlns:" + v + ":1.0}" for k, v in (("table", "table"), ("office", "office"), ("text", "text"))}
#: Cells that a sheet may hold once its runs are written out.
MAX_SHEET_CELLS = 300_000


def open_formula(formula: str) -> str:
    """An OpenDocument formula as a workbook writes it: places without brackets, sheets before an exclamation mark."""

    def place(part: str) -> str:
        sheet, _, at = part.rpartition(".")
        return f"{sheet.lstrip('$')}!{at}" if sheet else at

    plain = re.sub(r"^[a-z]+:=?|^=", "", formula)
    texts = re.split(r'("(?:[^"]|"")*")', plain)
    for k in range(0, len(texts), 2):
        texts[k] = re.sub(r"\[([^\]]*)\]", lambda m: ":".join(place(p) for p in m[1].split(":")), texts[k]).replace(";", ",")
    return "".join(texts)


def open_parts(raw: bytes) -> list[dict]:
    """Sheets of an OpenDocument spreadsheet, as workbook_parts gives them; values as their cells show them.

    Runs of repeated rows and cells are counted, and written out only where they hold something.
    """
    table, office, text = _O["table"], _O["office"], _O["text"]

    def shown(p) -> str:
        out = p.text or ""
        for x in p:
            if x.tag == f"{text}s":
                out += " " * int(x.get(f"{text}c", 1))
            elif x.tag in (f"{text}tab", f"{text}line-break"):
                out += "\t" if x.tag.endswith("tab") else "\n"
            else:
                out += shown(x)
            out += x.tail or ""
        return out

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    out = []
    for k, sheet in enumerate(root.iter(f"{table}table"), 1):
        cells, merges, heads, row_no = [], [], [], 1

        def rows_of(node, head: bool = False):
            for x in node:
                if x.tag == f"{table}table-row":
                    yield x, head
                elif x.tag in (f"{table}table-header-rows", f"{table}table-rows", f"{table}table-row-group"):
                    yield from rows_of(x, head or x.tag.endswith("header-rows"))

        for row, head in rows_of(sheet):
            times, col, held = int(row.get(f"{table}number-rows-repeated", 1)), 1, []
            for cell in row:
                if cell.tag not in (f"{table}table-cell", f"{table}covered-table-cell"):
                    continue
                across = int(cell.get(f"{table}number-columns-repeated", 1))
                paragraphs = cell.findall(f"{text}p")
                formula, note = cell.get(f"{table}formula"), cell.find(f"{office}annotation") is not None
                value = "\n".join(map(shown, paragraphs)) if paragraphs else None
                wide, down = (int(cell.get(f"{table}number-{n}-spanned", 1)) for n in ("columns", "rows"))
                if wide > 1 or down > 1:
                    merges.append({"merge_no": len(merges), "top": row_no, "left": col, "bottom": row_no + down - 1, "right": col + wide - 1})
                if value is not None or formula or note:
                    one = {"value": value, "formula": open_formula(formula) if formula else None, "comment": note, "kind": "s", "style": None, "shared": None}
                    if len(cells) + (len(held) + across) * times > MAX_SHEET_CELLS:
                        raise ValueError("the sheet holds too many cells")
                    held += [{"col": c, **one} for c in range(col, col + across)]
                col += across
            for r in range(row_no, row_no + times) if held else ():
                cells += [{"row": r, **x} for x in held]
            if head:
                heads += [row_no, row_no + times - 1]
            row_no += times
        titles = [f"!${min(heads)}:${max(heads)}"] if heads else []
        out.append({"sheet_no": k, "sheet": sheet.get(f"{table}name"), "cells": cells, "merges": merges, "titles": titles, "formats": [], "epoch": 1900})
    return out


def cell_formats(styles) -> list[dict]:
    """Format codes of a workbook's cell styles; those without one are General."""
    if styles is None:
        return []
    own = {int(n.get("numFmtId")): n.get("formatCode") or "General" for n in styles.iter(f"{_M}numFmt")}
    cells = styles.find(f"{_M}cellXfs")
    numbers = [int(x.get("numFmtId") or 0) for x in (cells if cells is not None else [])]
    return [{"style": k, "code": own.get(n, BUILT_IN.get(n, "General"))} for k, n in enumerate(numbers)]


def workbook_parts_of(df: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, name, sheet_no, sheet, cells, merges, titles of workbooks (doc_id, name, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                parts = workbook_parts(bytes(row.content))
                yield pd.DataFrame([{"doc_id": row.doc_id, "name": row.name, **p} for p in parts], columns=["doc_id", "name", "sheet_no", "sheet", "cells", "merges", "titles", "formats", "epoch"])

    rows = df.select("doc_id", "name", F.col(content).alias("content"))
    return rows.mapInPandas(parse, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, name string, {CELLS}")


def workbook_tables(parts: DataFrame) -> dict[str, DataFrame]:
    """cells, merges, names and sheets of written workbook parts, as operators.cells takes them: shared formulas written out, values as displayed."""
    keys = ["doc_id", "sheet_no"]
    stored = parts.select(*keys, F.inline("cells"))
    formats = parts.select(*keys, "epoch", F.map_from_entries(F.transform("formats", lambda x: F.struct(x["style"], x["code"]))).alias("codes"))
    return {
        "cells": display_cells(share_formulas(stored), formats), "merges": parts.select(*keys, F.inline("merges")), "sheets": parts.select(*keys, "name", "sheet"),
        "names": parts.select(*keys, F.lit("_xlnm.Print_Titles").alias("name"), F.posexplode("titles").alias("name_no", "ref")),
    }


def workbook_rows(raw: bytes) -> list[dict]:
    """Rows of an OOXML workbook's used ranges as they are stored, without its layout and formats."""
    out = []
    for part in workbook_parts(raw):
        held = {(c["row"], c["col"]): c["value"] or "" for c in part["cells"] if c["value"] is not None or c["formula"] is not None}
        if held:
            rows, columns = [r for r, _ in held], [c for _, c in held]
            for r in range(min(rows), max(rows) + 1):
                out.append({"sheet_no": part["sheet_no"], "sheet": part["sheet"], "row_no": r - min(rows), "cells": [held.get((r, c), "") for c in range(min(columns), max(columns) + 1)]})
    return out


def workbook_sheets(df: DataFrame, content: str = "content") -> DataFrame:
    """Sheet rows of workbooks (doc_id, name, content)."""

    @F.pandas_udf(ROWS)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series([workbook_rows(bytes(r)) for r in raw])

    return df.select("doc_id", "name", F.inline(parse(content)))


_V = f"{_W}val"
#: Elements whose text isn't the paragraph's own: deleted and moved text, field codes, drawings, readings, notes.
_NO_TEXT = {f"{_W}{n}" for n in ("del", "moveFrom", "instrText", "delText", "drawing", "pict", "object", "rt", "pPr", "rPr", "footnoteReference", "endnoteReference", "commentReference")}
_AS_TEXT = {f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}tab": "\t", f"{_W}ptab": "\t", f"{_W}noBreakHyphen": "-"}


def word_text(node) -> str:
    """Text of a paragraph with its links and insertions; white space as a block shows it."""
    parts: list[str] = []

    def walk(x) -> None:
        for child in x:
            if child.tag in _NO_TEXT or child.tag.endswith("}AlternateContent"):
                continue
            if child.tag == f"{_W}t":
                parts.append(child.text or "")
            elif child.tag in _AS_TEXT:
                parts.append("" if child.get(f"{_W}type") in ("page", "column") else _AS_TEXT[child.tag])
            else:
                walk(child)

    walk(node)
    return re.sub(r" *\n *", "\n", re.sub(r"[^\S\n]+", " ", "".join(parts))).strip()


def inherited(styles: dict[str, dict], start: str | None, key: str):
    """A property of a style, or of the first style it is based on that has it; a circle of styles ends the search."""
    seen: set[str] = set()
    while start in styles and start not in seen:
        seen.add(start)
        if styles[start].get(key) is not None:
            return styles[start][key]
        start = styles[start]["based"]
    return None


def _numbering(p) -> tuple[str | None, int] | None:
    """numId and level of paragraph properties that name a list; None where they name none."""
    numbers = p.find(f"{_W}numPr") if p is not None else None
    if numbers is None:
        return None
    own, level = numbers.find(f"{_W}numId"), numbers.find(f"{_W}ilvl")
    return None if own is None else own.get(_V), int(level.get(_V, 0)) if level is not None else 0


def word_styles(root) -> dict[str, dict]:
    """based, level (of its outline or its name) and numbering of each style."""
    out = {}
    for style in root.iter(f"{_W}style") if root is not None else []:
        p, name, based = style.find(f"{_W}pPr"), style.find(f"{_W}name"), style.find(f"{_W}basedOn")
        outline = p.find(f"{_W}outlineLvl") if p is not None else None
        named = re.fullmatch(r"(?i)heading\s*([1-6])", (name.get(_V) if name is not None else style.get(f"{_W}styleId")) or "")
        level = int(named[1]) if named else int(outline.get(_V, 9)) + 1 if outline is not None else None
        out[style.get(f"{_W}styleId")] = {"based": based.get(_V) if based is not None else None, "level": level, "numbers": _numbering(p)}
    return out


def ordered_levels(root) -> dict[tuple[str, int], bool]:
    """Whether a list (numId) counts at a level, by its abstract numbering and its own overrides."""
    if root is None:
        return {}
    abstract, linked = {}, {}
    for a in root.iter(f"{_W}abstractNum"):
        key = a.get(f"{_W}abstractNumId")
        abstract[key] = {int(v.get(f"{_W}ilvl", 0)): v.find(f"{_W}numFmt") for v in a.findall(f"{_W}lvl")}
        link, own = a.find(f"{_W}numStyleLink"), a.find(f"{_W}styleLink")
        if link is not None:
            linked[key] = link.get(_V)
        if own is not None:
            abstract[("style", own.get(_V))] = abstract[key]
    out = {}
    for n in root.iter(f"{_W}num"):
        of = n.find(f"{_W}abstractNumId")
        key = of.get(_V) if of is not None else None
        levels = dict(abstract.get(("style", linked[key])) or {}) if key in linked else dict(abstract.get(key) or {})
        for o in n.findall(f"{_W}lvlOverride"):
            if (v := o.find(f"{_W}lvl")) is not None and v.find(f"{_W}numFmt") is not None:
                levels[int(o.get(f"{_W}ilvl", 0))] = v.find(f"{_W}numFmt")
        for level, kind in levels.items():
            out[n.get(f"{_W}numId"), level] = kind is not None and kind.get(_V) not in ("bullet", "none")
    return out


def word_spans(table) -> list[list[dict]]:
    """Rows of a table's cells with the rows and columns they span; a cell that goes on from above is part of it."""
    rows, open_ = [], {}
    for row in table.findall(f"{_W}tr"):
        cells, col, still = [], 0, {}
        skipped = row.find(f"{_W}trPr/{_W}gridBefore")
        col += int(skipped.get(_V, 0)) if skipped is not None else 0
        if col:
            cells.append({"text": "", "rowspan": 1, "colspan": col})
        for cell in row.findall(f"{_W}tc"):
            across, down = cell.find(f"{_W}tcPr/{_W}gridSpan"), cell.find(f"{_W}tcPr/{_W}vMerge")
            wide = max(1, int(across.get(_V, 1))) if across is not None else 1
            goes_on = down is not None and down.get(_V) != "restart" and col in open_
            if goes_on:
                open_[col]["rowspan"] += 1
                still[col] = open_[col]
            else:
                one = {"text": "\n".join(filter(None, (word_text(p) for p in cell.findall(f".//{_W}p")))), "rowspan": 1, "colspan": wide}
                cells.append(one)
                if down is not None:
                    still[col] = one
            col += wide
        open_ = still
        rows.append(cells)
    return rows


def word_blocks(raw: bytes) -> list[dict]:
    """Headings, paragraphs, list items and tables of an OOXML text document, in order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        read = lambda name: ElementTree.fromstring(z.read(name)) if name in names else None
        body = read("word/document.xml").find(f"{_W}body")
        styles, lists = word_styles(read("word/styles.xml")), ordered_levels(read("word/numbering.xml"))
    out: list[dict] = []

    def paragraph(node) -> None:
        p = node.find(f"{_W}pPr")
        style = p.find(f"{_W}pStyle") if p is not None else None
        name = style.get(_V, "") if style is not None else None
        outline = p.find(f"{_W}outlineLvl") if p is not None else None
        bare = re.fullmatch(r"(?i)heading\s*([1-6])", name or "")
        level = int(outline.get(_V, 9)) + 1 if outline is not None else inherited(styles, name, "level") or (int(bare[1]) if bare and name not in styles else None)
        number = _numbering(p) or inherited(styles, name, "numbers")
        if number and number[0] is None:
            number = ((inherited(styles, name, "numbers") or (None,))[0], number[1])
        text = word_text(node)
        if not text:
            return
        heading = level is not None and 1 <= level <= 6
        item = not heading and number is not None and number[0] not in (None, "0")
        kind = "heading" if heading else "list-item" if item else "paragraph"
        out.append({"order": len(out), "kind": kind, "level": level if heading else None, "depth": number[1] if item else None, "ordered": lists.get(number, False) if item else None, "text": text, "cells": None})

    def walk(nodes) -> None:
        for node in nodes if nodes is not None else []:
            if node.tag == f"{_W}p":
                paragraph(node)
            elif node.tag == f"{_W}tbl":
                out.append({"order": len(out), "kind": "table", "level": None, "depth": None, "ordered": None, "text": None, "cells": word_spans(node)})
            elif node.tag in (f"{_W}sdt", f"{_W}sdtContent", f"{_W}ins", f"{_W}moveTo"):
                walk(node)

    walk(body)
    return out


def document_blocks(df: DataFrame, content: str = "content") -> DataFrame:
    """doc_id, name, order, kind, level, depth, ordered, text, cells (rows of struct<text, rowspan, colspan>) of text documents (doc_id, name, content)."""

    @F.pandas_udf(BLOCKS)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series([word_blocks(bytes(r)) for r in raw])

    return df.select("doc_id", "name", F.inline(parse(content)))


def placed_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (as document_blocks gives them) with rows and merges of their tables and block_id, and issues of tables whose grid is too large."""
    c = F.col
    tables = blocks.where("kind = 'table'").select("doc_id", c("order").alias("table_no"), c("cells").alias("rows"))
    placed = cut(spans.placed_cells(tables), "placed")
    grid = spans.grid_rows(placed).groupBy("doc_id", "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda x: x["cells"]).alias("rows"))
    merges = merge_ranges(spans.grid_merges(placed)).groupBy("doc_id", "table_no").agg(F.array_sort(F.collect_list(F.struct("merge_no", "range"))).alias("_m"))
    own = grid.join(merges, ["doc_id", "table_no"], "left").select("doc_id", c("table_no").alias("order"), "rows", F.transform("_m", lambda m: m["range"]).alias("merges"))
    out = blocks.drop("cells").join(own, ["doc_id", "order"], "left").withColumn("block_id", F.concat(F.lit("docx-block-"), (c("order") + 1).cast("string")))
    return out.where("kind <> 'table' or rows is not null"), spans.grid_issues(placed)


def blocks_to_text(blocks: DataFrame) -> DataFrame:
    """doc_id, name, text of placed blocks: headings as Markdown, list items with marks, tables as Markdown tables."""
    table = F.concat(S.render_table_start(F.col("rows")[0]), F.array_join(F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: F.concat(F.lit("\n"), S.render_row(r))), ""))
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when(F.col("kind") == "list-item", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("ordered"), "1. ").otherwise("- "), "text")).when(F.col("kind") == "table", table).otherwise(F.col("text"))
    rows = blocks.select("doc_id", "name", "order", line.alias("line")).groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(F.struct("order", "line"))).alias("l"))
    return rows.select("doc_id", "name", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
