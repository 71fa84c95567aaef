"""Structured documents as JSON records: shape, budgets, lengths, issues and what a status means.

A record is {version, fileName, sourceFormat, extractionMethod, blocks, warnings[, excelOptions]}. Fields are read as
variants, so that a value of another type is told from a missing one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import strings as S

# What records may hold, and how much of it.
BLOCK_KINDS = ["raw-text", "heading", "paragraph", "list-item", "table"]
EXTRACTION_METHODS = ["local-text", "local-excel", "local-docx", "miso", "law-api", "user-edited"]
HEADER_SOURCES = ["print-titles", "detected", "manual"]
FORMULA_OUTPUTS = ["value-only", "value-and-formula"]
MAX_BLOCKS, MAX_WARNINGS, MAX_PATH = 10_000, 1_000, 64
MAX_ROWS, MAX_COLUMNS, MAX_CELLS, MAX_MERGES, MAX_LOCATIONS = 20_000, 512, 300_000, 10_000, 10_000
MAX_TEXT, MAX_ITEMS = 50_000_000, 2_000_000
PRESENTATION = {"ready": ("MISO 등록 가능", "success", True), "review": ("원문 확인 필요", "warning", True), "blocked": ("오류 확인 필요", "destructive", False)}

_INTEGER = r"^(?:BIGINT|DECIMAL\(\d+,0\))\z"


def _kind(v: Column, path: str) -> Column:
    """The type of a field as text: null if it is missing, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is(v: Column, path: str, pattern: str) -> Column:
    return F.coalesce(_kind(v, path).rlike(pattern), F.lit(False))


def _absent(v: Column, path: str) -> Column:
    return _kind(v, path).isNull()


def _text(v: Column, path: str) -> Column:
    """A string field; null for any other type."""
    return F.when(_is(v, path, r"^STRING\z"), F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    return F.when(_is(v, path, _INTEGER), F.try_variant_get(v, path, "bigint"))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _one_of(value: Column, values: list[str]) -> Column:
    return F.coalesce(value.isin(values), F.lit(False))


def _at_least(value: Column, least: int) -> Column:
    return F.coalesce(value >= least, F.lit(False))


_LIST, _STRINGS = r"^ARRAY<", r"^ARRAY<(?:STRING|VOID)>\z"
_ROWS = r"^ARRAY<(?:VOID|ARRAY<(?:STRING|VOID)>)>\z"


def _strings(v: Column, path: str) -> Column:
    """Whether a field is a list of strings; nulls among them aren't."""
    return _is(v, path, _STRINGS) & ~F.exists(_list(v, path), lambda x: F.is_variant_null(x))


def _valid_issue(v: Column) -> Column:
    ok = _at_least(F.length(_text(v, "$.code")), 1) & _one_of(_text(v, "$.severity"), ["warning", "error"]) & _at_least(F.length(_text(v, "$.message")), 1)
    return ok & (_absent(v, "$.count") | _at_least(_number(v, "$.count"), 0)) & (_absent(v, "$.locations") | _strings(v, "$.locations"))


def _valid_merge(v: Column) -> Column:
    places = [_at_least(_number(v, f"$.{side}.{axis}"), 0) for side in ("start", "end") for axis in ("row", "column")]
    ok = _at_least(F.length(_text(v, "$.range")), 1)
    for place in places:
        ok = ok & place
    return ok


def _valid_layout(v: Column) -> Column:
    used, head = "$.excelLayout.usedRange", "$.excelLayout.headerRows"
    top, bottom, left, right = (_number(v, f"{used}.{k}") for k in ("startRow", "endRow", "startColumn", "endColumn"))
    first, last = _number(v, f"{head}.startRow"), _number(v, f"{head}.endRow")
    none = _absent(v, f"{used}.startColumn") & _absent(v, f"{used}.endColumn")
    widest = F.coalesce(F.array_max(F.transform(_list(v, "$.rows"), lambda r: F.size(F.coalesce(F.try_variant_get(r, "$", "array<variant>"), F.array().cast("array<variant>"))))), F.lit(0))
    columns = none | ((left >= 1) & (right >= left) & (right - left + 1 == widest))
    ok = (top >= 1) & (bottom >= top) & (first >= top) & (last >= first) & (last <= bottom) & columns
    return F.coalesce(ok, F.lit(False)) & _one_of(_text(v, f"{head}.source"), HEADER_SOURCES)


def _valid_formulas(v: Column) -> Column:
    """Formula cells lie in the used range and the table, once each."""
    used = "$.excelLayout.usedRange"
    top, bottom, left, right = (_number(v, f"{used}.{k}") for k in ("startRow", "endRow", "startColumn", "endColumn"))
    widths = F.transform(_list(v, "$.rows"), lambda r: F.size(F.coalesce(F.try_variant_get(r, "$", "array<variant>"), F.array().cast("array<variant>"))))
    cells = F.transform(_list(v, "$.formulaCells"), lambda x: F.struct(_number(x, "$.row").alias("r"), _number(x, "$.column").alias("c"), _text(x, "$.formula").alias("f"), _kind(x, "$.hasStoredResult").alias("k")))

    def ok(x: Column) -> Column:
        row, col = x["r"] - top, x["c"] - F.coalesce(left, F.lit(1))
        inside = (x["r"] >= top) & (x["r"] <= bottom) & (row < F.size(widths)) & (col >= 0) & (col < F.get(widths, row.cast("int"))) & (right.isNull() | (x["c"] <= right))
        return F.coalesce(inside & x["f"].rlike(r"^=\S") & (x["k"] == "BOOLEAN"), F.lit(False))

    places = F.transform(cells, lambda x: F.struct(x["r"], x["c"]))
    return F.forall(cells, ok) & (F.size(F.array_distinct(places)) == F.size(cells)) & (F.size(cells) <= F.aggregate(widths, F.lit(0), lambda a, b: a + b))


def _valid_block(v: Column) -> Column:
    table = _text(v, "$.kind") == "table"
    ok = _at_least(F.length(_text(v, "$.id")), 1) & _one_of(_text(v, "$.kind"), BLOCK_KINDS) & _at_least(_number(v, "$.order"), 0) & _strings(v, "$.headingPath")
    ok = ok & F.when(table, _is(v, "$.rows", _ROWS)).otherwise(_is(v, "$.text", r"^STRING\z") & (_absent(v, "$.rows") | _is(v, "$.rows", _ROWS)))
    ok = ok & (_absent(v, "$.text") | _is(v, "$.text", r"^STRING\z"))
    level = _number(v, "$.level")
    ok = ok & (_absent(v, "$.level") | F.coalesce(level.between(1, 6), F.lit(False))) & (_absent(v, "$.depth") | _at_least(_number(v, "$.depth"), 0))
    ok = ok & (_absent(v, "$.ordered") | _is(v, "$.ordered", r"^BOOLEAN\z"))
    for name in ("sheetName", "tableId"):
        ok = ok & (_absent(v, f"$.{name}") | _is(v, f"$.{name}", r"^STRING\z"))
    ok = ok & (_absent(v, "$.excelLayout") | (table & _valid_layout(v)))
    ok = ok & (_absent(v, "$.formulaCells") | (table & ~_absent(v, "$.excelLayout") & _is(v, "$.formulaCells", _LIST) & _valid_formulas(v)))
    return F.coalesce(ok & (_absent(v, "$.merges") | (_is(v, "$.merges", _LIST) & F.forall(_list(v, "$.merges"), _valid_merge))), F.lit(False))


def _measured(rows: DataFrame) -> DataFrame:
    """rows (_v) with _m, struct<text, items, over>: UTF-16 units of all strings, members of all lists, and whether a list alone is too long.

    Blocks are measured once, into a column; an expression used several times would be read from the record each time.
    """
    v = F.col("_v")
    plus = lambda a, b: a + b
    long = lambda x: F.coalesce(S.u16_length(x), F.lit(0)).cast("bigint")
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), plus)
    texts = lambda xs: total(F.transform(xs, lambda x: long(_text(x, "$"))))

    def warning(w: Column) -> Column:
        places = _list(w, "$.locations")
        return F.struct((long(_text(w, "$.code")) + long(_text(w, "$.message")) + texts(places)).alias("t"), F.size(places).cast("bigint").alias("i"), (F.size(places) > MAX_LOCATIONS).alias("o"))

    def block(b: Column) -> Column:
        path, rows, merges, formulas = (_list(b, f"$.{k}") for k in ("headingPath", "rows", "merges", "formulaCells"))
        widths = F.transform(rows, lambda r: F.size(_list(r, "$")).cast("bigint"))
        cells = total(widths)
        text = long(_text(b, "$.id")) + long(_text(b, "$.text")) + long(_text(b, "$.sheetName")) + long(_text(b, "$.tableId")) + texts(path) + total(F.transform(rows, lambda r: texts(_list(r, "$"))))
        text = text + total(F.transform(merges, lambda m: long(_text(m, "$.range")))) + total(F.transform(formulas, lambda m: long(_text(m, "$.formula"))))
        over = (F.size(path) > MAX_PATH) | (F.size(rows) > MAX_ROWS) | F.exists(widths, lambda n: n > MAX_COLUMNS) | (cells > MAX_CELLS) | (F.size(merges) > MAX_MERGES) | (F.size(formulas) > MAX_CELLS)
        return F.struct(text.alias("t"), (F.size(path) + F.size(rows) + cells + F.size(merges) + F.size(formulas)).cast("bigint").alias("i"), over.alias("o"))

    blocks, warnings = _list(v, "$.blocks"), _list(v, "$.warnings")
    rows = rows.withColumn("_p", F.concat(F.transform(warnings, warning), F.transform(blocks, block)))
    parts = F.col("_p")
    text = total(F.transform(parts, lambda p: p["t"])) + long(_text(v, "$.fileName")) + long(_text(v, "$.sourceFormat"))
    items = total(F.transform(parts, lambda p: p["i"])) + F.size(blocks) + F.size(warnings)
    rows = rows.withColumns({"_t": text, "_i": items.cast("bigint")})
    over = (F.size(blocks) > MAX_BLOCKS) | (F.size(warnings) > MAX_WARNINGS) | F.exists(parts, lambda p: p["o"]) | (F.col("_t") > MAX_TEXT) | (F.col("_i") > MAX_ITEMS)
    return rows.withColumn("_m", F.struct(F.col("_t").alias("text"), F.col("_i").alias("items"), over.alias("over"))).drop("_p", "_t", "_i")


def document_sums(records: DataFrame, json: str = "json") -> DataFrame:
    """doc_id, n_text, n_items, over_budget of records (doc_id, json)."""
    rows = _measured(records.select("doc_id", F.try_parse_json(json).alias("_v")))
    return rows.select("doc_id", F.col("_m.text").alias("n_text"), F.col("_m.items").alias("n_items"), F.col("_m.over").alias("over_budget"))


def _has_content(b: Column) -> Column:
    filled = F.exists(_list(b, "$.rows"), lambda r: F.exists(_list(r, "$"), lambda c: ~S.is_blank(F.coalesce(_text(c, "$"), F.lit("")))))
    return F.when(_text(b, "$.kind") == "table", filled).otherwise(~S.is_blank(F.coalesce(_text(b, "$.text"), F.lit(""))))


def validate(records: DataFrame, json: str = "json") -> DataFrame:
    """doc_id, error, file_name of records (doc_id, json): the code of the first fault, null for a sound record.

    INVALID_DOCUMENT (shape), INPUT_TOO_LARGE (budgets), INVALID_BLOCK (a block, or ids that repeat), EMPTY_INPUT.
    """
    v = F.col("_v")
    options = _absent(v, "$.excelOptions") | _one_of(_text(v, "$.excelOptions.formulaOutput"), FORMULA_OUTPUTS)
    shape = _is(v, "$.version", _INTEGER) & (_number(v, "$.version") == 1) & _text(v, "$.fileName").isNotNull() & ~S.is_blank(F.coalesce(_text(v, "$.sourceFormat"), F.lit("")))
    shape = shape & _one_of(_text(v, "$.extractionMethod"), EXTRACTION_METHODS) & _is(v, "$.blocks", _LIST) & _is(v, "$.warnings", _LIST) & options
    blocks = _list(v, "$.blocks")
    ids = F.transform(blocks, lambda b: _text(b, "$.id"))
    error = (
        F.when(~F.coalesce(shape, F.lit(False)), "INVALID_DOCUMENT")
        .when(F.col("_m.over"), "INPUT_TOO_LARGE")
        .when(~F.forall(_list(v, "$.warnings"), _valid_issue), "INVALID_DOCUMENT")
        .when(~F.forall(blocks, _valid_block), "INVALID_BLOCK")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "INVALID_BLOCK")
        .when(~F.exists(blocks, _has_content), "EMPTY_INPUT")
    )
    rows = _measured(records.select("doc_id", F.try_parse_json(json).alias("_v")))
    judged = rows.select("doc_id", error.alias("error"), _text(v, "$.fileName").alias("_n"))
    return judged.select("doc_id", "error", F.when(F.col("error").isNull(), S.safe_file_name(F.col("_n"))).alias("file_name"))


BLOCK = "block_id string, `order` int, kind string, depth int, ordered boolean, text string, rows array<array<string>>"


def document_blocks(records: DataFrame, json: str = "json") -> DataFrame:
    """doc_id, name and the blocks of sound records, one a row."""
    rows = records.select("doc_id", F.try_parse_json(json).alias("_v"))
    rows = rows.select("doc_id", S.safe_file_name(_text(F.col("_v"), "$.fileName")).alias("name"), F.explode(_list(F.col("_v"), "$.blocks")).alias("b"))
    b = F.col("b")
    cells = F.try_variant_get(b, "$.rows", "array<array<string>>")
    return rows.select("doc_id", "name", _text(b, "$.id").alias("block_id"), _number(b, "$.order").cast("int").alias("order"), _text(b, "$.kind").alias("kind"), _number(b, "$.depth").cast("int").alias("depth"), F.try_variant_get(b, "$.ordered", "boolean").alias("ordered"), _text(b, "$.text").alias("text"), cells.alias("rows"))


def source_length(blocks: DataFrame) -> DataFrame:
    """doc_id, n: UTF-16 units of all texts and cells, as they came."""
    cells = F.aggregate(F.flatten("rows"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(S.u16_length(x), F.lit(0)))
    n = F.when(F.col("kind") == "table", F.coalesce(cells, F.lit(0))).otherwise(F.coalesce(S.u16_length(F.col("text")), F.lit(0)))
    return blocks.groupBy("doc_id").agg(F.sum(n).cast("long").alias("n"))


ISSUE = ["code", "severity", "message", "n", "locations"]


def distinct_issues(issues: DataFrame) -> DataFrame:
    """Issues (doc_id, at, code, severity, message, n, locations) once each, at their first place."""
    return issues.groupBy("doc_id", *ISSUE).agg(F.min("at").alias("at"))


def with_issues(results: DataFrame, issues: DataFrame) -> DataFrame:
    """results (doc_id, status, can_download) with further issues: an error blocks, any other asks for review."""
    worst = issues.groupBy("doc_id").agg(F.max(F.col("severity") == "error").alias("_error"))
    rows = results.join(worst, "doc_id", "left")
    status = F.when((F.col("status") == "blocked") | F.coalesce("_error", F.lit(False)), "blocked").when((F.col("status") == "review") | F.col("_error").isNotNull(), "review").otherwise("ready")
    return rows.withColumn("status", status).withColumn("can_download", F.col("can_download") & (status != "blocked")).drop("_error")


def presentation(status: Column) -> Column:
    """struct<label, tone, allows_download> of a status; null for an unknown one."""
    out = F.lit(None).cast("struct<label:string,tone:string,allows_download:boolean>")
    for name, (label, tone, allows) in PRESENTATION.items():
        out = F.when(status == name, F.struct(F.lit(label).alias("label"), F.lit(tone).alias("tone"), F.lit(allows).alias("allows_download"))).otherwise(out)
    return out


def prefer_local(files: DataFrame) -> DataFrame:
    """files (doc_id, local_text, local_error, aborted, remote_text, remote_error) with text, method, warning and error.

    Remote text counts only where the local one failed and the work wasn't aborted; where both failed, both are told.
    """
    c = F.col
    local = c("local_error").isNull() & c("local_text").isNotNull()
    remote = ~local & ~F.coalesce("aborted", F.lit(False)) & c("remote_text").isNotNull() & c("remote_error").isNull()
    text = F.when(local, c("local_text")).when(remote, c("remote_text"))
    error = F.when(local | remote, None).when(F.coalesce("aborted", F.lit(False)), "aborted").otherwise(F.concat_ws("; ", F.coalesce("remote_error", F.lit("no text")), F.concat(F.lit("local: "), F.coalesce("local_error", F.lit("no text")))))
    warning = F.when(remote, F.concat(F.lit("DOCX_FALLBACK: "), F.coalesce("local_error", F.lit("no text"))))
    return files.withColumns({"text": text, "method": F.when(local, "local-docx").when(remote, "miso"), "warning": warning, "error": error})


def envelope(results: DataFrame) -> DataFrame:
    """doc_id, body: what an interface answers, as JSON; results have data (a struct), error_code and error_message."""
    good = F.to_json(F.struct(F.lit(True).alias("success"), F.col("data")))
    bad = F.to_json(F.struct(F.lit(False).alias("success"), F.struct(F.col("error_code").alias("code"), F.col("error_message").alias("message")).alias("error")))
    return results.select("doc_id", F.when(F.col("error_code").isNull(), good).otherwise(bad).alias("body"))


def write_results(results: DataFrame, path: str) -> None:
    """Answers as JSON lines, dealt by document."""
    envelope(results).select("body").write.text(path)
