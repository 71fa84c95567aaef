"""String columns with the counting and trimming rules of the chunk contract.

Lengths are UTF-16 code units. White space is the ECMAScript set, which Java's ``\\s`` doesn't cover.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the chunk contract.
CHUNK_LIMIT = 3800
CONSUMER_LIMIT = 4000
SEPARATOR = "@@@"
SEPARATOR_SUBSTITUTE = "＠＠＠"
JOINER = "\n@@@\n"
DEFAULT_NAME = "텍스트 문서.txt"
MAX_FILE_BYTES = 50 * 1024 * 1024

SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_SPACES_TO_BLANK = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u202f\u205f\u3000"


def u16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+\\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE[1:]}")


def normalize_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def clean_text(text: Column) -> Column:
    """Line ends to LF, control characters out, Unicode spaces to blanks, no trailing white space on lines or at the end."""
    text = normalize_line_ends(text)
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    text = F.translate(text, _SPACES_TO_BLANK, " " * len(_SPACES_TO_BLANK))
    text = F.regexp_replace(text, r"(?m)[ \t]+$", "")
    return F.regexp_replace(text, f"{SPACE}+\\z", "")


def escape_separator(text: Column) -> Column:
    return F.replace(text, F.lit(SEPARATOR), F.lit(SEPARATOR_SUBSTITUTE))


def count_separators(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SEPARATOR)).cast("long")


def is_page_number(line: Column) -> Column:
    return trim(line).rlike(r"(?iu)^(?:\d+\s*[-–—]\s*\d+|[-–—]\s*\d+\s*[-–—]|(?:page|페이지)\s*\d+(?:\s*(?:/|of)\s*\d+)?)\z")


def is_decoration_candidate(line: Column) -> Column:
    """Short lines that may be a page's header or footer: no page number, table row, bullet or sentence."""
    value = trim(line)
    n = u16_length(value)
    return (n >= 2) & (n <= 80) & ~is_page_number(value) & ~value.rlike(r"^(?:\|.*\||(?:[-*+] |\d+[.)] |[•◦] ).*)\z") & ~value.rlike(r"[.!?。！？]\z")


def is_pipe_line(line: Column) -> Column:
    # A search for one character keeps ordinary lines from the pattern.
    return F.contains(line, F.lit("|")) & line.rlike(f"^{SPACE}*\\|.*\\|{SPACE}*\\z")


def is_separator_line(line: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(trim(line), r"^\|", ""), r"\|\z", "")
    return F.contains(line, F.lit("---")) & body.rlike(f"^{SPACE}*:?-{{3,}}:?{SPACE}*(?:\\|{SPACE}*:?-{{3,}}:?{SPACE}*)*\\z")


def escape_cell(cell: Column) -> Column:
    cell = F.replace(normalize_line_ends(cell), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(cell, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def render_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: escape_cell(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))


def render_table_start(header: Column) -> Column:
    return F.concat(render_row(header), F.lit("\n| "), F.array_join(F.transform(header, lambda c: F.lit("---")), " | "), F.lit(" |"))


def row_cells(line: Column) -> Column:
    r"""Cells of a Markdown row: split at pipes, ``\\`` and ``\|`` unescaped, trimmed."""
    body = F.regexp_replace(F.regexp_replace(trim(line), r"^\|", ""), r"\|\z", "")
    # Escapes are set aside as characters that cleaned text never holds.
    body = F.replace(F.replace(body, F.lit("\\\\"), F.lit("\x01")), F.lit("\\|"), F.lit("\x02"))
    return F.transform(F.split(body, r"\|", -1), lambda c: trim(F.replace(F.replace(c, F.lit("\x01"), F.lit("\\")), F.lit("\x02"), F.lit("|"))))


def doc_type(name: Column) -> Column:
    return F.when(name.isin("law", "excel", "manual", "general"), name).when(name == "research_paper", "manual").otherwise("general")


# Extensions by route.
TEXT_EXTENSIONS = ["txt", "md", "markdown", "json", "csv", "log", "xml", "yml", "yaml"]
EXCEL_EXTENSIONS = ["xlsx", "xls", "ods"]
DOCX_EXTENSIONS = ["docx"]
REMOTE_EXTENSIONS = ["pdf", "html", "pptx", "ppt", "jpg", "jpeg", "png", "gif", "webp", "svg"]


def file_route(name: Column) -> Column:
    ext = F.lower(F.element_at(F.split(name, "[.]"), -1))
    return F.when(ext.isin(TEXT_EXTENSIONS), "local-text").when(ext.isin(EXCEL_EXTENSIONS), "local-excel").when(ext.isin(DOCX_EXTENSIONS), "local-docx").when(ext.isin(REMOTE_EXTENSIONS), "miso").otherwise("unsupported")


def safe_file_name(name: Column) -> Column:
    """Last path part without control or unsafe characters, at most 255 units."""
    value = F.element_at(F.split(name, r"[/\\]"), -1)
    value = trim(F.regexp_replace(F.regexp_replace(value, r"[\x00-\x1F\x7F]", ""), r'[<>:"|?*]', "_"))
    value = F.substring(F.regexp_replace(value, r"[ .]+\z", ""), 1, 255)
    return F.when(value == "", "document.txt").otherwise(value)


def ordered_distinct(items: Column) -> Column:
    """Filled items once each, in the order of their first places."""
    return F.array_distinct(F.filter(items, lambda x: F.coalesce(x, F.lit("")) != ""))


def severity_status(issues: Column) -> Column:
    return F.when(F.exists(issues, lambda x: x["severity"] == "error"), "blocked").when(F.size(issues) > 0, "review").otherwise("ready")
