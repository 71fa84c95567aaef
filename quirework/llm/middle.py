"""Fill-in-middle transformation: texts cut at token offsets and put in the order that trains infilling.

The tokenizers library's Split pre-tokenizer isolates the matches of a regular expression, without any training; its
offsets are code points. The number of offsets is a text's length in tokens, and the offsets of two ranks bound the
prefix, the middle and the suffix. Long texts go to the library in blocks that end where a token ends, so its memory
doesn't grow with a text; a block ends before white space that follows a word, or later where there is none.

Cuts and forms come from the sha256 of the seed and the row's doc_id, so reruns agree. A text with a marker in it stays
plain: the markers of an output are then the only ones in it, and `restore` finds the text from output and form alone.

Edge cases: a null or empty text is plain, with no tokens. A text of white space is one token. A null doc_id hashes as
an empty one. Equal doc_ids draw equal numbers; rows are told apart by nothing else, so equal rows give equal outputs.
Extra columns travel along, but for those named as the added ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.text import pieces

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 texts, so many are transformed, and so many of those have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Code points that go to the library at once.
BLOCK_CHARS = 1 << 15
_SPACES = "\x20\t\n\x0b\x0c\r"


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Starts and ends of blocks of about size code points, each a whole number of tokens."""
    at, n = 0, len(text)
    while n - at > size:
        end = at + size
        while end < n and not (text[end] in _SPACES and text[end - 1] not in _SPACES):
            end += 1
        yield at, end
        at = end
    if at < n:
        yield at, n


def token_ends(splitter, text: str, size: int = BLOCK_CHARS) -> np.ndarray:
    """Past-the-end code points of a text's tokens."""
    ends = [np.fromiter((end for _, (_, end) in splitter.pre_tokenize_str(text[a:b])), np.int64) + a for a, b in blocks(text, size)]
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns in: the row, text, h1, h2; out: the row, text, n, first and second (past-the-end code points of prefix and middle)."""
    from tokenizers import Regex, pre_tokenizers

    splitter = pre_tokenizers.Split(Regex(TOKEN), "isolated")
    for batch, _, _ in pieces(batches):
        out = []
        for text, h1, h2 in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            ends = np.append(0, token_ends(splitter, text))
            n = len(ends) - 1
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            out.append((n, int(ends[a]), int(ends[b])))
        n, first, second = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, first, second))], ["row", "text", "n", "first", "second"])


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hash, as unsigned integers."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs (doc_id, text, ...) with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    c = F.col
    added = ["n", "form", "prefix_chars", "middle_chars", "output"]
    text = F.coalesce(c("text").cast("string"), F.lit(""))
    # The input's columns travel as one, so that their names can't clash with those added here.
    rows = docs.select(F.struct(*[c(f"`{k}`") for k in docs.columns if k not in (*added, "text")]).alias("row"), text.alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(c("doc_id"), seed)[:2], 1)])
    cut = rows.mapInArrow(_cuts, f"row {rows.schema['row'].dataType.simpleString()}, text string, n long, first long, second long")
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    _, _, h3, h4 = draws(c("row.doc_id"), seed)
    form = F.when((c("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    cut = cut.withColumn("form", form)
    first, second = c("first").cast("int"), c("second").cast("int")
    prefix, middle = F.substring(c("text"), F.lit(1), first), F.substring(c("text"), first + 1, second - first)
    suffix = F.substring(c("text"), second + 1, F.char_length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(c("form") == "psm", psm).when(c("form") == "spm", spm).otherwise(c("text"))
    cuts = [F.when(c("form") != "plain", x).alias(k) for k, x in (("prefix_chars", c("first")), ("middle_chars", c("second") - c("first")))]
    kept = [c("text") if k == "text" else c(f"row.`{k}`").alias(k) for k in docs.columns if k not in added]
    return cut.select(*kept, "n", "form", *cuts, output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output: its markers are the only ones in it."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring(F.substring_index(head, SUFFIX, 1), len(PREFIX) + 1, 2**31 - 1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring(F.substring_index(head, PREFIX, 1), len(SUFFIX) + 1, 2**31 - 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def middle_digest(docs: DataFrame) -> DataFrame:
    rows = fill_in_middle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    digest = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: Tokens as lists, cut and joined; the restored text is the input itself.
MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts FROM documents
), u AS (
  SELECT *, CAST(len(ts) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(ts[1:a], '') AS pre, array_to_string(ts[a+1:b], '') AS mid, array_to_string(ts[b+1:], '') AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
