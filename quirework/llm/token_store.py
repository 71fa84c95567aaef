"""Token ids in Parquet: list columns with chosen encodings, row groups and page indexes.

Rows lie in ascending doc_id order (nulls first, equal ids by text), one file per range of ids. Columns:
``doc_id``, ``part`` and ``pos`` (the row's place), ``n_tokens`` and ``ids``. The page index of doc_id and
n_tokens lets a reader skip pages and never touch the ids it doesn't need.

Edge cases: a null or empty text has only the end id. Rows with one doc_id stay separate rows. An empty
table gives an empty store. Extra columns of the input are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.llm import text
from quirework.llm.scratch import new_path

STORE = "doc_id long, part int, pos long, n_tokens long, ids array<int>"
#: A worker forgets its encoded runs beyond this many.
CACHE_RUNS = 1_500_000
#: White space outside the ASCII class: the pre-tokeniser may join it to ASCII white space, so such texts are encoded whole.
OTHER_SPACE = rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
#: Texts looked up at once: long enough that most runs of a piece repeat within it.
ENCODED_BYTES = 1 << 20
#: Texts encoded at once: an encoding takes much more memory than its ids.
BATCH_TEXTS = 64


class RunEncoder:
    """Encode each distinct run once.

    Byte-level pre-tokenisation always breaks before a white-space run and between a letter and a stop, so
    the ids of a text are those of its runs, one after another. Runs repeat a lot; the tokeniser sees the
    distinct ones, many at a time, with line ends between them. Texts with other white space or with an added
    token's string are encoded whole, as are all texts where the tokeniser's file names other steps.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        before = steps["pre_tokenizer"] or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        line_end = self.encode(["\n"])[0]
        self.by_runs = bool(byte_level and not steps["normalizer"] and not steps["post_processor"] and steps["model"]["type"] == "BPE" and not steps["model"].get("dropout") and len(line_end) == 1)
        self.line_end = line_end[0] if line_end else -1
        added = [re.escape(t["content"].encode()) for t in steps["added_tokens"]]
        self.whole = re.compile(b"|".join([OTHER_SPACE, *added]))
        #: Bytes with which such a string may begin.
        self.begins = np.zeros(256, bool)
        self.begins[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, *(t["content"].encode()[0] for t in steps["added_tokens"])]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.starts, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _between_line_ends(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of runs and their lengths, encoded as one text."""
        ids = np.array([*self.encode([b"\n".join(raw).decode()])[0], self.line_end], np.int32)
        ends = np.flatnonzero(ids == self.line_end)
        if len(ends) != len(raw):
            each = self.encode([x.decode() for x in raw])
            return np.array([i for row in each for i in row], np.int32), np.array([len(row) for row in each], np.int64)
        return ids[ids != self.line_end], np.diff(ends, prepend=-1) - 1

    def _encode_runs(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of runs and their lengths."""
        plain = [x[:1] not in b"\t\n\x0b\x0c\r" and x[:2] != b"  " and x != b" " and not x[:2].isspace() for x in raw]
        joined = [x for x, ok in zip(raw, plain, strict=True) if ok]
        found = [self._between_line_ends(joined[k : k + 1000]) for k in range(0, len(joined), 1000)]
        ids = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in found)])
        lengths = np.zeros(len(raw), np.int64)
        plain = np.array(plain, bool)
        lengths[plain] = np.concatenate([np.zeros(0, np.int64), *(x for _, x in found)])
        others = [np.array(row, np.int32) for row in self.encode([x.decode() for x, ok in zip(raw, plain, strict=True) if not ok])]
        lengths[~plain] = [len(row) for row in others]
        flat = np.empty(int(lengths.sum()), np.int32)
        of_plain = np.repeat(plain, lengths)
        flat[of_plain] = ids
        flat[~of_plain] = np.concatenate([np.zeros(0, np.int32), *others])
        return flat, lengths

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        flat, lengths = self._encode_runs(raw)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, len(self.flat) + np.cumsum(lengths) - lengths)
        self.lengths = np.insert(self.lengths, at, lengths)
        self.flat = np.concatenate([self.flat, flat])

    def _odd_places(self, raw: bytes, data: np.ndarray) -> Iterator[int]:
        """Where strings begin whose texts are encoded whole: only bytes that may begin one are tried, unless they are many."""
        places = np.flatnonzero(self.begins[data])
        if len(places) * 16 > len(data):
            return (m.start() for m in self.whole.finditer(raw))
        return (at for at in places.tolist() if self.whole.match(raw, at))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number per document."""
        whole = np.full(len(offsets) - 1, not self.by_runs)
        raw = data.tobytes()
        if self.by_runs:
            # An added token's string may be one only across two documents: that costs nothing but time.
            for at in self._odd_places(raw, data):
                whole[int(np.searchsorted(offsets, at, "right")) - 1] = True
        spans = text.runs(data, offsets)
        used = np.repeat(~whole, spans.counts)
        keys, first, which = np.unique(spans.hashes()[used], return_index=True, return_inverse=True)
        first = np.flatnonzero(used)[first]
        if len(self.keys) > CACHE_RUNS:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if new.any():
            self._learn(keys[new], [spans.text(k) for k in first[new]])
        row = np.searchsorted(self.keys, keys) if new.any() else at
        each = np.zeros(len(used), np.int64)
        each[used] = self.lengths[row][which]
        counts = text.per_document(each, spans.bounds)
        ids = text.ragged(self.flat, self.starts[row][which], each[used])
        odd = np.flatnonzero(whole).tolist()
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in range(0, len(odd), BATCH_TEXTS):
                some = odd[k : k + BATCH_TEXTS]
                for d, found in zip(some, self.encode([raw[offsets[d] : offsets[d + 1]].decode() for d in some]), strict=True):
                    parts[d] = np.array(found, np.int32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts


@functools.cache
def run_encoder(path: str) -> RunEncoder:
    """One a worker process: later tasks find the runs of earlier ones."""
    return RunEncoder(path)


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.int32), counts + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 20, page_rows: int = 5000) -> None:
    """Encode docs (doc_id, text) and write them in doc_id order.

    Rows are dealt by ranges of doc_id before they are encoded, so the tokeniser runs once per row.
    encoding: "dictionary", or "delta" (no dictionary, delta-packed pages).
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, pos = run_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for rows, data, offsets in text.pieces(batches, size=ENCODED_BYTES):
            ids, counts = _with_end(*encoder(data, offsets), end_id)
            n = rows.num_rows
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), pa.array(counts.astype(np.int64)), text.list_column(ids, counts, pa.int32())], ["doc_id", "part", "pos", "n_tokens", "ids"])
            pos += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.dictionary.page.size": 2 << 20, "parquet.writer.version": "v1" if encoding == "dictionary" else "v2", "compression": "snappy"}
    writer = rows.mapInArrow(encode, STORE).write
    for key, value in options.items():
        writer = writer.option(key, str(value))
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the store, or those with low <= doc_id < high: the bounds reach the scan, which skips pages by its index."""
    rows = spark.read.schema(STORE).parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") < high)
    return rows


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, pos, n_tokens and start (ids of all rows before it), without reading any ids."""
    return with_start(spark.read.schema(STORE).parquet(path).select("doc_id", "part", "pos", "n_tokens"))


def with_start(rows: DataFrame) -> DataFrame:
    """Sums within a file's range, and over the files: one row for each of them."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy(F.col("part").alias("file")).agg(F.sum("n_tokens").alias("_n")).select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(files, F.col("part") == F.col("file")).withColumn("start", F.col("_before") + F.col("_within")).drop("file", "_before", "_within")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = np.asarray(lists.offsets, np.int64)
        raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "part", "pos", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a store and derive from what is read back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    read = read_tokens(spark, path).select("doc_id", "part", "pos", "ids").mapInArrow(_checksums, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")
    return with_start(read).select("doc_id", "start", "n_tokens", "ids_crc32")
