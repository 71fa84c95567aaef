"""Vectorised word work on Arrow string columns.

A task sees its texts as one byte array per piece of about a quarter megabyte. Words, runs and windows are
found and hashed with numpy over the whole piece, so no Python code runs per word. White space is the
ASCII class ``[\\x20\\x09-\\x0D]``; its bytes never occur inside a multi-byte UTF-8 character, which
makes byte positions safe to cut at.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18
#: Entries of the power tables that a worker keeps.
KEPT_POWERS = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche the bits of 64-bit values (a public finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse. Those of one very long document aren't kept for the next."""
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, PIECE_BYTES + 1)
    tables = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.full(size, base, np.uint64)
        table[0] = 1
        tables.append(np.cumprod(table))
    if size <= KEPT_POWERS:
        _powers[:] = tables
    return tables


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task with what it holds, not with what it once held."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into pieces of about size bytes (or one longer document)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(column)
        _, offsets = text_bytes(batch.column(k))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            part = batch.slice(at, to - at)
            yield part, *text_bytes(part.column(k))
            at = to
    give_back()


class Spans:
    """Spans of a piece (words, runs or lines) with the documents they lie in.

    ``bounds[d]:bounds[d + 1]`` are the spans of document d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.offsets, self.starts, self.ends = data, offsets, starts, ends
        self.bounds = np.searchsorted(starts, offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self, table: np.ndarray = _BYTE) -> np.ndarray:
        """A 64-bit hash of every span's bytes, from one running sum over the piece."""
        n = len(self.data)
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[self.data] * power[:n], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * _STEP)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First spans of all windows of n spans within a document, and the windows' hashes."""
        if len(hashes) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.bounds[1:], self.counts)
        at = np.flatnonzero(np.arange(len(hashes)) + n <= last)
        return at, window_hash(hashes, at, n)

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def window_hash(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    g = np.full(len(at), n, np.uint64)
    for k in range(n):
        g = g * _STEP + hashes[at + k]
    return mix(g)


LOWER_BYTE = _BYTE[LOWER]


def _document_starts(n: int, offsets: np.ndarray) -> np.ndarray:
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    return first


def words(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Maximal runs of bytes outside the white-space class."""
    n = len(data)
    inside = ~SPACE[data]
    first = _document_starts(n, offsets)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes[:-1] &= ~inside[1:] | first[1:n]
    return Spans(data, offsets, np.flatnonzero(opens), np.flatnonzero(closes) + 1)


_STOP = np.zeros(256, bool)
_STOP[list(b".,!?;:|")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def runs(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Pieces that begin at a document's start, where white space begins, or where a stop follows a letter or digit.

    Letters are known as such in ASCII and in the Latin-1 block.
    """
    n = len(data)
    space = SPACE[data]
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    letter = _ALNUM[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    opens[1:] |= _STOP[data[1:]] & letter[:-1]
    opens |= _document_starts(n, offsets)[:n]
    starts = np.flatnonzero(opens)
    return Spans(data, offsets, starts, np.append(starts[1:], n))


def lines(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Lines split at \\n, without it; empty lines and empty documents give none."""
    n = len(data)
    inside = data != 10
    first = _document_starts(n, offsets)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes[:-1] &= ~inside[1:] | first[1:n]
    return Spans(data, offsets, np.flatnonzero(opens), np.flatnonzero(closes) + 1)


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over each document's spans."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate flat[starts[k] : starts[k] + lengths[k]] for all k."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def list_column(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
