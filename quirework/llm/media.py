"""Media columns: ISO media files as binary columns, read by their boxes.

`store` writes a payload as 8-bit monochrome video frames; `describe` walks a file's nested boxes and decodes
its sample tables into codec, duration and the byte ranges of keyframes, without touching the payload.

Edge cases: a null or empty file, truncated boxes, boxes that claim more bytes than their parent has, tables
that disagree, and unknown boxes never raise: `describe` gives an Info whose `error` names the first fault and
that holds what was read before it. 64-bit sizes, boxes that run to the end, `uuid` boxes, both chunk offset
tables, both sample size tables and files without `stss` (every sample is a keyframe) are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.scratch import written

WIDTH = HEIGHT = 24
FRAME_BYTES = WIDTH * HEIGHT
TIMESCALE, FRAME_TICKS = 24000, 1000
KEYFRAME_EVERY = 12
FRAMES_PER_CHUNK = 64
PAD = b"\xff"
#: Boxes nest no deeper in a sound file.
MOST_DEPTH = 16
_CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"mfra", b"udta"}


def padded(payload: bytes) -> bytes:
    """Filled up with bytes 255 to a positive multiple of a frame."""
    return payload + PAD * (max(1, -(-len(payload) // FRAME_BYTES)) * FRAME_BYTES - len(payload))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def store(payload: bytes) -> bytes:
    """An ISO media file whose single video track holds the payload's frames unchanged."""
    frames = len(payload) // FRAME_BYTES
    if not frames or frames * FRAME_BYTES != len(payload):
        raise ValueError("the payload is a positive multiple of a frame")
    ticks = frames * FRAME_TICKS
    chunks = -(-frames // FRAMES_PER_CHUNK)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, min(FRAMES_PER_CHUNK, frames), 1)]
    if chunks > 1 and frames % FRAMES_PER_CHUNK:
        runs.append((chunks, frames % FRAMES_PER_CHUNK, 1))
    keys = np.arange(1, frames + 1, KEYFRAME_EVERY, dtype=">u4")
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")

    def movie(first: int) -> bytes:
        offsets = (first + FRAME_BYTES * FRAMES_PER_CHUNK * np.arange(chunks, dtype=np.int64)).astype(">u8")
        table = _box(
            b"stbl",
            _full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, 0, struct.pack(">III", 1, frames, FRAME_TICKS)),
            _full(b"stss", 0, 0, struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", 0, 0, struct.pack(">II", FRAME_BYTES, frames)),
            _full(b"co64", 0, 0, struct.pack(">I", chunks), offsets.tobytes()),
        )
        info = _box(b"minf", _full(b"vmhd", 0, 1, bytes(8)), _box(b"dinf", _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1))), table)
        media = _box(b"mdia", _full(b"mdhd", 1, 0, bytes(16), struct.pack(">IQHH", TIMESCALE, ticks, 0x55C4, 0)), _full(b"hdlr", 0, 0, bytes(4), b"vide", bytes(12), b"frames\0"), info)
        track = _box(b"trak", _full(b"tkhd", 1, 7, bytes(16), struct.pack(">IIQ", 1, 0, ticks), bytes(16), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16)), media)
        return _box(b"moov", _full(b"mvhd", 1, 0, bytes(16), struct.pack(">IQIH", TIMESCALE, ticks, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)), track)

    start = len(head) + len(movie(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return head + movie(start) + _box(b"mdat", payload)


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int, str]]:
    """Kind, body's start and end, and a fault ('' if none) of each box between start and end."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            yield b"", start, end, "truncated box header"
            return
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                yield kind, body, end, "truncated box header"
                return
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if size < body - start or start + size > end:
            yield kind, min(body, end), end, f"box {kind.decode('latin-1')} exceeds its parent" if start + size > end else f"box {kind.decode('latin-1')} is too short"
            return
        yield kind, body, start + size, ""
        start += size


@dataclass
class Track:
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keyframes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def ranges(self) -> list[tuple[int, int]]:
        """First and past-the-end byte of each keyframe."""
        at = self.keyframes
        return list(zip(self.offsets[at].tolist(), (self.offsets[at] + self.sizes[at]).tolist(), strict=True))


@dataclass
class Info:
    brand: str = ""
    tracks: list[Track] = field(default_factory=list)
    error: str = ""


def _tables(data: bytes, tables: dict[bytes, tuple[int, int]], track: Track) -> None:
    def numbers(kind: bytes, skip: int, type_: str, count: int | None = None) -> np.ndarray:
        start, end = tables[kind]
        (n,) = struct.unpack_from(">I", data, start + skip - 4) if count is None else (count,)
        if start + skip + n * np.dtype(type_).itemsize > end:
            raise ValueError(f"{kind.decode()} is shorter than its count")
        return np.frombuffer(data, type_, n, start + skip)

    if b"stsd" in tables:
        start, end = tables[b"stsd"]
        for kind, *_ in boxes(data, start + 8, end):
            track.codec = kind.decode("latin-1")
            break
    if b"stsz" in tables:
        size, n = struct.unpack_from(">II", data, tables[b"stsz"][0] + 4)
        if size and n > len(data) // size:
            raise ValueError("samples lie beyond the file")
        track.sizes = np.full(n, size, np.int64) if size else numbers(b"stsz", 12, ">u4").astype(np.int64)
    elif b"stz2" in tables:
        start, end = tables[b"stz2"]
        bits, n = data[start + 7], struct.unpack_from(">I", data, start + 8)[0]
        if bits not in (4, 8, 16):
            raise ValueError(f"stz2 has fields of {bits} bits")
        if bits == 16:
            track.sizes = numbers(b"stz2", 12, ">u2").astype(np.int64)
        else:
            raw = numbers(b"stz2", 12, ">u1", n if bits == 8 else -(-n // 2))
            track.sizes = (raw if bits == 8 else np.stack([raw >> 4, raw & 15], 1).ravel()[:n]).astype(np.int64)
    n = len(track.sizes)
    if b"stts" in tables:
        runs = numbers(b"stts", 8, np.dtype([("n", ">u4"), ("ticks", ">u4")]))
        if not track.duration:
            track.duration = int((runs["n"].astype(np.int64) * runs["ticks"]).sum())
    chunk = b"co64" if b"co64" in tables else b"stco"
    if n and chunk in tables and b"stsc" in tables:
        at = numbers(chunk, 8, ">u8" if chunk == b"co64" else ">u4").astype(np.int64)
        runs = numbers(b"stsc", 8, np.dtype([("first", ">u4"), ("n", ">u4"), ("entry", ">u4")]))
        first = runs["first"].astype(np.int64) - 1
        if not len(runs) or first[0] != 0 or (np.diff(first) <= 0).any() or first[-1] >= max(len(at), 1):
            raise ValueError("stsc doesn't fit its chunks")
        each = np.repeat(runs["n"].astype(np.int64), np.diff(np.append(first, len(at))))
        if int(each.sum()) != n:
            raise ValueError("stsc doesn't fit its samples")
        before = np.concatenate([[0], np.cumsum(track.sizes)])[:-1]
        heads = np.cumsum(each) - each
        track.offsets = np.repeat(at - before[np.minimum(heads, n - 1)], each) + before
        if ((track.offsets < 0) | (track.offsets > len(data) - track.sizes)).any():
            track.offsets = np.zeros(0, np.int64)
            raise ValueError("samples lie beyond the file")
    if len(track.offsets):
        track.keyframes = np.arange(n) if b"stss" not in tables else numbers(b"stss", 8, ">u4").astype(np.int64) - 1
        if len(track.keyframes) and not (0 <= track.keyframes.min() and track.keyframes.max() < n):
            track.keyframes = np.zeros(0, np.int64)
            raise ValueError("stss names samples that aren't there")


def describe(data: bytes | None) -> Info:
    """Walk a file's boxes; the first fault ends the walk."""
    info = Info()
    if not data:
        info.error = "no data"
        return info

    def walk(start: int, end: int, track: Track | None, depth: int) -> None:
        if depth > MOST_DEPTH:
            raise ValueError("boxes lie too deep")
        tables: dict[bytes, tuple[int, int]] = {}
        for kind, body, stop, fault in boxes(data, start, end):
            if fault:
                raise ValueError(fault)
            if kind == b"ftyp" and stop - body >= 4:
                info.brand = data[body : body + 4].decode("latin-1")
            elif kind == b"trak":
                info.tracks.append(Track())
                walk(body, stop, info.tracks[-1], depth + 1)
            elif kind in _CONTAINERS:
                walk(body, stop, track, depth + 1)
            elif track is not None and kind == b"mdhd":
                long = data[body] == 1
                track.timescale, track.duration = struct.unpack_from(">IQ" if long else ">II", data, body + (20 if long else 12))
            elif track is not None and kind == b"hdlr":
                track.handler = track.handler or data[body + 8 : body + 12].decode("latin-1")
            elif track is not None:
                tables[kind] = (body, stop)
        if track is not None and (b"stsz" in tables or b"stz2" in tables):
            _tables(data, tables, track)

    try:
        walk(0, len(data), None, 0)
    except (ValueError, struct.error, IndexError) as fault:
        info.error = str(fault) or type(fault).__name__
    return info


def payload(data: bytes, track: Track) -> bytes:
    """The track's samples in order; neighbouring samples are cut out together."""
    if not len(track.offsets):
        return b""
    breaks = np.flatnonzero(track.offsets[1:] != (track.offsets + track.sizes)[:-1]) + 1
    heads, tails = np.append(0, breaks), np.append(breaks, len(track.offsets)) - 1
    return b"".join(data[a:b] for a, b in zip(track.offsets[heads].tolist(), (track.offsets[tails] + track.sizes[tails]).tolist(), strict=True))


def feature(info: Info) -> str:
    """Brand, and of each track the codec, times, samples and the byte ranges of its keyframes (first, last, checksum of all)."""
    parts = [info.brand or "-"]
    for t in info.tracks:
        ranges = t.ranges()
        shown = ",".join(f"{a}-{b}" for a, b in dict.fromkeys(ranges[:1] + ranges[-1:]))
        parts.append(f"{t.handler} codec={t.codec.strip()} duration={t.duration}/{t.timescale} samples={len(t.sizes)} keyframes={len(ranges)} [{shown}] crc={zlib.crc32(np.array(ranges, '<i8').tobytes()):08x}")
    return "; ".join(parts + [f"error={info.error}"] * bool(info.error))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of each text (null: empty), one file a row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([store(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_bytes long, media binary")


TRACK_COLUMNS = "brand string, codec string, duration_s double, n_samples long, keyframes array<struct<start:long,end:long>>, error string"


def describe_media(media: DataFrame) -> DataFrame:
    """doc_id and of its media column: brand, first video track's codec, seconds, samples and keyframe byte ranges, error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data in batch.column(1).to_pylist():
                info = describe(data)
                t = next((t for t in info.tracks if t.handler == "vide"), (info.tracks or [Track()])[0])
                out.append((info.brand, t.codec.strip(), t.duration / t.timescale if t.timescale else None, len(t.sizes), [{"start": a, "end": b} for a, b in t.ranges()], info.error or None))
            kinds = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "brand", "codec", "duration_s", "n_samples", "keyframes", "error"])

    return media.select("doc_id", "media").mapInArrow(read, f"doc_id long, {TRACK_COLUMNS}")


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text, write the media column, read it back and digest what was read."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data in batch.column(2).to_pylist():
                info = describe(data)
                raw = payload(data, info.tracks[0]) if info.tracks else b""
                out.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(info)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    media = written(store_texts(docs), "media", codec="zstd", parquet_enable_dictionary="false", parquet_block_size=32 << 20)
    return media.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
