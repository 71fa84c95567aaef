"""Files that are cut, contradictory or foreign: described as far as they can be read, never an exception."""

import random
import struct

import pytest

from quirework.llm import media


def box(kind, body=b""):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def track(*tables):
    return box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", b"".join(tables))))))


@pytest.fixture(scope="module")
def sound():
    return media.store(media.padded(b"some text " * 500))


def test_sound(sound):
    info = media.describe(sound)
    (t,) = info.tracks
    assert (info.error, info.brand, t.handler, t.codec, len(t.sizes)) == ("", "isom", "vide", "raw ", 9)
    assert t.duration / t.timescale == pytest.approx(9 * media.FRAME_TICKS / media.TIMESCALE)
    assert t.ranges() == [(int(t.offsets[0]), int(t.offsets[0]) + media.FRAME_BYTES)]
    assert media.payload(sound, t) == media.padded(b"some text " * 500)
    assert media.feature(info).startswith("isom; vide codec=raw duration=9000/24000 samples=9 keyframes=1 [")


def test_every_cut(sound):
    for n in range(0, min(len(sound), 900)):
        info = media.describe(sound[:n])
        assert info.error or n in (0, 28) or not info.tracks
        media.feature(info)


def test_noise(sound):
    rng = random.Random(4)
    for _ in range(3000):
        raw = bytearray(sound[:900])
        for _ in range(rng.randrange(1, 6)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        info = media.describe(bytes(raw))
        media.feature(info)
        for t in info.tracks:
            assert all(0 <= a <= b <= len(raw) for a, b in t.ranges())


@pytest.mark.parametrize(
    "data",
    [
        track(box(b"stsz", struct.pack(">III", 0, 1000, (1 << 32) - 1))),
        track(box(b"stsz", struct.pack(">III", 0, 0, (1 << 32) - 1))),
        track(box(b"stz2", struct.pack(">III", 0, 3, 7))),
        track(box(b"stsz", struct.pack(">III", 0, 1, 1)), box(b"co64", struct.pack(">IIQ", 0, 1, (1 << 64) - 5)), box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 1, 1))),
        b"\x00\x00\x00\x07abcd",
        b"plain text, no boxes at all",
    ],
)
def test_contradictions(data):
    info = media.describe(data)
    assert info.error and all(t.ranges() == [] for t in info.tracks)


def test_deep_nesting():
    data = b""
    for _ in range(3000):
        data = box(b"trak", data)
    assert media.describe(data).error == "boxes lie too deep"


def test_describe_media(spark, sound):
    rows = media.describe_media(spark.createDataFrame([(1, bytearray(sound)), (2, None), (3, bytearray(sound[:100]))], "doc_id long, media binary")).collect()
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].codec, by_id[1].n_samples, len(by_id[1].keyframes), by_id[1].error) == ("raw", 9, 1, None)
    assert by_id[2].error == "no data" and by_id[3].error and by_id[3].keyframes == []
