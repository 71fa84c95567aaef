"""Samples of small lattices against all their segmentations: distribution, order, scores and inclusion."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from quirework.llm import pieces, text
from quirework.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.Model(PATH)


def every(model, raw):
    """Probability of each segmentation of a text, by plain recursion over its characters and the model's pieces."""
    surface = {model.surface[i]: i for i in range(len(model.surface)) if np.isfinite(model.weight[i])}
    raw = b" " + raw if raw else raw
    cuts = [i for i in range(len(raw) + 1) if i == len(raw) or (raw[i] & 0xC0) != 0x80]
    segments, start = [], 0
    for i in range(1, len(raw) + 1):
        if i == len(raw) or (raw[i : i + 1] in b" \n" and not (raw[i : i + 1] == b" " and raw[i - 1 : i] == b" ")) or raw[i - 1 : i] == b"\n":
            segments.append((start, i))
            start = i

    def paths(a, b):
        if a == b:
            return [((), 0.0)]
        out = []
        for e in cuts:
            if a < e <= b and raw[a:e] in surface:
                i = surface[raw[a:e]]
                out += [((i, *rest), model.weight[i] + w) for rest, w in paths(e, b)]
        nxt = min(e for e in cuts if e > a)
        if raw[a:nxt] not in surface:
            ids = tuple(model.bytes_ids[list(raw[a:nxt])].tolist())
            out += [((*ids, *rest), pieces.UNKNOWN + w) for rest, w in paths(nxt, b)]
        return out

    total = [((), 0.0)]
    for a, b in segments:
        total = [(x + y, v + w) for x, v in total for y, w in paths(a, b)]
    top = max(w for _, w in total)
    norm = top + math.log(sum(math.exp(w - top) for _, w in total))
    return {ids: w - norm for ids, w in total}


def drawn(model, raw, keys, k):
    data, offsets = text.text_bytes(pa.array([raw.decode()] * len(keys)))
    d, m, flat, counts, logp, score, inclusion = pieces.Sampler(model).sample(data, offsets, keys, k)
    ends = np.cumsum(counts)
    rows = {}
    for i in range(len(d)):
        rows.setdefault(int(d[i]), []).append((int(m[i]), tuple(flat[ends[i] - counts[i] : ends[i]].tolist()), logp[i], score[i], inclusion[i]))
    return rows


@pytest.mark.parametrize("raw", [b"a", b"ab", b"the", b"  ab\nc", "é日".encode(), b"\x01x"])
@pytest.mark.parametrize("k", [2, 3, 6])
def test_against_all_segmentations(model, raw, k):
    known = every(model, raw)
    keys = text.mix(np.arange(1, 1501, dtype=np.uint64))
    rows = drawn(model, raw, keys, k)
    first, held = {}, {}
    for samples in rows.values():
        assert len(samples) == min(k, len(known))
        assert len({x[1] for x in samples}) == len(samples)
        scores = [x[3] for x in sorted(samples)]
        assert scores == sorted(scores, reverse=True)
        for _, ids, logp, _, inclusion in samples:
            assert logp == pytest.approx(known[ids], abs=1e-6) and inclusion <= 1e-9
            held[ids] = held.get(ids, 0) + math.exp(-inclusion)
        first[samples[0][1]] = first.get(samples[0][1], 0) + 1
    n = len(keys)
    for ids, w in known.items():
        p = math.exp(w)
        assert abs(first.get(ids, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    # Horvitz-Thompson: weights of one over the inclusion count each segmentation once on average.
    if 2 < k < len(known):
        for ids, w in sorted(known.items(), key=lambda x: -x[1])[:2]:
            assert held[ids] / n == pytest.approx(1.0, abs=0.15)


def test_all_segmentations_are_reached(model):
    """As many samples as there are segmentations: the last, very unlikely ones aren't lost."""
    raw = b"that"
    known = every(model, raw)
    rows = drawn(model, raw, text.mix(np.arange(1, 20, dtype=np.uint64)), len(known) + 3)
    for samples in rows.values():
        assert {x[1] for x in samples} == set(known)


def test_second_sample_is_drawn_without_the_first(model):
    known = every(model, b"ab")
    rows = drawn(model, b"ab", text.mix(np.arange(1, 6001, dtype=np.uint64)), 2)
    pairs = {}
    for samples in rows.values():
        key = (samples[0][1], samples[1][1])
        pairs[key] = pairs.get(key, 0) + 1
    for a, b in itertools.permutations(known, 2):
        p = math.exp(known[a]) * math.exp(known[b]) / (1 - math.exp(known[a]))
        assert abs(pairs.get((a, b), 0) / 6000 - p) < 5 * math.sqrt(p * (1 - p) / 6000) + 1e-3


@pytest.mark.parametrize(("n", "k"), [(3_000, 3), (20_000, 5)])
def test_long_unbroken_texts(model, n, k):
    """Thousands of letters without a space: k distinct samples, in falling order of their perturbed scores."""
    raw = bytes(97 + (i * i) % 11 for i in range(n))
    rows = drawn(model, raw, np.array([7, 8], np.uint64), k)
    for samples in rows.values():
        assert [m for m, *_ in samples] == list(range(1, k + 1)) and len({ids for _, ids, *_ in samples}) == k
        assert all(a[3] >= b[3] for a, b in zip(samples, samples[1:]))


def test_rounding_never_costs_a_sample(model):
    """Segments whose lattices are all but certain: as many samples as there are segmentations."""
    for raw in (b"the of and", b"a b", b"of"):
        count = len(every(model, raw))
        k = min(count, 12)
        assert all(len(samples) == k for samples in drawn(model, raw, np.arange(20, dtype=np.uint64), k).values())
