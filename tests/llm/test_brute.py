"""Operators against plain Python on small tables."""

import binascii
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import fmindex, jaccard, media, mix, pieces, quality_model, rules, shards, token_store
from quirework.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=240, seed=11):
    """Prose with exact copies, near copies of all degrees, shared passages and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(180)] + ["The", "THE", "é", "日本語"]
    texts, passages = [], [[rng.choice(vocabulary) for _ in range(40)] for _ in range(4)]
    for k in range(n):
        if k % 4 == 3 and texts:
            words = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.choice([0, 1, 1, 2, 5, 12])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 3, 9, 40, 90, 150]))]
            if k % 5 == 0:
                at = rng.randrange(len(words) + 1)
                words[at:at] = passages[rng.randrange(4)]
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    return [(k, None if k == 17 else t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return made.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_components(rows, n, num, den):
    sets = {}
    for k, t in rows:
        w = WORD.findall(lower(t))
        sets[k] = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}) if w else set()
    label = {k: k for k in sets}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {k: (len(sets[k]), root(k)) for k in ids}


@pytest.mark.parametrize(("n", "num", "block"), [(4, 85, 1 << 20), (4, 60, 300)])
def test_jaccard(docs, rows, n, num, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs, n, num, 100, block).collect()}
    assert got == brute_components(rows, n, num, 100)


def test_jaccard_shared_widely(docs, rows, monkeypatch):
    """Shingles of more classes than a tree may hold, and cells of many blocks."""
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs, 4, 85, 100, 200).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def brute_dedup(rows):
    first = {}
    words = {k: WORD.findall(t or "") for k, t in rows}
    for k in sorted(words):
        for i in range(len(words[k]) - 12):
            first.setdefault(tuple(words[k][i : i + 13]), k)
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < k:
                gone.update(range(i, i + 13))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("hot", [2000, 2])
def test_substring_dedup(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(fmindex, "HOT_ANCHOR", hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.dedup_digest(docs).collect()}
    expected = brute_dedup(rows)
    assert got == {k: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for k, (n, gone, t) in expected.items()}
    assert sum(g[1] for g in got.values()) > 0
    kept = {r.doc_id: r.text for r in fmindex.dedup(docs).collect()}
    for k, (n, gone, t) in expected.items():
        assert " ".join(WORD.findall(kept.get(k) or "")) == t
        assert (k in kept) == (gone == 0 or gone < n)


def test_rules(docs, rows):
    trusted = docs.where("doc_id % 3 = 0")
    out = {r.doc_id: r for r in rules.judge(docs, rules.fit(docs, trusted)).collect()}
    for k, t in rows:
        t = t or ""
        w = WORD.findall(t)
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + d for i, x in enumerate(windows) if windows.count(x) > 1 for d in range(5)}
        r = out[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_media(docs, rows):
    for r in media.media_digest(docs).collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == binascii.crc32(payload[-32:]) and r.media_bytes > len(payload)


def test_tokens(docs, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_store.token_digest(docs, path).collect()}
    start = 0
    for k, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), binascii.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_shards(docs, rows):
    out = shards.shard_digest(docs).collect()
    assert {r.doc_id: r["size"] for r in out} == {k: len((t or "").encode()) + 8 for k, t in rows}
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.doc_id, r.shard) for r in out) == sorted((r.doc_id, r.shard) for r in shards.shard_digest(docs.repartition(5)).collect())


def test_mix(docs, rows):
    out = mix.mix_digest(docs).collect()
    total = sum(len(WORD.findall(t or "")) for _, t in rows)
    by_source = {}
    for r in out:
        assert r["size"] == len(WORD.findall(dict(rows)[r.doc_id] or "")) and 0 <= r.taken <= 3 * r["size"]
        s = by_source.setdefault(f"s{r.doc_id % 5}", [r.target, 0, r.source_size])
        s[1] += r.taken
    assert sum(s[0] for s in by_source.values()) == pytest.approx(total)
    for target, taken, size in by_source.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= 0.02 * target + 1
    # Sources weigh 5, 2, 1, 5, 2 in code point order.
    shares = [by_source[f"s{k}"][0] for k in range(5)]
    free = [k for k in range(5) if shares[k] < 3 * by_source[f"s{k}"][2] - 1e-6]
    assert len({round(shares[k] / (5, 2, 1, 5, 2)[k], 6) for k in free}) == 1
    assert sorted(map(tuple, out)) == sorted(map(tuple, mix.mix_digest(docs.repartition(4)).collect()))


def test_pieces(docs, rows):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    out = pieces.sample_segmentations(docs, path).collect()

    def plain(ids):
        """The pieces' bytes without the space put before the text."""
        raw = b"".join(bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.encode() for i, p in ((i, processor.id_to_piece(i)) for i in ids))
        return raw.decode().replace("\u2581", " ")[1:]

    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, []).append(r)
    for k, t in rows:
        samples = by_id[k]
        assert len({tuple(r.ids) for r in samples}) == len(samples)
        for r in samples:
            assert plain(r.ids) == (t or "") and r.n_pieces == len(r.ids)
            assert r.log_inclusion <= 1e-9 and r.decoded_crc32 == binascii.crc32((t or "").encode())
    assert sorted((r.doc_id, r.sample, tuple(r.ids)) for r in out) == sorted((r.doc_id, r.sample, tuple(r.ids)) for r in pieces.sample_segmentations(docs.repartition(5), path).collect())


def test_quality_held_out(spark):
    rng = random.Random(3)
    texts, good = [], []
    for k in range(600):
        clean = rng.random() < 0.5
        words = [rng.choice(["river", "stone", "light", "house", "walked", "slowly", "under", "bridge"]) + str(rng.randrange(9) if not clean else "") for _ in range(rng.randrange(20, 80))]
        texts.append((k, (" ".join(words).capitalize() + ".") if clean else " !!! ".join(words).upper()))
        good.append(clean)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(g)) for k, g in enumerate(good) if k % 2], "doc_id long, quality int")
    rows = quality_model.classify(docs, labels).collect()
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, good[r.doc_id]) for r in rows if r.held_out]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x and not y]
    assert sum(pairs) / len(pairs) > 0.95


def test_bit_vectors_and_index_size():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 65, 1000, 64 * 1023, 200_000):
        bits = rng.random(n) < 0.3
        v = fmindex.BitVector(bits)
        at = rng.integers(0, n + 1, 200)
        assert (v.rank(at) == np.concatenate([[0], np.cumsum(bits)])[at]).all()
    words = rng.integers(1, 5000, 100_000)
    words[rng.integers(0, len(words), 3000)] = 0
    index = fmindex.FMIndex(np.append(words, 0), rng.integers(0, 10**6, len(words) + 1))
    # An owner for each distinct window and a place for each distinct parent, and under 4 bytes a word for the rest.
    assert index.nbytes() - index.least.nbytes - index.parents.nbytes - index.smaller.nbytes - index.bwt.first.nbytes < 4 * len(words)


def test_intervals(spark, rows, docs):
    """Intervals of words hold the same words as those that brute force removes."""
    plain = brute_dedup(rows)
    got = {}
    for r in fmindex.intervals(docs.select("doc_id", "text")).collect():
        n = len(WORD.findall(dict(rows)[r.doc_id] or ""))
        got.setdefault(r.doc_id, set()).update(range(r.start, n if r.end is None else r.end) if r.end is not None or n >= 13 else ())
    for k, (_, gone, _) in plain.items():
        assert len(got.get(k, ())) == gone
