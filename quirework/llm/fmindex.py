"""Substring dedup: FM-indexes over the passages that documents may share.

A window is 13 consecutive words of one document; a word goes if a window that covers it also starts in a document
with a smaller doc_id. Three steps keep the index to text that can matter:

1. Every window has an anchor, the 6-word gram in it with the least hash. Equal windows have equal anchors, so a
   window whose anchor lies in one document only can't be shared.
2. What is left are passages: the words of the windows around one shared anchor. Equal passages are merged (with
   the least doc_id) before they are shuffled, and dealt to shards by their anchor; windows around an anchor that
   very many documents hold are dealt one by one, by their own hash.
3. Each shard builds a compressed FM-index over its passages (symbols are words): a word-level Burrows-Wheeler transform
   in a wavelet matrix, ordered by the first 16 words, with runs of equal windows as bit vectors. Backward search streams
   all passages through it in step, and gives each window's interval and the least doc_id in it; neighbouring windows
   that an earlier document holds are reported as intervals of words.

Edge cases: null, empty and blank texts have no words; texts under 13 words lose none. A null doc_id is neither
smaller nor larger than another, so such rows neither lose words nor make others lose any; rows with equal doc_ids
don't either. Of rows with equal texts, all but those with the least doc_id lose every word (if they have 13). Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm import text
from quirework.llm.scratch import discard, if_small, release, written

WINDOW, ANCHOR = 13, 6
_CHOICES = WINDOW - ANCHOR + 1
#: Windows around an anchor in more documents than this are dealt one by one.
HOT_ANCHOR = 2000
#: Words of an index; a shard's passages are indexed in runs of about so many.
INDEX_WORDS = 1 << 18
#: Rows of removals that are broadcast at most, and the ranges they hold; beyond that texts are shuffled.
BROADCAST_ROWS, BROADCAST_RANGES = 400_000, 3_000_000
_ORDER = 16


class BitVector:
    """Packed bits with ranks: counts of 16 bits a word within blocks of 1,023 words, and one of 32 bits a block."""

    _WORDS = 1023

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(np.uint64)
        count = np.bitwise_count(self.words).astype(np.int64)
        before = np.cumsum(count) - count
        self.blocks = before[:: self._WORDS].astype(np.uint32)
        self.within = (before - np.repeat(before[:: self._WORDS], self._WORDS)[: len(before)]).astype(np.uint16)
        self.ones = int(count.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        before = self.blocks[word // self._WORDS].astype(np.int64) + self.within[word]
        return before + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, top: int):
        n = len(seq)
        self.bits, self.zeros = [], []
        self.levels = range(max(1, int(top).bit_length()) - 1, -1, -1)
        for level in self.levels:
            on = ((seq >> level) & 1).astype(bool)
            self.bits.append(BitVector(on))
            self.zeros.append(n - self.bits[-1].ones)
            seq = np.concatenate([seq[~on], seq[on]])
        self.first = self.position(np.arange(top + 1), np.zeros(top + 1, np.int64)).astype(np.int32)

    def position(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = self.bits[k].rank(i)
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Times symbol occurs before i."""
        return self.position(symbol, i) - self.first[symbol]


class FMIndex:
    """Backward search over passages of symbols from 1 on; 0 ends each passage.

    Suffixes are in order of their first 16 symbols, which is all that patterns of up to 16 can tell apart. What is kept
    is the transform as a wavelet matrix, where runs of rows with equal first 13 and 12 symbols begin as two bit
    vectors, one owner for each run of the first kind and one place for each of the second: a few bits a word.
    """

    def __init__(self, symbols: np.ndarray, owners: np.ndarray):
        n = len(symbols)
        ranks = {1: symbols.astype(np.int64)}
        h = 1
        while h < _ORDER:
            shifted = np.zeros(n, np.int64)
            shifted[: max(0, n - h)] = ranks[h][h:]
            _, ranks[2 * h] = np.unique(ranks[h] * (int(ranks[h].max(initial=0)) + 1) + shifted, return_inverse=True)
            h *= 2
        suffix = np.argsort(ranks[_ORDER], kind="stable")

        def opens(depths: list[tuple[int, int]]) -> np.ndarray:
            """Whether each row differs from the one before it in any rank (length, offset)."""
            out = np.zeros(n, bool)
            out[:1] = True
            for length, offset in depths:
                at = suffix + offset
                r = np.where(at < n, ranks[length][np.minimum(at, n - 1)], 0)
                out[1:] |= r[1:] != r[:-1]
            return out

        whole, parent = opens([(8, 0), (4, 8), (1, 12)]), opens([(8, 0), (4, 8)])
        self.windows_open, self.parents_open = BitVector(whole), BitVector(parent)
        self.least = np.minimum.reduceat(owners[suffix], np.flatnonzero(whole)) if n else owners
        self.parents = np.append(np.flatnonzero(parent), n).astype(np.int32)
        top = int(symbols.max(initial=0))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        self.bwt = WaveletMatrix(symbols[suffix - 1], top)
        self.n = n

    def nbytes(self) -> int:
        vectors = [*self.bwt.bits, self.windows_open, self.parents_open]
        return sum(v.words.nbytes + v.within.nbytes + v.blocks.nbytes for v in vectors) + self.least.nbytes + self.parents.nbytes + self.smaller.nbytes + self.bwt.first.nbytes

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after a symbol is put before the pattern; a symbol below 1 or unknown empties it."""
        known = (symbol > 0) & (symbol < len(self.smaller) - 1)
        symbol = np.where(known, symbol, 0)
        both = self.smaller[np.tile(symbol, 2)] + self.bwt.rank(np.tile(symbol, 2), np.concatenate([lo, hi]))
        lo, hi = np.split(both, 2)
        return lo, np.where(known, hi, lo)

    def windows(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of patterns at the length of a window.

        All patterns go from right to left in step. Yields for each step the patterns, the windows' places in them
        and the least owner of each window (-1 where it doesn't occur). A found window's interval is widened to its
        first 12 symbols and goes on from there; after a failure 12 symbols are searched anew.
        """
        lanes = np.flatnonzero(lengths >= WINDOW)
        lanes = lanes[np.argsort(-lengths[lanes], kind="stable")]
        lo, hi = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        for back in range(WINDOW, int(lengths[lanes].max(initial=0)) + 1):
            live = int(np.searchsorted(-lengths[lanes], -back, "right"))
            lanes, lo, hi = lanes[:live], lo[:live], hi[:live]
            at = lengths[lanes] - back
            lost = np.flatnonzero(lo >= hi)
            if len(lost):
                a, b = np.zeros(len(lost), np.int64), np.full(len(lost), self.n, np.int64)
                for k in range(WINDOW - 1, 0, -1):
                    a, b = self.step(flat[starts[lanes[lost]] + at[lost] + k], a, b)
                lo[lost], hi[lost] = a, b
            lo, hi = self.step(flat[starts[lanes] + at], lo, hi)
            found = lo < hi
            row = np.minimum(lo, self.n - 1)
            yield lanes, at, np.where(found, self.least[self.windows_open.rank(row + 1) - 1], -1)
            run = self.parents_open.rank(row + 1)
            lo, hi = np.where(found, self.parents[run - 1], 0), np.where(found, self.parents[run], 0)


def _anchors(spans: text.Spans, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, the first word of each one's anchor, and the hashes of all 6-word grams."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(np.arange(len(hashes)) + WINDOW <= np.repeat(spans.bounds[1:], spans.counts))
    grams = text.window_hash(hashes, np.arange(len(hashes) - ANCHOR + 1), ANCHOR)
    best, least = at.copy(), grams[at]
    for k in range(1, _CHOICES):
        other = grams[at + k]
        less = other < least
        best[less] = at[less] + k
        least = np.where(less, other, least)
    return at, best, grams


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text.pieces(batches):
        spans = text.words(data, offsets)
        _, best, grams = _anchors(spans, spans.hashes())
        best = best[np.append(True, best[1:] != best[:-1])] if len(best) else best
        document = np.searchsorted(spans.bounds, best, "right") - 1
        ids = rows.column(0).to_numpy()[document]
        # An anchor counts once a document.
        keys = text.mix(grams[best] + document.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, once = np.unique(keys, return_index=True)
        yield pa.RecordBatch.from_arrays([_signed(grams[best][once]), pa.array(ids[once])], ["anchor", "doc_id"])


def _emit_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns in: doc_id, text_key, text, anchors array<struct<anchor, n>>."""
    for rows, data, offsets in text.pieces(batches):
        spans = text.words(data, offsets)
        hashes = spans.hashes()
        at, best, grams = _anchors(spans, hashes)
        if not len(at):
            continue
        document = np.searchsorted(spans.bounds, at, "right") - 1
        shared = rows.column(3)
        of = np.repeat(np.arange(rows.num_rows), np.diff(shared.offsets.to_numpy())).astype(np.uint64)
        flat = shared.flatten()
        salt = np.uint64(0x9E3779B97F4A7C15)
        keys = text.mix(flat.field("anchor").to_numpy().view(np.uint64) + of * salt)
        order = np.argsort(keys)
        keys, counts = keys[order], flat.field("n").to_numpy()[order]
        own = text.mix(grams[best] + document.astype(np.uint64) * salt)
        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        n = np.where(keys[place] == own, counts[place], 0)
        keep = n > 1
        at, best, n, document = at[keep], best[keep], n[keep], document[keep]
        if not len(at):
            continue
        hot = n > HOT_ANCHOR
        # A passage begins where the anchor changes or windows aren't neighbours; around hot anchors with each window.
        opens = np.append(True, (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1) | hot[1:])
        head = np.flatnonzero(opens)
        tail = np.append(head[1:], len(at)) - 1
        key = grams[best[head]].copy()
        warm = hot[head]
        window = text.window_hash(hashes, at[head[warm]], WINDOW)
        parts = -(-n[head[warm]] // HOT_ANCHOR).astype(np.uint64)
        key[warm] = text.mix(key[warm] + window % parts)
        first, last = spans.starts[at[head]], spans.ends[at[tail] + WINDOW - 1]
        raw = data.tobytes()
        passages = [raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        pid = text.Spans(data, offsets, first, last).hashes() + key
        d = document[head]
        yield pa.RecordBatch.from_arrays(
            [_signed(key), _signed(pid), rows.column(0).take(pa.array(d)), rows.column(1).take(pa.array(d)), pa.array((at[head] - spans.bounds[d]).astype(np.int32)), pa.array(passages, pa.binary())],
            ["key", "pid", "doc_id", "text_key", "start", "passage"],
        )


def search(passages: list[bytes], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least owner of every window of every passage, flat, and the windows' number in each passage."""
    data = np.frombuffer(b"".join(passages), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in passages])])
    spans = text.words(data, offsets)
    _, symbols = np.unique(spans.hashes(), return_inverse=True)
    n = len(symbols) + len(passages)
    stops = spans.bounds[1:] + np.arange(len(passages))
    flat = np.zeros(n, np.int64)
    mask = np.ones(n, bool)
    mask[stops] = False
    flat[mask] = symbols + 1
    index = FMIndex(flat, np.repeat(owners, spans.counts + 1))
    windows = np.maximum(spans.counts - WINDOW + 1, 0)
    out = np.zeros(int(windows.sum()), np.int64)
    base = np.cumsum(windows) - windows
    for lanes, at, least in index.windows(flat, stops - spans.counts, spans.counts):
        out[base[lanes] + at] = least
    return out, windows


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in: key, pid, passage, least and most doc_id, sorted by key; a key's rows are indexed together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        rows = rows.combine_chunks()
        least, windows = search(rows.column("passage").to_pylist(), rows.column("least").to_numpy())
        ends = np.cumsum(windows)
        smaller = text.per_document(least < np.repeat(rows.column("most").to_numpy(), windows), np.append(0, ends)) > 0
        lists = text.list_column(least, windows, pa.int64())
        keep = pa.array(np.flatnonzero(smaller))
        yield pa.RecordBatch.from_arrays([rows.column("pid").combine_chunks().take(keep), lists.take(keep)], ["pid", "least"])

    for batch in batches:
        held.append(batch)
        size += batch.column(2).nbytes // 6
        if size < INDEX_WORDS:
            continue
        rows = pa.Table.from_batches(held)
        keys = rows.column("key").to_numpy()
        # The last key may go on in the next batch.
        cut = int(np.searchsorted(keys, keys[-1]))
        at = 0
        while at < cut:
            sizes = rows.column("passage").slice(at, cut - at)
            ends = np.cumsum([len(x) // 6 for x in sizes.to_pylist()])
            to = at + max(1, int(np.searchsorted(ends, INDEX_WORDS)))
            to = min(cut, int(np.searchsorted(keys, keys[min(to, cut) - 1], "right")))
            yield from flush(rows.slice(at, to - at))
            at = to
        held = rows.slice(cut).to_batches()
        size = 0
    if held:
        yield from flush(pa.Table.from_batches(held))
    text.give_back()


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns in: doc_id, text_key, hits array<struct<start, mask>>; out: word ranges start, end, start, end, ..."""
    for batch in batches:
        hits = batch.column(2)
        flat, counts = hits.flatten(), np.diff(hits.offsets.to_numpy())
        start, mask = flat.field("start").to_numpy().astype(np.int64), flat.field("mask").to_numpy()
        row = np.repeat(np.arange(batch.num_rows), counts)
        k = np.arange(_CHOICES)
        on = ((mask[:, None] >> k) & 1).astype(bool)
        begins, rows = (start[:, None] + k)[on], np.broadcast_to(row[:, None], on.shape)[on]
        order = np.lexsort((begins, rows))
        begins, rows = begins[order], rows[order]
        fresh = np.append(True, (rows[1:] != rows[:-1]) | (begins[1:] > begins[:-1] + WINDOW)) if len(begins) else np.zeros(0, bool)
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(begins)) - 1 if len(head) else head
        pairs = np.stack([begins[head], begins[tail] + WINDOW], 1).astype(np.int32).ravel()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text.list_column(pairs, 2 * np.bincount(rows[head], minlength=batch.num_rows), pa.int32())], ["doc_id", "text_key", "ranges"])


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, ranges, is_copy of the texts of docs (doc_id, text_key, text) that lose words.

    ranges are first and past-the-end words; a copy loses all words, if it has a window.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null")
    keys = rows.select("doc_id", "text_key", F.octet_length("text").alias("_bytes"), F.md5(F.encode("text", "UTF-8")).alias("_md5"))
    least = keys.groupBy("_md5").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).where("_least < _most").select(F.col("_md5").alias("_m"), "_least")
    later = keys.join(least, (F.col("_md5") == F.col("_m")) & (F.col("doc_id") > F.col("_least"))).select("doc_id", "text_key").distinct()
    later = written(later, "copies").withColumn("is_copy", F.lit(True))
    marks = later.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"))
    firsts = rows.join(if_small(marks, BROADCAST_ROWS), (F.col("doc_id") == F.col("_d")) & (F.col("text_key") == F.col("_t")), "left_anti")

    pairs = written(firsts.select("doc_id", "text").mapInArrow(_emit_anchors, "anchor long, doc_id long"), "anchor-rows")
    # Counted first and joined back, so that an anchor of very many documents is no single task's rows.
    often = pairs.groupBy(F.col("anchor").alias("_a")).agg(F.count("*").cast("int").alias("n")).where("n > 1")
    shared = pairs.join(often.hint("merge"), F.col("anchor") == F.col("_a"))
    shared = written(shared.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "n")).alias("anchors")), "anchors")
    discard(pairs)
    release(spark)
    found = firsts.join(shared.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d")).select("doc_id", "text_key", "text", "anchors")
    passages = found.mapInArrow(_emit_passages, "key long, pid long, doc_id long, text_key long, start int, passage binary")
    passages = written(passages, "passages", codec="zstd")
    release(spark)
    distinct = passages.groupBy("key", "pid", "passage").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    dealt = distinct.repartition("key").sortWithinPartitions("key").select("key", "pid", "passage", "least", "most")
    result = written(dealt.mapInArrow(_search_shards, "pid long, least array<long>"), "windows")
    release(spark)
    mask = F.expr("aggregate(transform(least, (m, i) -> IF(m < doc_id, shiftleft(1, i), 0)), 0, (a, b) -> a | b)")
    hits = passages.select("pid", "doc_id", "text_key", "start").join(result.withColumnRenamed("pid", "_p"), F.col("pid") == F.col("_p"))
    hits = hits.select("doc_id", "text_key", "start", mask.alias("mask")).where("mask <> 0")
    hits = hits.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "mask")).alias("hits"))
    ranges = hits.mapInArrow(_ranges, "doc_id long, text_key long, ranges array<int>").withColumn("is_copy", F.lit(False))
    out = written(ranges.unionByName(later.withColumn("ranges", F.lit(None).cast("array<int>"))), "removals")
    release(spark)
    return out


def intervals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, start, end: the intervals of words of docs (doc_id, text) that lie in windows which start in earlier documents.

    A copy of an earlier document is one interval of all its words, past-the-end null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    gone = removals(rows)
    pair = F.explode(F.transform(F.sequence(F.lit(0), (F.size("ranges") / 2 - 1).cast("int")), lambda k: F.struct(F.get("ranges", (2 * k).cast("int")).alias("start"), F.get("ranges", (2 * k + 1).cast("int")).alias("end")))).alias("x")
    found = gone.where("not is_copy and size(ranges) > 0").select("doc_id", "text_key", pair).select("doc_id", "text_key", "x.*")
    return found.unionByName(gone.where("is_copy").select("doc_id", "text_key", F.lit(0).alias("start"), F.lit(None).cast("int").alias("end")))


def _covered(spans: text.Spans, ranges: pa.Array, copies: np.ndarray) -> np.ndarray:
    """Whether each word goes."""
    edges = np.zeros(len(spans.starts) + 1, np.int64)
    flat = ranges.flatten().to_numpy()
    of = np.repeat(np.arange(len(spans.counts)), np.diff(ranges.offsets.to_numpy()))
    np.add.at(edges, flat[::2] + spans.bounds[of[::2]], 1)
    np.subtract.at(edges, flat[1::2] + spans.bounds[of[1::2]], 1)
    return (np.cumsum(edges[:-1]) > 0) | np.repeat(copies & (spans.counts >= WINDOW), spans.counts)


def _marked(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text, others) with their removals: the others, text, ranges, is_copy."""
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("text_key", F.xxhash64("text"))
    gone = removals(docs.select("doc_id", "text_key", "text"))
    n, total = gone.agg(F.count("*"), F.sum(F.size(F.coalesce("ranges", F.array().cast("array<int>"))))).first()
    if n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_RANGES:
        gone = F.broadcast(gone)
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "ranges", "is_copy")
    rows = docs.join(gone, (F.col("doc_id") == F.col("_d")) & (F.col("text_key") == F.col("_t")), "left")
    others = [c for c in docs.columns if c not in ("text", "text_key")]
    return rows.select(*others, "text", F.coalesce("ranges", F.array().cast("array<int>")).alias("ranges"), F.coalesce("is_copy", F.lit(False)).alias("is_copy"))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the hash of the kept words of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text.pieces(batches):
            spans = text.words(data, offsets)
            gone = _covered(spans, rows.column(2), rows.column(3).to_numpy(zero_copy_only=False))
            kept = []
            raw = data.tobytes()
            for a, b in zip(spans.bounds[:-1].tolist(), spans.bounds[1:].tolist(), strict=True):
                stay = np.flatnonzero(~gone[a:b]) + a
                kept.append(hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(spans.starts[stay].tolist(), spans.ends[stay].tolist(), strict=True)])).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans.counts.astype(np.int64)), pa.array(text.per_document(gone, spans.bounds).astype(np.int64)), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame) -> DataFrame:
    """docs without the words that go; each kept word keeps the white space before it. Texts left empty by this are dropped."""
    # The other columns travel as one, so that their names can't clash with those added here.
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row")
    rows = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", others))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in text.pieces(batches):
            spans = text.words(data, offsets)
            gone = _covered(spans, part.column(3), part.column(4).to_numpy(zero_copy_only=False))
            lost = np.zeros(len(data) + 1, np.int64)
            before = np.append(0, spans.ends[:-1]) if len(spans.ends) else spans.ends
            before = np.maximum(before, np.repeat(offsets[:-1], spans.counts))
            np.add.at(lost, before[gone], 1)
            np.subtract.at(lost, spans.ends[gone], 1)
            keep = np.cumsum(lost[:-1]) == 0
            size = text.per_document(keep, offsets)
            kept = data[keep].tobytes()
            ends = np.cumsum(size).tolist()
            texts = [kept[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            removed = text.per_document(gone, spans.bounds)
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(texts, pa.string()), pa.array((removed > 0) & (removed == spans.counts))], ["row", "text", "was_emptied"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, was_emptied boolean"
    out = rows.mapInArrow(cut, schema).where("not was_emptied")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: Windows as lists of words, compared whole.
DEDUP_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
keyed AS (SELECT doc_id, i, ws[i:i+12] AS g FROM starts),
least AS (SELECT g, min(doc_id) AS m FROM keyed GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM keyed JOIN least USING (g) WHERE m < doc_id),
flat AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT f.doc_id, string_agg(word, ' ' ORDER BY p) AS txt, count(*) AS n FROM flat f ANTI JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p GROUP BY f.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
