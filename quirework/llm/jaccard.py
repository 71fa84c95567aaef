"""N-gram Jaccard join by signature trees.

Documents with equal shingle sets form one class. Classes that can be linked share a shingle among the first of
their sets, when sets are ordered from rare to frequent. The order is estimated from two count sketches of fixed
size: the frequencies of a shingle's words, and its own where it stands out; any order is exact, a poor one only
costs time. The classes under one shingle form a signature tree: leaves hold token bitmaps and sizes, nodes the OR of
their bitmaps and their range of sizes. A dual traversal goes down pairs of nodes and drops those whose largest
possible overlap is too small, or whose classes are connected already. What it leaves are candidate links; the
classes they connect make up a cell, and no link leaves a cell. Within a cell, a tree over whole shingle sets is
traversed in the same way, and the pairs left at its leaves are compared exactly.

Large cells are dealt to blocks of bounded size, by grades of size and a hash. Blocks are traversed by themselves, then
one class of each part found so far with the others of its cell. Links that are still missing have an end outside of
the cell's main part: those classes meet all blocks of sizes they may be linked with.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing. Texts shorter than a shingle
have their whole word sequence as one. Rows with equal doc_ids are rows like others; a null doc_id is never the
smallest, and a group of nothing else has a null component. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.llm import text
from quirework.llm.components import connected
from quirework.llm.scratch import discard, if_small, release, written

#: Counters of each sketch, whatever the input's size; they are summed and sent in blocks.
SKETCH, SKETCH_BLOCK = 1 << 18, 1 << 12
BITS = 2048
#: Bits of a class's own bitmap, by the size of its set.
WIDTHS = ((512, 512), (2048, 2048), (8192, 8192), (1 << 62, 32768))
LEAF = FAN = 8
#: Classes under one shingle that one tree holds. More are joined in one cell: that loses no link.
BUCKET_ROWS = 1 << 12
#: Shingles of a block of a cell.
BLOCK_SHINGLES = 1 << 19
BROADCAST_ROWS = 500_000


def piece_shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[text.Spans, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a piece, their hashes, first words and hashes of its shingles, and their bounds by document."""
    spans = text.words(data, offsets)
    hashes = spans.hashes(text.LOWER_BYTE)
    at, grams = spans.windows(hashes, n)
    return spans, hashes, at, grams, np.searchsorted(at, spans.bounds)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    spans, hashes, _, grams, bounds = piece_shingles(data, offsets, n)
    out = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    for d in np.flatnonzero((spans.counts > 0) & (spans.counts < n)).tolist():
        out[d] = text.window_hash(hashes, spans.bounds[d : d + 1], int(spans.counts[d]))
    return out


def _set_key(grams: np.ndarray) -> int:
    """An order-free 64-bit hash of a set."""
    total = text.mix(grams).sum(dtype=np.uint64, keepdims=True) + np.full(1, len(grams), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(text.mix(total).view(np.int64)[0])


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH - 1)).astype(np.int64)


def _sketches(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How often words and shingles occur, by hash: SKETCH counters each whatever the input's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SKETCH, np.int64)
        for _, data, offsets in text.pieces(batches):
            _, hashes, _, grams, _ = piece_shingles(data, offsets, n)
            total[:SKETCH] += np.bincount(_cell(hashes), minlength=SKETCH)
            total[SKETCH:] += np.bincount(_cell(grams), minlength=SKETCH)
        yield emit({k: block for k, block in enumerate(total.reshape(-1, SKETCH_BLOCK)) if block.any()})

    def emit(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([b.astype(np.int64).tobytes() for b in blocks.values()], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks[k] = blocks.get(k, 0) + np.frombuffer(raw, np.int64)
        yield emit(blocks)

    schema = "block int, counts binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros(2 * SKETCH, np.int64)
    for k, raw in summed.collect():
        out[k * SKETCH_BLOCK : (k + 1) * SKETCH_BLOCK] = np.frombuffer(bytes(raw), np.int64)
    return out[:SKETCH], out[SKETCH:]


class Frequency:
    """Estimated frequencies of shingles: as if words were independent, or by its own counter where that is more.

    A counter holds many shingles, so only what exceeds its expected sum by five deviations counts.
    """

    def __init__(self, words: np.ndarray, grams: np.ndarray):
        total = max(1, int(words.sum()))
        self.total, self.share = total, np.log(np.maximum(words, 1) / total)
        mean = grams.mean()
        self.excess = np.maximum(grams - mean - 5 * np.sqrt(mean), 0.0)

    def __call__(self, hashes: np.ndarray, at: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
        of_word = self.share[_cell(hashes)]
        share = np.zeros(len(at))
        for k in range(n):
            share += of_word[at + k]
        return np.maximum(np.exp(share) * self.total, self.excess[_cell(grams)])


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    bits = np.zeros((len(sets), width), bool)
    for k, s in enumerate(sets):
        bits[k, (s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps as they would be with fewer bits."""
    while bitmap.shape[1] > words:
        half = bitmap.shape[1] // 2
        bitmap = bitmap[:, :half] | bitmap[:, half:]
    return bitmap


class Tree:
    """A signature tree over bitmaps and sizes, in an order that puts similar ones together."""

    def __init__(self, bitmap: np.ndarray, n: np.ndarray):
        excess = n - np.bitwise_count(bitmap).sum(1, dtype=np.int64)
        #: Per level: first set of each node and the end; bitmaps; least and most size; most shingles without a bit of their own.
        self.levels = [(np.arange(len(n) + 1), bitmap, n, n, excess)]
        width = LEAF
        while len(self.levels[-1][2]) > 1:
            first, bitmap, least, most, excess = self.levels[-1]
            cut = np.arange(0, len(least), width)
            self.levels.append((np.append(first[cut], first[-1]), np.bitwise_or.reduceat(bitmap, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut), np.maximum.reduceat(excess, cut)))
            width = FAN

    def children(self, level: int, node: int) -> tuple[int, int]:
        width = LEAF if level == 1 else FAN
        return node * width, min((node + 1) * width, len(self.levels[level - 1][2]))


def _may_link(a: tuple, i: slice, b: tuple, j: slice, num: int, den: int) -> np.ndarray:
    """Which node pairs may hold a link: by sizes, then by the largest overlap that sizes and bitmaps allow."""
    _, bits_a, lo_a, hi_a, ex_a = a
    _, bits_b, lo_b, hi_b, ex_b = b
    common = np.bitwise_count(bits_a[i, None] & bits_b[None, j]).sum(2, dtype=np.int64)
    most = np.minimum(np.minimum(hi_a[i, None], hi_b[None, j]), common + np.minimum(ex_a[i, None], ex_b[None, j]))
    fits = (den * hi_a[i, None] >= num * lo_b[None, j]) & (den * hi_b[None, j] >= num * lo_a[i, None])
    return fits & ((num + den) * most >= num * (lo_a[i, None] + lo_b[None, j]))


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if den * len(a) < num * len(b):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return den * common >= num * (len(a) + len(b) - common)


def connections(sets: list[np.ndarray], parts: np.ndarray, side: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect the sets' parts (labels of what is connected already) as far as links do.

    side: with two sides, only links between them are looked for. The result is a spanning set of links.
    """
    if len(sets) == 2:
        return [(0, 1)] if parts[0] != parts[1] and (side is None or side[0] != side[1]) and linked(sets[0], sets[1], num, den) else []
    order = np.array(sorted(range(len(sets)), key=lambda k: (0 if side is None else side[k], sets[k][0], len(sets[k]))))
    groups = [order] if side is None else [order[side[order] == s] for s in (0, 1)]
    if any(not len(g) for g in groups):
        return []
    trees = [Tree(bitmaps([sets[k] for k in g], BITS), np.array([len(sets[k]) for k in g], np.int64)) for g in groups]
    found = traverse(trees, parts[order], lambda p, q: linked(sets[order[p]], sets[order[q]], num, den), num, den)
    return [(int(order[p]), int(order[q])) for p, q in found]


def traverse(trees: list[Tree], parts: np.ndarray, joins, num: int, den: int) -> list[tuple[int, int]]:
    """Dual traversal of one tree with itself, or of two trees whose sets are numbered on: pairs that connect parts and that joins accepts."""
    out: list[tuple[int, int]] = []
    _, label = np.unique(parts, return_inverse=True)
    a, b = trees[0], trees[-1]
    base = [0, 0 if len(trees) == 1 else len(a.levels[0][2])]
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        own = len(trees) == 1 and la == lb and i == j
        x = slice(base[0] + a.levels[la][0][i], base[0] + a.levels[la][0][i + 1])
        y = slice(base[1] + b.levels[lb][0][j], base[1] + b.levels[lb][0][j + 1])
        if label[x.start] == label[y.start] and (label[x] == label[x.start]).all() and (label[y] == label[y.start]).all():
            continue
        if la == lb == 0:
            p, q = int(x.start), int(y.start)
            if not own and joins(p, q):
                out.append((p, q))
                label[label == label[q]] = label[p]
            continue
        ca = a.children(la, i) if la and la >= lb else (i, i + 1)
        cb = b.children(lb, j) if lb and lb >= la else (j, j + 1)
        na, nb = la - (la >= lb and la > 0), lb - (lb >= la and lb > 0)
        may = _may_link(a.levels[na], slice(*ca), b.levels[nb], slice(*cb), num, den)
        if own:
            may = np.triu(may)
        r, c = np.nonzero(may)
        # The last pushed is the first visited: nodes with themselves and near ones before far ones.
        far = np.argsort(-np.abs(r - c), kind="stable")
        stack.extend((na, int(ca[0] + r[k]), nb, int(cb[0] + c[k])) for k in far)
    return out


def _pair_bound(bits: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """_may_link for pairs of single classes with bitmaps of their own widths."""
    fits = (den * n[i] >= num * n[j]) & (den * n[j] >= num * n[i])
    out = np.zeros(len(i), bool)
    words = np.array([len(b) for b in bits])
    for w in np.unique(np.minimum(words[i], words[j])):
        at = np.flatnonzero(fits & (np.minimum(words[i], words[j]) == w))
        if len(at):
            x, y = (np.concatenate([folded(bits[k][None], w) for k in side[at].tolist()]) for side in (i, j))
            common = np.bitwise_count(x & y).sum(1, dtype=np.int64)
            ex, ey = (n[side[at]] - np.bitwise_count(z).sum(1, dtype=np.int64) for side, z in ((i, x), (j, y)))
            most = np.minimum(np.minimum(n[i[at]], n[j[at]]), common + np.minimum(ex, ey))
            out[at] = (num + den) * most >= num * (n[i[at]] + n[j[at]])
    return out


def _candidates(num: int, den: int):
    """Candidate links under each shingle; rows in: token, node, n, bits, sorted by token and n."""

    def under_one(n: np.ndarray, bits: list[np.ndarray]) -> list[tuple[int, int]]:
        # The tree's bitmaps are as wide as its narrowest; pairs at its leaves are held against their own.
        width = min(map(len, bits))
        bitmap = np.concatenate([folded(b[None], width) for b in bits])
        return traverse([Tree(bitmap, n)], np.arange(len(n)), lambda p, q: bool(_pair_bound(bits, n, np.array([p]), np.array([q]), num, den)[0]), num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # rows of a shingle that may go on
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            token = rows.column("token").to_numpy()
            cut = int(np.searchsorted(token, token[-1]))
            if cut:
                yield emit(rows.slice(0, cut))
            rest = rows.slice(cut)
        if rest is not None and rest.num_rows:
            yield emit(rest)

    def emit(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        token, nodes, n = (rows.column(c).to_numpy() for c in ("token", "node", "n"))
        bits = [np.frombuffer(b.as_buffer(), np.uint64) for b in rows.column("bits")]
        heads = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        ends = np.append(heads[1:], len(token))
        size = ends - heads
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        of = np.repeat(ends, size)
        small = np.repeat(size <= LEAF, size)
        for d in range(1, LEAF):  # a leaf's pairs, those of all small buckets together
            i = np.flatnonzero(small & (np.arange(len(token)) + d < of))
            if len(i):
                ok = _pair_bound(bits, n, i, i + d, num, den)
                left.append(i[ok])
                right.append(i[ok] + d)
        for a, b in zip(heads[size > LEAF].tolist(), ends[size > LEAF].tolist(), strict=True):
            pairs = under_one(n[a:b], bits[a:b])
            left.append(np.array([p for p, _ in pairs], np.int64) + a)
            right.append(np.array([q for _, q in pairs], np.int64) + a)
        i, j = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _find(n: int, num: int, den: int):
    """Edges between classes of each unit; rows in: unit, node, part, side, text, sorted by unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, {}

        def flush() -> pa.RecordBatch | None:
            nodes = list(held)
            if len(nodes) < 2:
                return None
            sets, parts, sides = zip(*held.values(), strict=True)
            sides = np.array(sides)
            found = connections(list(sets), np.array(parts), None if (sides < 0).all() else sides, num, den)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], ["a", "b"]) if found else None

        for rows, data, offsets in text.pieces(batches):
            sets = shingle_sets(data, offsets, n)
            for u, node, part, side, grams in zip(*(rows.column(k).to_pylist() for k in range(4)), sets, strict=True):
                if u != unit:
                    if (found := flush()) is not None:
                        yield found
                    unit, held = u, {}
                # Where rows share a doc_id, the text may be another class's.
                if node not in held and len(grams) and _set_key(grams) == node:
                    held[node] = (grams, part, side)
        if (found := flush()) is not None:
            yield found

    return run


def _edges(docs: DataFrame, units: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links between the classes of each unit. units: doc_id, text_key, unit, node, part, side."""
    units = units.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_key", "_k")
    rows = docs.join(if_small(units, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")))
    rows = rows.select("unit", "node", "part", "side", "text").repartition("unit").sortWithinPartitions("unit")
    return written(rows.mapInArrow(_find(n, num, den), "a long, b long"), "links")


def shingle_rows(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of docs (doc_id, text, text_key): doc_id, text_key, n_shingles, node (the class), first shingles, bitmap."""
    frequency = Frequency(*_sketches(docs, n))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text.pieces(batches):
            spans, hashes, at, grams, bounds = piece_shingles(data, offsets, n)
            often = frequency(hashes, at, grams, n)
            sets, first = [], []
            for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own, index = np.unique(grams[a:b], return_index=True)
                if spans.counts[d] and a == b:
                    own, index = text.window_hash(hashes, spans.bounds[d : d + 1], int(spans.counts[d])), None
                sets.append(own)
                # A linked set shares at least num/den of this one.
                reach = len(own) - -(-num * len(own) // den) + 1 if len(own) else 0
                first.append(own if index is None else own[np.lexsort((own, often[a:b][index]))[:reach]])
            size = np.array([len(s) for s in sets], np.int64)
            reach = np.array([len(f) for f in first], np.int64)
            flat = np.concatenate(first).view(np.int64) if first else np.zeros(0, np.int64)
            nodes = [_set_key(s) if len(s) else None for s in sets]
            widths = [next(w for most, w in WIDTHS if len(s) <= most) for s in sets]
            bits: list[bytes | None] = [None] * len(sets)
            for w in set(widths):
                at = [k for k in range(len(sets)) if widths[k] == w]
                for k, b in zip(at, bitmaps([sets[k] for k in at], w), strict=True):
                    bits[k] = b.tobytes()
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(size), pa.array(nodes, pa.int64()), text.list_column(flat, reach, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "text_key", "n_shingles", "node", "first", "bits"])

    return docs.select("doc_id", "text", "text_key").mapInArrow(prefixes, "doc_id long, text_key long, n_shingles long, node long, first array<long>, bits binary")


def _candidate_links(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate links (a, b) between classes (node, n, first, bits)."""
    tokens = classes.select(F.explode("first").alias("token"), "node", F.col("n").cast("int").alias("n"))
    shared = tokens.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").cast("int").alias("held")).where("held > 1")
    shared = written(shared.withColumnRenamed("token", "_t"), "shared")
    release(classes.sparkSession)
    by_size = Window.partitionBy("token").orderBy("n", "node")
    less, more = (F.coalesce(step("n").over(by_size), F.lit(0)) for step in (F.lag, F.lead))
    near = (den * less >= num * F.col("n")) | ((more > 0) & (den * F.col("n") >= num * more))
    # Both sides grow with the input, so they are joined in one way at every size.
    rows = tokens.join(shared.where(F.col("held") <= BUCKET_ROWS).hint("merge"), F.col("token") == F.col("_t"))
    kept = written(rows.withColumn("_near", near).where("_near").select("token", "node", "n"), "tokens")
    release(classes.sparkSession)
    # What very many classes share puts them into one cell: a star, which no task has to gather.
    wide = shared.where(F.col("held") > BUCKET_ROWS)
    stars = tokens.join(if_small(wide, BROADCAST_ROWS), (F.col("token") == F.col("_t")) & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    bits = classes.select(F.col("node").alias("_n"), "bits")
    pairs = kept.join(bits.hint("merge"), F.col("node") == F.col("_n")).select("token", "node", F.col("n").cast("long").alias("n"), "bits")
    pairs = pairs.repartition("token").sortWithinPartitions("token", "n", "node")
    return pairs.mapInArrow(_candidates(num, den), "a long, b long").union(stars)


def _dealt(rows: DataFrame, most: int, num: int, den: int, out: str) -> DataFrame:
    """Deal rows (cell, n, node, ...) to blocks of about so many shingles: cells within that stay whole.

    Larger ones are cut by grades of n, a grade's classes by a hash; all counts are plain sums.
    """
    grade = F.floor(F.log(F.col("n") + 0.5) / F.lit(float(np.log(den / num)))).cast("long")
    rows = rows.withColumn("_grade", grade)
    cells = rows.groupBy("cell").agg(F.sum("n").alias("_all")).where(F.col("_all") > most).select(F.col("cell").alias("_c"))
    parts = rows.join(cells, F.col("cell") == F.col("_c")).groupBy("_c", F.col("_grade").alias("_g")).agg(F.ceil(F.sum("n") / most).alias("_parts"))
    parts = if_small(written(parts, "parts"), BROADCAST_ROWS)
    rows = rows.join(parts, (F.col("cell") == F.col("_c")) & (F.col("_grade") == F.col("_g")), "left")
    block = F.when(F.col("_parts").isNull(), 0).otherwise(F.xxhash64("_grade", F.pmod(F.xxhash64("node"), F.col("_parts"))))
    return rows.withColumn(out, block).drop("_grade", "_c", "_g", "_parts")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: rows with equal doc_ids are told apart by it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("text_key", F.xxhash64("text"))


def class_links(docs: DataFrame, n: int, num: int, den: int, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Of docs: a row a document (doc_id, text_key, n_shingles, node), and links (a, b) that connect the classes."""
    spark = docs.sparkSession
    docs = keyed(docs)
    wide = written(shingle_rows(docs, n, num, den), "wide-sets")
    sets = written(wide.select("doc_id", "text_key", "n_shingles", "node"), "sets")
    held = wide.where("node is not null")
    some = F.struct("doc_id", "text_key")
    classes = held.groupBy("node").agg(F.min(some).alias("k"), F.first("n_shingles").alias("n"), F.first("first").alias("first"), F.first("bits").alias("bits"))
    classes = written(classes.select("k.*", "node", "n", "first", "bits"), "classes")
    discard(wide)
    release(spark)
    cells = written(connected(_candidate_links(classes, num, den)), "cells")
    release(spark)
    rows = classes.select("doc_id", "text_key", "node", "n").join(cells.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"))
    rows = rows.select("doc_id", "text_key", "node", "n", F.col("label").alias("cell"))
    rows = written(rows, "celled")
    discard(classes)
    rows = written(_dealt(rows, block_shingles, num, den, "block"), "blocks")
    own = rows.select("doc_id", "text_key", F.xxhash64("cell", "block").alias("unit"), "node", F.col("node").alias("part"), F.lit(-1).alias("side"))
    repeated = sets.where("node is not null").groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count() > 0
    texts = docs.dropDuplicates(["doc_id", "text_key"]) if repeated else docs
    links = _edges(texts, own, n, num, den)
    wide = written(rows.groupBy("cell").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select(F.col("cell").alias("_c")), "wide")
    if not wide.isEmpty():
        rows = rows.join(if_small(wide, BROADCAST_ROWS), F.col("cell") == F.col("_c")).drop("_c")
        links = links.union(_across(texts, rows, links, n, num, den, block_shingles))
    return sets.select("doc_id", "text_key", "n_shingles", "node"), links


def _parts(classes: DataFrame, links: DataFrame) -> DataFrame:
    labels = connected(links).withColumnRenamed("node", "_n")
    rows = classes.join(labels, F.col("node") == F.col("_n"), "left").withColumn("part", F.coalesce("label", "node"))
    return written(rows.drop("_n", "label"), "parts")


def _across(docs: DataFrame, classes: DataFrame, links: DataFrame, n: int, num: int, den: int, block_shingles: int) -> DataFrame:
    """Links between blocks of cells that have several."""
    found = links
    rows = _parts(classes, found)
    # One class of each part in each block meets the others of its cell.
    some = rows.groupBy("cell", "block", "part").agg(F.min(F.struct("n", "node", "doc_id", "text_key")).alias("c")).select("cell", "part", "c.*")
    some = _dealt(written(some, "bridges"), block_shingles, num, den, "bridge")
    bridges = written(some.select("doc_id", "text_key", F.xxhash64("cell", "bridge", F.lit("bridge")).alias("unit"), "node", "part", F.lit(-1).alias("side")), "bridges")
    more = _edges(docs, bridges, n, num, den)
    found = found.union(more)
    rows = _parts(classes, found)
    # A missing link has an end outside of its cell's main part: those classes meet every block that sizes allow.
    parts = rows.groupBy("cell", "part").agg(F.sum("n").alias("held"))
    main = parts.groupBy("cell").agg(F.max(F.struct("held", "part"))["part"].alias("main")).withColumnRenamed("cell", "_c")
    main = if_small(written(main, "main"), BROADCAST_ROWS)
    outside = written(rows.join(main, (F.col("cell") == F.col("_c")) & (F.col("part") != F.col("main"))).drop("_c", "main"), "outside")
    if outside.isEmpty():
        return more
    outside = written(_dealt(outside, block_shingles, num, den, "chunk"), "chunks")
    ranges = [F.min("n").alias("lo"), F.max("n").alias("hi")]
    chunks = outside.groupBy("cell", "chunk").agg(*ranges)
    blocks = rows.groupBy(F.col("cell").alias("_c"), "block").agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    pairs = chunks.join(blocks, (F.col("cell") == F.col("_c")) & (F.col("hi") * den >= F.col("_lo") * num) & (F.col("_hi") * den >= F.col("lo") * num))
    pairs = written(pairs.select(F.col("cell").alias("_c"), F.col("chunk").alias("_k"), F.col("block").alias("_b"), F.xxhash64("cell", "chunk", "block", F.lit("pair")).alias("unit")), "pairs")
    columns = ["doc_id", "text_key", "unit", "node", "part"]
    few = if_small(pairs, BROADCAST_ROWS)
    one = outside.join(few, (F.col("cell") == F.col("_c")) & (F.col("chunk") == F.col("_k"))).select(*columns, F.lit(0).alias("side"))
    other = rows.join(few, (F.col("cell") == F.col("_c")) & (F.col("block") == F.col("_b"))).select(*columns, F.lit(1).alias("side"))
    return more.union(_edges(docs, written(one.union(other), "units"), n, num, den))


def row_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, text_key, n_shingles, node and label (of the class's group, null without links) of every row."""
    sets, links = class_links(docs, n, num, den, block_shingles)
    labels = connected(links).withColumnRenamed("node", "_n")
    return sets.join(labels, F.col("node") == F.col("_n"), "left").drop("_n").withColumn("label", F.coalesce("label", "node"))


def components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: links join documents with den * overlap >= num * union."""
    rows = written(row_components(docs, n, num, den, block_shingles), "rows")
    least = rows.where("label is not null").groupBy(F.col("label").alias("_l")).agg(F.min("doc_id").alias("component_id"))
    rows = rows.join(least, F.col("label") == F.col("_l"), "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each group: that with its smallest doc_id (null only where all are; then the least hash of
    the text decides). Rows without words are no group and stay."""
    rows = written(row_components(docs, n, num, den).where("label is not null").select("doc_id", "text_key", "label"), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("unset"), "doc_id", "text_key")
    least = rows.groupBy(F.col("label").alias("_l")).agg(F.min(place).alias("k"), F.count("*").alias("n")).where("n > 1")
    least = written(least.select("_l", F.col("k.doc_id").alias("_d"), F.col("k.text_key").alias("_k")), "least")
    grouped = rows.join(least, F.col("label") == F.col("_l"))
    stays = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k"))
    # Rows of one doc_id and text stay or go together; where several stay, one of them does.
    marked = grouped.groupBy("doc_id", "text_key").agg(F.max(stays).alias("_stays"), F.count("*").alias("n"))
    marked = written(marked.where("not _stays or n > 1").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "_stays"), "marked")
    # The input's columns travel as one, so that their names can't clash.
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_text"))
    whole = whole.join(if_small(marked, BROADCAST_ROWS), F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_k")), "left")
    out = whole.where("_stays is null").select("_row.*")
    if not marked.where("_stays").isEmpty():
        out = out.unionByName(whole.where("_stays").dropDuplicates(["_id", "_text"]).select("_row.*"))
    return out


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i+3]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
