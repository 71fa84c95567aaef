"""SentencePiece encoding and decoding: distinct sampled segmentations without replacement.

A text's lattice is a row of segments that no piece crosses (a run of spaces with the word after it, or a line
end). Per distinct segment, backward sums give each edge's probability, so that a path is drawn from left to right
and its probability known. Sampling k distinct segmentations is a best-first (A*) search on perturbed scores: the
sum over a subtree is its exact bound, and the Gumbel maximum of a subtree is drawn conditional on its parent's.
The first path takes the whole lattice's maximum; at each segment the other segmentations form a subtree whose
maximum is drawn below that. The largest open subtree gives the next path: it leaves the old one at that segment.
What remains largest after k paths is the threshold of the inclusion scores.

Weights are those of a unigram model over the model's pieces: minus the logarithm of a piece's rank, times `theta`.
A character that is no piece becomes its bytes. All draws are hashes of (seed, row key, path, segment, step), so a
row's samples depend on nothing but its key and text.

Edge cases: a null or empty text has one segmentation, without pieces. A text with fewer than k segmentations gives
fewer. Literal U+2581 reads as a space, as in the library. Equal texts under equal keys are sampled alike; a null key is
a key of its own. Extra columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm import text

SAMPLES = 2
THETA = 1.0
SEED = 20240601
UNKNOWN = -25.0
#: Edges of the segments a worker keeps between pieces of text.
KEPT_EDGES = 1_000_000
_U = np.uint64
_SALTS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))
_MARK = "▁"


class Model:
    """Pieces as bytes with a space for the space mark, their weights, and the hashes of all their prefixes."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.surface = [b""] * n
        for b, i in enumerate(self.bytes_ids.tolist()):
            self.surface[i] = bytes([b])
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and sp.get_score(i) > -1e8]
        ranked = sorted(usable, key=lambda i: -sp.get_score(i))
        for i in range(n):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                self.surface[i] = sp.id_to_piece(i).replace(_MARK, " ").encode()
        for i in usable:
            s = self.surface[i]
            if b"\n" in s or b" " in s.lstrip(b" "):
                raise ValueError("a piece crosses segments")
        weight = {i: -theta * np.log(rank + 2.0) for rank, i in enumerate(ranked)}
        prefixes: dict[bytes, int] = {}
        for i in usable:
            s = self.surface[i]
            for k in range(1, len(s)):
                prefixes.setdefault(s[:k], -1)
            prefixes[s] = i
        joined = b"".join(prefixes)
        ends = np.cumsum([len(p) for p in prefixes])
        data = np.frombuffer(joined, np.uint8)
        hashes = text.Spans(data, np.array([0, len(data)]), ends - np.array([len(p) for p in prefixes]), ends).hashes()
        order = np.argsort(hashes)
        self.prefix, self.prefix_id = hashes[order], np.array(list(prefixes.values()), np.int32)[order]
        self.longest = max(map(len, prefixes))
        # A table on the first bits narrows each search to a few entries.
        self.shift = _U(64 - 18)
        self.slot = np.searchsorted(self.prefix, np.arange((1 << 18) + 1, dtype=np.float64) * 2.0**46)
        self.weight = np.full(n, -np.inf)
        for i, w in weight.items():
            self.weight[i] = w
        self.theta = theta
        lengths = np.array([len(s) for s in self.surface], np.int64)
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.at, self.length = np.cumsum(lengths) - lengths, lengths

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a prefix's, and the piece it is (-1 if none)."""
        top = (hashes >> self.shift).astype(np.int64)
        at, end = self.slot[top].copy(), self.slot[top + 1]
        found, piece = np.zeros(len(hashes), bool), np.full(len(hashes), -1, np.int32)
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.prefix[at[live]] == hashes[live]
            hit = live[same]
            found[hit], piece[hit] = True, self.prefix_id[at[hit]]
            at[live] += 1
            live = live[~same]
            live = live[at[live] < end[live]]
        return found, piece


class Lattices:
    """Lattices of segments, flat: a node for each byte position, its edges from the longest on.

    first[node]: its first edge; cum: probability of the edges of a node up to this one; step: bytes; piece: id, or
    minus the bytes of a character that is written in bytes; logq: log probability.
    """

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.node = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.cum, self.logq, self.step, self.piece = np.zeros(0), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def build(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges of segments data[offsets[k]:offsets[k + 1]]; nodes are numbered by byte."""
        model, n = self.model, len(data)
        size = np.where(data < 0x80, 1, np.where(data < 0xC0, 0, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))))
        end = np.repeat(offsets[1:], np.diff(offsets))
        live = np.flatnonzero(size)
        spans = text.Spans(data, offsets, live, live)
        power, inverse = text._power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(text._BYTE[data] * power[:n], out=total[1:])
        sources, steps, ids = [], [], []
        single = np.zeros(n, bool)
        for k in range(1, model.longest + 1):
            live = live[live + k <= end[live]]
            if not len(live):
                break
            h = text.mix((total[live + k] - total[live]) * inverse[live] + np.full(1, k, np.uint64) * text._STEP)
            found, piece = model.find(h)
            live, piece = live[found], piece[found]
            whole = piece >= 0
            at = live[whole]
            sources.append(at)
            steps.append(np.full(len(at), k, np.int32))
            ids.append(piece[whole])
            single[at[size[at] == k]] = True
        alone = np.flatnonzero((size > 0) & ~single)
        sources.append(alone)
        steps.append(np.minimum(size[alone], end[alone] - alone).astype(np.int32))
        ids.append(-steps[-1])
        source, step, piece = np.concatenate(sources), np.concatenate(steps), np.concatenate(ids)
        weight = np.where(piece >= 0, model.weight[np.maximum(piece, 0)], UNKNOWN * model.theta)
        # Backward sums, all segments in step from their ends.
        beta = np.full(n + 1, -np.inf)
        beta = np.append(beta, 0.0)  # the last place stands for every segment's end
        target = np.where(source + step == end[source], n + 1, source + step)
        left = end[source] - source
        # No two edges have one source and step, so the order, and with it every sum, depends on the segment alone.
        most = int(step.max(initial=0)) + 1
        order = np.argsort((left * (n + 1) + source) * most + step)
        source, step, piece, weight, target, left = (x[order] for x in (source, step, piece, weight, target, left))
        cuts = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(left) else np.zeros(0, np.int64)
        first = np.append(True, source[1:] != source[:-1]) if len(source) else np.zeros(0, bool)
        score = np.empty(len(source))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(left)).tolist(), strict=True):
            own = np.add(weight[a:b], beta[target[a:b]], out=score[a:b])
            heads = np.flatnonzero(first[a:b])
            top = np.maximum.reduceat(own, heads)
            sums = np.add.reduceat(np.exp(own - np.repeat(top, np.diff(np.append(heads, b - a)))), heads)
            beta[source[a + heads]] = top + np.log(sums)
        logq = score - beta[source]
        # Longer steps first: they are mostly the likelier ones.
        order = np.argsort(source * most + (most - 1 - step))
        source, step, piece, logq = source[order], step[order], piece[order], logq[order]
        heads = np.flatnonzero(np.append(True, source[1:] != source[:-1])) if len(source) else np.zeros(0, np.int64)
        q = np.exp(logq)
        run = np.cumsum(q)
        counts = np.diff(np.append(heads, len(source)))
        cum = run - np.repeat(run[heads] - q[heads], counts)
        cum[heads + counts - 1] = 2.0  # the last edge takes what rounding leaves
        return np.searchsorted(source, np.arange(n)), cum, logq, step, piece

    def nodes(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """Lattice arrays that hold the segments of the sorted distinct keys, and each one's first node."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        node = np.zeros(len(keys), np.int64)
        node[known] = self.node[at[known]]
        new = np.flatnonzero(~known)
        held = (self.first, self.cum, self.logq, self.step, self.piece)
        if not len(new):
            return held, node
        flat = text.ragged(data, starts[new], lengths[new])
        ends = np.cumsum(lengths[new])
        first, cum, logq, step, piece = self.build(flat, np.append(0, ends))
        base = len(self.first) - 1
        node[new] = base + ends - lengths[new]
        full = (np.concatenate([self.first[:-1], first + len(self.cum), [len(self.cum) + len(cum)]]), *(np.concatenate([a, b]) for a, b in zip(held[1:], (cum, logq, step, piece), strict=True)))
        if len(full[1]) <= KEPT_EDGES:
            self.first, self.cum, self.logq, self.step, self.piece = full
            self.keys, self.node = np.insert(self.keys, at[new], keys[new]), np.insert(self.node, at[new], node[new])
        return full, node


def _draw(keys: np.ndarray, path: int, segment: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers in (0, 1]."""
    h = text.mix(keys + segment.astype(np.uint64) * _SALTS[0])
    h = text.mix(h ^ (np.full(1, path + 1, np.uint64) * _SALTS[1] + np.full(1, step, np.uint64) * _SALTS[2]))
    return ((h >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def normalized(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each non-empty text with a space before it, U+2581 as a space."""
    if b"\xe2\x96\x81" in (raw := data.tobytes()):
        parts = [raw[a:b].replace(b"\xe2\x96\x81", b" ") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts]))
    filled = np.flatnonzero(np.diff(offsets))
    return np.insert(data, offsets[filled], 0x20), offsets + np.append(0, np.cumsum(np.diff(offsets) > 0))


def _segments(data: np.ndarray, offsets: np.ndarray) -> text.Spans:
    n = len(data)
    space, line = data == 0x20, data == 0x0A
    opens = space | line
    opens[1:] &= ~space[:-1] | line[1:]
    opens[1:] |= line[:-1]
    opens |= text._document_starts(n, offsets)[:n]
    starts = np.flatnonzero(opens)
    return text.Spans(data, offsets, starts, np.append(starts[1:], n))


class Sampler:
    def __init__(self, model: Model):
        self.model, self.lattices = model, Lattices(model)

    def _paths(self, arrays: tuple, start: np.ndarray, length: np.ndarray, keys: np.ndarray, segment: np.ndarray, path: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One path through each segment: flat edges, their number, and the path's log probability."""
        first, cum, logq, step, _ = arrays
        who, at, end = np.arange(len(start)), start.copy(), start + length
        counts, logp = np.zeros(len(start), np.int64), np.zeros(len(start))
        taken = []
        t = 0
        while len(who):
            u = _draw(keys[who], path, segment[who], t)
            e = first[at]
            late = np.flatnonzero(cum[e] < u)
            while len(late):
                e[late] += 1
                late = late[cum[e[late]] < u[late]]
            taken.append((who, e))
            counts[who] += 1
            logp[who] += logq[e]
            at = at + step[e]
            going = at < end[who]
            who, at = who[going], at[going]
            t += 1
        flat = np.empty(int(counts.sum()), np.int64)
        base = np.cumsum(counts) - counts
        for k, (who, e) in enumerate(taken):
            flat[base[who] + k] = e
        return flat, counts, logp

    def _left(self, arrays: tuple, start: int, barred: list[tuple[int, ...]]) -> tuple[list[dict[int, int]], list[float]]:
        """The barred segmentations as a trie (children by edge; the root is 0), and the probability of what isn't barred under each of its nodes.

        One pass over the nodes from the last made to the first: each lies behind its parent. Sums of positive terms
        only, so that nothing is lost to rounding however little is left.
        """
        first, _, logq, step, _ = arrays
        children: list[dict[int, int]] = [{}]
        at = [start]
        for path in barred:
            node = 0
            for e in path:
                child = children[node].get(e)
                if child is None:
                    child = children[node][e] = len(children)
                    children.append({})
                    at.append(at[node] + int(step[e]))
                node = child
        left = [0.0] * len(children)
        for node in range(len(children) - 1, -1, -1):
            under = children[node]
            if under:
                lo, hi = int(first[at[node]]), int(first[at[node] + 1])
                left[node] = sum(math.exp(w) * (left[under[e]] if e in under else 1.0) for e, w in zip(range(lo, hi), logq[lo:hi].tolist(), strict=True))
        return children, left

    def _other(self, arrays: tuple, start: int, length: int, draws: list[float], barred: list[tuple[int, ...]]) -> tuple[int, ...] | None:
        """A segmentation of one segment outside barred, drawn by what is left of the lattice; None if nothing is."""
        first, _, logq, step, _ = arrays
        children, left = self._left(arrays, start, barred)
        out: list[int] = []
        at, end, node = start, start + length, 0
        while at < end:
            lo, hi = int(first[at]), int(first[at + 1])
            under = children[node] if node is not None else {}
            parts = [(e, math.exp(w) * (left[under[e]] if e in under else 1.0)) for e, w in zip(range(lo, hi), logq[lo:hi].tolist(), strict=True)]
            parts = [p for p in parts if p[1] > 0]
            if not parts:
                return None
            x, n = draws[len(out)] * sum(w for _, w in parts), 0
            while n < len(parts) - 1 and x > parts[n][1]:
                x -= parts[n][1]
                n += 1
            e = parts[n][0]
            node = under.get(e)
            out.append(e)
            at += int(step[e])
        return tuple(out)

    def _leave(self, arrays: tuple, start: int, length: int, draws: list[float], old: tuple[int, ...]) -> tuple[int, ...] | None:
        """As _other with one barred segmentation, which is left at an edge drawn by the mass that leaves there."""
        first, _, logq, step, _ = arrays
        steps, logs = step[list(old)].tolist(), logq[list(old)].tolist()
        leave, ahead, nodes, at = [], 0.0, [], start
        for w, n in zip(logs, steps, strict=True):
            leave.append(math.exp(ahead) * -math.expm1(min(w, 0.0)))
            ahead += w
            nodes.append(at)
            at += n
        if not any(leave):
            return None
        x, j = draws[0] * sum(leave), 0
        while j < len(old) - 1 and x > leave[j]:
            x -= leave[j]
            j += 1
        while leave[j] <= 0:  # rounding has passed the last edge that can be left
            j -= 1
        out, at, skip, t = list(old[:j]), nodes[j], old[j], 1
        while at < start + length:
            lo, hi = int(first[at]), int(first[at + 1])
            edges = [e for e in range(lo, hi) if e != skip]
            weights = [math.exp(w) for e, w in zip(range(lo, hi), logq[lo:hi].tolist(), strict=True) if e != skip]
            x = draws[t] * sum(weights)
            n = 0
            while n < len(edges) - 1 and x > weights[n]:
                x -= weights[n]
                n += 1
            out.append(edges[n])
            at += int(step[edges[n]])
            skip, t = -1, t + 1
        return tuple(out)

    def sample(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Document, sample number, flat ids, their number, log probability, perturbed score and log inclusion of all samples."""
        data, offsets = normalized(data, offsets)
        segments = _segments(data, offsets)
        length = segments.ends - segments.starts
        distinct, once, which = np.unique(segments.hashes(), return_index=True, return_inverse=True)
        arrays, node = self.lattices.nodes(distinct, data, segments.starts[once], length[once])
        start, bounds = node[which], segments.bounds
        document = segments.document()
        local, key = np.arange(len(start)) - bounds[document], keys[document]
        docs = np.flatnonzero(segments.counts)
        heads = bounds[docs]

        def before(logp: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0.0], np.cumsum(logp)])[:-1]
            return total - total[bounds[document]] if len(logp) else total

        flat, counts, logp = self._paths(arrays, start, length, key, local, 0)
        top = -np.log(-np.log(np.minimum(_draw(keys, 0, np.zeros(len(keys), np.int64), 1 << 30), 1 - 1e-16)))
        ahead = before(logp)
        rounds = [(flat, counts, logp, ahead, top.copy(), self._rest(ahead, logp, top[document], key, local, 0), np.ones(len(keys), bool))]
        barred: dict[tuple[int, int], list[tuple[int, ...]]] = {}
        while len(rounds) < k and len(docs):
            path = len(rounds)
            best = np.stack([np.maximum.reduceat(r[5], heads) for r in rounds])
            source = best.argmax(0)
            score = np.full(len(keys), -np.inf)
            score[docs] = best.max(0)
            of = np.zeros(len(keys), np.int64)
            of[docs] = source
            going = score > -np.inf
            if not going.any():
                break
            opens = np.choose(of[document], [r[5] for r in rounds])
            hit = np.flatnonzero((opens == score[document]) & going[document])
            at = hit[np.unique(document[hit], return_index=True)[1]]
            edges = [np.concatenate([[0], np.cumsum(r[1])]) for r in rounds]
            own: dict[int, tuple[int, ...]] = {}
            for g in at.tolist():
                d = int(document[g])
                lo, hi = int(bounds[d]), int(bounds[d + 1])
                while True:
                    m = int(of[d])
                    old = tuple(rounds[m][0][edges[m][g] : edges[m][g + 1]].tolist())
                    taken = barred.setdefault((m, g), [old])
                    n = int(length[g]) + 2
                    draws = _draw(np.repeat(keys[d : d + 1], n) + np.arange(n, dtype=np.uint64), path, np.full(n, local[g]), 1 << 20).tolist()
                    if len(taken) == 1:
                        found = self._leave(arrays, int(start[g]), int(length[g]), draws, old)
                    else:
                        found = self._other(arrays, int(start[g]), int(length[g]), draws, taken)
                    if found is not None:
                        break
                    # Rounding alone left mass here: the document's next largest subtree takes its place.
                    rounds[m][5][g] = -np.inf
                    tops = [r[5][lo:hi].max() for r in rounds]
                    of[d], score[d] = int(np.argmax(tops)), max(tops)
                    if score[d] == -np.inf:
                        going[d] = False
                        break
                    g = lo + int(rounds[of[d]][5][lo:hi].argmax())
                if found is None:
                    continue
                own[g] = found
                taken.append(found)
                if k > 2:
                    left = self._left(arrays, int(start[g]), taken)[1][0]
                else:
                    left = 1.0 - sum(math.exp(arrays[2][list(x)].sum()) for x in taken)
                place = np.array([rounds[m][3][g] + math.log(left) if left > 0 else -np.inf])
                rounds[m][5][g] = _below(place, score[d : d + 1], _draw(keys[d : d + 1], path, local[g : g + 1], 1 << 28))[0]
            branch = np.full(len(keys), np.iinfo(np.int64).max)
            branch[document[list(own)]] = list(own)
            here = np.arange(len(start))
            fresh = np.flatnonzero((here > branch[document]) & going[document])
            head = np.flatnonzero((here < branch[document]) & going[document])
            new_flat, new_counts, new_logp = self._paths(arrays, start[fresh], length[fresh], key[fresh], local[fresh], path)
            counts, logp = np.zeros(len(start), np.int64), np.zeros(len(start))
            counts[fresh], logp[fresh] = new_counts, new_logp
            for g, x in own.items():
                counts[g], logp[g] = len(x), arrays[2][list(x)].sum()
            for m, r in enumerate(rounds):
                mine = head[of[document[head]] == m]
                counts[mine], logp[mine] = r[1][mine], r[2][mine]
            base = np.cumsum(counts) - counts
            flat = np.zeros(int(counts.sum()), np.int64)
            for m, r in enumerate(rounds):
                mine = head[of[document[head]] == m]
                flat[_places(base[mine], counts[mine])] = text.ragged(r[0], edges[m][mine], counts[mine])
            flat[_places(base[fresh], counts[fresh])] = new_flat
            for g, x in own.items():
                flat[base[g] : base[g] + len(x)] = x
            ahead = before(logp)
            rest = np.full(len(start), -np.inf)
            rest[fresh] = self._rest(ahead[fresh], logp[fresh], score[document[fresh]], key[fresh], local[fresh], path)
            rounds.append((flat, counts, logp, ahead, score, rest, going))
        threshold = np.full(len(keys), -np.inf)
        if len(docs):
            threshold[docs] = np.stack([np.maximum.reduceat(r[5], heads) for r in rounds]).max(0)
        rows = []
        for m, (flat, counts, logp, _, score, _, going) in enumerate(rounds):
            at = np.flatnonzero(going)
            ids, n = self._ids(arrays, flat, data, segments, document, counts)
            total = np.bincount(document, weights=logp, minlength=len(keys))
            rows.append((at, np.full(len(at), m + 1), ids, n[at], total[at], score[at], _log_inclusion(total[at], threshold[at])))
        return tuple(np.concatenate(x) for x in zip(*rows, strict=True))

    def _rest(self, ahead: np.ndarray, logp: np.ndarray, bound: np.ndarray, key: np.ndarray, local: np.ndarray, path: int) -> np.ndarray:
        """Gumbel maxima, below bound, of each segment's other segmentations."""
        rest = -np.expm1(np.minimum(logp, 0.0))
        with np.errstate(divide="ignore"):
            mass = ahead + np.where(rest > 0, np.log(rest), -np.inf)
        return _below(mass, bound, _draw(key, path, local, 1 << 29))

    def _ids(self, arrays: tuple, edges: np.ndarray, data: np.ndarray, segments: text.Spans, document: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number per document; characters outside the model become bytes."""
        ids = arrays[4][edges]
        size = np.where(ids < 0, -ids, 1).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        n = np.bincount(document, weights=np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]), minlength=len(segments.counts)).astype(np.int64)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, n
        step = arrays[3][edges].astype(np.int64)
        heads = np.cumsum(counts) - counts
        within = np.cumsum(step) - step
        owner = np.searchsorted(heads, odd, "right") - 1
        # Segments without edges in this path share a head with the next one; the last is the owner.
        at = segments.starts[owner] + within[odd] - within[heads[owner]]
        out = np.repeat(ids, size)
        places = _places(ends[odd], size[odd])
        out[places] = self.model.bytes_ids[data[_places(at, size[odd])]]
        return out, n


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _below(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at location, conditional on lying below bound."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(location == -np.inf, -np.inf, -np.logaddexp(np.log(-np.log(np.minimum(u, 1 - 1e-16))) - location, -bound))


def _log_inclusion(logp: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """log(1 - exp(-exp(logp - threshold))): the chance that a segmentation's perturbed score exceeds the threshold."""
    with np.errstate(divide="ignore"):
        x = np.minimum(logp - np.where(threshold == -np.inf, -1e9, threshold), 700.0)
        return np.where(threshold == -np.inf, 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.maximum(x, -30.0))))))


@functools.cache
def sampler(path: str, theta: float) -> Sampler:
    """One a worker process, with the lattices of frequent segments."""
    return Sampler(Model(path, theta))


def decode_ids(model: Model, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bytes of all texts and their ends; the space put before each is taken off."""
    raw = text.ragged(model.flat, model.at[ids], model.length[ids])
    size = text.per_document(model.length[ids], np.append(0, np.cumsum(counts)))
    heads = (np.cumsum(size) - size)[size > 0]
    return np.delete(raw, heads).tobytes(), np.cumsum(np.maximum(size - 1, 0))


SAMPLE = "doc_id long, sample int, n_pieces long, ids array<int>, log_prob double, perturbed double, log_inclusion double, decoded_crc32 long"


def sample_segmentations(docs: DataFrame, model: str, k: int = SAMPLES, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """Up to k rows for each row of docs (doc_id, text): SAMPLE. Where docs have a column row_key, it seeds instead of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(model, theta)
        for rows, data, offsets in text.pieces(batches):
            keys = text.mix(rows.column(2).to_numpy().view(np.uint64) + text.mix(np.full(1, seed, np.uint64)))
            d, m, flat, counts, logp, score, inclusion = s.sample(data, offsets, keys, k)
            raw, ends = decode_ids(s.model, flat, counts)
            view = memoryview(raw)
            crc = [zlib.crc32(view[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(d)), pa.array(m, pa.int32()), pa.array(counts), text.list_column(flat, counts, pa.int32()), pa.array(logp, pa.float64()), pa.array(score, pa.float64()), pa.array(inclusion, pa.float64()), pa.array(crc, pa.int64())],
                ["doc_id", "sample", "n_pieces", "ids", "log_prob", "perturbed", "log_inclusion", "decoded_crc32"],
            )

    key = F.col("row_key") if "row_key" in docs.columns else F.col("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(key).alias("row_key"))
    return rows.mapInArrow(run, SAMPLE)


def decode(samples: DataFrame, model: str) -> DataFrame:
    """samples with ids replaced by text."""
    others = [c for c in samples.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sampler(model, THETA).model
        for batch in batches:
            lists = batch.column(len(others))
            raw, ends = decode_ids(m, lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))
            texts = [raw[a:b].decode(errors="replace") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(others))), pa.array(texts, pa.string())], [*others, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields if f.name != "ids") + ", text string"
    return samples.select(*others, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, schema)
