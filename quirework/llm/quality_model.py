"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows; the unlabelled sample is the whole corpus. A linear score over a text's words and
its counts minimises the non-negative unbiased risk: prior * (loss of positives) + max(0, loss of the unlabelled as negatives
- prior * loss of positives as negatives), with the logistic loss. The class prior is estimated from a first
classifier of positives against the corpus: the least ratio of corpus to positives in its top scores.

Words enter through hashed 1- and 2-grams: their log ratios between one half of the positives (by a hash of the id) and
the corpus, as a text's mean and as the shares of its n-grams that speak strongly for or against it. The other half fits
the score, so that no row is judged by ratios that it shaped. The remaining features are rates of counts.

Features are computed once, from whole texts; every fitting step is a pass over the feature table that returns sums.
No label, language, source or id is a feature.

Edge cases: null and empty texts have all counts 0 and a score like others. Rows without positives to learn from
(none at all) score 0.5. A null doc_id is never labelled and counts as held out only if crc32 of the empty text does.
Repeated rows score alike. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm import rules, text
from quirework.llm.scratch import if_small, written

FOLDS = 5
THRESHOLD = 0.3
BROADCAST_ROWS = 1_000_000
STEPS = 25
RIDGE = 1e-3
#: Share of the positives that a top range of scores must hold to count for the prior.
PRIOR_RANGE = 0.2
_BINS = 400


def _of(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_CLASSES = {"upper": _of(bytes(range(65, 91))), "lower": _of(bytes(range(97, 123))), "digit": _of(b"0123456789"), "stop": _of(b".,;:?"), "bang": _of(b"!"), "bar": _of(b"|"), "symbol": _of(b"#*$%&<>@=~^+_\\/"), "line": _of(b"\n"), "high": _of(bytes(range(128, 256)))}
N_COUNTS, N_FEATURES = 16, 19
#: A log ratio beyond this is a strong one.
STRONG = 0.5


def features(data: np.ndarray, offsets: np.ndarray, spans: text.Spans, hashes: np.ndarray) -> np.ndarray:
    """Rates and logarithms of counts, a row a document."""
    base = rules.counts(spans, hashes)
    count = {k: text.per_document(t[data], offsets) for k, t in _CLASSES.items()}
    n = np.maximum(spans.counts, 1).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    letters = np.maximum(count["upper"] + count["lower"] + count["high"], 1)
    document = spans.document()
    _, first = np.unique(text.mix(hashes + document.astype(np.uint64)), return_index=True)
    distinct = np.bincount(document[first], minlength=len(spans.counts))
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (document[1:] == document[:-1])
    root = np.sqrt
    return np.stack([
        np.log1p(spans.counts), root(count["upper"] / letters), root(count["bang"] / n), root(count["bar"] / n), root(count["symbol"] / n),
        root(base["n_repeat_words"] / n), root(text.per_document(same, spans.bounds) / n), distinct / n, np.log1p(base["word_chars"] / n),
        root(base["n_dup_lines"] / (count["line"] + 1)), root(count["digit"] / size), root(count["stop"] / n), count["high"] / size,
        root(count["line"] / n), np.log1p(np.diff(offsets)) / 10, (spans.counts < 10).astype(float),
    ], 1)


def word_features(spans: text.Spans, hashes: np.ndarray, ratios: rules.Ratios) -> np.ndarray:
    """Mean log ratio of each document's n-grams, and the shares of strong ones for and against it."""
    grams, document = rules._grams(spans, hashes)
    value = np.clip(ratios.values[rules._buckets(grams, ratios.n_buckets)] / rules._FIXED, -3.0, 3.0)
    n = np.maximum(np.bincount(document, minlength=len(spans.counts)), 1)
    # Fixed-point sums: equal texts have equal features wherever they lie.
    mean = np.bincount(document, weights=np.round(value * 2**20), minlength=len(n)) / 2**20 / n
    strong = [np.bincount(document[on], minlength=len(n)) / n for on in (value > STRONG, value < -STRONG)]
    return np.stack([mean, *strong], 1)


def _fold(column: Column, n: int) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8")), F.lit(n))


def feature_table(docs: DataFrame, positives: DataFrame) -> DataFrame:
    """doc_id, held_out, is_pos, x of every row; positives (doc_id) mark rows outside the held-out fold that fit the score."""
    known = positives.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
    known = written(known.where(_fold(F.col("_id"), FOLDS) != 0).withColumn("_half", F.pmod(F.xxhash64("_id"), F.lit(2))), "positives")
    ratios = rules.fit(docs, known.where("_half = 0").select(F.col("_id").alias("doc_id")), rules.BROADCAST_BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text.pieces(batches):
            spans = text.words(data, offsets)
            hashes = spans.hashes()
            x = np.concatenate([features(data, offsets, spans, hashes), word_features(spans, hashes, ratios)], 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), text.list_column(x.ravel().astype(np.float32), np.full(len(x), x.shape[1]), pa.float32())], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<float>")
    rows = rows.withColumn("held_out", _fold(F.col("doc_id"), FOLDS) == 0)
    rows = rows.join(if_small(known.where("_half = 1"), BROADCAST_ROWS), F.col("doc_id") == F.col("_id"), "left")
    return written(rows.select("doc_id", "held_out", F.col("_id").isNotNull().alias("is_pos"), "x"), "features")


def _sums(table: DataFrame, step) -> np.ndarray:
    """Sum of step(x, is_pos) over all rows; what reaches the driver is one vector, whatever the number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                got = step(x, batch.column(0).to_numpy(zero_copy_only=False))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(np.round(total * 2.0**20).astype(np.int64))], ["k", "v"])

    got = table.select("is_pos", "x").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("v")).collect()
    out = np.zeros(max((r.k for r in got), default=-1) + 1)
    for r in got:
        out[r.k] = float(r.v) / 2.0**20
    return out


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([np.ones((len(x), 1)), z], 1)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def risk_sums(w: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """What risk_of needs of some rows, as one vector of sums."""

    def step(x, pos):
        z = _design(x, mean, scale)
        f = z @ w
        p = _sigmoid(f)
        loss = np.logaddexp(0, f)  # of a negative; that of a positive is loss - f
        return np.concatenate([[len(x), pos.sum(), loss.sum(), loss[pos].sum(), f[pos].sum()], z.T @ p, z[pos].T @ p[pos], z[pos].sum(0), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

    return step


def risk_of(s: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
    """Non-negative risk with its ridge, the part that is kept from falling below 0, the gradients of the unclipped risk
    and of that part, and the curvature."""
    d = len(w)
    n, m = s[0], max(s[1], 1)
    gu, gp, zp, h = s[5 : 5 + d] / n, s[5 + d : 5 + 2 * d] / m, s[5 + 2 * d : 5 + 3 * d] / m, s[5 + 3 * d :].reshape(d, d) / n
    positive, negative = prior * (s[3] - s[4]) / m, s[2] / n - prior * s[3] / m
    return positive + max(0.0, negative) + RIDGE / 2 * w[1:] @ w[1:], negative, gu - prior * zp, gu - prior * gp, h


def _fit(table: DataFrame, mean: np.ndarray, scale: np.ndarray, prior: float) -> np.ndarray:
    """Newton steps on the non-negative risk; where its negative part falls below 0, a step that raises it."""
    d = len(mean) + 1

    def risk(w):
        return risk_of(_sums(table, risk_sums(w, mean, scale)), w, prior)

    w, best, least = np.zeros(d), np.zeros(d), np.inf
    ridge = np.diag([1e-9, *[RIDGE] * (d - 1)])
    scale_step = 1.0
    for _ in range(STEPS):
        value, negative, gradient, negative_gradient, h = risk(w)
        if value < least - 1e-7:
            best, least, scale_step = w, value, min(1.0, 2 * scale_step)
        elif scale_step < 1e-3 or np.allclose(w, best, atol=1e-6) and least < np.inf:
            break
        else:
            w, scale_step = best + (w - best) / 4, scale_step / 4
            continue
        if negative < 0:
            w = w + 0.5 * negative_gradient
        else:
            w = w - scale_step * np.linalg.solve(h + ridge, gradient + ridge @ w)
    return best


def _prior(table: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> float:
    """The least ratio of corpus to positives among the highest scores: an upper bound of the prior that is tight where
    positives stand alone."""

    def step(x, pos):
        at = np.minimum((_sigmoid(_design(x, mean, scale) @ w) * _BINS).astype(int), _BINS - 1)
        return np.concatenate([np.bincount(at, minlength=_BINS), np.bincount(at[pos], minlength=_BINS)]).astype(float)

    s = _sums(table, step)
    corpus, positive = np.cumsum(s[:_BINS][::-1]) / s[:_BINS].sum(), np.cumsum(s[_BINS:][::-1]) / max(s[_BINS:].sum(), 1)
    n = max(s[_BINS:].sum(), 1)
    at = positive >= PRIOR_RANGE
    slack = np.sqrt(1 / (n * np.maximum(positive, 1 / n)))
    return float(np.clip((corpus[at] * (1 + slack[at]) / positive[at]).min(), 0.05, 0.98))


def fit_table(table: DataFrame) -> dict:
    """Means, scales, weights and prior from a feature table."""
    s = _sums(table, lambda x, pos: np.concatenate([[len(x), pos.sum()], x.sum(0), (x * x).sum(0)]))
    d = N_FEATURES
    if not len(s) or not s[1]:
        return {"mean": np.zeros(d), "scale": np.ones(d), "w": np.zeros(d + 1), "prior": 0.5}
    mean = s[2 : 2 + d] / s[0]
    scale = np.sqrt(np.maximum(s[2 + d :] / s[0] - mean**2, 0))
    scale = np.where(scale < 1e-4, 1.0, scale)
    prior = _prior(table, mean, scale, _fit(table, mean, scale, 0.5))
    return {"mean": mean, "scale": scale, "w": _fit(table, mean, scale, prior), "prior": prior}


def score_table(table: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            score = np.round(_sigmoid(_design(x, model["mean"], model["scale"]) @ model["w"]), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return table.select("doc_id", "held_out", "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on positive labels outside the held-out fold, score every row of docs."""
    table = feature_table(docs, labels.where("quality = 1"))
    return score_table(table, fit_table(table))
