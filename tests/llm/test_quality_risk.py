"""The non-negative risk and its gradient against their definition, the prior, and equal texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import quality_model as q


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 5))
    pos = rng.random(400) < 0.3
    x[pos] += 0.7
    return x, pos, x.mean(0), x.std(0)


def plain_risk(x, pos, mean, scale, w, prior):
    z = np.concatenate([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)], 1)
    f = z @ w
    as_positive, as_negative = np.log1p(np.exp(-f)), np.log1p(np.exp(f))
    return prior * as_positive[pos].mean() + max(0.0, as_negative.mean() - prior * as_negative[pos].mean()) + q.RIDGE / 2 * (w[1:] ** 2).sum()


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_risk_and_gradient(sample, prior):
    x, pos, mean, scale = sample
    rng = np.random.default_rng(3)
    signs = set()
    # The last weights put the positives far up, where a high prior takes more than there is.
    for w in [*(rng.normal(size=6) * rng.choice([0.2, 3.0]) for _ in range(12)), np.array([0.0, *[4.0] * 5])]:
        value, negative, gradient, of_negative, _ = q.risk_of(q.risk_sums(w, mean, scale)(x, pos), w, prior)
        assert value == pytest.approx(plain_risk(x, pos, mean, scale, w, prior), rel=1e-9)
        signs.add(negative > 0)
        ridge = q.RIDGE * np.append(0.0, w[1:])
        # Above 0 the whole risk is differentiated; below, the clipped part has no slope.
        expected = gradient + ridge if negative > 0 else gradient - of_negative + ridge
        step = 1e-6
        numeric = [(plain_risk(x, pos, mean, scale, w + step * e, prior) - plain_risk(x, pos, mean, scale, w - step * e, prior)) / (2 * step) for e in np.eye(6)]
        assert np.allclose(numeric, expected, atol=1e-5)
    assert True in signs and (prior < 0.9 or False in signs)


@pytest.fixture(scope="module")
def table(spark, sample):
    x, pos, _, _ = sample
    return spark.createDataFrame([(bool(p), [float(v) for v in row]) for row, p in zip(x, pos, strict=True)], "is_pos boolean, x array<float>").repartition(3).cache()


def test_prior_by_its_definition(table, sample):
    """The least ratio, over score bins from the top that hold enough positives, of the corpus's share to the positives' with its slack."""
    x, pos, mean, scale = sample
    w = np.array([-0.5, 0.8, 0.6, 0.9, 0.7, 0.5])
    z = np.concatenate([np.ones((len(x), 1)), np.clip((x - mean) / scale, -8, 8)], 1)
    score = 1 / (1 + np.exp(-(z @ w)))
    ratios = []
    for least in range(q._BINS):
        above = np.minimum((score * q._BINS).astype(int), q._BINS - 1) >= least
        share = above[pos].mean()
        if share >= q.PRIOR_RANGE:
            ratios.append(above.mean() * (1 + np.sqrt(1 / (pos.sum() * share))) / share)
    assert q._prior(table, mean, scale, w) == pytest.approx(min(ratios), rel=1e-6)
    assert 0.3 < min(ratios) < 0.98


def test_fit_finds_no_larger_risk_than_any_other_weights(table, sample):
    x, pos, mean, scale = sample
    found = q._fit(table, mean, scale, 0.3)
    rng = np.random.default_rng(1)
    others = [found + rng.normal(size=6) * s for s in (1e-3, 1e-2, 0.1, 1.0, 3.0) for _ in range(60)]
    least = min(plain_risk(x, pos, mean, scale, w, 0.3) for w in [np.zeros(6), *others])
    assert plain_risk(x, pos, mean, scale, found, 0.3) <= least + 2e-3


def test_steps_hold_the_negative_part_up(table, sample):
    """With a prior far above the truth the unclipped risk has no floor; the steps that raise its negative part keep it above where plain Newton steps go."""
    x, pos, mean, scale = sample
    found = q._fit(table, mean, scale, 0.9)
    part = lambda w: q.risk_of(q.risk_sums(w, mean, scale)(x, pos), w, 0.9)[1]
    w = np.zeros(6)
    for _ in range(q.STEPS):
        _, _, gradient, _, h = q.risk_of(q.risk_sums(w, mean, scale)(x, pos), w, 0.9)
        w = w - np.linalg.solve(h + q.RIDGE * np.eye(6), gradient + q.RIDGE * w)
    assert part(w) < part(found) and part(w) < 0
    assert plain_risk(x, pos, mean, scale, found, 0.9) <= plain_risk(x, pos, mean, scale, np.zeros(6), 0.9)


def test_sums_of_parts_are_the_sums_of_all(sample):
    x, pos, mean, scale = sample
    step = q.risk_sums(np.ones(6), mean, scale)
    assert np.allclose(step(x, pos), step(x[:150], pos[:150]) + step(x[150:], pos[150:]))


def test_equal_texts_score_alike_and_labels_of_the_fold_do_not_count(spark):
    rows = [(k, ("good words in a calm sentence. " if k % 2 else "JUNK!!! ||| buy ") * (3 + k % 5)) for k in range(300)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, quality int")
    held = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0
    once = {r.doc_id: r.score for r in q.classify(docs, labels).collect()}
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in q.classify(docs.repartition(3), flipped).collect()}
    # Sums over other partitions differ in their last bits.
    assert again == pytest.approx(once, abs=1e-6)
    by_text = {}
    for k, t in rows:
        by_text.setdefault(t or "", set()).add(once[k])
    assert all(len(s) == 1 for s in by_text.values())
    assert min(once[k] for k in range(1, 300, 2)) > max(once[k] for k in range(0, 300, 2))
