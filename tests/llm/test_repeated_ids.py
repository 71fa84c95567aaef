"""Rows that share a doc_id, or have none, are rows of their own."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import jaccard, mix
from quirework.llm.components import connected

def words(name):
    return " ".join(f"{name}{k}" for k in range(60))


def test_one_of_each_group_stays(spark):
    a, b, c, d, e = map(words, "abcde")
    rows = [(1, a), (5, a), (5, b), (None, a)]  # the copy under 5 and the one without an id go, the other text of 5 stays
    rows += [(None, c), (None, c + " tail"), (None, d), (7, None), (7, "")]  # no id at all: one of the group stays
    rows += [(3, e), (3, e), (3, e + " tail")]  # one id for all of a group
    rows += [(2, "one two"), (2, "one two"), (11, "one two")]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, _d int").repartition(3)
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    assert got.pop((None, c), 0) + got.pop((None, c + " tail"), 0) == 1
    assert got.pop((3, e), 0) + got.pop((3, e + " tail"), 0) == 1
    assert got == {(1, a): 1, (5, b): 1, (None, d): 1, (7, None): 1, (7, ""): 1, (2, "one two"): 1}


def test_mixed_takes_what_the_plan_takes(spark):
    rng = np.random.default_rng(2)
    rows = [(9, f"w{k} " * int(rng.integers(1, 40)), "s") for k in range(6)] + [(k, "x " * int(rng.integers(1, 30)), f"s{k % 3}") for k in range(40)]
    rows += [(9, "same text here", "s")] * 7 + [(None, None, None), (None, "null id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_n", F.lit(1)).repartition(3)
    plan = mix.mix(mix.sizes(docs)).collect()
    taken = collections.Counter()
    for r in plan:
        taken[r.source] += r["size"] * r.n_copies
    out = mix.mixed(docs)
    assert out.columns == docs.columns
    got, copies = collections.Counter(), collections.Counter()
    for r in out.collect():
        got[r.source] += len((r.text or "").split())
        copies[r.doc_id, r.text] += 1
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}
    most = collections.Counter((d, t) for d, t, _ in rows)
    assert all(n <= 3 * most[k] for k, n in copies.items())


def dual(cells, targets, groups, cap):
    """The balanced rates by plain coordinate-wise bisection of each multiplier."""
    total = sum(n for _, _, n in cells)
    lam, mu = {s: 0.0 for s in targets}, {g: 0.0 for g in groups}

    def rate(s, g):
        return min(cap, math.exp(lam[s] + mu[g]))

    def root(f):
        a, b = -30.0, 30.0
        for _ in range(80):
            m = (a + b) / 2
            a, b = (m, b) if f(m) < 0 else (a, m)
        return (a + b) / 2

    for _ in range(400):
        for s in lam:
            def off(x, s=s):
                lam[s] = x
                return sum(n * rate(s, g) for t, g, n in cells if t == s) - targets[s]
            lam[s] = root(off)
        for g in mu:
            def off(x, g=g):
                mu[g] = x
                return sum(n * rate(s, h) for s, h, n in cells if h == g) + mix.RIDGE * total * x - groups[g]
            mu[g] = root(off)
    for s in lam:
        def off(x, s=s):
            lam[s] = x
            return sum(n * rate(s, g) for t, g, n in cells if t == s) - targets[s]
        lam[s] = root(off)
    return {(s, g): rate(s, g) for s, g, _ in cells}, mu


def test_coupled_dual(spark):
    cells = [("a", 3, 500), ("a", 9, 300), ("a", 40, 200), ("b", 3, 280), ("b", 40, 500), ("b", 9, 90), ("c", 9, 300), ("c", 40, 150), ("c", 3, 60), ("d", 3, 10)]
    rows = [(s, g, 1.0, float(n)) for s, g, n in cells]
    df = spark.createDataFrame(rows, "source string, group int, base double, size double")
    sized = df.select("source", F.col("size").cast("long").alias("size"))
    targets = mix.source_targets(sized)
    goal = {r.source: r.target for r in targets.collect()}
    groups = collections.Counter()
    for _, g, n in cells:
        groups[g] += n
    expected, mus = dual(cells, goal, dict(groups), mix.CAP)
    mu = mix.balance(df, mix.written(targets, "t"))
    assert mu == pytest.approx(mus, abs=2e-3)
    tilted = df.withColumn("base", F.exp(mix._of_group(mu, F.col("group"))))
    lam = {r.source: r.lam for r in mix.solve(tilted, targets).collect()}
    for (s, g), rate in expected.items():
        assert min(mix.CAP, math.exp(lam[s] + mu[g])) == pytest.approx(rate, rel=5e-3)
    # Languages keep their tokens better than they would without their multipliers.
    plain = {r.source: r.lam for r in mix.solve(df, targets).collect()}

    def miss(of):
        return sum(abs(sum(n * of(s, h) for s, h, n in cells if h == g) - groups[g]) for g in groups)

    assert miss(lambda s, g: expected[s, g]) < miss(lambda s, g: min(mix.CAP, math.exp(plain[s])))


def test_components_of_long_paths(spark):
    path = [(k, k + 1) for k in range(100, 400)] + [(900, 899), (898, 900), (5, 5)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(path, "a long, b long").repartition(4)).collect()}
    assert got == {k: 100 for k in range(100, 401)} | {k: 898 for k in (898, 899, 900)}


def test_unfinished_components_are_an_error(spark, monkeypatch):
    from quirework.llm import components

    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        connected(spark.createDataFrame([(k, k + 1) for k in range(50)], "a long, b long"))
