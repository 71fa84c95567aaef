"""Queries of the corpus operators on the small tables, against their SQL, and the pipeline's stages."""

import duckdb
import pytest

from quirework.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(str([dict(zip(names, r, strict=True))[c] for c in columns]) for r in result.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == expected


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = corpus_pipeline.written(stage(spark, kept, FOLDER), name)
        assert kept.columns == docs.columns
        if name != "mix":
            assert 0 < kept.count() <= before
    out = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_pipeline_against_brute_force(spark):
    """Rules, near duplicates and shared passages of a small table, by plain Python on what the stage before kept."""
    import hashlib

    import corpus_pipeline

    from quirework.llm import rules
    from tests.llm.test_brute import brute_components, brute_dedup, corpus

    rows = corpus(120, seed=5)
    words = {k: rules_words(t) for k, t in rows}
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    groups = brute_components(rows, 5, 80, 100)
    expected = {k for k, t in rows if not words[k] or groups[k][1] == k}
    assert {r.doc_id for r in kept.collect()} == expected
    left = [(k, t) for k, t in rows if k in expected]
    out = {r.doc_id: r.text for r in corpus_pipeline.shared_passages(spark, kept, FOLDER).collect()}
    plain = brute_dedup(left)
    assert {k: hashlib.md5(" ".join(rules_words(t)).encode()).hexdigest() for k, t in out.items()} == {k: hashlib.md5(t.encode()).hexdigest() for k, (n, gone, t) in plain.items() if gone == 0 or gone < n}
    trusted = docs.where("doc_id % 2 = 0")
    judged = {r.doc_id for r in rules.judge(docs, rules.fit(docs, trusted)).where("kept").collect()}
    assert {r.doc_id for r in rules.keep_good(docs, rules.fit(docs, trusted)).collect()} == judged


def rules_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")
