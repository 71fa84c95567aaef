"""Every operator on messy and on empty tables: it doesn't fail, and keeps the rows it should."""

import pytest
from pyspark.sql import functions as F

from quirework.llm import chat, fmindex, jaccard, media, mix, pieces, quality_model, rules, shards, token_store
from quirework.llm.queries import tokenizer_path

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def quality(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    return quality_model.classify(docs, labels)


def ruled(docs):
    return rules.judge(docs, rules.fit(docs, docs.where("doc_id > 4")))


ALL_ROWS = {
    "media": media.media_digest,
    "quality": quality,
    "jaccard": jaccard.components,
    "rules": ruled,
    "shards": shards.shard_digest,
    "dedup": fmindex.dedup_digest,
    "mix": mix.mix_digest,
    "tokens": lambda docs: token_store.token_digest(docs, BPE),
}


@pytest.mark.parametrize("name", ALL_ROWS)
def test_messy(name, messy):
    rows = ALL_ROWS[name](messy).collect()
    assert len(rows) == messy.count()
    by_id = [r for r in rows if r.doc_id == 1]
    assert len(by_id) == 1
    r = by_id[0].asDict()
    expected = {"media": ("n_bytes", 0), "jaccard": ("component_id", 1), "rules": ("base_failed", True), "shards": ("size", 8), "dedup": ("n_removed", 0), "mix": ("taken", 0), "tokens": ("n_tokens", 1)}
    if name in expected:
        assert r[expected[name][0]] == expected[name][1]


@pytest.mark.parametrize("name", ALL_ROWS)
def test_nothing(name, nothing):
    assert ALL_ROWS[name](nothing).count() == 0


def test_samples_messy(messy, nothing):
    rows = pieces.sample_segmentations(messy, PIECES).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in messy.collect()}
    assert [(r.sample, r.n_pieces, r.log_prob) for r in rows if r.doc_id == 1] == [(1, 0, 0.0)]
    assert pieces.sample_segmentations(nothing, PIECES).count() == 0


def test_stages_keep_columns(messy, nothing):
    for docs in (messy, nothing):
        ratios = rules.fit(docs, docs.where("doc_id > 4"))
        for out in (rules.keep_good(docs, ratios), jaccard.keep_one(docs), fmindex.dedup(docs), mix.mixed(docs)):
            assert out.columns == docs.columns
            out.collect()


def test_chat_messy(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (1, 0, "user", None), (None, 3, "assistant", "a < b \\ c <|end|>\n"), (2, 1, "assistant", ""), (2, 0, "user", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = {r.conv_id: r for r in chat.chat_digest(spark, df).collect()}
    assert {k: v.n_turns for k, v in out.items()} == {1: 3, None: 1, 2: 2, -7: 2}
    assert out[None].loss_chars == len("a < b \\ c <|end|>\n") and out[2].loss_chars == 0
    assert len(chat.chat_digest(spark, df.limit(0)).collect()) == 1
