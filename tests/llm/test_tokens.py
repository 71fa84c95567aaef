"""The token store against the tokenizer itself, text by text."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quirework.llm import text, token_store
from quirework.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = [" ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\xa0", " ", "　", "\x85", "\x1c", "a", "b", "The", "é", "ö", "×", "÷", "日", ".", ",", "?", "!", ":", "|", "'s", "'ll", "1", "2", "—", "<|endoftext|>", "<|", "|>", "😀", "ß", "​", "Ω", "́"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def equal(encoder, tokenizer, docs):
    ids, counts = encoder(*text.text_bytes(pa.array(docs, pa.string())))
    expected = [tokenizer.encode(d or "", add_special_tokens=False).ids for d in docs]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_any_text(tokenizer):
    rng = random.Random(1)
    encoder = token_store.RunEncoder(PATH)
    assert encoder.by_runs
    for _ in range(400):
        equal(encoder, tokenizer, ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 3, 10, 40]))) for _ in range(rng.choice([1, 1, 5, 30]))])


def test_known_texts(tokenizer):
    encoder = token_store.RunEncoder(PATH)
    for docs in (["\xa0\n—5 é\xa0\xa0"], ["x <|endoftext|> y"], ["x <|endofte", "xt|> y"], [None, "", " "], ["it's. it's, it's"]):
        equal(encoder, tokenizer, docs)
        equal(encoder, tokenizer, docs)


def test_forgetting(tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_RUNS", 3)
    encoder = token_store.RunEncoder(PATH)
    for k in range(5):
        equal(encoder, tokenizer, [f"some words {k} and others. " * 3, "more"])


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    encoder = token_store.RunEncoder(path)
    assert not encoder.by_runs
    equal(encoder, Tokenizer.from_file(path), ["Some Words. And others", "", "x  y\n\nz"])


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_store(spark, tokenizer, tmp_path, encoding):
    rows = [(k, f"text {k} " * (k % 7)) for k in range(300)] + [(None, "no id"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path}/{encoding}"
    token_store.write_tokens(docs, path, PATH, encoding=encoding)
    by_id = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in rows[:-1]}
    some = token_store.read_tokens(spark, path, 20, 40).collect()
    assert {r.doc_id: list(r.ids) for r in some} == {k: by_id[k] for k in range(20, 40)}
    places = token_store.read_places(spark, path)
    assert "ids" not in places.columns
    places = sorted(places.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in places][:2] == [None, 0] and len(places) == len(rows)
    assert [r.start for r in places] == np.concatenate([[0], np.cumsum([r.n_tokens for r in places])[:-1]]).tolist()
    with pytest.raises(ValueError):
        token_store.write_tokens(docs, path + "x", PATH, encoding="other")
