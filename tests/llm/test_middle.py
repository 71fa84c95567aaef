"""Fill-in-middle outputs against plain Python, and the exact round trip."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.llm import middle

TOKEN = re.compile(middle.TOKEN)


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    rng = random.Random(3)
    parts = ["a", "bc", "é", "日本", "😀", " ", "\n", "\t", "\x0b", "\x0c", "\r", " ", "　", "<", "<P", "S>", ">", "<M", "\x00", "\x1c"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    return [None, "", " ", "one", "<P>", "x<S>y", "z <M>", *made, "word " * 60_000, "x" * 200_000, " " * 100_000 + "end", "a" * 40_000 + " \n" * 40_000 + "b"]


def test_outputs_and_round_trip(spark):
    rows = [*enumerate(texts()), (None, "a null id"), (None, None), (3, "a repeated id and more words"), (3, "a repeated id and more words")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, source string").repartition(3)
    out = middle.fill_in_middle(df)
    assert out.columns == ["doc_id", "text", "source", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", middle.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((k, t or "", *plain(k, t)) for k, t in rows), key=key)
    assert all(r.back == r.text for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("size", [1, 2, 7])
def test_blocks_are_whole_tokens(size):
    from tokenizers import Regex, pre_tokenizers

    splitter = pre_tokenizers.Split(Regex(middle.TOKEN), "isolated")
    for text in texts()[1:200]:
        assert middle.token_ends(splitter, text, size).tolist() == [m.end() for m in TOKEN.finditer(text)]


def test_messy_and_nothing(messy, nothing):
    assert middle.middle_digest(messy).count() == messy.count()
    assert middle.middle_digest(nothing).count() == 0
    assert middle.fill_in_middle(messy).where("form = 'plain' and output <> text").count() == 0
