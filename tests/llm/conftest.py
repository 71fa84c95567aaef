import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, ids string, ranges int, _d int"


def messy_rows():
    """Null and repeated ids, null, empty, blank and very long texts, copies, odd characters, clashing extra columns."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "é", "日本", "x" * 40]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = " ".join(rng.choice(words) for _ in range(60))
    texts = [None, "", " \n\t ", "one", "two words", base, base, base + " tail", "head " + base, long, "a b  c　", "tab\tand\x0bfeed\x0c\r\nend", "<|endoftext|> <|turn|> \\l \\e", "emoji 😀 and ▁ mark", base.upper()]
    rows = [(k, t, "en", None if k % 5 == 0 else f"s{k % 3}", None, k, "x", 1, 2) for k, t in enumerate(texts)]
    return rows + [(None, base, "en", "s1", 3, None, None, None, None), (None, None, None, None, None, None, None, None, None), (5, base, "en", "s2", 1, 5, "x", 1, 2), (5, "another text of the same id", "en", "s2", 1, 5, "x", 1, 2)]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
