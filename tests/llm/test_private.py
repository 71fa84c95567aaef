"""Personal data: base forms against plain regular expressions, and the rounds against plain Python."""

import hashlib
import math
import random
import re
import time

import pytest

from quirework.llm import private

# The forms as they are stated; plain, so too slow for long runs.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = 0
        for k, d in enumerate(reversed(digits)):
            d = int(d) * (1 + k % 2)
            total += d - 9 * (d > 9)
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    out = []
    for order, (kind, form) in enumerate(PLAIN.items()):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(form, text or "") if passes(kind, m.group())]
    return [s for _, _, s in sorted(out)]


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["1", "23", "4.5", ".", "..", "@", "a", "b.c", "%", "_", "+", "-", " ", "(", ")", "255", "256", "007", "+1", "x@y.z", "10.0.0.1", "4111 1111 1111 1111", "+44 20 7946 0958", "é", "😀", "\n", "0" * 5]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_base_forms():
    for text in odd_texts(20_000, 1):
        assert [f"{private.KINDS[k - 1]}:{a}:{b}" for a, k, b in private.base_spans(text)] == plain_spans(text), text


def test_long_runs_take_linear_time():
    n = 400_000
    start = time.time()
    for text in ("1" * n, "a" * n, "a" * n + "@", "a@" * (n // 2), "1." * (n // 2), "+1" * (n // 2), "+1" + "." * n, "a." * (n // 2) + "@b", "1 " * (n // 2), "x1" * (n // 2), "@" * n, "a@b." * (n // 4), "(1) " * (n // 4), "." * n + "1", "a:" * (n // 2) + "1"):
        private.slots_of(text)
    assert time.time() - start < 60


def contexts():
    """Phones and mails after telling words, some of them in forms that no base form has, and other numbers elsewhere."""
    rng = random.Random(9)
    rows = []
    for k in range(12):
        rows.append(f"please call me at +1 (555) 01{k:02d}-77{k:02d} after lunch")
        rows.append(f"write to mail: user{k}@host{k}.example.com about it")
    rows += [f"please call me at 020 7946 0{k}58 after work" for k in range(100, 103)]
    rows += ["my number is 020 7946 010058 ok", "also 020 7946 010158 ok", "or 1 555 0103 7703 again", "send to mail: someone@localhost now", "call me at home", "part number 55512345 is 20 cm", "version 4.0. of 2.0."]
    rows += [f"item {rng.randrange(10**6, 10**8)} costs {rng.randrange(100)} each" for _ in range(40)]
    return rows


def plain_bootstrap(rows, rounds=private.ROUNDS):
    """The same graph and scores by dictionaries."""
    slots = [(d, *s) for d, t in enumerate(rows) for s in private.slots_of(t or "")]
    seed = {(v, k): 1.0 for _, _, _, k, _, v, _ in slots if k}
    values = {s[5] for s in slots}
    kinds, edges = {}, {}
    for _, _, _, _, bits, v, ps in slots:
        for p in ps:
            edges.setdefault(p, set()).add(v)
            kinds[p, v] = kinds.get((p, v), 0) | bits
    scores = dict(seed)
    for _ in range(rounds):
        good = {}
        for p, vs in edges.items():
            best = max((sum(scores.get((v, k), 0.0) for v in vs) / (len(vs) + 1), -k, sum(scores.get((v, k), 0.0) >= private.ACCEPTED for v in vs)) for k in range(1, 5))
            if best[0] >= private.CONFIDENCE and best[2] >= private.SUPPORT:
                good[p] = (best[0], -best[1])
        new = {}
        for v in values:
            for k in range(1, 5):
                miss = math.prod(1 - c for p, (c, kind) in good.items() if kind == k and v in edges[p] and kinds[p, v] >> (k - 1) & 1)
                new[v, k] = max(seed.get((v, k), 0.0), 1 - miss)
        scores = new
    out = {d: set() for d in range(len(rows))}
    for d, a, b, kind, bits, v, _ in slots:
        if kind:
            out[d].add((a, kind, b))
        else:
            fits = [(scores[v, k], -k) for k in range(1, 5) if scores[v, k] >= private.ACCEPTED and bits >> (k - 1) & 1]
            if fits:
                out[d].add((a, -max(fits)[1], b))
    return {d: sorted(s) for d, s in out.items()}


def test_bootstrapping_against_plain_python(spark):
    rows = contexts()
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(rows)], "doc_id long, text string, spans int").repartition(3)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in private.find(df).collect()}
    assert got == plain_bootstrap(rows)
    found = {rows[d][a:b] for d, spans in got.items() for a, _, b in spans}
    assert {"020 7946 010058", "020 7946 010158", "020 7946 010258", "1 555 0103 7703", "someone@localhost"} <= found
    assert not any("item" in rows[d] or "part number" in rows[d] or "version" in rows[d] for d, spans in got.items() if spans)
    clean = {r.doc_id: r.text for r in private.redact(df).collect()}
    assert clean[rows.index("my number is 020 7946 010058 ok")] == "my number is <phone> ok"
    assert clean[rows.index("call me at home")] == "call me at home"


def test_random_texts_against_plain_python(spark):
    rows = odd_texts(400, 5) + contexts()
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in private.find(df).collect()} == plain_bootstrap(rows)
    digest = {r.doc_id: r for r in private.private_digest(df).collect()}
    for k, t in enumerate(rows):
        spans = plain_spans(t)
        assert digest[k].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [digest[k][f"n_{kind}"] for kind in private.KINDS] == [sum(s.startswith(kind) for s in spans) for kind in private.KINDS]
        assert set(spans) <= set(digest[k].spans.split(",")) if spans else True


@pytest.mark.parametrize("rounds", [1, 4])
def test_messy_and_nothing(messy, nothing, rounds):
    assert private.find(messy, rounds).count() == messy.count()
    assert private.find(nothing, rounds).count() == 0
    out = private.redact(messy, rounds)
    assert out.columns == messy.columns and sorted(map(str, out.collect())) == sorted(map(str, messy.collect()))
