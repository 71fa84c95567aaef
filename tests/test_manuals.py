"""Manuals: labels, steps, tables, long units; and lines held exactly once by the drafts of every kind of text."""

import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import claims, delegation, lines, manuals, sections
from quirework.operators import drafts as D
from quirework.operators.manuals import fragments_of
from quirework.plans.preprocess import preprocess, preprocess_results, raw_documents


def docs_of(spark, *texts):
    return raw_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def run(spark, *texts):
    docs = docs_of(spark, *texts)
    chunks, issues, _ = preprocess(docs, "manual")
    out = {k: ([], []) for k in range(len(texts))}
    for r in chunks.orderBy("doc_id", "draft_no", "piece").collect():
        out[r.doc_id][0].append(r.chunk.split("\n", 1)[1])
    for r in issues.collect():
        out[r.doc_id][1].append((r.code, r.severity, r.n))
    return out


TABLE = "| 항목 | 기준 |\n| --- | --- |\n| 압력 | 정상 |"


def test_labels(spark):
    out = run(
        spark,
        f"1. 점검\n[주의] 지시가 없다.\n2. 기동\n[경고] 표를 본다.\n{TABLE}\n[주의] 끝이다.",
        "1. 점검\n[주의] 보호구\n장비 상태를 확인합니다.",
        "1. 점검\n장비 상태를 확인합니다.\n[주의] 이상이면 중단합니다.",
        "안전 수칙\n[주의] 보호구\n[경고] 고온",
        "점검\n\n[주의] 뒤\n1) 연다.",
        "1. 점검\n[주의] 앞\n\n[경고] 또\n1) 밸브를 연다.\n[주의] 뒤\n그 밖의 말",
    )
    assert out[0] == (["[섹션] 1. 점검\n[주의] 지시가 없다.", f"[섹션] 2. 기동\n[경고] 표를 본다.\n[주의] 끝이다.\n{TABLE}"], [(manuals.UNPAIRED, "warning", 1)])
    assert out[1] == (["[섹션] 1. 점검\n[주의] 보호구\n장비 상태를 확인합니다."], [])
    assert out[2] == (["[섹션] 1. 점검\n장비 상태를 확인합니다.\n[주의] 이상이면 중단합니다."], [])
    assert out[3] == (["[섹션] 안전 수칙\n[주의] 보호구\n[경고] 고온"], [])
    assert out[4] == (["[섹션] 점검\n\n[주의] 뒤\n1) 연다."], [])
    # A blank line among waiting labels comes before them; as the first line of a draft it is left out.
    assert out[5] == (["[섹션] 1. 점검\n[주의] 앞\n[경고] 또\n1) 밸브를 연다.\n[주의] 뒤\n그 밖의 말"], [])


def test_sections_reset_each_other(spark):
    for boundary in ("# Markdown boundary", "안전 수칙"):
        chunks, issues = run(spark, f"1. Parent\n1.1 Child\n{boundary}\n1.1.1 Must remain body")[0]
        assert issues == [(manuals.DEEP, "warning", 1)] and chunks[-1] == f"[섹션] {boundary}\n1.1.1 Must remain body"
    chunks, issues = run(spark, "1. Parent\n본문\n1.1 Child\n속\n1.1.1 Deep\n더\n2. Next\n끝\n3. Last")[0]
    assert chunks == ["[섹션] 1. Parent\n본문", "[섹션] 1. Parent > 1.1 Child\n속", "[섹션] 1. Parent > 1.1 Child > 1.1.1 Deep\n더", "[섹션] 2. Next\n끝", "[섹션] 3. Last\n"] and not issues


def test_long_units(spark):
    step = "1) " + "가나다 " * 1500 + "연다."
    out = run(spark, f"1. 점검\n[주의] 앞\n{step}\n[경고] 뒤", f"1. 점검\n{'가' * 5000}", f"1. 점검\n{'문장이다. ' * 900}", f"1. 점검\n[주의] {'나' * 3790}\n1) 연다.")
    chunks, issues = out[0]
    assert not issues and len(chunks) == 2 and chunks[0].startswith("[섹션] 1. 점검\n[주의] 앞\n1) ") and chunks[-1].endswith("연다.\n[경고] 뒤")
    assert out[1][1] == [(manuals.TOO_LONG, "error", 1)] and out[2][1] == [] and len(out[2][0]) == 2
    assert out[3][1] == [(manuals.NO_ROOM, "error", 1)] and not out[3][0]


def test_fragments():
    assert fragments_of("ab cd", 0, 0, 3, False) == (["ab ", "cd"], None)
    assert fragments_of("abcd", 0, 0, 3, False) == (["abcd"], manuals.TOO_LONG)
    assert fragments_of("abcd", 0, 0, 3, True) == (["abc", "d"], None)
    assert fragments_of("!\nabcd", 2, 0, 5, True) == (["!\nabc", "d"], None)
    assert fragments_of("!\nabcd\n?", 2, 2, 7, True) == (["!\nabc", "d\n?"], None)
    assert fragments_of("!!!\na", 4, 0, 4, True) == (None, manuals.NO_ROOM)


PARTS = ["1. 점검", "1.1 하위", "2.1.1 떠돌이", "# 제목", "안전 수칙", "[주의] 조심", "※ 확인", "1) 연다.", "2) 닫는다.", "3) 본다.", "그냥 말이다", "", "| a | b |\n| --- | --- |\n| c | d |\n|  |  |\n| e |", "| x |\n| --- |", "제1장 총칙", "제1조(목적) 이 규칙은 이렇다", "제2조(정의)", "부칙", "별표 1", "Ⅰ. 개요", "INTRODUCTION TO PUMPS", "## Head", "말 " * 2500, "① 항이다 " * 900, "| long | row |\n| --- | --- |\n| k | " + "v " * 3000 + "|"]


@pytest.mark.parametrize("kind", ["general", "law", "manual"])
def test_every_line_is_held_once(spark, kind):
    """Random texts of all parts: each filled body line is in one draft, and losing or doubling one would be told."""
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    docs = lines.prepare(docs_of(spark, *texts))
    chunker = {"general": sections.general_drafts, "law": sections.law_drafts, "manual": manuals.manual_drafts}[kind]
    found, issues = chunker(docs.select("doc_id", "name", "text"))
    assert issues.where("code = 'source-block-consumption-mismatch'").isEmpty()
    held = claims.claims(found)
    assert held.groupBy("doc_id", "source_id").count().where("count > 1").isEmpty()
    # The text of each held line is in its draft, tables by their cells, what is split by a part of it.
    text = docs.select(F.col("doc_id").alias("_d"), F.posexplode(F.split("text", "\n", -1)).alias("_k", "line"))
    rows = held.join(found, ["doc_id", "draft_no"]).join(text, (F.col("doc_id") == F.col("_d")) & (F.col("source_id") == F.col("_k")))
    start = F.regexp_extract(F.regexp_replace("line", r"^[ |]+|^제\d조\([^)]*\) ?", ""), r"^[^ |]{1,3}", 0)
    bad = rows.where(~F.contains("body", start) & ~F.contains(F.array_join("context", "\n"), start))
    assert [(r.line[:20], r.body[:60], r.context) for r in bad.collect()] == []


def test_lost_and_doubled_lines_are_told(spark):
    rows = spark.createDataFrame([(1, 0, [0, 1]), (1, 1, [1, 3]), (2, 0, [0])], "doc_id long, draft_no int, sources array<int>")
    expected = spark.createDataFrame([(1, [0, 1, 2, 3]), (2, [0]), (3, [0, 1])], "doc_id long, sources array<int>")
    assert sorted((r.doc_id, r.n) for r in claims.lost_lines(expected, rows).collect()) == [(1, 2), (3, 2)]
    assert {r.status for r in D.results(spark.range(1).select(F.lit(1).alias("doc_id")), spark.createDataFrame([(1, 0, 0, "x", 0)], "doc_id long, draft_no int, piece int, chunk string, n_collisions long"), claims.lost_issues(expected, rows)).collect()} == {"blocked"}


def test_piece_sources_in_buckets(spark):
    rng = random.Random(2)
    spans, pieces = [], []
    for d in range(3):
        at = 0
        for k in range(60):
            n = rng.choice([0, 1, 5, 40, 300])
            spans.append((d, k, at, at + n))
            at += n
        cut = sorted(rng.randrange(at + 1) for _ in range(20))
        pieces += [(d, k, a, b) for k, (a, b) in enumerate(zip([0, *cut], [*cut, at], strict=True))]
    s = spark.createDataFrame(spans, "doc_id long, source_id int, start int, end int")
    p = spark.createDataFrame(pieces, "doc_id long, piece_no int, start int, end int")
    expected = {(d, k, i) for d, k, a, b in pieces for e, i, x, y in spans if d == e and x < b and y > a and x < y and a < b}
    for bucket in (1, 7, 4096):
        assert {tuple(r) for r in claims.piece_sources(p, s, bucket=bucket).collect()} == expected


def test_delegation_holds_each_line(spark):
    text = "앞 글\n\n더 앞\n[위임전결규정 매뉴얼]\n범례\nA. 총무\n" + "설명 " * 1500 + "\n둘째 줄\n| 업무 | 결재 |\n| --- | --- |\n" + "\n".join(f"| 업무 {k} | {'장' * 60} |" for k in range(80)) + "\nB. 인사\n\nC. 회계\n끝"
    found, issues, ids = delegation.delegation_drafts(docs_of(spark, text))
    assert ids.count() == 1 and issues.isEmpty()
    held = {(r.source_id) for r in claims.claims(found).collect()}
    rows = text.split("\n")
    assert held == {k for k, t in enumerate(rows) if t.strip() and t not in ("[위임전결규정 매뉴얼]", "A. 총무", "B. 인사", "C. 회계", "| --- | --- |")}


def test_results_are_ready_where_nothing_is_lost(spark):
    docs = docs_of(spark, "제1편 총칙\n제1조(목적) 이 규칙은 이렇다\n제2장 끝", "# A\n말\n# B")
    assert {r.doc_id: r.status for r in preprocess_results(docs, "law").collect()} == {0: "ready", 1: "ready"}
