"""Structured documents, workbooks, contracts and delegation rules: against SQL, and small inputs with known answers."""

import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quirework.functions import headings as H
from quirework.functions import strings as S
from quirework.operators import blocks, cells, contracts, delegation, documents, drafts, lines, spans, workbook
from quirework.plans import structured_queries
from quirework.plans.preprocess import preprocess, preprocess_blocks, preprocess_results, raw_documents
from quirework.sources import files

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(structured_queries.ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = structured_queries.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    result = db.execute(structured_queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(str([dict(zip(names, r, strict=True))[c] for c in columns]) for r in result.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == expected


BLOCKS = "doc_id long, name string, block_id string, `order` int, kind string, depth int, ordered boolean, text string, rows array<array<string>>"


def contract(spark, bodies, preamble="서문", doc_id=1):
    """A document of articles; a body is a list of texts and tables."""
    out = [(doc_id, "c.docx", "p", 0, "paragraph", None, None, preamble, None)]
    for k, body in enumerate(bodies, 1):
        for part in (f"제{k}조(제목 {k})", *body):
            n = len(out)
            table = isinstance(part, list)
            out.append((doc_id, "c.docx", f"b{n}", n, "table" if table else "paragraph", None, None, None if table else part, part if table else None))
    return spark.createDataFrame(out, BLOCKS)


def chunks_of(df):
    return [(tuple(r.context), r.body) for r in df.orderBy("doc_id", "draft_no").collect()]


def test_contract_packs_whole_articles(spark):
    docs = contract(spark, [["가" * 1800], ["나" * 1800], ["다" * 1800], ["라" * 100]])
    out, issues, claims = contracts.contract_drafts(docs)
    packs = chunks_of(out)
    assert [c[1] for c, _ in packs] == ["[조문 범위] 제1조 ~ 제2조", "[조문 범위] 제3조 ~ 제4조"]
    assert packs[0][1].startswith("서문\n\n제1조(제목 1)\n가가") and "제2조(제목 2)\n나" in packs[0][1]
    assert issues.isEmpty() and claims.count() == claims.select("source_id").distinct().count() == docs.count()


def test_contract_long_article_repeats_its_context(spark):
    table = [["키", "값"], *[[f"k{k}", "v" * 100] for k in range(60)]]
    docs = contract(spark, [["짧다"], ["단어 " * 1500, table, "끝"], ["셋"]], preamble="머리말 " * 1000)
    out, _, claims = contracts.contract_drafts(docs)
    final = drafts.finalize(out).orderBy("draft_no", "piece").collect()
    texts = [r.chunk for r in final]
    assert all(len(t) <= S.CHUNK_LIMIT for t in texts)
    assert texts[0].startswith("[문서] c.docx\n[섹션] 전문\n머리말")
    long = [t for t in texts if "\n[조문] 제2조(제목 2)\n" in t]
    assert len(long) > 4 and sum("| 키 | 값 |" in t for t in long) >= 2 and long[-1].endswith("\n끝")
    assert texts[-1].startswith("[문서] c.docx\n[조문 범위] 제3조\n")
    assert claims.count() == docs.count()


def test_what_is_no_contract(spark):
    two = contract(spark, [["하나"], ["둘"]])
    raw = contract(spark, [["하나"], ["둘"], ["셋"]], doc_id=2).withColumn("kind", F.when(F.col("order") == 0, "raw-text").otherwise(F.col("kind")))
    bare = contract(spark, [[], [], ["셋"]], doc_id=3)
    out, _, claims = contracts.contract_drafts(two.unionByName(raw).unionByName(bare))
    assert out.isEmpty() and claims.isEmpty()


def test_structured_documents_end_to_end(spark):
    docs = contract(spark, [["하나"], ["둘"], ["셋"]]).unionByName(contract(spark, [["혼자"]], doc_id=2))
    chunks, results = preprocess_blocks(docs)
    by_id = {r.doc_id: r for r in results.collect()}
    assert by_id[1].status == by_id[2].status == "ready"
    text = {r.doc_id: r.chunk for r in chunks.collect() if r.piece == 0}
    assert "[조문 범위] 제1조 ~ 제3조" in text[1] and any("혼자" in r.chunk for r in chunks.where("doc_id = 2").collect())


def test_provenance_blocks(spark):
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id long, source_id string")
    consumed = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id long, source_id string")
    rows = drafts.provenance_issues(expected, consumed).collect()
    assert [(r.doc_id, r.code, r.severity, r.n) for r in rows] == [(1, "source-block-consumption-mismatch", "error", 2)]


def test_results_account_for_each_text(spark):
    rows = preprocess_results(raw_documents(spark.createDataFrame([(1, "글이다."), (2, " \n "), (3, None)], "doc_id long, text string"))).collect()
    by_id = {r.doc_id: [i.code for i in r.issues] for r in rows}
    assert by_id[1] == [] and by_id[2] == by_id[3] == ["empty-result"]


RULES = "앞 글\n[위임전결규정 매뉴얼]\n범례\nA. 총무\n설명\n| 업무 | 결재 |\n| --- | --- |\n| 가 | 팀장 |\nB. 인사\n\nC. 회계\n끝"


def test_delegation_rules(spark):
    docs = raw_documents(spark.createDataFrame([(1, RULES), (2, RULES.replace("B. 인사", "D. 인사")), (3, RULES.replace("| --- | --- |", "")), (4, "보통 글")], "doc_id long, text string"))
    out, _, ids = delegation.delegation_drafts(docs)
    assert [r.doc_id for r in ids.collect()] == [1]
    texts = [r.chunk for r in drafts.finalize(out).orderBy("draft_no").collect()]
    title = delegation.TITLE
    assert texts == ["앞 글", f"{title}\n범례", f"{title}\nA. 총무\n설명\n| 업무 | 결재 |\n| --- | --- |\n| 가 | 팀장 |", f"{title}\nB. 인사", f"{title}\nC. 회계\n끝"]


def test_delegation_packs_and_splits(spark):
    text = RULES.replace("설명", "설명 " * 1500).replace("| 가 | 팀장 |", "\n".join(f"| 업무 {k} | {'장' * 60} |" for k in range(80)))
    out, _, _ = delegation.delegation_drafts(raw_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    rows = drafts.finalize(out).collect()
    assert all(len(r.chunk) <= S.CHUNK_LIMIT for r in rows)
    own = [r.chunk for r in rows if r.chunk.startswith(delegation.TITLE + "\nA. 총무\n")]
    assert len(own) >= 4 and sum("업무 79" in t for t in own) == 1


def test_each_row_by_its_type(spark):
    rows = [(1, "제1조(목적) 본문", "law"), (2, RULES, "law"), (3, RULES, "excel"), (4, "# 절\n글", None)]
    docs = raw_documents(spark.createDataFrame(rows, "doc_id long, text string, type string"), kind="type")
    chunks, _, _ = preprocess(docs)
    first = {r.doc_id: r.chunk for r in chunks.orderBy(F.desc("draft_no")).collect()}
    assert "[위치] 제1조(목적)" in first[1] and first[2] == "앞 글" and first[3].startswith("[파일] 텍스트 문서.txt\n[시트] 텍스트 문서.txt\n") and "[섹션] 절" in first[4]


def test_wrapped_headings(spark):
    rows = [(1, k, t) for k, t in enumerate(["# **__~~제3조(목적)~~__**", "**__`**제2장 총칙**`__**", "****"])]
    out = H.with_legal_heading(spark.createDataFrame(rows, "doc_id int, pos int, line string"), "h").orderBy("pos").collect()
    assert [(r.h.kind, r.h.heading) for r in out[:2]] == [("article", "제3조(목적)"), ("chapter", "제2장 총칙")] and out[2].h.kind is None


@pytest.mark.parametrize(("line", "is_one"), [("SAFETY RULES", True), ("1.2 SAFETY RULES 2", True), ("Safety RULES", False), ("AB 12", False), ("ABC", False), ("STOP NOW!", False), ("ABC 가나", False), ("A B C D", True), ("A" * 81, False)])
def test_capitals(spark, line, is_one):
    assert spark.createDataFrame([(line,)], "line string").select(H.is_caps_heading(F.col("line"))).first()[0] == is_one


def test_deep_lists(spark):
    rows = [(1, "a", 0, 11, True), (1, "b", 1, 11, True), (1, "c", 2, 10, False), (1, "d", 3, 11, True), (1, "e", 4, None, None), (1, "f", 5, 11, True), (1, "g", 6, 11, False), (1, "h", 7, 11, True)]
    df = spark.createDataFrame([(d, b, o, "paragraph" if depth is None else "list-item", depth, on) for d, b, o, depth, on in rows], "doc_id int, block_id string, `order` int, kind string, depth int, ordered boolean")
    assert {r.block_id: r.ordinal for r in blocks.list_ordinals(df).collect()} == {"a": 1, "b": 2, "c": None, "d": 1, "e": None, "f": 1, "g": None, "h": 1}


def test_spans(spark):
    assert spans.place([[("a", 2, 1), ("b", 1, 2)], [("c", 1, 1), ("d", 1, 1)], [("e", 2, 2)], [("f", 1, 1)]]) == [(0, 0, 1, 0, "a"), (0, 1, 0, 2, "b"), (1, 1, 1, 1, "c"), (1, 2, 1, 2, "d"), (2, 0, 3, 1, "e"), (3, 2, 3, 2, "f")]
    assert spans.place([[("a", 5001, 1)]]) is None and spans.place([[("a", 1, 513)]]) is None and spans.place([[("a", 1000, 101)]]) is None
    # A wide cell doesn't fit before a cell that reaches down, so it goes behind it.
    assert spans.place([[("a", 1, 1), ("b", 2, 1)], [("c", 1, 2)]])[-1] == (1, 2, 1, 3, "c")


def xlsx(sheet, comments=False):
    out = io.BytesIO()
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S1" r:id="r1"/></sheets><definedNames><definedName name="_xlnm.Print_Titles" localSheetId="0">S1!$2:$3</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}">{sheet}</worksheet>')
        if comments:
            z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships><Relationship Id="c" Type="{rel}/comments" Target="../comments1.xml"/></Relationships>')
            z.writestr("xl/comments1.xml", f'<comments xmlns="{main}"><commentList><comment ref="B4"/><comment ref="A9"/></commentList></comments>')
    return out.getvalue()


def test_workbook_layout(spark):
    cell = lambda at, text: f'<c r="{at}" t="inlineStr"><is><t>{text}</t></is></c>'
    rows = f'<sheetData><row>{cell("A1", "제목")}</row><row>{cell("A2", "품목")}{cell("B2", "단가")}{cell("C2", "숨김")}</row><row>{cell("B3", "하한")}{cell("C3", "상한")}</row><row>{cell("A4", "펌프")}<c r="B4"><f>1+1</f></c><c r="C4"><v>3</v></c></row><row>{cell("A6", "항목: 밸브")}</row><row>{cell("A7", "볼")}<c r="B7"><f>=B4</f><v>2</v></c></row></sheetData>'
    raw = xlsx(rows + '<mergeCells><mergeCell ref="B2:C2"/><mergeCell ref="A2:A3"/></mergeCells>', comments=True)
    df = spark.createDataFrame([(1, "b.xlsx", bytearray(raw))], "doc_id long, name string, content binary")
    t = files.workbook_tables(files.workbook_parts_of(df))
    ranges = cells.used_ranges(t["cells"], t["merges"])
    shown = cells.annotate_formulas(cells.displayed_rows(t["cells"], ranges), ranges, t["cells"])
    assert {r.row_no: r.cells for r in shown.collect()} == {0: ["제목", "", ""], 1: ["품목", "단가", ""], 2: ["", "하한", "상한"], 3: ["펌프", "(수식: =1+1)", "3"], 4: ["", "", ""], 5: ["항목: 밸브", "", ""], 6: ["볼", "2 (수식: =B4)", ""]}
    heads = cells.header_rows(ranges, shown, t["names"], t["cells"])
    assert tuple(heads.first()) == (1, 1, 2, 3, "print-titles")
    bare = cells.header_rows(ranges, shown, t["names"].limit(0), t["cells"])
    assert tuple(bare.first()) == (1, 1, 2, 3, "detected")
    out = cells.layout_drafts(cells.layout_tables(ranges, shown, heads), t["sheets"])[0].orderBy("draft_no").collect()
    assert [(r.context, r.body.split("\n")[0], r.body.split("\n")[2:]) for r in out] == [
        (["[파일] b.xlsx", "[시트] S1", "[머리행] 제목", "[표] 1"], "| 품목 | 단가 > 하한 | 단가 > 상한 |", ["| 펌프 | (수식: =1+1) | 3 |"]),
        (["[파일] b.xlsx", "[시트] S1", "[머리행] 제목", "[항목] 밸브"], "| 품목 | 단가 > 하한 | 단가 > 상한 |", ["| 볼 | 2 (수식: =B4) |  |"]),
    ]
    issues = {r.code: (r.n, r.locations) for r in cells.workbook_issues(t["cells"], t["merges"], t["sheets"].select("doc_id", "sheet_no", "sheet")).collect()}
    assert issues == {"MERGED_CELLS": (2, ["S1!B2:C2", "S1!A2:A3"]), "FORMULA_RESULT_MISSING": (1, ["S1!B4"]), "EXCEL_CELL_COMMENTS_UNSUPPORTED": (2, ["S1!B4", "S1!A9"])}


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        for name, xml in parts.items():
            z.writestr(f"word/{name}.xml", f'<w:{name} xmlns:w="{W}">{xml}</w:{name}>')
    return out.getvalue()


def para(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def tc(text, more=""):
    return f"<w:tc><w:tcPr>{more}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"


def word(spark, *raws):
    return spark.createDataFrame([(k, "a.docx", bytearray(r)) for k, r in enumerate(raws)], "doc_id long, name string, content binary")


def test_word_table_spans(spark):
    down, on, two = '<w:vMerge w:val="restart"/>', "<w:vMerge/>", '<w:gridSpan w:val="2"/>'
    table = f"<w:tbl><w:tr>{tc('a', down)}{tc('b', two)}</w:tr><w:tr>{tc('x', on)}{tc('c')}{tc('d')}</w:tr><w:tr>{tc('y', on)}{tc('e', two)}</w:tr></w:tbl>"
    wide = "<w:tbl>" + "".join(f"<w:tr>{tc('z')}</w:tr>" for _ in range(5001)) + "</w:tbl>"
    blocks, issues = files.placed_blocks(files.document_blocks(word(spark, docx(table), docx(wide + para("text")))))
    rows = {(r.doc_id, r.kind): (r.rows, r.merges) for r in blocks.collect()}
    assert rows == {(0, "table"): ([["a", "b", ""], ["", "c", "d"], ["", "e", ""]], ["A1:A3", "B1:C1", "B3:C3"]), (1, "paragraph"): (None, None)}
    assert [(r.doc_id, r.code, r.severity, r.n) for r in issues.collect()] == [(1, "DOCX_TABLE_LIMIT", "error", 1)]


def test_word_styles_and_lists(spark):
    style = lambda key, based="", more="", name="x": f'<w:style w:styleId="{key}"><w:name w:val="{name}"/>' + (f'<w:basedOn w:val="{based}"/>' if based else "") + f"<w:pPr>{more}</w:pPr></w:style>"
    number = lambda n, level=0: f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr>'
    styles = style("Top", more='<w:outlineLvl w:val="0"/>') + style("Own", "Top") + style("Deep", "Own", '<w:outlineLvl w:val="2"/>') + style("A", "B") + style("B", "A") + style("Named", name="heading 2") + style("Li", more=number(1)) + style("LiKid", "Li")
    level = lambda k, kind: f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="{kind}"/></w:lvl>'
    numbering = f'<w:abstractNum w:abstractNumId="5">{level(0, "decimal")}{level(1, "bullet")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="5"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="5"/><w:lvlOverride w:ilvl="0">{level(0, "bullet")}</w:lvlOverride></w:num>'
    styled = lambda key: f'<w:pStyle w:val="{key}"/>'
    link = '<w:p><w:r><w:t xml:space="preserve">see </w:t></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:ins><w:r><w:t xml:space="preserve">  new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:r><w:br/><w:t>next</w:t><w:instrText>PAGE</w:instrText></w:r></w:p>'
    body = para("one", styled("Own")) + para("three", styled("Deep")) + para("two", styled("Named")) + para("circle", styled("A")) + para("n1", number(1)) + para("b1", number(1, 1)) + para("b2", number(2)) + para("n2", styled("LiKid")) + para("none", styled("LiKid") + number(0)) + para("no heading", styled("Own") + '<w:outlineLvl w:val="9"/>') + link + f"<w:sdt><w:sdtContent>{para('inside')}</w:sdtContent></w:sdt>" + para("  ")
    rows = files.document_blocks(word(spark, docx(body, styles=styles, numbering=numbering))).orderBy("order").collect()
    assert [(r.kind, r.text, r.level, r.depth, r.ordered) for r in rows] == [
        ("heading", "one", 1, None, None), ("heading", "three", 3, None, None), ("heading", "two", 2, None, None), ("paragraph", "circle", None, None, None), ("list-item", "n1", None, 0, True), ("list-item", "b1", None, 1, False),
        ("list-item", "b2", None, 0, False), ("list-item", "n2", None, 0, True), ("paragraph", "none", None, None, None), ("paragraph", "no heading", None, None, None), ("paragraph", "see link new\nnext", None, None, None), ("paragraph", "inside", None, None, None),
    ]


def test_word_documents_end_to_end(spark):
    from quirework.plans.preprocess import preprocess_word

    good = docx(para("Top", '<w:pStyle w:val="Heading1"/>') + para("text") + f"<w:tbl><w:tr>{tc('a')}{tc('b')}</w:tr><w:tr>{tc('c')}{tc('d')}</w:tr></w:tbl>")
    large = docx(para("text") + "<w:tbl>" + "".join(f"<w:tr>{tc('z')}</w:tr>" for _ in range(5001)) + "</w:tbl>")
    chunks, results = preprocess_word(word(spark, good, large))
    assert [r.chunk for r in chunks.where("doc_id = 0").orderBy("draft_no").collect()] == ["[문서] a.docx\n[섹션] Top\ntext", "[문서] a.docx\n[섹션] Top\n| a | b |\n| --- | --- |\n| c | d |"]
    assert {r.doc_id: (r.status, [i.code for i in r.issues]) for r in results.collect()} == {0: ("ready", []), 1: ("blocked", ["DOCX_TABLE_LIMIT"])}


GOOD = {"version": 1, "fileName": "a.txt", "sourceFormat": "txt", "extractionMethod": "local-text", "warnings": [], "blocks": [{"id": "b", "kind": "paragraph", "order": 0, "headingPath": [], "text": "글"}]}
TABLE = {"id": "t", "kind": "table", "order": 1, "headingPath": ["x"], "rows": [["a", "b"], ["c", ""]], "excelLayout": {"usedRange": {"startRow": 2, "endRow": 3, "startColumn": 1, "endColumn": 2}, "headerRows": {"startRow": 2, "endRow": 2, "source": "detected"}}, "formulaCells": [{"row": 3, "column": 2, "formula": "=A1", "hasStoredResult": False}], "merges": [{"range": "A1:B1", "start": {"row": 0, "column": 0}, "end": {"row": 0, "column": 1}}]}


def changed(**parts):
    table = json.loads(json.dumps(TABLE))
    for path, value in parts.items():
        at = table
        *names, last = path.split("__")
        for n in names:
            at = at[int(n) if n.isdigit() else n]
        if value is None:
            del at[last]
        else:
            at[last] = value
    return {**GOOD, "blocks": [*GOOD["blocks"], table]}


CASES = [
    (GOOD, None), (changed(), None), ({**GOOD, "excelOptions": {"formulaOutput": "value-only"}}, None), ({**GOOD, "excelOptions": {"formulaOutput": "x"}}, "INVALID_DOCUMENT"),
    ({**GOOD, "version": "1"}, "INVALID_DOCUMENT"), ({**GOOD, "fileName": 3}, "INVALID_DOCUMENT"), ({**GOOD, "sourceFormat": " "}, "INVALID_DOCUMENT"), ({**GOOD, "blocks": {}}, "INVALID_DOCUMENT"),
    ({**GOOD, "blocks": []}, "EMPTY_INPUT"), ({**GOOD, "blocks": [{**GOOD["blocks"][0], "level": 7}]}, "INVALID_BLOCK"), ({**GOOD, "blocks": [{**GOOD["blocks"][0], "headingPath": [1]}]}, "INVALID_BLOCK"),
    ({**GOOD, "blocks": [{**GOOD["blocks"][0], "order": 1.5}]}, "INVALID_BLOCK"), ({**GOOD, "blocks": [{**GOOD["blocks"][0], "headingPath": ["x"] * 65}]}, "INPUT_TOO_LARGE"),
    ({**GOOD, "warnings": [{"code": "A", "severity": "error", "message": "m", "count": -1}]}, "INVALID_DOCUMENT"), ({**GOOD, "warnings": [{"code": "A", "severity": "error", "message": "m", "locations": ["x", None]}]}, "INVALID_DOCUMENT"),
    (changed(id="b"), "INVALID_BLOCK"), (changed(rows=[["a", 1], ["c", ""]]), "INVALID_BLOCK"), (changed(rows=None), "INVALID_BLOCK"), (changed(excelLayout__usedRange__endColumn=3), "INVALID_BLOCK"),
    (changed(excelLayout__headerRows__endRow=9), "INVALID_BLOCK"), (changed(formulaCells__0__row=4), "INVALID_BLOCK"), (changed(formulaCells__0__formula="A1"), "INVALID_BLOCK"), (changed(formulaCells=[TABLE["formulaCells"][0]] * 2), "INVALID_BLOCK"),
    (changed(excelLayout=None), "INVALID_BLOCK"), (changed(merges__0__range=""), "INVALID_BLOCK"), (changed(rows=[["x"] * 513]), "INPUT_TOO_LARGE"),
]


def test_record_validation(spark):
    rows = [(k, json.dumps(record)) for k, (record, _) in enumerate(CASES)] + [(100, "not json"), (101, None), (102, "[]")]
    got = {r.doc_id: r.error for r in documents.validate(spark.createDataFrame(rows, "doc_id long, json string")).collect()}
    for k, (record, error) in enumerate(CASES):
        assert got[k] == error, record
    assert {got[k] for k in (100, 101, 102)} == {"INVALID_DOCUMENT"}


def test_titles_are_peeled_repeatedly(spark):
    rows = [["보고"], ["연도"], ["a", "b"], ["c", "d"], ["", ""], ["제목만", ""], ["", ""], ["x", "y"]]
    df = spark.createDataFrame([(1, "n", 1, "s", k, [*r, *[""] * (2 - len(r))]) for k, r in enumerate(rows)], "doc_id long, name string, sheet_no int, sheet string, row_no int, cells array<string>")
    got = sorted({(r.number, tuple(r.titles)) for r in workbook.sheet_tables(df).collect()})
    assert got == [(1, ("보고", "연도")), (2, ()), (3, ())]


def test_pages_of_a_search(spark, tmp_path):
    from quirework.sources import statutes

    df = spark.createDataFrame([(1, '{"LawSearch":{"totalCnt":"41","page":"2","numOfRows":"20"}}'), (2, '{"LawSearch":{"resultCode":"09"}}'), (3, "x")], "doc_id long, json string")
    assert [(r.doc_id, r.page) for r in statutes.next_pages(statutes.search_pages(df)).collect()] == [(1, 3)]
    assert {r.doc_id: r.error for r in statutes.search_pages(df).collect()} == {1: None, 2: "code 09", 3: "not JSON"}
    rows = spark.createDataFrame([(1, "E", "m")], "doc_id long, error_code string, error_message string").withColumn("data", F.struct("doc_id"))
    documents.write_results(rows, f"file://{tmp_path}/out")
    assert json.loads(spark.read.text(f"file://{tmp_path}/out").first()[0]) == {"success": False, "error": {"code": "E", "message": "m"}}


def test_stream_keeps_one_of_resubmitted_documents(spark, tmp_path):
    from quirework.streaming.files import distinct_documents, document_stream

    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:05"), (2, "b", "2024-01-01 00:00:01")], "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = document_stream(spark, f"file://{tmp_path}/in", "doc_id long, text string, at timestamp")
    q = distinct_documents(stream, "at", "1 minute").writeStream.format("memory").queryName("once").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.doc_id for r in spark.table("once").collect()) == [1, 2]
    assert lines.prepare is not None
