"""Workbook texts and files from end to end."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quirework.operators import cells, workbook
from quirework.plans.preprocess import preprocess, preprocess_results, raw_documents
from quirework.plans.workbooks import preprocess_workbooks
from tests.test_structured import xlsx


def chunks_of(spark, *texts, name="점검.xlsx"):
    docs = raw_documents(spark.createDataFrame([(k, t, name) for k, t in enumerate(texts)], "doc_id long, text string, name string"), name="name")
    chunks, issues, _ = preprocess(docs, "excel")
    out = {k: ([], []) for k in range(len(texts))}
    for r in chunks.orderBy("doc_id", "draft_no", "piece").collect():
        out[r.doc_id][0].append(r.chunk.split("\n", 2)[2])
    for r in issues.collect():
        out[r.doc_id][1].append((r.code, r.n))
    return out


def test_texts(spark):
    out = chunks_of(
        spark,
        "name,qty\nbolt,2",
        "앞 글\n\n| 설비 | 상태 |\n| --- | --- |\n| 급수펌프 | 정상 |\n|  |  |\n| 냉각탑 | 2026-02-10 |\n\n담당: 김철수",
        "| a | b |\n| x | y |\n| --- | --- |",
        "",
        " \n , \n",
        "보고서,,\n설비,점검일,결과\n급수펌프,01-15,정상\n,,\n자격,인원,비고\n갑,을,병",
        "| a | b |\n| --- | --- |\n| 1 |\n",
        "글 " * 3000 + "\n| a |\n| --- |\n| b |",
    )
    assert out[0] == (["[표] 1\n| name | qty |\n| --- | --- |\n| bolt | 2 |"], [])
    assert out[1] == (["앞 글", "[표] 1\n| 설비 | 상태 |\n| --- | --- |\n| 급수펌프 | 정상 |\n| 냉각탑 | 2026-02-10 |", "담당: 김철수"], [("TABLE_CONTINUATION_MERGED", 1)])
    # Pipe lines without a rule in their second line are no table, so the text is read as delimited.
    assert out[2][0] == ["[표] 1\n| \\| a \\| b \\| |\n| --- |\n| \\| x \\| y \\| |\n| \\| --- \\| --- \\| |"]
    assert out[3] == out[4] == ([], [])
    assert out[5] == (["[머리행] 보고서\n[표] 1\n| 설비 | 점검일 | 결과 |\n| --- | --- | --- |\n| 급수펌프 | 01-15 | 정상 |", "[표] 2\n| 자격 | 인원 | 비고 |\n| --- | --- | --- |\n| 갑 | 을 | 병 |"], [("MULTIPLE_TABLES", 2)])
    assert out[6][1] == [("IRREGULAR_COLUMNS", 1)]
    assert len(out[7][0]) == 3 and out[7][0][-1] == "[표] 1\n| a |\n| --- |\n| b |"


def test_results_of_texts(spark):
    docs = raw_documents(spark.createDataFrame([(1, "a,b\n1,2", "excel"), (2, "", "excel"), (3, "# 절\n글", "general")], "doc_id long, text string, type string"), kind="type")
    assert {r.doc_id: r.status for r in preprocess_results(docs).collect()} == {1: "ready", 2: "blocked", 3: "ready"}


def test_delegation_is_tried_for_every_kind(spark):
    from tests.test_structured import RULES

    docs = raw_documents(spark.createDataFrame([(1, RULES)], "doc_id long, text string"))
    for kind in ("general", "law", "manual"):
        assert preprocess(docs, kind)[0].where("chunk like '[위임전결규정 매뉴얼]%'").count() == 4
    assert preprocess(docs, "excel")[0].where("chunk like '[위임전결규정 매뉴얼]%'").isEmpty()


def cell(at, text):
    return f'<c r="{at}" t="inlineStr"><is><t>{text}</t></is></c>'


def rows_of(grid):
    return "<sheetData>" + "".join("<row>" + "".join(cell(f"{chr(65 + c)}{r}", t) for c, t in enumerate(row) if t) + "</row>" for r, row in enumerate(grid, 1)) + "</sheetData>"


def books(spark, *raws):
    return spark.createDataFrame([(k, "b.xlsx", bytearray(r)) for k, r in enumerate(raws)], "doc_id long, name string, content binary")


def test_files_end_to_end(spark):
    plain = xlsx(rows_of([["제목", "", ""], ["품목", "단가", ""], ["", "하한", "상한"], ["펌프", "1", "3"], ["", "", ""], ["항목: 밸브", "", ""], ["볼", "2", "4"]]) + '<mergeCells><mergeCell ref="B2:C2"/></mergeCells>')
    empty = xlsx("<sheetData></sheetData>")
    chunks, issues, results = preprocess_workbooks(books(spark, plain, empty))
    text = [r.chunk for r in chunks.where("doc_id = 0").orderBy("draft_no").collect()]
    assert text == ["[파일] b.xlsx\n[시트] S1\n[머리행] 제목\n[표] 1\n| 품목 | 단가 > 하한 | 단가 > 상한 |\n| --- | --- | --- |\n| 펌프 | 1 | 3 |", "[파일] b.xlsx\n[시트] S1\n[머리행] 제목\n[항목] 밸브\n| 품목 | 단가 > 하한 | 단가 > 상한 |\n| --- | --- | --- |\n| 볼 | 2 | 4 |"]
    found = {r.code: (r.n, r.locations) for r in issues.where("doc_id = 0").collect()}
    assert found == {"MERGED_CELLS": (1, ["S1!B2:C2"]), "COMPLEX_EXCEL_HEADER": (1, ["S1!B2:C2"])}
    assert {r.doc_id: r.status for r in results.collect()} == {0: "review", 1: "blocked"}


def test_columns_without_a_title(spark):
    raw = xlsx(rows_of([["", ""], ["품목", "", "값"], ["", "", ""], ["펌프", "x", "1"]]))
    _, issues, _ = preprocess_workbooks(books(spark, raw))
    assert {r.code: (r.n, r.locations) for r in issues.collect()}["EMPTY_EXCEL_HEADER"] == (1, ["S1!B:B"])


def test_manual_header_rows(spark):
    raw = xlsx(rows_of([["제목", ""], ["a", "b"], ["c", "d"], ["e", "f"]]))
    settings = spark.createDataFrame([(0, 1, 3, 3)], "doc_id long, sheet_no int, first int, last int")
    chunks, _, _ = preprocess_workbooks(books(spark, raw), settings=settings)
    assert chunks.first().chunk == "[파일] b.xlsx\n[시트] S1\n[머리행] 제목\n[머리행] a | b\n[표] 1\n| c | d |\n| --- | --- |\n| e | f |"


def test_a_frame_without_room_is_told(spark):
    sheets = spark.createDataFrame([(1, 1, "b.xlsx", "n" * 3790)], "doc_id long, sheet_no int, name string, sheet string")
    tables = spark.createDataFrame([(1, 1, 1, None, ["t"], ["a"], 1, ["x"])], "doc_id long, sheet_no int, section int, item string, context array<string>, header array<string>, row_no int, cells array<string>")
    drafts, issues = cells.layout_drafts(tables, sheets)
    assert drafts.isEmpty() and [(r.code, r.severity) for r in issues.collect()] == [("TABLE_FRAMING_EXCEEDS_LIMIT", "error")]


def test_a_band_may_end_far_below(spark):
    """A title merged over seventy rows, its column titles in the row after."""
    ranges = spark.createDataFrame([(1, 1, 1, 1, 80, 2, [(1, 2, 1, 71, 2)])], "doc_id long, sheet_no int, top int, left int, bottom int, right int, merges array<struct<merge_no:int,top:int,left:int,bottom:int,right:int>>")
    grid = [["", ""], ["큰 제목", ""], *[["", ""]] * 68, ["이름", "값"], *[["x", "1"]] * 9]
    rows = spark.createDataFrame([(1, 1, k, r) for k, r in enumerate(grid)], "doc_id long, sheet_no int, row_no int, cells array<string>")
    names = spark.createDataFrame([], "doc_id long, sheet_no int, name string, ref string, name_no int")
    none = spark.createDataFrame([], "doc_id long, sheet_no int, row int, col int, value string, formula string, comment boolean")
    assert tuple(cells.header_rows(ranges, rows, names, none).first())[2:] == (2, 71, "detected")


@pytest.mark.parametrize(("n", "label"), [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD"), (18278, "ZZZ"), (18279, "AAAA"), (475255, "AAAAA")])
def test_column_labels(spark, n, label):
    assert spark.range(1).select(cells.column_label(F.lit(n))).first()[0] == label


def test_numbers_run_on_over_the_tables_of_a_sheet(spark):
    rows = [(1, "n", k, "s", r, [f"h{k}", "x"]) for k in (3, 9) for r in range(2)] + [(1, "n", 9, "s", 2, ["", ""]), (1, "n", 9, "s", 3, ["other", "head"]), (1, "n", 12, "t", 0, ["q", "r"])]
    drafts, _ = workbook.workbook_drafts(spark.createDataFrame(rows, "doc_id long, name string, sheet_no int, sheet string, row_no int, cells array<string>"))
    assert [r.context[1:] for r in drafts.orderBy("draft_no").collect()] == [["[시트] s", "[표] 1"], ["[시트] s", "[표] 2"], ["[시트] s", "[표] 3"], ["[시트] t", "[표] 1"]]
    assert io and zipfile


def ods(rows):
    names = {"table": "table", "office": "office", "text": "text"}
    spaces = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{v}:1.0"' for k, v in names.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f'<office:document-content {spaces}><office:body><office:spreadsheet><table:table table:name="S1">{rows}</table:table></office:spreadsheet></office:body></office:document-content>')
    return out.getvalue()


def test_open_document_sheets_equal_workbooks(spark):
    """The same sheet in both formats gives the same chunks and issues; a million empty rows cost nothing."""
    one = lambda t, more="": f"<table:table-cell {more}><text:p>{t}</text:p></table:table-cell>"
    wide, under, blank = 'table:number-columns-spanned="2"', "<table:covered-table-cell/>", "<table:table-cell/>"
    rows = f"<table:table-row>{one('제목')}</table:table-row><table:table-header-rows><table:table-row>{one('품목')}{one('단가', wide)}{under}</table:table-row><table:table-row>{blank}{one('하한')}{one('상한')}</table:table-row></table:table-header-rows>"
    rows += f"<table:table-row>{one('펌프')}{one('1', 'table:number-columns-repeated=' + chr(34) + '2' + chr(34))}</table:table-row><table:table-row>{blank}</table:table-row><table:table-row>{one('항목: 밸브')}</table:table-row>"
    rows += f"<table:table-row table:number-rows-repeated=\"2\">{one('볼')}{one('4', 'table:formula=' + chr(34) + 'of:=SUM([.A1:.B2];[$S1.C$3])' + chr(34))}{one('4')}</table:table-row><table:table-row table:number-rows-repeated=\"1048000\"><table:table-cell table:number-columns-repeated=\"16384\"/></table:table-row>"
    grid = [["제목", "", ""], ["품목", "단가", ""], ["", "하한", "상한"], ["펌프", "1", "1"], ["", "", ""], ["항목: 밸브", "", ""], ["볼", "4", "4"], ["볼", "4", "4"]]
    same = rows_of(grid).replace('<c r="B7" t="inlineStr">', '<c r="B7" t="inlineStr"><f>SUM(A1:B2,S1!C$3)</f>').replace('<c r="B8" t="inlineStr">', '<c r="B8" t="inlineStr"><f>SUM(A1:B2,S1!C$3)</f>')
    found = []
    for raw in (ods(rows), xlsx(same + '<mergeCells><mergeCell ref="B2:C2"/></mergeCells>')):
        chunks, issues, _ = preprocess_workbooks(books(spark, raw), formulas=True)
        found.append((sorted(r.chunk for r in chunks.collect()), sorted((r.code, r.n, tuple(r.locations)) for r in issues.collect())))
    assert found[0] == found[1] and len(found[0][0]) == 2 and "(수식: =SUM(A1:B2,S1!C$3))" in "".join(found[0][0])
