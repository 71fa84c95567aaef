"""Queries against their SQL on the small tables, and operators on small inputs with known answers."""

import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quirework.functions import strings as S
from quirework.operators import drafts, edits, lines, sections
from quirework.operators.split import pieces_of
from quirework.plans.preprocess import preprocess, preprocess_results, raw_documents
from quirework.plans import column_queries, queries
from quirework.sources import files, statutes

ORACLES, QUERIES = queries.ORACLES | column_queries.ORACLES, queries.QUERIES | column_queries.QUERIES
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(str([dict(zip(names, r, strict=True))[c] for c in columns]) for r in result.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == expected


@pytest.mark.parametrize(("text", "limit"), [("a b c d " * 40, 17), ("x" * 50, 7), ("한국어 문장이다. 다음 문장.\n\n끝" * 9, 20), ("😀" * 15, 5), ("", 3), ("one\ntwo\n\nthree. four", 9)])
def test_pieces_join_to_the_text(text, limit):
    parts = pieces_of(text, limit)
    assert "".join(parts) == text
    assert all(len(p.encode("utf-16-le")) // 2 <= limit for p in parts)


def test_split_prefers_wide_breaks():
    assert pieces_of("aa\n\nbb cc\ndd", 9) == ["aa\n\n", "bb cc\ndd"]
    assert pieces_of("One. Two three", 8) == ["One. ", "Two ", "three"]


def docs_of(spark, *texts):
    return raw_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_chunks_hold_the_whole_text(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    prepared = lines.prepare(raw_documents(docs))
    chunks, _, _ = preprocess(raw_documents(docs))
    longest = chunks.select(F.max(S.u16_length(F.col("chunk")))).first()[0]
    assert longest <= S.CHUNK_LIMIT
    text = prepared.select("doc_id", F.regexp_replace("text", r"\s", "").alias("t")).where("t <> ''")
    assert text.select("doc_id").exceptAll(chunks.select("doc_id").distinct()).isEmpty()


def test_separator_and_limits(spark):
    docs = docs_of(spark, "원문 @@@ " + "단어 " * 1500, "", None)
    out = {r.doc_id: r for r in preprocess_results(docs).collect()}
    assert out[0].source_collisions == 1 and out[0].unresolved_collisions == 0 and out[0].longest_chunk <= 3800 and out[0].chunk_count > 1
    assert out[1].status == out[2].status == "blocked" and not out[1].can_download


def test_edits_are_not_split_again(spark):
    rows = spark.createDataFrame([(1, 0, "정상"), (1, 1, ""), (1, 2, "x" * 3801)], "doc_id long, draft_no int, chunk string")
    r = drafts.revalidate(rows).first()
    assert (r.status, r.empty_chunks, r.over_safe_limit, r.chunk_count) == ("blocked", 1, 1, 3)


def test_page_decoration(spark):
    text = "회사 보고서\n1-1\n본문입니다.\n회사 보고서\n2-2\n다음 본문입니다."
    assert lines.prepare(docs_of(spark, text)).select("text").first()[0].split("\n") == ["회사 보고서", "본문입니다.", "다음 본문입니다."]


def test_law_sections(spark):
    text = "제1편 총칙\n제1장 목적\n제1조(목적) 이 규칙은 목적을 정한다.\n제2조(정의) 정의는 다음과 같다.\n부칙\n이 규칙은 시행한다."
    found, _ = sections.law_drafts(docs_of(spark, text))
    places = [r.context[1] for r in found.collect()]
    assert any("제1편 총칙 > 제1장 목적 > 제1조(목적)" in p for p in places) and any("부칙" in p for p in places)


def test_edit_columns(spark):
    df = spark.createDataFrame([(1, ["one ", " two", "three"])], "doc_id long, chunks array<string>")
    c = F.col("chunks")
    r = df.select(edits.delete(c, F.lit(1)).alias("d"), edits.delete(c, F.lit(9)).alias("bad"), edits.merge_next(c, F.lit(0)).alias("m"), edits.move_boundary(c, F.lit(1), F.lit(5)).alias("b"), edits.split_edited(F.lit("a@@@b")).alias("s")).first()
    assert (r.d, r.bad, r.m, r.b, r.s) == (["one ", "three"], ["one ", " two", "three"], ["one\n\ntwo", "three"], ["one ", " twothree"], ["a", "b"])
    assert [x["index"] for x in edits.search(df, "TWO").collect()] == [1] and [x["index"] for x in edits.search(df, "#003").collect()] == [2]


def test_decoding():
    assert files.decode_bytes("설비,상태".encode("cp949"))[:2] == ("설비,상태", "euc-kr")
    assert files.decode_bytes(b"\xef\xbb\xbfabc") == ("abc", "utf-8", 0)
    assert files.decode_bytes(b"\x61\xc3\x28\x62", "utf-8")[2] == 1


def test_irregular_records(spark):
    sheets = files.csv_sheets(spark.createDataFrame([(1, "a.csv", "a,b,c\n1,2,\n3,4\n")], "doc_id long, name string, text string"))
    r = files.irregular_records(sheets).first()
    assert (r.n, r.locations) == (1, ["row 3"])


def workbook():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>size</t></is></c></row><row r="3"><c r="C3"><v>7</v></c></row></sheetData></worksheet>')
    return raw.getvalue()


def test_workbook_files(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(workbook())
    (tmp_path / "note.txt").write_text("x")
    rows = files.files(spark, str(tmp_path), "local-excel").withColumn("doc_id", F.lit(1))
    assert [list(r.cells) for r in files.workbook_sheets(rows).orderBy("row_no").collect()] == [["name", "size"], ["", "7"]]


def test_word_blocks(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    df = spark.createDataFrame([(1, "a.docx", bytearray(raw.getvalue()))], "doc_id long, name string, content binary")
    blocks = files.document_blocks(df)
    assert [r.kind for r in blocks.orderBy("order").collect()] == ["heading", "paragraph", "table"]
    assert files.blocks_to_text(files.placed_blocks(blocks)[0]).first().text.split("\n")[:2] == ["# Top", "text"]


def test_statute_members_may_be_objects_or_lists(spark):
    one = '{"법령":{"기본정보":{"법령명_한글":"법"},"조문":{"조문단위":{"조문내용":"제1조 &amp;lt;가&amp;gt;","항":[{"항내용":"① 갑"}]}},"별표":{"별표단위":[{"별표제목":"별표 1"}]}}}'
    r = statutes.statute_text(spark.createDataFrame([(1, one), (2, "not json")], "doc_id long, json string")).orderBy("doc_id").collect()
    assert (r[0].name, r[0].text.split("\n")) == ("법", ["제1조 &lt;가&gt;", "① 갑", "별표 1"]) or r[0].text.split("\n")[0] == "제1조 <가>"
    assert not r[1].text


def test_stream_gives_the_batch_result(spark, tmp_path):
    from quirework.streaming.files import chunk_stream, document_stream

    docs = spark.createDataFrame([(1, "# A\none"), (2, "two")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = document_stream(spark, str(tmp_path / "in"), "doc_id long, text string")
    chunk_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "batch_id=0"))
    batch, _, _ = preprocess(raw_documents(docs))
    assert sorted((r.doc_id, r.chunk) for r in got.collect()) == sorted((r.doc_id, r.chunk) for r in batch.collect())


def test_one_file_a_document(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (2, 0, 0, "c")], "doc_id long, draft_no int, piece int, chunk string")
    names = spark.createDataFrame([(1, "dir/one.txt"), (2, "one.md")], "doc_id long, name string")
    path = f"file://{tmp_path}/out"
    drafts.write_texts(chunks, names, path)
    # A rerun of one document replaces its file and leaves the other.
    drafts.write_texts(chunks.where("doc_id = 2").withColumn("chunk", F.lit("d")), names, path)
    found = {p.parent.name: p.read_text() for p in (tmp_path / "out").rglob("part-*.txt")}
    assert found == {"document=one-1": "a\n@@@\nb\n", "document=one-2": "d\n"}


def test_written_results_leave_no_tables(spark, tmp_path):
    import pathlib

    from quirework.operators import storage
    from quirework.plans.preprocess import write_results

    storage.cut(spark.range(1), "stays")
    before = set(pathlib.Path(storage._own[0]).iterdir()) if storage._own else set()
    write_results(docs_of(spark, "# A\none\n| a |\n| --- |\n| b |"), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/chunks").count() == 2 and spark.read.parquet(f"file://{tmp_path}/out/results").first().status == "ready"
    assert not storage._own or set(pathlib.Path(storage._own[0]).iterdir()) == before


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
