"""Plans and steps whose memory or rows must grow no faster than their input."""

from quirework.operators import delegation, manuals, sections, settings, spans, storage, stored, workbook
from quirework.operators.storage import parts
from quirework.plans import preprocess, queries, structured_queries


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_sent_whole(spark):
    """Cells are exploded from a small file: a join that sends them to the driver grows with the table."""
    got = structured_queries.densest_header(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in _plan(got)


def test_merges_meet_cells_near_them_only(spark):
    """Each column of a sheet has its own small merge; tall, wide and overlapping ones hold cells as plain loops say."""
    cells = [(d, r, c) for d in (1, 2) for r in range(1, 41) for c in range(1, 8)]
    merges = [(1, k, k, 1, k + 1, 2) for k in range(1, 40, 3)] + [(1, 90, 5, 1, 37, 1), (1, 0, 9, 2, 9, 7), (1, 91, 4, 4, 3, 9), (3, 1, 1, 1, 40, 7)]
    want = set()
    for d, r, c in cells:
        at = min((m[1:4] for m in merges if m[0] == d and m[2] <= r <= m[4] and m[3] <= c <= m[5]), default=(0, r, c))
        want.add((d, r, c, at[1], at[2]))
    shape = "doc_id int, merge_no int, top int, left int, bottom int, right int"
    frames = spark.createDataFrame(cells, "doc_id int, row int, col int"), spark.createDataFrame(merges, shape)
    assert set(map(tuple, settings.containing_merge(*frames).collect())) == want
    rows = spark.range(200_000).selectExpr("1 as doc_id", "cast(id as int) as row", "1 as col")
    many = rows.where("row % 4 = 0").selectExpr("doc_id", "row as merge_no", "row as top", "1 as left", "row + 2 as bottom", "3 as right")
    assert settings.containing_merge(rows, many).where("row <> anchor_row").count() == 100_000


def test_only_cells_without_a_text_meet_their_group(spark):
    """One sort of the cells, by a number first, and a formula that is read once for all its cells."""
    stored_rows = spark.createDataFrame([(1, 1, r, c, "=A1+$B2" if (r, c) == (1, 1) else "", 5) for r in range(1, 4) for c in (1, 2)] + [(1, 1, 9, 9, "", 6), (1, 1, 9, 8, "=X", None)], "doc_id int, sheet_no int, row int, col int, formula string, shared int")
    got = stored.share_formulas(stored_rows)
    plan = _plan(got)
    assert "ArrowEvalPython" in plan and plan.count("regexp_extract") == 0 and "BroadcastHashJoin" not in plan
    found = {(r.row, r.col): r.formula for r in got.collect()}
    assert found == {(1, 1): "=A1+$B2", (1, 2): "=B1+$B2", (2, 1): "=A2+$B3", (2, 2): "=B2+$B3", (3, 1): "=A3+$B4", (3, 2): "=B3+$B4", (9, 9): "", (9, 8): "=X"}


def test_small_rows_that_take_long_are_dealt(spark):
    """A small file is one task else, and its few bytes would be joined into one again."""
    for f in (structured_queries.record_faults, structured_queries.record_sums):
        assert f(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 16


def test_parts_grow_with_rows(spark):
    assert [parts(spark.range(n)) for n in (0, 800_000, 800_001, 2_000_000)] == [4, 4, 5, 10]


def test_delegation_is_dealt_by_its_lines(spark, monkeypatch):
    """Lines compress to few bytes, by which Spark would join them into few tasks."""
    seen = []

    def some(rows, *each):
        seen.append(rows.count())
        return 7

    for module in (structured_queries, delegation):
        monkeypatch.setattr(module, "parts", some)
    got = structured_queries.delegation_chunks(spark, "/root/testdata/sf0.001")
    orders, lines = seen
    assert orders == 1500 and lines > 5 * orders and got.count() > orders


def test_tables_of_one_shape_are_placed_once(spark, monkeypatch):
    """Their texts don't matter; a missing row is an empty one, a span of 0 has no place."""
    import pyarrow as pa

    calls, place = [], spans.place
    monkeypatch.setattr(spans, "place", lambda rows: calls.append(rows) or place(rows))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "_shape": ["2x1 1x2 /1x1 /"] * 200 + ["0x1 /"] * 100})
    (out,) = spans._place_all([batch])
    assert len(calls) == 2 and out.column(1).to_pylist()[199:201] == [[{"row": r, "col": c, "bottom": b, "right": e} for r, c, b, e in ((0, 0, 1, 0), (0, 1, 0, 2), (1, 1, 1, 1))], None]
    rows = spark.sql("SELECT 1 AS doc_id, 0 AS table_no, array(null, array(named_struct('text', 'a', 'rowspan', 1, 'colspan', 2))) AS rows")
    assert [tuple(r) for r in spans.grid_rows(spans.placed_cells(rows)).orderBy("row_no").collect()] == [(1, 0, 0, ["", ""]), (1, 0, 1, ["a", ""])]


def test_numbers_and_counts_need_no_join(spark):
    """Blocks see resets, and claims are counted, where their key lies; the partitions are given, so small bytes aren't joined into few tasks."""
    for f in (queries.list_ordinals, queries.claim_mismatches):
        plan = _plan(f(spark, "/root/testdata/sf0.001"))
        assert "Join" not in plan and "REPARTITION_BY_NUM" in plan


def test_manuals_are_dealt_by_their_lines(spark, monkeypatch):
    """A manual's line table compresses to few bytes, by which Spark would join it into few tasks."""
    seen = []
    monkeypatch.setattr(manuals, "parts", lambda rows, *each: seen.append(rows.count()) or 5)
    assert queries.manual_steps(spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 1 and seen[0] > 1500


def test_labelled_manuals_are_dealt(spark):
    """A small file of orders is one task else, and preparing texts takes far longer than reading them."""
    assert structured_queries._label_manual(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_statutes_are_stored_by_units(spark, monkeypatch):
    """Lines are grouped in the document's own task, before anything is written, and never sent whole; titles keep their places."""
    seen, write = {}, sections.cut
    monkeypatch.setattr(sections, "cut", lambda df, name: seen.setdefault(name, (_plan(df), write(df, name)))[1])
    got = structured_queries.line_claims(spark, "/root/testdata/sf0.001")
    plan, units = seen["law-units"]
    assert plan.count("Exchange hashpartitioning") == 1 and units.count() == 1500
    assert "BroadcastHashJoin" not in _plan(got)
    monkeypatch.undo()
    text = "제1장 총칙\n제1조(목적)\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n뒤\n제2조(정의)\n부칙\n끝"
    found, issues = sections.law_drafts(spark.createDataFrame([(1, "n", text)], "doc_id int, name string, text string"))
    rows = [(r.context[1], r.body, r.sources) for r in found.orderBy("draft_no").collect()]
    assert rows == [
        ("[위치] 제1장 총칙 > 제1조(목적)", "| a | b |\n| --- | --- |\n| 1 | 2 |", [3, 5]), ("[위치] 제1장 총칙 > 제1조(목적)", "뒤", [6]),
        ("[위치] 제1장 총칙 > 제2조(정의)", "", []), ("[위치] 부칙", "끝", [9]),
    ]
    assert issues.count() == 0


def test_workbook_texts_are_joined_to_nothing(spark, monkeypatch):
    """Texts are tested after they are dealt, and rows find their tables' numbers, frames and contexts where they lie."""
    seen = {}

    def cut(df, name):
        seen[name] = _plan(df)
        return storage.cut(df, name)

    for module in (structured_queries, preprocess, workbook):
        monkeypatch.setattr(module, "cut", cut)
    got = structured_queries.workbook_texts(spark, "/root/testdata/sf0.001")
    assert got.count() == 300 and "RLike" not in seen["workbook-docs"] and "workbook-docs" in seen["prepared"]
    assert not [name for name in ("segment-lines", "sheet-rows", "sheet-drafts", "workbook-drafts") if "Join" in seen[name]]
    # One deal for the rows of tables; two more for texts that hold none: their lines are joined, their rows widened.
    assert seen["sheet-rows"].count("Exchange hashpartitioning") == 3
