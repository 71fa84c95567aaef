"""Records of delimited text against the csv module, however lines are dealt to blocks and files to tasks."""

import csv
import io
import random

import pytest

from quirework.sources import delimited


def plain(text):
    """Records and their physical lines, read line by line."""
    out, start, held = [], 0, ""
    whole = text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n")
    reader_lines = whole.split("\n") if whole else []
    within = False
    for k, line in enumerate(reader_lines):
        if not within:
            start, held = k, line
        else:
            held += "\n" + line
        within = delimited.ends_within(line, within)
        if not within or k == len(reader_lines) - 1:
            out.append((start + 1, next(csv.reader(io.StringIO(held, newline="")), [])))
    return out


def texts(n=300, seed=6):
    rng = random.Random(seed)
    parts = ["a", "b c", ",", ",", "\n", '"', '""', '"x\ny"', ',"', '",', "\r\n", "é", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_line_states_match_the_csv_module():
    for text in texts(3000, 1):
        whole = text.replace("\r\n", "\n").removesuffix("\n")
        assert [cells for _, cells in plain(text) if cells] == [cells for cells in csv.reader(io.StringIO(whole, newline="")) if cells], text


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_records(spark, monkeypatch, block):
    monkeypatch.setattr(delimited, "BLOCK_LINES", block)
    rows = [*texts(), "", None, "a,b,c\n1,2,\n3,4", '"open\nto\nthe end', "x" * 5000 + '\n"' + "y\n" * 3000 + '"\nlast']
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = delimited.records(delimited.text_lines(df)).collect()
    got = {k: [] for k in range(len(rows))}
    for r in sorted(found, key=lambda r: (r.doc_id, r.record_no)):
        got[r.doc_id].append((r.start_line, list(r.cells)))
    assert {k: [x for x in v] for k, v in got.items()} == {k: plain(t or "") for k, t in enumerate(rows)}


def test_irregular_records_by_physical_line(spark):
    df = spark.createDataFrame([(1, "a,b,c\n1,2,\n3,4"), (2, 'h,i\n"x\ny",2\n\n1,2,3\n"p\nq"\n'), (3, "a\nb")], "doc_id long, text string")
    out = {r.doc_id: (r.n, r.locations) for r in delimited.irregular_records(delimited.records(delimited.text_lines(df))).collect()}
    assert out == {1: (1, ["row 3"]), 2: (2, ["row 5", "row 6"])}


def test_one_file_in_many_tasks(spark, tmp_path):
    text = "".join(f'{k},"line {k}\nwith ""quotes"" {"w" * (k % 50)}",end\n' for k in range(4000))
    (tmp_path / "big.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        lines = delimited.file_lines(spark, f"file://{tmp_path}/big.csv")
        found = delimited.records(lines)
        rows = sorted((r.record_no, r.start_line, list(r.cells)) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(k, 2 * k + 1, [str(k), f'line {k}\nwith "quotes" {"w" * (k % 50)}', "end"]) for k in range(4000)]
