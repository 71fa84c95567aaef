"""Formulas moved between cells, and values as their formats show them."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quirework.functions.formats import display
from quirework.operators.stored import translate_formula
from quirework.plans.workbooks import preprocess_workbooks

MOVED = [
    ("A1+B2", 2, 1, "B3+C4"), ("$A1+A$1+$A$1", 2, 1, "$A3+B$1+$A$1"), ("SUM(A1:A9)", 1, 0, "SUM(A2:A10)"), ("A:A+$B:C+1:2+$3:4", 1, 1, "B:B+$B:D+2:3+$3:5"), ('"A1 ""B2"" "&A1', 1, 0, '"A1 ""B2"" "&A2'),
    ("'A1 it''s'!B2+Sheet1!C3+AB12!A1", 1, 1, "'A1 it''s'!C3+Sheet1!D4+AB12!B2"), ("LOG10(A1)+ATAN2(B1,C1)", 1, 0, "LOG10(A2)+ATAN2(B2,C2)"), ("name_1+TAXES2024+x.A1", 1, 1, "name_1+TAXES2024+x.A1"), ("Table1[A1]+A1", 1, 0, "Table1[A1]+A2"),
    ("A1", -1, 0, "#REF!"), ("A1:B2", 0, -1, "#REF!:A2"), ("XFD1", 0, 1, "#REF!"), ("Z9+AZ1", 0, 1, "AA9+BA1"), ("1E5+A1*2", 1, 0, "1E5+A2*2"), ("=a1+ b2", 1, 1, "=B2+ C3"), ("", 1, 1, ""),
]


def test_formulas_move(spark):
    df = spark.createDataFrame([(k, f, d, a) for k, (f, d, a, _) in enumerate(MOVED)], "k int, f string, d int, a int")
    got = {r.k: r.x for r in df.select("k", translate_formula(F.col("f"), F.col("d"), F.col("a")).alias("x")).collect()}
    expected = {k: x for k, (_, _, _, x) in enumerate(MOVED)}
    assert got == expected


SHOWN = [
    ("1234.5", "#,##0", "1,235"), ("1234567.891", "#,##0.00", "1,234,567.89"), ("0.256", "0%", "26%"), ("-3.5", "0.0;(0.0)", "(3.5)"), ("-3.5", "0.0", "-3.5"), ("0", '0.0;(0.0);"zero"', "zero"), ("5", "000", "005"), ("0", "#", ""),
    ("0.5", "#.##", ".5"), ("1234567", "#,##0,", "1,235"), ("1234567", '0.0,,"M"', "1.2M"), ("12345.678", "0.00E+00", "1.23E+04"), ("12345.6789", "##0.0E+0", "12.3E+3"), ("1.5", "# ?/?", "1 1/2"), ("1234", "₩#,##0", "₩1,234"), ("1234", "[$₩-412]#,##0", "₩1,234"),
    ("3", '0"개"', "3개"), ("1234567890", "000-0000-0000", "012-3456-7890"), ("150", '[>100]"big";"small"', "big"), ("50", '[>100]"big";"small"', "small"), ("7", "0_);(0)", "7 "), ("0.30000000000000004", "General", "0.3"), ("123456789012", "General", "1.23457E+11"),
    ("1234.56789012", "General", "1234.56789"), ("-7", "General", "-7"), ("45292.75", "yyyy-mm-dd hh:mm", "2024-01-01 18:00"), ("45292", "d-mmm-yy", "1-Jan-24"), ("44927.5", "mmmm d, yyyy", "January 1, 2023"), ("44927", "dddd", "Sunday"), ("0.5", "h:mm AM/PM", "12:00 PM"),
    ("1.5", "[h]:mm", "36:00"), ("0.000011574", "mm:ss.0", "00:01.0"), ("60", "yyyy-mm-dd", "1900-02-29"), ("59", "yyyy-mm-dd", "1900-02-28"), ("61", "yyyy-mm-dd", "1900-03-01"), ("-1", "yyyy-mm-dd", "########"), ("2.5", "0", "3"), ("-0.4", "0", "0"), ("not a number", "0", "not a number"), ("1e400", "0", "1e400"),
]


@pytest.mark.parametrize(("value", "code", "shown"), SHOWN)
def test_numbers(value, code, shown):
    assert display(value, "n", code, 1900) == shown


def test_texts_and_epochs():
    assert display("x", "s", "@", 1900) == "x" and display("x", "s", '0;0;0;"<"@">"', 1900) == "<x>" and display("x", "s", "0.00", 1900) == "x"
    assert display("0", "n", "yyyy-mm-dd", 1904) == "1904-01-01" and display("TRUE", "b", "0", 1900) == "TRUE"


def test_a_workbook_with_both(spark):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    text = lambda at, t: f'<c r="{at}" t="inlineStr"><is><t>{t}</t></is></c>'
    rows = f'<row>{text("A1", "날짜")}{text("B1", "금액")}{text("C1", "합")}</row>'
    rows += '<row><c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>1234.5</v></c><c r="C2"><f t="shared" ref="C2:C4" si="0">B2*2</f><v>2469</v></c></row>'
    rows += '<row><c r="A3" s="1"><v>45293</v></c><c r="B3" s="2"><v>7</v></c><c r="C3"><f t="shared" si="0"/><v>14</v></c></row>'
    rows += '<row><c r="A4" s="9"><v>0.1</v></c><c r="B4" s="3"><v>0.5</v></c><c r="C4"><f t="shared" si="0"/></c></row>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf/><xf numFmtId="164"/><xf numFmtId="4"/><xf numFmtId="9"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    df = spark.createDataFrame([(1, "b.xlsx", bytearray(out.getvalue()))], "doc_id long, name string, content binary")
    chunks, issues, _ = preprocess_workbooks(df, formulas=True)
    assert chunks.first().chunk.split("\n")[3:] == ["| 날짜 | 금액 | 합 |", "| --- | --- | --- |", "| 2024-01-01 | 1,234.50 | 2469 (수식: =B2*2) |", "| 2024-01-02 | 7.00 | 14 (수식: =B3*2) |", "| 0.1 | 50% | (수식: =B4*2) |"]
    assert [(r.code, r.n) for r in issues.collect()] == [("FORMULA_RESULT_MISSING", 1)]
