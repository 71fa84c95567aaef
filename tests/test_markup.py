"""HTML blocks of pages with lacking, stray and nested tags."""

import pytest

from quirework.sources import markup

PAGES = [
    ("<h1>A</h1><p>one<p>two<br>lines</p>stray<div>gone</div><h2>B &amp; C</h2><p>x<b>y</b>z</p><h1>D</h1><p>last", [("heading", "A", "A"), ("paragraph", "one", "A"), ("paragraph", "two\nlines", "A"), ("heading", "B & C", "A > B & C"), ("paragraph", "xyz", "A > B & C"), ("heading", "D", "D"), ("paragraph", "last", "D")]),
    ("<ul><li>a<li>b<ol><li>c</li><li>d</ol><li>e</ul><p>f", [("list-item", "a", 0, False), ("list-item", "b", 0, False), ("list-item", "c", 1, True), ("list-item", "d", 1, True), ("list-item", "e", 0, False), ("paragraph", "f", None, None)]),
    ("<ol><li><p>a</p><p>b</p></li></ol>", [("list-item", "a b", 0, True)]),
    ('<p>x</p><script>var t="</p><p>no";</script><style>p{}</style><!-- <p>no --><nav><p>no</p></nav><footer><ul><li>no</ul></footer><p title="a > b">y', [("paragraph", "x"), ("paragraph", "y")]),
    ("<table><tr><th colspan=2>a<th rowspan='2'>b<tr><td>c<td>d<br>e</table><p>z", [("table", [["a", "", "b"], ["c", "d\ne", ""]]), ("paragraph", "z")]),
    ("<table><tr><td></td></tr></table>", []),
    ("</p></ul></nav>text<p>&lt;tag&gt; &#44032;&#x1F600; &unknown; &#0; &nbsp;</p></p>", [("paragraph", "<tag> 가😀 &unknown; �")]),
    ("<H2>Up</H2><P>Low</P>", [("heading", "Up"), ("paragraph", "Low")]),
    ("", []),
    (None, []),
    ("plain < text", []),
    ("<p>" + "word " * 50_000, [("paragraph", ("word " * 50_000).strip())]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = markup.html_blocks(spark.createDataFrame([(k, h) for k, (h, _) in enumerate(PAGES)], "doc_id long, html string")).collect()
    out = {k: [] for k in range(len(PAGES))}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.order)):
        out[r.doc_id].append(r)
    return out


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_blocks(found, k):
    rows, expected = found[k], PAGES[k][1]
    assert [r.order for r in rows] == list(range(len(rows)))
    plain = [(r.kind, r.rows if r.kind == "table" else r.text) for r in rows]
    assert plain == [x[:2] for x in expected]
    if k == 0:
        assert [" > ".join(r.heading_path) for r in rows] == [x[2] for x in expected]
    if k in (1, 2):
        assert [(r.depth, r.ordered) for r in rows] == [x[2:] for x in expected]


def test_levels(found):
    assert [r.level for r in found[0] if r.kind == "heading"] == [1, 2, 1]
