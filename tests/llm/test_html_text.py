import time

import pytest

from torquil.llm import html_text as H

CASES = [
    ("<p>One <b>bold</b>  word<br>next<p>Two", "One bold word\nnext\n\nTwo"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  1. x\n  2. y\n- c"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>fig<td>12</table>", "Name       Qty\napple pie  3\nfig        12"),
    ("<table><tr><td colspan=2>wide<td>z<tr><td>a<td>b<td>c</table>", "wide     z\na     b  c"),
    ("<title>t</title><script>var x='<p>no</p>'</script><style>p{}</style>yes", "yes"),
    ("<p hidden>no</p><div style='display: none'>no</div><span style=\"visibility:hidden\">no</span><dialog>no</dialog>yes", "yes"),
    ("<pre>  k\n   v</pre>end", "  k\n   v\n\nend"),
    ("x &lt; y &amp; &eacute;<!-- no --> z", "x < y & é z"),
    ("</div></p>text</b>", "text"),
    ("<div>a<div>b</div>c</div>d", "a\nb\nc\nd"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
    ("a < b", "a < b"),
    ("<table><tr><td>x<ul><li>p<li>q</ul><td>y</table>", "x    y\n\n- p\n- q"),
    ("<img alt='A &amp; B'> c", "A & B c"),
    ("", ""),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_layout(page, text):
    assert H.render(page) == text


SHOWN = [
    ("<p>so <math><mi>E</mi><mo>=</mo><mfrac><mrow><mi>m</mi><mi>v</mi></mrow><mn>2</mn></mfrac></math> holds", "so E= mv 2 holds"),
    ("<math><semantics><mi>x</mi><annotation encoding='application/x-tex'>\\\\x</annotation></semantics></math>y", "xy"),
    ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><mn>4</mn></mtd></mtr></mtable></math>", "1 2\n3 4"),
    ("a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><style>no{}</style><path d='M0'/><text x=1>Sales <tspan>2024</tspan></text><g><text>Costs</text></g><text display='none'>no</text></svg>b", "a\nSales 2024\nCosts\nb"),
    ("<svg><foreignObject><p>one<p>two</foreignObject></svg>", "one\n\ntwo"),
    ("Note:<textarea rows=3>\n first &amp; line\n  <b>second</b></textarea>end", "Note:\n first & line\n  <b>second</b>\nend"),
    ("<textarea hidden>no</textarea>x", "x"),
    ("Size <select><option>S<option selected>M<option>L</select> now", "Size M now"),
    ("<select><option disabled>Pick<optgroup label=A><option>one<option>two</select>", "one"),
    ("<select multiple><optgroup label='Red &amp; co'><option>r1<option>r2<optgroup label=Blue><option label='b one'>b1</select>x", "Red & co\nr1\nr2\nBlue\nb one\nx"),
    ("<select></select>x<datalist><option>no</datalist>", "x"),
    ("<desc>seen</desc>", "seen"),
]


@pytest.mark.parametrize(("page", "text"), SHOWN)
def test_formulas_drawings_and_forms(page, text):
    assert H.render(page) == text


def test_depth_and_odd_pages(spark):
    deep = "<div>" * 20000 + "in" + "</div>" * 20000
    rows = [(1, deep, "u"), (2, None, None), (3, "", "u"), (3, "", "u"), (None, "<p>x", "u"), (4, "<" * 2000 + "<a href='", "u"), (5, "<table>" * 300 + "deep", "u")]
    got = H.html_text(spark.createDataFrame(rows, "page_id long, html string, url string"))
    out = [(r.page_id, r.text) for r in got.collect()]
    assert (1, "in") in out and (2, "") in out and out.count((3, "")) == 2 and (None, "x") in out and len(out) == 7
    assert H.html_text(got.select("page_id", "url", H.F.lit("").alias("html")).limit(0)).count() == 0


def test_broken_markup_takes_time_in_proportion():
    began = time.time()
    assert H.render("<table>" + "<caption>" * 30_000 + "x<tbody><tr><td>y").split() == ["x", "y"]
    for page in ("<a " * 300_000, "<div><p>" * 60_000, "<p><table><tr><td>" + "<span><p></p>" * 40_000, "<b title='" * 50_001 + ">"):
        assert H.render(page + "end").endswith("end")
    assert time.time() - began < 60


def test_visible_inside_hidden_and_cells_that_reach_down():
    assert H.render('<div style="visibility:hidden">a<b style="visibility: visible">b</b>c</div>') == "b"
    page = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td colspan=100000>f<td>g</table>"
    assert H.render(page).split("\n") == ["a  b  c", "   d  e", "f        g"]
