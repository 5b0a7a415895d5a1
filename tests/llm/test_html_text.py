import re
import time
from html.parser import HTMLParser

import pytest

from loomline.llm.html_text import extract, page_text


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; <b>bo</b>ld", "plain & bold"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>a</div><div>b</div>c<br>d<br><br>e", "a\nb\nc\nd\n\ne"),
        ("<head><title>t</title><style>x</style></head><body>b<script>s</script><!-- c --><noscript>n</noscript>e", "be"),
        ("<div hidden>a</div><span style='color:red; display : none'>b</span><p style=\"visibility:hidden\">c</p>d", "d"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol start=9><li>a</li><li>b</li></ol>", "9. a\n10. b"),
        ("<pre>  x\n\ty</pre>", "  x\n        y"),
        ("<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>long one<td>7</table>", "name      n\na         10\nlong one  7"),
        ("<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>", "a     b\n\nx  y"),
        ("<table><tr><td colspan=2>wide cell here</td></tr><tr><td>a</td><td>b</td></tr></table>", "wide cell here\na  b"),
        ("<a href='x>y' title=\"a>b\">link</a>", "link"),
        ("a < b and <unclosed", "a < b and"),
        ("<p>x <script>var a = '</p>';</script>y", "x y"),
        ("<!-- never closed <p>x", ""),
        ("</p></div>x</table>", "x"),
        ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n    d\nu\n    e"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("x<img alt='a picture'>y", "x a picture y"),
    ],
)
def test_layout(html, text):
    assert page_text(html) == text


def test_deep_and_long_pages():
    assert page_text("<div>" * 50_000 + "x") == "x"
    assert page_text("<b>" * 5_000 + "x" + "</i>" * 5_000) == "x"
    assert len(page_text("<p>word</p>" * 20_000).split()) == 20_000


@pytest.mark.parametrize(
    "html",
    [
        "<b>" * 20_000 + "x" + "</i>" * 20_000,
        "<div>" * 30_000 + "<p>" * 30_000 + "x",
        "<p>" + "<table>" + "<div>" * 30_000 + "x",
        "<b hidden></b>" + "<span>" * 30_000 + "</em>" * 30_000 + "x",
        "<b>" * 20_000 + "<div>" * 20_000 + "</b>" * 20_000 + "x",
        "<style>.a{display:none}</style>" + "<b class=b>" * 20_000 + "<div>" + "</b>" * 20_000 + "x",
        "<ul><li>" * 20_000 + "x" + "</dd>" * 20_000,
        '<b style="color:red"><div>' * 8_000 + "</b>" * 8_000 + "x",
        '<b style="color:red"><span></span><div>' * 8_000 + "y" + "</b>" * 8_000 + "x",
        '<i style="color:red">' * 8_000 + "<span></span>" * 8_000 + "<p>" + "</i>" * 8_000 + "x",
        '<b style="color:red"><div><i style="x:y">' * 5_000 + "</b></i>" * 5_000 + "</i>" * 5_000 + "x",
        "< " * 100_000 + "x",
        "<style>" + "a{" * 50_000 + "}" * 50_000 + "</style>x",
    ],
)
def test_time_grows_in_proportion(html):
    began = time.process_time()
    assert page_text(html).rstrip().endswith("x")
    assert time.process_time() - began < 4


class Plain(HTMLParser):
    """Visible words of a page without tables, read by another parser: a depth of hidden elements is all it keeps."""

    hidden = {"script", "style", "title", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], []

    def handle_starttag(self, tag, attrs):
        said = dict(attrs)
        if tag in self.hidden or "hidden" in said or "display:none" in (said.get("style") or "").replace(" ", ""):
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        if tag in ("p", "div", "li", "td", "th", "h1", "h2", "article", "nav", "footer"):
            self.out.append(" ")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_every_visible_word_comes_out_in_order(spark):
    for folder in ("sf0.001", "sf0.01", "sf0.1"):
        for r in spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").select("html").collect():
            plain = Plain()
            plain.feed(r.html or "")
            plain.close()
            lines = [re.sub(r"^\s*(?:- |\d+\. )", "", line) for line in page_text(r.html).split("\n")]
            assert "".join("".join(lines).split()) == "".join("".join(plain.out).split()), r.html[:500]


def test_alignment_ends_at_a_column_whatever_the_size_of_the_table():
    wide = "w" * 3000
    for rows in (1, 20_000):
        lines = page_text(f"<table><tr><td>{wide}<td>a" + "<tr><td>b<td>c" * rows + "</table>").split("\n")
        assert lines[0] == wide + "  a" and set(lines[1:]) == {"b" + " " * 1999 + "  c"} and len(lines) == rows + 1


@pytest.mark.parametrize(
    "html, text",
    [
        ("a<b hidden>b<div>c</b>d", "a\nd"),
        ("a<b hidden><div>b<div>c</b>d</div>e</div>f", "a\nd\ne\nf"),
        ("a<b hidden>" + "<div>b" * 8 + "</b>d", "a\nd"),
        ("a<b hidden>" + "<div>b" * 12 + "</b>d</b>e" + "</div>" * 12 + "f", "a\ne\nf"),
        ("a<b hidden><i hidden>x<div>c</b>d</i>e", "a\ne"),
        ("a<b hidden><i style='x:y'>x<div>c</b>d</i>e", "a\nde"),
    ],
)
def test_what_follows_a_formatting_end_tag_inside_open_blocks(html, text):
    assert page_text(html).replace("\n\n", "\n") == text


def test_extract(spark):
    rows = [(1, "u", "<p>x</p>"), (None, None, None), (2, "u", ""), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text")
    assert sorted(((r.page_id, r.text) for r in extract(pages).collect()), key=str) == [(1, "x"), (2, ""), (2, ""), (None, "")]
    assert extract(pages.filter("false")).count() == 0
