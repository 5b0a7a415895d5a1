import pytest

from loomline.llm.html_text import page_text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<head><title>T</title>Hello<br>world <p>x", "Hello\nworld\n\nx"),
        ("<head><meta charset=utf-8> <link rel=x><title>T</title>\n<img alt=logo>after", "logo after"),
        ("<head><title>T</title><hr>a", "a"),
        ("<head><title>T</title><svg><title>no</title><text>one</text><text>two</text></svg>", "one two"),
        ("<head><title>T</title><textarea>typed</textarea>", "typed"),
        ("x = <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>tex</annotation></math>!", "x = a+b!"),
        ("<svg><defs><text>no</text></defs><text>label</text></svg>", "label"),
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c<img alt=d></div>e", "b\ne"),
        ("<ul><li style='visibility:hidden'>a<li>b</ul>", "- b"),
        ("<div style='display:none'>a<b style='visibility:visible'>b</b></div>c", "c"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>long<td rowspan=2>x<td>y<tr><td>p<td>q</table>", "long  x  y\np        q"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c</tbody><tbody><tr><td>d<td>e</tbody></table>", "a  b\n   c\nd  e"),
        ("<table><tr><td rowspan=3>a<td>b<tr><td><tr><td>c</table>", "a  b\n   c"),
        ("<input value=typed> <input type=hidden value=no> <input type=checkbox value=no> <input type=password value=no> <input placeholder=hint>", "typed hint"),
        ("<input type=submit value=Go><button>Press</button>", "Go Press"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<details><summary>s</summary>no<p>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<style>.gone{display:none}</style><p class='x gone'>a<p class=x>b", "b"),
        ("<style>#i, b.c { color: red; DISPLAY : none } i{visibility:hidden}</style><p id=i>a</p><b class=c>b</b><b>c</b><i>d</i>", "c"),
        ("<style>p{display:none}p.on{display:block}</style><p>a<p class=on>b", "b"),
        ("<style>.x{display:none!important}.x.y{display:block}</style><p class='x y' style='display:block'>a</p>b", "b"),
        ("<style>@media print{.m{display:none}} .n{display:none} nav .q{display:none}</style><p class=m>a<p class=n>b<p class=q>c", "a\n\nc"),
        ("<style media=print>.m{display:none}</style><p class=m>a", "a"),
        ("<style>/* .m{display:none} */ .n{display:none</style><p class=m>a<p class=n>b", "a"),
        ("<style>div{display:block}</style><div hidden>a</div><p hidden>b", "a"),
        ("<body><p class=z>a<style>.z{display:none}</style><p>b", "b"),
        ("<ol start=0><li>a<li>b</ol>", "0. a\n1. b"),
        ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol type=a start=26><li>a<li>b</ol><ol type=I start=4><li>c</ol>", "z. a\naa. b\n\nIV. c"),
        ("<b>one<div>two</b>three</div>four", "one\ntwothree\nfour"),
        ("<b hidden>one<div>two</b>three</div>four", "three\nfour"),
        ("<b hidden>one<i>x<div>two<p>in</b>three</div>four", "three\n\nfour"),
        ("<span>one<div>two</span>three</div>four", "one\ntwothree\nfour"),
        (f"<table><tr><td>{'w' * 90}<td>a<tr><td>b<td>c</table>", f"{'w' * 90}  a\n{'b':90}  c"),
        ("<table><tr><td colspan=2>a wide one<td>x<tr><td>a<td>b<td>y</table>", "a wide one  x\na  b        y"),
        ("<progress>no</progress><meter>no</meter>yes<ruby>a<rp>(</rp><rt>b</rt></ruby>", "yesab"),
    ],
)
def test_visible_text(html, text):
    assert page_text(html) == text
