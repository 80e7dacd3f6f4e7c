import html as htmllib
import re
import time

import pytest

from quarry.llm.html import extract, main_text

LONG = "Here is a sentence of the story, with a comma, that goes on for a while. "
CASES = {
    "blocks": ("<body><article><h1>T</h1><p>One  two\n three</p><p>Four<b>five</b> six</p></article></body>", "T One two three Fourfive six"),
    "references": (f"<article><p>{LONG}A &amp; B &eacute; &#x4e2d; &lt;b&gt; x&nbsp;y</p></article>", f"{LONG}A & B é 中 <b> x y"),
    "open tags": ("<article><p><b>A one.<br><p>B two.</p><p><b>C<br></article><footer>f</footer>", "A one. B two. C"),
    "notices": (f"<div class='cookie-notice'><p>{LONG}</p></div><header><p>{LONG}</p></header><main><p>{LONG}</p><aside>{LONG}</aside><form><p>{LONG}</p></form></main><div id=comments><p>{LONG * 9}</p></div>", LONG.strip()),
    "divs": (f"<div class=menu><a href=x>one</a></div><div><div class=content><p>{LONG}</p><p>{LONG}</p><ul><li>a, b</li></ul></div><div class=sidebar>{LONG * 3}</div></div>", f"{LONG}{LONG}a, b"),
    "scripts": (f"<article><script>var t='</p><p>{LONG}';</script><style>p{{}}</style><!-- <p>no</p> --><p>yes, it is</p><noscript>no</noscript></article>", "yes, it is"),
    "hidden": (f"<article><p hidden>{LONG}</p><p style='display: none'>no</p><p>shown</p></article>", "shown"),
    "link list": (f"<article><p>{LONG}</p><ul><li><a href=a>a first other story</a></li><li><a href=b>a second other story</a></li></ul></article>", f"{LONG}a first other story a second other story"),
    "link list beside": (f"<div><p>{LONG}</p><p>{LONG}</p><ul><li><a href=a>a first other story</a></li><li><a href=b>a second other story</a></li></ul></div>", f"{LONG}{LONG.strip()}"),
    "sections": (f"<article><section><p>{LONG}</p></section><section><p>{LONG}</p></section><div><p>end</p></div></article>", f"{LONG}{LONG}end"),
    "plain": ("just words, no tags", "just words, no tags"),
    "cut off": ("<article><p>word <a hre", "word"),
    "comments in the article": (f"<article><p>{LONG}</p><div class='comments'><article class='comment'><p>{LONG * 5}</p></article></div></article>", LONG.strip()),
    "nothing": ("<html><nav><a>x</a></nav></html>", ""),
    "less than": ("<p>1 < 2, and 3 > 2</p>", "1 < 2, and 3 > 2"),
}


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    page, want = CASES[case]
    assert main_text(page) == want


def test_deep_and_long():
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(main_text("<p>" + "word " * 200_000)) == 999_999
    assert main_text("<" * 3000) == "<" * 3000


def test_every_page(spark):
    """On these pages, the article element is the article; only p and h1 are blocks in it."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>|<br>", body)
        text = " ".join(" ".join(htmllib.unescape(re.sub(r"<[^>]*>", "", b)) for b in blocks).split())
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text)


def test_odd_rows(spark):
    rows = [(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<p>hi</p>", None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [tuple(r) for r in got] == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "hi", 2)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("unit", ["<x y ", "a <b c ", "<div>a, ", '<p>a "b" <i', "</b>", "<a href='", "<li>x", "<span>", "</section>x<span>", "<td>", '<b title="x>', '<div x="', "<article><div>z,</section>", "<script>", "<ul><li><a href=q>t</a>"])
def test_time_is_linear(unit):
    page = (unit * (1_000_000 // len(unit) + 1))[:1_000_000]
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 4  # about 1 s; quadratic steps would take minutes


def test_siblings_of_the_container():
    long = "A sentence, with commas, that goes on for a while and says something of use. " * 6
    page = f"<body><div><h1>Title</h1><div><p>{long}</p><p>{long}</p></div><p>Short end.</p><p><a href=x>Other</a></p></div></body>"
    assert main_text(page) == " ".join(["Title", long.strip(), long.strip(), "Short end."])
    links = "".join(f"<li><a href=x{i}>A reference with a title {i}</a></li>" for i in range(9))
    assert main_text(f"<article><p>{long}</p><ul>{links}</ul></article>").endswith("A reference with a title 8")


def test_names_that_change_length_in_lower_case():
    assert main_text("<article><p>İİİİ one</p><SCRIPT>x</p></scripty></ScRiPt ><p>two</p></article>") == "İİİİ one two"
