import random
from html.parser import HTMLParser

import pytest

from helixframe.llm.html_extract import extract, main_text

LONG = "This is a sentence, with commas, that is long enough to count as text."


def test_article():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
    <nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">{LONG}</div>
    <article><h1>Head &amp; tail</h1><p><b>{LONG}<br><p>Fish&nbsp;&lt;chips&gt;
      <a href='x>y'>link</a></p><form>login</form><p>Short.</p><aside>{LONG}</aside></article>
    <section id="comments"><p>{LONG}</p></section><footer>&copy; x</footer>"""
    assert main_text(page) == f"Head & tail\n\n{LONG}\n\nFish <chips> link\n\nShort."


def test_without_article_element():
    page = f"<div class=wrap><div class=header>Site</div><div class=content><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><ul><li>point</li></ul></div><div class=sidebar><p>{LONG}</p></div><div id=cookie-notice>We use cookies</div><div class='links'><a href=1>{LONG}</a> <a href=2>{LONG}</a></div></div>"
    assert main_text(page) == f"Title\n\n{LONG}\n\n{LONG}\n\npoint"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<script>x") == main_text("<!-- never ends") == ""
    assert main_text("just  text") == "just text"
    assert main_text("a < b & c") == "a < b & c"
    assert main_text("<p>" * 3000 + LONG) == LONG
    assert main_text("<div>" * 3000 + LONG) == LONG
    assert main_text(f"<nav>menu<article><p>{LONG}</p></article>") == LONG
    assert LONG in main_text(f"<table><tr><td>{LONG}<td>{LONG}</table>")


def test_operator(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>"), (None, None, None), (1, "u", f"<p>{LONG}</p>")], "page_id long, url string, html string").selectExpr("*", "'x' as text", "3 as n_chars")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(df).collect())
    assert got == [(0, "", 0), (1, LONG, len(LONG)), (1, LONG, len(LONG))]
    assert extract(df.limit(0)).count() == 0


KEPT = [
    (f"<p class=a'>{LONG}</p><p>x y</p>", f"{LONG}\n\nx y"),
    (f"<p title='don't'>{LONG}</p>", LONG),
    (f'<p class="a>{LONG}</p><p>{LONG}</p>', f"{LONG}\n\n{LONG}"),
    (f"<p data-x=a=b\"c>{LONG}</p>", LONG),
    (f"<p a = 'x > y' b>{LONG}</p>", LONG),
    (f"<!-->{LONG}<!-- gone -->", LONG),
    (f"<!--->{LONG}<!-- gone --!><p>end", f"{LONG}\n\nend"),
    (f"<![CDATA[{LONG}]]>", LONG),
    (f"<?php x ?>{LONG}", LONG),
    ("Hello <b", "Hello"),
    ("Hello </b", "Hello"),
    ("Hello <!-- b", "Hello"),
    ("a <3 b", "a <3 b"),
    ("1 < 2 <", "1 < 2 <"),
    ("&amp;lt; &#65;&#x42;&bogus; &copy", "&lt; AB&bogus; ©"),
    (f"<article><p>{LONG}</p><p class='promotion'>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    (f"<article><section class='social-history'><p>{LONG}</p></section><p>b</p></article>", f"{LONG}\n\nb"),
    (f"<article><div class='share'><a href=1>Share this on a network of many people</a></div><p>{LONG}</p></article>", LONG),
    (f"<article><div class='ad-slot'>{LONG}</div><p>{LONG}</p></article>", LONG),
    (f"<article class='post comments-open'><p>{LONG}</p></article>", LONG),
    (f"<article><header class='article-header'><h1>T</h1></header><p>{LONG}</p></article>", f"T\n\n{LONG}"),
    (f"<article><p>{LONG}</p><div class='comment-list'><p>{LONG}</p></div></article>", LONG),
    (f"<fieldset><p>{LONG}</p><p>{LONG}</p></fieldset>", f"{LONG}\n\n{LONG}"),
    (f"<form action=x><div><p>{LONG}</p><p>{LONG}</p></div></form><p>Short.</p>", f"{LONG}\n\n{LONG}"),
    (f"<form><input name=a><label>Name</label><button>Go</button></form><p>{LONG}</p>", LONG),
    ("<form><label>Name</label><button>Go</button></form>", ""),
    (f"<fieldset><article><p>{LONG}</p></article></fieldset>", LONG),
    (f"<article><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></article>", f"{LONG}\n\nOne\n\nTwo\n\nThree"),
    (f"<div><p>{LONG}</p><p>{LONG}</p><ol><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ol></div>", f"{LONG}\n\n{LONG}\n\nOne\n\nTwo\n\nThree"),
    (f"<div><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
    (f"<main><h2>T</h2>{'<div>' * 9}<p>{LONG}</p>{'</div>' * 9}<p>b</p></main>", f"T\n\n{LONG}\n\nb"),
    (f"<div hidden><p>{LONG}</p></div><div><p>{LONG}!</p></div>", f"{LONG}!"),
    (f"<div style='display: none'><p>{LONG}</p></div><div><p>{LONG}!</p></div>", f"{LONG}!"),
    (f"<div role=navigation><p>{LONG}</p></div><div><p>{LONG}!</p></div>", f"{LONG}!"),
    (f"<div id=siteFooter><p>{LONG}</p></div><div><p>{LONG}!</p></div>", f"{LONG}!"),
    (f"<header><p>{LONG}</p></header><article><p>{LONG}!</p></article>", f"{LONG}!"),
    (f"<aside><p>{LONG}</p></aside><div><p>{LONG}!</p></div>", f"{LONG}!"),
    (f"<article><p>{LONG}</p><aside><p>{LONG}</p></aside></article>", LONG),
    (f"<noscript><p>{LONG}</p></noscript><div><p>{LONG}!</p></div>", f"{LONG}!"),
    (f"<textarea><article>{LONG}</textarea><div><p>{LONG}!</p></div>", f"{LONG}!"),
    (f"<SCRIPT>if (a<b) x='</p>'</SCRIPT ><DIV><P>{LONG}</DIV>", LONG),
    (f"<dl><dt>Word<dd>{LONG}<dt>Other<dd>{LONG}</dl>", f"Word\n\n{LONG}\n\nOther\n\n{LONG}"),
    (f"<table><tr><td>{LONG}<td>b<tr><td>c</table>", f"{LONG}\n\nb\n\nc"),
    (f"<p>{LONG}<p>a<br>b<br/>c<hr>d", f"{LONG}\n\na b c\n\nd"),
    (f"<p>a b\n\t c</p><p>{LONG}</p>", f"a b c\n\n{LONG}"),
    (f"</div></p>{LONG}</html></html>", LONG),
    (f"<p>{LONG}<b><i>x</b></i>y</p>", f"{LONG}xy"),
    (f"<article><p>{LONG}", LONG),
    (f"<nav><p>menu</p><article><p>{LONG}</p></article>", LONG),
    (f"<a href=1><p>{LONG}</p></a><p>{LONG}!</p><p>{LONG}!</p>", f"{LONG}\n\n{LONG}!\n\n{LONG}!"),
]


@pytest.mark.parametrize("page,text", KEPT, ids=range(len(KEPT)))
def test_broken_and_plain_pages(page, text):
    assert main_text(page) == text


class Plain(HTMLParser):
    """A slow extractor of another kind for pages with one article: the strings inside it by block, without the parts named in ``gone``."""

    blocks = {"p", "h1", "h2", "li", "ul", "div", "section", "article", "blockquote"}
    gone = {"aside", "form", "nav", "footer", "script", "style"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.away, self.got = False, 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.away += tag in self.gone
        if tag in self.blocks:
            self.got.append("")
        elif tag == "br":
            self.got[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.blocks:
            self.got.append("")
        self.away -= tag in self.gone
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside and not self.away:
            self.got[-1] += data

    def text(self):
        return "\n\n".join(t for t in (" ".join(x.split()) for x in self.got) if t)


def test_against_slow_extractor():
    r = random.Random(4)
    words = lambda a, b: " ".join(r.choice(["fish", "&amp;", "soup,", "&lt;b&gt;", "naïve", "a&#65;", "x"]) for _ in range(r.randint(a, b)))
    for _ in range(300):
        parts = []
        for _ in range(r.randint(1, 8)):
            parts.append(r.choice([f"<p>{words(0, 80)}</p>", f"<h2>{words(1, 5)}</h2>", f"<ul><li>{words(1, 9)}</li><li><a href=1>{words(1, 9)}</a></li></ul>", f"<section><p>{words(5, 50)}<br>{words(1, 5)}</p></section>", f"<aside>{words(9, 60)}</aside>", f"<form>{words(1, 9)}</form>", f"<blockquote>{words(9, 40)}</blockquote>"]))
        page = f"<html><body><nav>{words(1, 20)}</nav><div class=sidebar><p>{words(9, 60)}</p></div><article><p>{words(20, 40)}</p>{''.join(parts)}</article><div id=comments><p>{words(9, 90)}</p></div><footer>{words(9, 50)}</footer></body></html>"
        assert main_text(page) == Plain(page).text()


def test_query_against_slow_extractor(spark):
    from helixframe.llm.q_html_extract import op10_html_extract

    got = op10_html_extract(spark, "/root/testdata/sf0.01")
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = {}
    for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want[x.page_id] = Plain(x.html).text() if "<article" in (x.html or "") else None
    found = {x.page_id: x.text for x in got.collect()}
    assert found.keys() == want.keys()
    differ = [i for i, t in want.items() if t is not None and t != found[i]]
    assert not differ, differ[:5]
    assert sum(t is not None for t in want.values()) > 200


def test_long_and_deep_pages():
    assert main_text("<div>" * 100_000 + f"<p>{LONG}" + "</div>" * 100_000) == LONG
    assert main_text("".join(f"<p>{LONG}</p>" for _ in range(120_000))).count("\n\n") == 119_999


def test_open_quotes_and_deep_stacks_take_time_in_proportion():
    import time

    began = time.perf_counter()
    for n in (5, 8, 12, 50, 3000):
        page = "<p>" + "Words of the page, enough of them, stand here. " * 3 + "</p><div " + "a=bbbbbbbb " * n + 'x="unclosed><p>' + "More words of the page, quite as many, follow. " * 3 + "</p>"
        assert main_text(page).startswith("Words of the page")
    for tag in ("span", "b", "li", "td"):
        deep = "<div>" * 6000 + "<p>Some text.</p>" + f"</{tag}>" * 6000 + f"<{tag}>" * 2000
        main_text(deep)
    assert time.perf_counter() - began < 20
