import html
import random
import re
import time

import pytest

from tabassay.llm.main_text import contents, extract_main_text, main_text, measure, parse
from tabassay.llm.queries import op7_html_extraction

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header>
<div id=menu><a href=x>Home</a></div><div class="cookieNotice">We use cookies for all you do.</div>
<div class=content><h1>Title &amp; x</h1><section><p>First with <a href=y>a link</a> in text that
is long enough.<p>Second&nbsp;  text<br>here</section><section><p>Third long paragraph of it.</p>
</section><form>Sign <input></form><div class=comments><p>A very long reader comment with much
more text in it than anything else on this page has.</div></div><aside>Side</aside>
<script>var a = "<p>no</p>";</script><footer>F</footer></body></html>"""


def test_page_without_article():
    assert main_text(PAGE).split("\n") == [
        "Title & x",
        "First with a link in text that is long enough.",
        "Second text here",
        "Third long paragraph of it.",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"),
        ("<div title='a>b'>x</div>", "x"), ("<script>x", ""), ("a < b and c > d", "a < b and c > d"),
        ("<article></article>", ""), ("<p>&lt;b&gt; &am &copy x&#233;</p>", "<b> &am © xé"),
        ("<ul>" + "<li><ul>" * 3000 + "deep", "deep"), ("<!-- a --><p>b<!-- c", "b"),
        ("<nav>only a menu</nav>", ""), ("<p hidden>a</p><p>b</p>", "b"),
        ("<article><p>a a</p><div class='ad'>buy</div><p>b b</p></article><p>c</p>", "a a\nb b"),
    ],
)
def test_small_pages(page, text):
    assert main_text(page) == text


LONG = "Text of the article that goes on for a while, with enough words to be dense."
MORE = "Another paragraph of the same article, which is as long as the first one was."


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (f"<article><p>{LONG}</article><article><p>{MORE}</article>", [LONG, MORE]),
        (f"<article><p>Short one</article><article><p>{MORE}</article>", ["Short one", MORE]),
        (
            f"<main><h1>Head</h1><p>Lead</p><article><p>{LONG}<p>{MORE}</article></main>",
            ["Head", "Lead", LONG, MORE],
        ),
        (f"<div class='content no-sidebar'><p>{LONG}<p>{MORE}</div><div>&copy; x</div>", [LONG, MORE]),
        (
            f"<article><p>{LONG}<section class='related-work'><p>{MORE}</section></article>",
            [LONG, MORE],
        ),
        (
            f"<article><p>{LONG}</p><ul class=related><li><a href=a>a b</a><li><a href=b>c</a></ul>"
            f"<p>{MORE}</article>",
            [LONG, MORE],
        ),
        (f"<div id=comments-page><p>{LONG}<p>{MORE}</div>", [LONG, MORE]),
        (
            f"<h2>Head</h2><div><p>{LONG}<p>{MORE}</div><div id=commentList><p>{LONG}{LONG}<p>{MORE}</div>",
            ["Head", LONG, MORE],
        ),
        (f"<div><p>{LONG}<p>{MORE}</div><article>teaser</article>", [LONG, MORE]),
    ],
)
def test_whole_articles_stay(page, lines):
    for body in (page, f"<nav><a href=/>Home</a></nav>{page}<footer>{MORE}</footer>"):
        assert main_text(body).split("\n") == lines


def test_built_pages():
    """Pages put together from known parts: what was put in as the article comes out."""
    rng = random.Random(9)
    said = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    link = lambda: f"<a href='/{rng.randrange(9)}'>{said(2)}</a>"
    for _ in range(200):
        lines, parts = [], []
        for k in range(rng.randint(2, 7)):
            text = said(rng.randint(15, 60))
            tag = rng.choice(["p", "p", "blockquote", "h3", "section"])
            inner = text if rng.random() < 0.7 else text.replace(" ", " <b>", 1) + "</b>"
            parts.append(f"<{tag}>{inner}</{tag}>")
            lines.append(text)
            noise = [
                f"<aside>{said(9)}</aside>", f"<div class='ad-box {k}'>{said(30)}</div>",
                f"<form>{said(5)}<input></form>", f"<script>{said(40)}</script>", "",
                f"<div class=related>{link()}{link()}</div>",
            ]
            parts.append(rng.choice(noise))
        around = rng.choice(["article", "main", "div", "div class='page has-sidebar'"])
        body = f"<{around}>{''.join(parts)}</{around.split()[0]}>"
        if rng.random() < 0.5:
            body = f"<div id=wrap>{body}</div>"
        before = f"<header><h1>{said(3)}</h1></header><nav>{link()}{link()}</nav>"
        after = f"<section id=user-comments><p>{said(80)}</p></section><footer>{said(12)}</footer>"
        assert main_text(f"<html><body>{before}{body}{after}</body></html>").split("\n") == lines


def test_deep_pages_take_time_in_proportion():
    def seconds(n):
        start = time.perf_counter()
        main_text("<div>" * n + "</p>" * n + "<p>" + "<b>" * n + "<div>" * 20 + "x")
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 40 * seconds(2000)


def test_densest_node_holds_the_text():
    root = parse(PAGE)
    assert max(measure(root), key=lambda n: n.density).chars > 0
    assert contents(root)


def plain(page):
    """The article of a given page by plain patterns."""
    article = re.search("<article>(.*?)</article>", page, re.S)[1]
    lines = (html.unescape(re.sub("<br>|</?b>", " ", x)) for x in re.split("</?(?:p|h1)>", article))
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def test_query(spark, data):
    found = {r.page_id: r for r in op7_html_extraction(spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        one = found[page.page_id]
        assert (one.url, one.text, one.n_chars) == (page.url, plain(page.html), len(one.text))


def test_tables(spark):
    rows = [(1, None, "u", "z"), (1, None, "u", "z"), (None, "<p>a", None, "z"), (2, "<p>" * 2, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    found = extract_main_text(pages)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(
        map(repr, [(1, "u", ""), (1, "u", ""), (None, None, "a"), (2, "u", "")])
    )
    assert extract_main_text(pages.filter("false")).count() == 0
