import html
import re

from recallspark.llm import html_text

PARAGRAPH = "a sentence of an article that says something at some length " * 4


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_pages_give_their_article_blocks(spark):
    rows = html_text.op4_html_main_text(spark, "/root/testdata/sf0.01").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S).group(1).split("<footer")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|article|body|html)[^>]*>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_boilerplate_goes_and_short_blocks_stay():
    text = html_text.main_text(page(
        f"<nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'>{PARAGRAPH}</div><article><header><h1>Title</h1><p>by line</p></header><p>{PARAGRAPH}<p>short<br>line &amp; more&nbsp;x"
        f"<script>var t = '</p>';</script><form>name <input></form><aside>{PARAGRAPH}</aside><p>{PARAGRAPH}</article><section class=comments><article><p>{PARAGRAPH}</article></section><footer>foot</footer>"
    ))
    one = " ".join(PARAGRAPH.split())
    assert text == f"Title\n\n{one}\n\nshort line & more x\n\n{one}"


def test_no_article_element():
    one = " ".join(PARAGRAPH.split())
    text = html_text.main_text(page(f"<div id=menu><a href=a>A</a><a href=b>B</a></div><div class='content'><h2>Head</h2><p>{PARAGRAPH}</p><p>tiny</p><p>{PARAGRAPH}</p></div><div class=sidebar><p>{PARAGRAPH}</p></div>"))
    assert text == f"Head\n\n{one}\n\ntiny\n\n{one}"


def blocks(body):
    return html_text.main_text(page(body)).split("\n\n")


ONE = " ".join(PARAGRAPH.split())
MENU = "<ul><li><a href=a>Home page</a><li><a href=b>News of today</a><li><a href=c>Contact us</a></ul>"


def test_layout_words_are_no_boilerplate():
    assert blocks(f"<nav>{MENU}</nav><div class='main-content has-sidebar'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><footer>f</footer>") == [ONE] * 2
    assert blocks(f"<div class='content-sidebar-wrap'><div class=text><h2>Head</h2><p>{PARAGRAPH}<p>x</div><div class=sidebar><p>{PARAGRAPH}</div></div>") == ["Head", ONE, "x"]
    assert blocks(f"<div id=widget-1><p>{PARAGRAPH}</p><p>tiny</p></div>") == [ONE, "tiny"]
    assert blocks(f"<div class=ad-page><article><h1>T</h1><p>{PARAGRAPH}</article></div>") == ["T", ONE]


def test_parts_of_an_article_stay():
    refs = "<ul>" + "".join(f"<li><a href={k}>Reference number {k}</a></li>" for k in range(3)) + "</ul>"
    assert blocks(f"<article><h1>T</h1><h2 id=search-results>Results</h2><p>{PARAGRAPH}</p><section id=discussion><h2>Discussion</h2><p>{PARAGRAPH}</p></section>{refs}</article>") == ["T", "Results", ONE, "Discussion", ONE, *(f"Reference number {k}" for k in range(3))]
    assert blocks(f"{MENU}<div class=text><h2>Head</h2><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div class=warning><p>Never open the lid while it is hot.</p></div><p>{PARAGRAPH}</p>{refs}</div>") == ["Head", ONE, ONE, "Never open the lid while it is hot.", ONE, *(f"Reference number {k}" for k in range(3))]
    assert blocks(f"<article><p>{PARAGRAPH}</p><div class='related tags'><a href=x>one</a> <a href=y>two</a></div><div class=newsletter-signup><p>{PARAGRAPH}</p></div><p>{PARAGRAPH}</p></article>") == [ONE, ONE]


def test_sibling_articles_and_comments():
    assert blocks(f"<div><article><p>{PARAGRAPH}</article><div class=ad><p>{PARAGRAPH}</div><article><h2>Two</h2><p>{PARAGRAPH}</article></div>") == [ONE, "Two", ONE]
    comments = "".join(f"<article class=comment><p>{PARAGRAPH}</article>" for _ in range(9))
    assert blocks(f"<div class=story><h1>T</h1><p>{PARAGRAPH}</p></div><section id=comments>{comments}</section>") == ["T", ONE]
    assert html_text.main_text(page(f"<section id=comments>{comments}</section>")) == ""


def test_unclosed_marked_blocks_end_with_the_next():
    assert blocks(f"<article><p class=ad>Buy now<p>{PARAGRAPH}<ul><li class=promo>Cheap<li>point one<li>point two</ul></article>") == [ONE, "point one", "point two"]


def test_deep_pages_take_linear_time():
    html_text.main_text("<div class=ad>" * 20_000 + f"<h1>x</h1><p>{PARAGRAPH}</p>" * 2000)


def test_odd_input(spark):
    odd = [None, "", "   ", "plain words", "<![foo bar <p>x</p>", "<p>unclosed <b>bold", "<div>" * 3000 + "deep", "<a" * 2000, "&lt;b&gt; &#x41; &bogus;", "<script>only</script>", "<p>\x00nul</p>"]
    df = spark.createDataFrame([(k, "u", h, 5) for k, h in enumerate(odd)] * 2, "page_id long, url string, html string, n_chars int")
    rows = html_text.extract(df).collect()
    assert len(rows) == 2 * len(odd)
    got = {r.page_id: r.text for r in rows}
    assert got[0] == got[1] == got[2] == got[9] == "" and got[3] == "plain words" and got[5] == "unclosed bold" and got[6] == "deep" and got[8] == "<b> A &bogus;"
    assert html_text.extract(df.limit(0)).collect() == []


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "u", "<p>words of a page</p>", "kept")], "page_id int, url string, html string, _html string")
    assert [tuple(r) for r in html_text.extract(df, keep=("url", "_html")).collect()] == [(1, "u", "kept", "words of a page", 15)]


BODY = "".join(f"<p>Paragraph {k} of the article tells at some length what happened on that day and why it matters.</p>" for k in range(6))
KEPT = "\n\n".join(f"Paragraph {k} of the article tells at some length what happened on that day and why it matters." for k in range(6))


def test_pages_that_are_one_form():
    nav = "<nav><a href='/'>Home</a></nav>"
    assert html_text.main_text(f"<html><body><form id='aspnet'>{nav}<div><h1>Title</h1>{BODY}</div><input value='x'><button>Send it</button></form></body></html>") == f"Title\n\n{KEPT}"
    assert html_text.main_text(f"<body><form>{nav}<div>{BODY}</div></form></body>") == KEPT
    assert html_text.main_text(f"<body><article><h1>Title</h1>{BODY}</article><form>Tell us what you think of this page: <input></form></body>") == f"Title\n\n{KEPT}"


def test_elements_without_an_end():
    for tag in ("iframe src='x'", "button", "select"):
        assert html_text.main_text(f"<body><article><h1>Title</h1><p>First words of the article, long enough to count.</p><{tag}>{BODY}</article></body>") == f"Title\n\nFirst words of the article, long enough to count.\n\n{KEPT}", tag
    whole = html_text.main_text(f"<body><article><h1>Title</h1><iframe><p>Your browser shows no frames, which is a pity for all of us here.</p></iframe>{BODY}</article></body>")
    assert whole == f"Title\n\n{KEPT}"


def test_names_of_parts_inside_an_article():
    page = "<body><article><h1>Title</h1><p>First of all this is an opening paragraph which says what the page is about.</p><section class='social-history'><p>The social history of the town is told in this long section of it.</p></section><div class='newsletter-archive'><p>The archive of the newsletter is described in this long paragraph.</p></div>{}<div class='share-buttons'><a href='#'>Share this</a></div><div class='ad'>Buy now</div></article></body>"
    first = "First of all this is an opening paragraph which says what the page is about."
    assert html_text.main_text(page.format(BODY)) == f"Title\n\n{first}\n\nThe social history of the town is told in this long section of it.\n\nThe archive of the newsletter is described in this long paragraph.\n\n{KEPT}"


def test_hostile_pages_take_linear_time():
    import time

    unit = ["<a href='", "<a href='x>", "<!-- ", "<![", "<div class=\"", "&#x", "</", "<p><a b='"]
    for x in unit:
        html = f"<body><article><h1>Title</h1>{BODY}" + x * (1_000_000 // len(x)) + ">"
        began = time.time()
        text = html_text.main_text(html)
        assert time.time() - began < 6, x
        assert "Paragraph 3 of the article" in text or x == "&#x", x
