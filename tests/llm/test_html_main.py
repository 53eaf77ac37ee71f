import html
import re

from tidewater.llm.html_main import extract, main_text, op10_html_main_text, parse, path_hash

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{color:red}</style><script>var t="</p><article>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad banner">Buy now, really, buy it now please</div>
<article><h1>Head &amp; line</h1><p><b>First&nbsp;par<br>two<p>Second <a href=x>link</a> text with more words in it
and   lines</p><div class="share">Share me</div><ul><li>one<li>two</ul><form><input><p>Sign up</p></form></article>
<aside><p>Related stories are here and here and here</p></aside><div id="comments"><p>Reader says a long thing that isn't the article at all</p></div>
<footer>&copy; site</footer></body></html>"""


def test_article_only():
    assert extract(PAGE) == "Head & line\n\nFirst par two\n\nSecond link text with more words in it and lines\n\none\n\ntwo"


def test_winning_path_beats_own_best():
    page = '<html><body><div class="alpha"><p>short one</p></div><div class="story"><p>the story</p></div><div class="beta"><p>a far longer block that would win here</p></div></body></html>'
    story = next(n.path for n in parse(page)[0] if n.path.endswith("story"))
    assert extract(page, path_hash(story)) == "the story"
    assert extract(page, 12345) == extract(page) == "a far longer block that would win here"


def test_nested_body_headline_and_sections():
    long, more = "the long body of the story " * 20, "another long part of it " * 15
    nested = f"<article><h1>Head</h1><p>standfirst</p><div class='entry'><p>{long}</p></div></article>"
    whole = f"Head\n\nstandfirst\n\n{long.strip()}"
    around = "<html><body><div class='col'><p>a box beside the story</p></div>{}</body></html>"
    assert extract(around.format(nested)) == whole
    assert extract(around.format(nested.replace("article>", "main>"))) == whole
    assert extract(around.format(f"<main><p>teaser line</p>{nested}</main>")) == whole
    assert extract(around.format(nested.replace("<article>", "<div class='story'>").replace("</article>", "</div>"))) == whole
    sections = f"<article><h1>Head</h1><section class='intro'><p>{more}</p></section><section class='body'><p>{long}</p></section></article>"
    assert extract(around.format(sections)) == f"Head\n\n{more.strip()}\n\n{long.strip()}"
    beside = f"<div class='page'>Here<div class='col'><p>a box</p></div><div class='entry'><p>{long}</p></div></div>"
    assert extract(around.format(beside)) == long.strip()


def test_host_with_nested_bodies(spark):
    page = "<body><article><h1>Head {0}</h1><p>standfirst</p><div class='entry'><p>{1}</p></div></article></body>"
    rows = [(i, "http://n.example/x", page.format(i, "the long body of the story " * (1 if i == 3 else 20))) for i in range(4)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"].startswith(f"Head {r['page_id']}\n\nstandfirst\n\nthe long body") for r in got) and len(got) == 4


def test_edges():
    assert extract(None) == extract("") == extract("<nav>only menu</nav>") == ""
    assert extract("plain text") == "plain text"
    assert extract("<p>never closed") == "never closed"
    assert extract("</div></p><p>stray</p></article>") == "stray"
    assert extract("<div><p>a &lt;b&gt; &#233; &unknown;</p></div>") == "a <b> é &unknown;"
    assert extract("<!-- <p>no</p> --><p>yes</p>") == "yes"
    assert extract('<p>a <a title="x > y" href=z>link</a> b</p>') == "a link b"
    assert extract("<p>it's <b title=\"never closed>bold</b> text</p>") == "it's bold text"
    assert extract("<p>kept</p> tail <b") == "kept\n\ntail"
    for bad in ('<a href="' * 30_000, "<!--" * 30_000, "<script>" * 20_000, "<" * 100_000, "<a '" * 30_000 + ">", "<div>" * 20_000 + "x"):
        assert extract("<p>first</p>" + bad).startswith("first") or "div" in bad
    big = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert extract(big).count("word") == 20_000


def test_left_out_end_tags():
    assert extract("<html><head><title>T</title><meta charset=x><body><p>one</p><p>two</p>") == "one\n\ntwo"
    assert extract("<head><title>T</title><p>no body tag</p>") == "no body tag"
    assert extract("<p>a</p><select><option>x</select><p>b</p><div><p>c</p></div>") == "a\n\nb\n\nc"
    assert extract("<p>a</p><select><option>x<option>y<p>b</p>") == "a\n\nb"
    assert extract("<div><textarea><div>typed</textarea><p>after</p></div>") == "after"
    assert extract("<p>a</p><button><div>press</button><p>b</p>") == "a\n\nb"


def test_inline_elements_are_left_out():
    page = '<p>Hi <button>Share this</button> there</p><p><svg viewBox="0"><title>Icon</title><text>x</text></svg>Text <noscript>Enable JS</noscript>more<textarea>typed</textarea></p><button>Subscribe</button>'
    assert extract(page) == "Hi there\n\nText more"


def test_names_that_hold_a_mark():
    for name in ('class="layout has-sidebar"', 'class="no-comments"', 'id="search-results-explained"', 'class="share-price"', 'class="adventure"', 'class="navy"'):
        assert extract(f"<div {name}><article><p>the story</p></article></div>") == "the story", name
        assert extract(f"<div><p {name}>the story</p></div>") == "the story", name
    for name in ('class="site-header"', 'id="comment-list"', 'class="x share"', 'role="navigation"', 'class="related_articles"', 'class="cookie-notice top"'):
        assert extract(f"<div {name}><p>not the story, long as it may be</p></div><div><p>the story</p></div>") == "the story", name
    assert extract('<div class="banner"><article><p>the story</p></article></div>') == "the story"
    reader = '<div id="comments"><article><p>a reader says more than the story does, much more</p></article></div>'
    assert extract(f"<article><p>the story</p></article>{reader}") == "the story"


LONG = "Long paragraph of prose that says something about nothing in many words. " * 4


def test_no_mark_hides_most_of_a_page_without_an_article():
    want = LONG.strip()
    for page in (
        f'<body><div class="main-content tags"><p>{LONG}',
        f'<div class="post social"><p>{LONG}</div><div class="foot"><p>x',
        f'<body><form id="aspnetForm"><div class="nav">one two</div><div class="content"><p>{LONG}',
        f'<form><table><tr><td class="sidebar">a<td><p>{LONG}</table></form>',
        f'<div class="no-comments has-sidebar"><p>{LONG}',
    ):
        assert extract(page) == want, page
    assert extract(f'<div><p>{LONG}</p></div><form><p>{LONG}</form>') == want  # a form as large as the text stays out
    assert extract(f'<article><p>short</p></article><div id="comments"><p>{LONG * 5}</div>') == "short"


def test_composed_names_are_marks():
    for name in ("advertorial", "ad-container-300x250", "google-ad", "promo-box-wide", "js-ad", "adbox", "newsletter-signup-form", "comments-thread", "sponsored-by-x"):
        assert extract(f'<div class="c"><p>{LONG}</p><div class="{name}"><p>LEAK {LONG[:140]}</div></div>') == LONG.strip(), name
        assert extract(f'<article><p>{LONG}</p><section id="{name}"><p>LEAK</section></article>') == LONG.strip(), name


def test_containers_side_by_side():
    intro = f'<div class="story"><div class="intro"><p>INTRO {LONG}</div><div class="body"><p>BODY {LONG}</div></div>'
    assert extract(f"<body>{intro}<div><p>below</p></div>") == f"INTRO {LONG.strip()}\n\nBODY {LONG.strip()}"
    assert extract(f'<div id="c"><h1>T</h1><section><p>{LONG}</section><section><p>{LONG}</section></div>') == f"T\n\n{LONG.strip()}\n\n{LONG.strip()}"
    links = "".join(f'<li><a href="{k}">another story to read {k}</a></li>' for k in range(9))
    assert extract(f'<div class="page"><div class="text"><p>{LONG}</div><div class="rail"><ul>{links}</ul></div></div>') == LONG.strip()
    assert extract(f'<div class="page"><div class="text"><p>{LONG}</div><div class="rail"><p>short note</p></div></div>') == LONG.strip()


def test_open_navigation_hides_nothing():
    assert LONG.strip() in extract(f'<body><nav><a href="x">home</a><div><p>{LONG}</div></body>')
    assert extract(f'<nav><a href="x">home</a></nav><div><p>{LONG}</div>') == LONG.strip()
    assert LONG.strip() in extract(f'<div><header><h1>t</h1></div><div><p>{LONG}</div>')


def test_frame_votes_nulls_and_repeats(spark):
    tpl = '<html><body><div class="side{0}"><p>{1}</p></div><div class="main{0}"><p>{2}</p></div></body></html>'
    rows = [(i, "http://h.example/x", tpl.format(i, "menu words", "body text of the page " * 3), "t") for i in range(5)]
    rows += [(9, "http://h.example/y", tpl.format(9, "an unusually long side box on this one page " * 3, "body"), "t"), (10, None, "<p>no host</p>", "t"), (11, "http://h.example", None, "t"), (11, "http://h.example", None, "t")]
    got = sorted((r["page_id"], r["text"]) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert (9, "body") in got and (10, "no host") in got and got.count((11, "")) == 2
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table_against_the_articles(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op10_html_main_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.sub("<br>", " ", re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1])
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])
