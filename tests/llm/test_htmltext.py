import html
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peerglyph.llm import htmltext as h

PROSE = "This is a sentence of the article, with some commas, and more words than a menu has."
NAV = '<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>'
PAGE = f"""<!DOCTYPE html><html><head><title>Title</title><style>p{{x:1}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header>{NAV}<div class="cookie-notice">We use cookies, really.</div>
<div id="wrap"><div class="sidebar"><p>{PROSE.replace('article', 'sidebar')}</p></div>
<div class="content"><h2>Heading</h2><p>{PROSE}</p><p>Second   paragraph&nbsp;with &eacute; &amp; &#x4e2d;,<br>a <b>bold</b>word.</p>
<form><p>Subscribe now, please, to our letter, every week.</p></form><div class="ad">Buy this, and that.</div></div>
<div class="comments"><p>{PROSE.replace('article', 'comment')}</p></div></div><footer>&copy; footer, 2024</footer></body></html>"""


def test_article_alone_is_kept():
    assert h.extract(PAGE) == f"Heading {PROSE} Second paragraph with é & 中, a boldword."


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>one", "one"), ("<script>x</script>", ""), ("<!-- open comment", ""), ("<p>a</p><p>b</p>", "a b"), ("a<b>b</b>c", "abc"), ("<p>x < y</p>", "x < y"), ("<nav>only menu</nav>", "")])
def test_small_pages(page, text):
    assert h.extract(page) == text


def test_unclosed_elements_and_end_tags():
    page = f"<article><h1>Head</h1><p><b>{PROSE}<br><p>Next, one.</i></div><ul><li>x<li>y</ul></article><footer>foot"
    assert h.extract(page) == f"Head {PROSE} Next, one. x y"


def test_sections_of_one_article_stay_together():
    page = f"<body>{NAV}<article><section><p>{PROSE}</p><p>{PROSE}</p></section><section><p>Short.</p></section><aside><p>{PROSE}</p></aside></article></body>"
    assert h.extract(page) == f"{PROSE} {PROSE} Short."


def test_siblings_with_prose_are_kept():
    block = f"<div><p>{PROSE}</p><p>{PROSE}</p></div>"
    page = f"<body><div>{block}{block}<div><a href=x>link, one</a> <a href=y>link two</a></div></div></body>"
    assert h.extract(page).count("sentence") == 4 and "link" not in h.extract(page)


def test_pages_of_the_driver(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html_of = {r.page_id: r.html for r in pages.collect()}
    for r in h.extract_pages(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", html_of[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub("<b>", "", re.sub(r"</?(?:p|br|h1)>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)


@given(st.text(alphabet="<>/!-\"'= apbdivscript&;x", max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_read(page):
    assert isinstance(h.extract(page), str)


def test_long_and_deep_pages():
    assert len(h.extract(f"<article>{f'<p>{PROSE}</p>' * 20000}</article>")) == 20000 * (len(PROSE) + 1) - 1
    assert h.extract("<div>" * 20000 + f"<p>{PROSE}</p>") == PROSE


@pytest.mark.parametrize(
    "page",
    [
        "<blockquote>word" * 20_000, "<table><tr><td>x" * 20_000, "<b>" * 20_000 + "<p>x" * 20_000, "<font><p>x" * 20_000, "<ul><li>x" * 20_000, "<span>" * 20_000 + PROSE + "</span>" * 20_000,
        '<a "' * 30_000, "<a x='" * 30_000, "<a x='" * 30_000 + ">", "<a x=\"' " * 30_000 + ">", ('<a x="> ' + "<b y='") * 20_000, "<!-- " * 30_000, "<" * 200_000, "<script>" * 20_000, "<a " + 'x= "' * 50_000 + ">", "<a " * 50_000 + '"">',
        '<div class="' + "ad-x " * 50_000 + '">x', "</b>" * 60_000 + "</p>" * 60_000, "&amp" * 60_000, "<p>x</b>" * 30_000,
    ],
)
def test_deep_and_broken_markup_takes_linear_time(page):
    start = time.process_time()
    assert isinstance(h.extract(page), str)
    assert time.process_time() - start < 5


def test_quotes_hide_tag_ends():
    assert h.extract('<p title="a > b" id=x>one</p>') == "one"
    assert h.extract('<p title="never closed>one</p><p>two') == "one two"
    assert h.extract("""<p it's>one</p> <p x = '<i>'>two""") == "one two"


def test_lists_of_links_inside_an_article_go():
    links = "".join(f'<li><a href="/{k}">Another page of this site</a></li>' for k in range(4))
    page = f'<body><article><p>{PROSE}</p><ul>{links}</ul><ul><li>a point</li><li>a <a href="/x">linked</a> point</li></ul><p>{PROSE}</p></article></body>'
    assert h.extract(page) == f"{PROSE} a point a linked point {PROSE}"


def test_all_articles_of_a_page_are_kept():
    page = f"<body>{NAV}<div>" + f"<article><h2>Head</h2><p>{PROSE}</p><p>{PROSE}</p></article>" * 3 + "<article><a href=x>teaser</a></article></div></body>"
    assert h.extract(page) == " ".join([f"Head {PROSE} {PROSE}"] * 3)


def test_awkward_rows(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>x</p>"), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = h.extract_pages(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == sorted([("1", len(h.extract(PAGE)))] * 2 + [("2", 0), ("3", 0), ("None", 1)])
    assert h.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
