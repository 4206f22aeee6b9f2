import html
import re
import time

import pytest
from llm_inputs import SF_SMALL

from txnlens.llm.html_text import extract_pages, page_text, smoothed

ARTICLE = "<article><h1>Title</h1><p>First paragraph with enough words to look like prose.</p><p>Short.</p></article>"
TEXT = "Title First paragraph with enough words to look like prose. Short."


@pytest.mark.parametrize("around", [
    "<nav><ul><li><a href=/>Home</a></li></ul></nav>{}", "<header><h1>Site name</h1></header>{}<footer>imprint</footer>",
    "{}<aside><p>A long aside that is as long as a paragraph of the text itself.</p></aside>",
    "<div class='cookie-banner'><p>We use cookies, and this notice has many words as well.</p></div>{}",
    "{}<section id=comments><article class=comment><p>I liked this very much indeed, thanks for it.</p></article></section>",
    "<script>var t = '<p>no</p>';</script><style>p {{}}</style>{}<noscript>none</noscript>", "<form><label>Name <input></label></form>{}",
    "<div class='ad top'>Buy our very good things today, they are all quite cheap.</div>{}", "<!-- <p>hidden</p> -->{}<p hidden>no</p>",
    "<div role=navigation>Go there</div>{}<div style='display: none'>secret</div>"])
def test_only_the_article(around):
    assert page_text(f"<html><body>{around.format(ARTICLE)}</body></html>")[0] == TEXT


def test_blocks_white_space_and_references():
    page = "<article><p>a &lt;b&gt;\n\t c&nbsp;d &amp;amp; &#233;<br>e<p><b>f<i>g</i></b> h</article>"
    assert page_text(page)[0] == "a <b> c d &amp; é e fg h"


def test_page_without_an_article_uses_ratios():
    page = ("<body><div id=menu><a href=a>One</a> <a href=b>Two</a></div><div><h2>Head</h2><p>Some prose that goes on for a good while, and then on.</p>"
            "<p>Ok.</p><p>More prose of the same kind, in a paragraph of its own here.</p></div><div><ul><li><a href=x>x</a><li><a href=y>y</a></ul></div>")
    assert page_text(page)[0] == "Head Some prose that goes on for a good while, and then on. Ok. More prose of the same kind, in a paragraph of its own here."


@pytest.mark.parametrize("page", [None, "", " \n", "<", "<p", "<!--", "</div></p>", "<nav>only</nav>", "<b" * 50])
def test_empty_and_broken_pages(page):
    assert isinstance(page_text(page)[0], str)


def test_very_long_page():
    page = f"<article>{'<p>word word word word</p>' * 20000}</article>"
    assert page_text(page)[0] == " ".join(["word word word word"] * 20000)


def test_smoothing_keeps_a_constant():
    assert smoothed(smoothed(__import__("numpy").full(9, 4.0))).tolist() == pytest.approx([4.0] * 9)


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in extract_pages(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", "\0", body)).split("\0")
        want = " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None, None, 1, "x"), (None, "u", ARTICLE, 2, None), (1, "u", ARTICLE, None, "y"), (1, "u", ARTICLE, None, "y")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text long, n_chars string")).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, TEXT, len(TEXT)), (1, "", 0), *[(1, TEXT, len(TEXT))] * 2]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BODY = ARTICLE.replace("article>", "div>")
SIDEBAR = "<div class=sidebar><p>Some words about the author that go on for quite a while, as they do.</p></div>"


@pytest.mark.parametrize("wrapper", [
    "<div class='page has-sidebar'>{}</div>", "<div class=no-sidebar>{}</div>", "<section class=share-enabled>{}</section>", "<div id='content-with-comments'>{}</div>",
    "<div class=has-header>{}</div>", "<div class='page has-sidebar'><div id=with-comments>{}</div></div>", "<main><div class=has-sidebar>{}</div></main>",
    "<main class=has-comments>{}</main>"])
@pytest.mark.parametrize("inner", [ARTICLE, BODY, ARTICLE.replace("article", "main")])
@pytest.mark.parametrize("beside", ["", SIDEBAR])
def test_a_wrapper_named_like_boilerplate_keeps_the_text(wrapper, inner, beside):
    if inner is BODY and beside:
        inner = BODY.replace("prose.", "prose. " + "And a second sentence with as many words again. " * 3)
    want = " ".join(re.sub("<[^>]*>", " ", inner).split())
    for page in (wrapper.format(inner + beside), wrapper.format(inner) + beside):
        assert page_text(f"<html><body><nav><a href=/>Home</a></nav>{page}</body></html>")[0] == want


@pytest.mark.parametrize("around", [
    "{}<div class=related><article><p>Another story with some words to read on.</p></article></div>",
    "<main>{}<div id=comments><p>" + "A long comment with many words in it. " * 20 + "</p></div></main>",
    "{}<div id=comments>" + "<article><p>A comment with words in it.</p></article>" * 9 + "</div>",
    "<div class=has-sidebar>{}<div class=related><article><p>Another story to read.</p></article></div></div>"])
def test_boilerplate_beside_an_article_still_goes(around):
    assert page_text(f"<html><body>{around.format(ARTICLE)}</body></html>")[0] == TEXT


@pytest.mark.parametrize("name", ["class=commentlist", "class=commentList", "id=userComments", "class=cookieConsent", "class=relatedPosts", "id=sitefooter",
                                  "class=responses", "class='post-1 usercomments'", "class=adslot", "id=sidebarWidget"])
@pytest.mark.parametrize("page", ["<article>{0}{1}</article>", "<div>{0}</div>{1}", "<main>{0}</main>{1}", "{1}<article>{0}</article>"])
def test_names_written_together_mark_boilerplate(name, page):
    inner = "<h1>Title</h1><p>First paragraph with enough words to look like prose, and some more.</p><p>Short.</p>"
    beside = f"<div {name}><p>Anna, 3 May</p><p>I liked this a lot, thank you.</p></div>"
    want = "Title First paragraph with enough words to look like prose, and some more. Short."
    assert page_text(f"<html><body>{page.format(inner, beside)}</body></html>")[0] == want


@pytest.mark.parametrize("name", ["class=commentary", "class=Article_body__x1Ad3", "class=navigator", "id=adaptation", "class=shareholders", "class=articleHeader",
                                  "class=sc-hAdFgx", "class=socialism"])
def test_names_that_only_begin_like_boilerplate_stay(name):
    page = f"<article><p>First paragraph with enough words to look like prose.</p><div {name}><p>And a second one.</p></div></article>"
    assert page_text(page)[0] == "First paragraph with enough words to look like prose. And a second one."


@pytest.mark.parametrize("page", [
    "<b>" * 60000 + "</i>" * 60000, "<div>" * 60000 + "</p>" * 60000, "<i><div>" + "<b>" * 60000 + "</i>" * 60000, "<span>" * 60000 + "<p>" * 60000,
    "<article>" * 20000 + "<div class=menu>x</div>" * 20000, "<div class=menu>word word" * 30000, "<article><div class=menu>word word" * 20000,
    "<div>word word " * 40000, "<!--" * 100000, "<!--x>" * 80000, "</" * 200000, "<?" * 200000, "<![CDATA[>" * 50000, "<a " + "x='" * 100000])
def test_unbalanced_pages_take_linear_time(page):
    begun = time.process_time()
    assert isinstance(page_text(page)[0], str)
    assert time.process_time() - begun < 10  # one second or less; a scan of the open elements a tag takes minutes


@pytest.mark.parametrize("page, want", [
    ("<p>a<![foo[x]]>b", "ab"), ("<p>a<![if !IE]>b<![endif]>c", "abc"), ("<p>a<![CDATA[<i>x</i>]]>b", "ab"), ("<p>a <! b > c", "a c"), ("<p>a &am", "a &am"),
    ("<p>a<script>b", "a"), ("<p>a < b", "a < b")])
def test_declarations_and_open_ends(page, want):
    assert page_text(page)[0] == want
