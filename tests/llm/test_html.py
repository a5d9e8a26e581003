"""Pages that the generator of the training pages doesn't make: broken, hidden, and laid out by hand."""

from __future__ import annotations

import time

import pytest

from lumenframe.llm import html_gbt, html_pages


def text_of(html: str) -> str:
    return html_gbt.extract_texts([html], html_gbt.model())[0]


def test_quotes_within_unquoted_values():
    assert text_of("<article><p title=Bob's>One text here, of words.</p><p>Two more words, here.</p></article>") == "One text here, of words.\nTwo more words, here."
    assert text_of('<article><p title=5" id=x>One text here, of words.</p></article>') == "One text here, of words."


def test_only_whole_attribute_names_count():
    assert text_of("<article data-id='comment-12' data-class=ad><h1>Title</h1><p>Some text of words, here.</p></article>") == "Title\nSome text of words, here."
    found, alone, end = html_gbt.attributes(" ID=a data-id='b' class = \"c d\" id=e checked / >x", 0, {'"': 100, "'": 100})
    assert found == {"id": "a", "data-id": "b", "class": "c d", "checked": ""} and not alone and end == 48
    assert html_gbt.attributes(" a=b/>", 0, {}) == ({"a": "b/"}, False, 6) and html_gbt.attributes(" a='b'/>", 0, {"'": 5})[1]


def test_hidden_elements_are_no_text():
    html = "<body style='display:none'><article><p hidden>No one sees this.</p><p style='color:red; DISPLAY: none'>Nor this, of course.</p><p>Seen <span hidden>not</span>words of a text, here.</p><div hidden><p>Deep, and not seen.</p></div></article>"
    assert text_of(html) == "Seen words of a text, here."


@pytest.mark.parametrize("piece", ['<p class="a', "<p title=\"x' ", "<div>", "<svg>", "<!--", "<", "</", "<a ", "<p a=", "&amp"])
def test_broken_pages_take_linear_time(piece):
    html_gbt.model()
    start = time.time()
    text_of(piece * (1_000_000 // len(piece)))
    assert time.time() - start < 2


def test_deep_tags_and_their_ends():
    start = time.time()
    assert "word of the text" in text_of("<article>" + "<b>" * 100_000 + "The only word of the text, so deep.") and time.time() - start < 2
    text_of("<b>" * 100_000 + "</i>" * 100_000)
    assert time.time() - start < 4


NEWS = """<!doctype html><html><head><title>Harbour wall rebuilt</title><script>if (a < b) { document.write("<p>no</p>") }</script></head>
<body class="single no-sidebar"><div id="page-wrap"><div class="top-bar"><a href="/">Daily Gull</a> <a href="/login">Log in</a></div>
<nav class="primary-navigation" role="navigation"><ul><li><a href="/n">News</a><li><a href="/s">Sport</a><li><a href="/w">Weather</a></ul></nav>
<div class="content-area"><div class="post-body entry">
<h1>Harbour wall rebuilt after the storm</h1>
<p>The harbour wall, which fell in last winter&rsquo;s storm, has been rebuilt by the town. Work took nine months and cost less than was feared.</p>
<div class="advertisement"><p>Buy two boats, get one free! Only this week.</p></div>
<p>Fishermen said that they were <em>pleased</em> with the result, although some of them<br>would have liked a wider pier.</p>
<ul><li>The wall is 300 metres long.</li><li>It stands four metres above the tide.</li></ul>
<blockquote><p>It will stand for a hundred years, the engineer told us.</p></blockquote>
</div>
<div class="share-links"><a href="#">Tweet</a><a href="#">Mail</a></div>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I never liked the old wall, it was too low.</p></div><div class="comment"><p>Who paid for all of this work, then?</p></div></section>
</div><aside class="right-rail widget"><h3>Most read</h3><ul><li><a href="/1">Gulls return to the bay</a></li><li><a href="/2">Mayor resigns</a></li></ul></aside>
<form class="newsletter"><label>Your mail</label><input name=m><button>Subscribe</button></form>
<footer><p>Copyright Daily Gull 2021. All rights reserved.</p><a href="/imprint">Imprint</a></footer></div></body></html>"""


def test_a_page_made_by_hand():
    assert text_of(NEWS).split("\n") == [
        "Harbour wall rebuilt after the storm",
        "The harbour wall, which fell in last winter’s storm, has been rebuilt by the town. Work took nine months and cost less than was feared.",
        "Fishermen said that they were pleased with the result, although some of them would have liked a wider pier.",
        "The wall is 300 metres long.", "It stands four metres above the tide.",
        "It will stand for a hundred years, the engineer told us.",
    ]


def test_an_old_page_of_tables():
    html = "<html><body bgcolor=white><table width=100%><tr><td colspan=2><font size=5>Gardens</font><a href=a>Home</a> | <a href=b>Plants</a> | <a href=c>Links</a></td></tr><tr><td><a href=1>Roses</a><br><a href=2>Lilies</a><br><a href=3>Trees</a></td><td class=text><h2>Roses in winter</h2><p>Cut roses back in late winter, before the buds swell. Use a clean knife.<p>Cover the roots with leaves, if hard frost is expected, and water them little.</td></tr></table></body></html>"
    assert text_of(html).endswith("Cut roses back in late winter, before the buds swell. Use a clean knife.\nCover the roots with leaves, if hard frost is expected, and water them little.")
    assert "Lilies" not in text_of(html) and "Links" not in text_of(html)


def test_tokens_are_learnt_by_bucket():
    odds = html_gbt.model().odds
    of = lambda t: odds[html_gbt._about({"class": t})[0][0]]
    assert min(of("article"), of("story"), of("entry")) > 0 > max(of("comment"), of("sidebar"), of("newsletter"))


HARBOUR = """<html><body><nav class="menu"><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Weather</a></li></ul></nav><article>
<h1>Harbour wall rebuilt</h1><p>The wall, which fell in the storm, has been rebuilt by the town. Work took nine months and cost less than was feared.</p>
{}
<p>Fishermen said that they were pleased with the result, although some of them would have liked a wider pier.</p></article>
<div class="related"><h3>Read next</h3><ul><li><a href="/x">Storm warning for the coast</a></li><li><a href="/y">New pier planned</a></li></ul></div>
<footer><p>Copyright Gull Press</p><a href="/z">Contact</a></footer></body></html>"""


@pytest.mark.parametrize(
    "block, text",
    [
        ('<p>See the <a href="/p">harbour plan</a>, the <a href="/q">cost table</a> and the <a href="/r">vote</a>.</p>', "See the harbour plan, the cost table and the vote."),
        ("<div class=h>Costs and dates</div>", "Costs and dates"),
        ('<div class="subhead"><b>What comes next</b></div>', "What comes next"),
        ("<p>The height is <math><mi>x</mi> <mo>=</mo> <mn>2</mn><annotation>x=2</annotation></math> metres above the tide.</p>", "The height is x = 2 metres above the tide."),
    ],
)
def test_text_of_articles_is_kept_whole(block, text):
    got = text_of(HARBOUR.format(block)).split("\n")
    assert got[0] == "Harbour wall rebuilt" and text in got and got[-1].startswith("Fishermen said") and len(got) == 4


def test_made_pages_are_told_apart():
    """Blocks of main text on pages that training didn't see: nearly all are kept, and nearly nothing else."""
    import numpy as np

    rng = np.random.default_rng(99)
    hit = lost = extra = 0
    for _ in range(150):
        html, main = html_pages.make_page(rng)
        page = html_gbt.parse(html)
        want = [t for t in page.text if t in main]
        got = [t for t in text_of(html).split("\n") if t]
        hit += sum(t in main for t in got)
        lost += sum(t not in got for t in want)
        extra += sum(t not in main for t in got)
    assert lost < 0.02 * hit and extra < 0.02 * hit
