"""Main content and Markdown on written pages; the stretch of greatest sum against brute force."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from trailbase.operators import content, html

LONG = "This paragraph has more than enough words of its own to count as content of the page."


def both(page):
    parsed = html.extract_page(page, ("plain_text", "markdown"))
    return parsed["plain_text"], parsed["markdown"], parsed["status"]


def test_boilerplate_goes_and_structure_stays():
    page = f"""<html><body><header><h1>Site</h1><p>{LONG}</p></header><div class="top menu"><p>{LONG}</p></div><ul><li><a href=/a>One link</a></li><li><a href=/b>Another link</a></li></ul>
    <div id="post"><h2>Head *star*</h2><p>{LONG} <b>Bold <i>both</i></b> and <em> slanted </em>word, <code>a*b</code>, <a href="/x">a link</a>.</p>
    <ol><li>first thing<li>second <b>thing</b><ul><li>inner</li></ul></li></ol>
    <blockquote><p>{LONG}</p></blockquote><pre>
  x = 1
  y</pre><table><tr><th>k</th><th>v|w</th></tr><tr><td>1</td><td>{LONG}</td></tr></table><p># not a heading<br>- no item</p><p>{LONG}</p></div>
    <p><a href=/n>Next page of many</a></p><div class=sidebar>{LONG}</div><footer><p>{LONG}</p></footer></body></html>"""
    text, markdown, status = both(page)
    assert status == "OK"
    assert markdown.split("\n\n") == [
        "## Head \\*star\\*",
        f"{LONG} **Bold *both*** and *slanted* word, `a*b`, a link.",
        "1. first thing\n2. second **thing**\n  - inner",
        f"> {LONG}",
        "```\n  x = 1\n  y\n```",
        f"| k | v\\|w |\n| --- | --- |\n| 1 | {LONG} |",
        "\\# not a heading  \n- no item".replace("\n- ", "\n\\- "),
        LONG,
    ]
    assert text.split("\n")[:2] == ["Head *star*", f"{LONG} Bold both and slanted word, a*b, a link."]
    assert "Site" not in text and "Another link" not in text and "Next page" not in text and text.count(LONG) == 4


def test_layout_tables_hold_content():
    page = f"<table><tr><td><ul><li><a href=/1>a</a><li><a href=/2>b</a></ul></td><td><h3>T</h3><p>{LONG}</p>\n<div>{LONG} <br/> tail</div></td></tr></table>"
    assert both(page) == (f"T\n{LONG}\n{LONG}\ntail", f"### T\n\n{LONG}\n\n{LONG}  \ntail", "OK")


def test_article_counts_short_blocks():
    page = f"<p>{LONG}</p><nav>x y z</nav><div>a b</div>" + "<p><a href=/x>l l l l</a></p>" * 5 + f"<article><p>Short.</p><p>Words.</p><p>{LONG} {LONG}</p><p>End.</p></article><div>c d</div>"
    assert both(page)[0] == f"Short.\nWords.\n{LONG} {LONG}\nEnd."


def test_little_and_nothing():
    assert both("<p>Hi</p>") == ("Hi", "Hi", "OK")
    assert both("<div>loose</div>") == ("loose", "loose", "DEGRADED")
    assert both(f"<nav>{LONG}</nav>") == (LONG, LONG, "DEGRADED")
    assert both("") == (None, None, "DEGRADED")
    assert both("<pre>\n\n</pre><p> </p><table><tr><td></td></tr></table>")[2] == "DEGRADED"
    assert both(f"<p>cut <b>off {LONG} <a href='/x") == (f"cut off {LONG}", f"cut **off {LONG}**", "OK")


def test_broken_nesting_ends():
    page = f"</div></b><p><b>{LONG}<br><p><i>{LONG}</b></i></li></ul><li>item {LONG}</tr></td></table>"
    text, markdown, status = both(page)
    assert status == "OK" and text.split("\n") == [LONG, LONG, f"item {LONG}"]
    assert markdown == f"**{LONG}**\n\n*{LONG}*\n\n- item {LONG}"


@given(st.lists(st.integers(-6, 6), max_size=14))
@settings(max_examples=300, deadline=None)
def test_best_stretch_is_the_best(values):
    start, end = content.best_stretch(values)
    most = max((sum(values[i:j]) for i in range(len(values)) for j in range(i, len(values) + 1)), default=0)
    assert sum(values[start:end]) == max(most, 0)
    assert (start, end) == (0, 0) if most <= 0 else end > start


TAGS = ["p", "b", "i", "li", "ul", "table", "tr", "td", "div", "a href=/x", "pre", "h2", "blockquote", "br", "code", "nav", "span"]


@given(st.lists(st.sampled_from([*(f"<{t}>" for t in TAGS), *(f"</{t.split()[0]}>" for t in TAGS), "word ", " more words here", "\n", "*", "<!-- x -->"]), max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_any_page_keeps_its_words_in_order(page):
    """Whatever the nesting: letters of the text are letters of the page in its order, and Markdown has the same."""
    text, markdown, _ = both(page)
    letters = lambda x: [c for c in x or "" if c.isalpha()]
    rest = iter(letters("".join(html.Page(page).root.texts())))
    assert all(any(c == d for d in rest) for c in letters(text))
    assert letters(markdown) == letters(text)


def test_many_blocks_and_deep_nesting_take_linear_time():
    began = time.time()
    assert len(both(f"<p>{LONG}" * 20_000)[0].split("\n")) == 20_000
    both("<div>" * 20_000 + LONG)
    both("<b>" * 3_000 + LONG + "<table><tr><td>" * 2_000 + LONG)
    assert time.time() - began < 20
