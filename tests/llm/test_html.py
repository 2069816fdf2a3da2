"""Main text of pages whose markup misleads: names inside values, frames with names of parts, pages without an article."""

import time

import pytest

from flowtide.llm.html import main_text

LONG = "This is a long paragraph of words, with commas, that counts as text for the scoring of containers."
PARAGRAPH = f"<p>{LONG}</p>"

FOUND = {
    "frame with a state": f'<div class="layout has-sidebar"><article>{PARAGRAPH}</article></div>',
    "frame with a layout name": f'<div class="site header-fixed">{PARAGRAPH}</div><div class="sidebar"><p>Some words beside it.</p></div>',
    "frame around main": f'<div class="overlay"><main>{PARAGRAPH}</main></div>',
    "name in a title": f'<div title="the hidden truth">{PARAGRAPH}</div>',
    "name in a longer name": f'<div data-hidden="false">{PARAGRAPH}</div>',
    "role in a longer name": f'<div data-role="navigation">{PARAGRAPH}</div>',
    "hidden": f'<div hidden>{PARAGRAPH}{PARAGRAPH}</div><div>{PARAGRAPH}</div>',
    "comments in articles": f'<div class="content">{PARAGRAPH}</div><div class="comments"><article>{PARAGRAPH}</article></div>',
    "notice longer than the article": f'<article>{PARAGRAPH}</article><div class="cookie-consent">{PARAGRAPH * 9}</div>',
    "sidebar longer than the article": f'<article>{PARAGRAPH}</article><div class="sidebar">{PARAGRAPH * 9}</div>',
    "upper case, no quotes": f"<DIV CLASS=navbar>{PARAGRAPH}</DIV><MAIN>{PARAGRAPH}</MAIN>",
    "raw text": f'<script>if (a < b) "</p>"</SCRIPT><div>{PARAGRAPH}</div>',
    "quote never closed": f"<a title='x>{PARAGRAPH}",
}


@pytest.mark.parametrize("name", FOUND)
def test_the_paragraph_is_found_alone(name):
    assert main_text(FOUND[name]) == LONG


def test_all_blocks_of_the_whole():
    sections = f"<article><h1>T</h1><section>{PARAGRAPH}</section><section>{PARAGRAPH}<p>x.</p></section></article><p>a line below</p>"
    assert main_text(sections) == f"T\n\n{LONG}\n\n{LONG}\n\nx."
    assert main_text(f"<div>{PARAGRAPH}{PARAGRAPH}</div><div>{PARAGRAPH}</div><ul><li><a href=x>{LONG}</a></ul>") == "\n\n".join([LONG] * 3)
    assert main_text("<p><a>Short link</a></p><p>Short.</p>") == "Short link\n\nShort."
    assert main_text("\u0130" * 40 + f"<script>x</script>{PARAGRAPH}<p>After.</p>").endswith(f"{LONG}\n\nAfter.")
    assert main_text(f"<ul><li>{LONG}<li>{LONG}</ul>") == f"{LONG}\n\n{LONG}"
    assert main_text("") == main_text("<div></div>") == main_text("<!-- x") == ""


def test_scoring_chooses_among_articles():
    teaser = "<article><p>A teaser of a few words, no more.</p></article>"
    assert main_text(f"<div>{teaser}{teaser}</div><div><article>{PARAGRAPH * 3}</article></div>") == "\n\n".join([LONG] * 3)


N = 20_000
DEEP = {
    "divisions": "<div>" * N + LONG + "</div>" * N, "lists": "<ul>" * N + LONG, "items": "<li>" * N + LONG,
    "open quotes": "<a title='x>" * N + LONG, "mixed quotes": "<a title='x> \"y " * N + LONG, "open tags": "<a " * N,
    "stray ends": "<div>" * N + "</b>" * N + LONG, "paragraphs": PARAGRAPH[:-4] * N, "scripts": "<script>" * N, "names": "<div class=sidebar>" * N + LONG,
}


@pytest.mark.parametrize("name", DEEP)
def test_time_is_linear(name):
    def seconds(page):
        start = time.process_time()
        main_text(page)
        return time.process_time() - start

    page = DEEP[name]
    assert seconds(page) < 5
