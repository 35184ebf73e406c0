"""The scanner on bad markup: what it reads, and that its time grows with the page's length only."""

import time

import pytest

from chronoweave.llm import html_template


def texts(page):
    return [text for _, text, _, _ in html_template.scan(page) if text]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a<b>b</b> c<p>d", ["ab c", "d"]),
        ("<p title='>'>x</p>", ["x"]),
        ('<p title="a > b" class=\'<i>\'>x</p>', ["x"]),
        ("1 < 2 and <3 >", ["1 < 2 and <3 >"]),
        ("a <p b <p>c", ["a", "c"]),  # broken off by the next tag
        ("a <p b", ["a <p b"]),  # no > at all
        ("<p>it's<p>o'clock", ["it's", "o'clock"]),
        ("<a title=it's>x</a><p>y", ["x", "y"]),  # a quote that nothing closes
        ("<!-- <p>no --><p>yes<!-- to the end <p>", ["yes"]),
        ("<!doctype html><?xml?><p>x", ["x"]),
        ("<!no end", ["<!no end"]),
        ("<script>if (a < b) '</p>'</SCRIPT ><p>x<style>y", ["x"]),
        ("<p>&lt;b&gt; &#228;&nbsp;x", ["<b> ä\xa0x"]),
        ("</div></ul><div>a</ul>b</div>c", ["a", "b", "c"]),  # a stray end tag ends a block
        ("", []),
    ],
)
def test_texts(page, want):
    assert texts(page) == want


def test_end_tags_close_what_is_open():
    page = "<nav><ul><li>menu</nav><article><div>x</section>y</article><footer>z"
    assert [(t, outside, article) for _, t, outside, article in html_template.scan(page) if t] == [("menu", True, False), ("x", False, True), ("y", False, True), ("z", True, False)]


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 50_000 + "</ul>" * 150_000, "<div>" * 180_000, '<a "' * 250_000, "<a '\"" * 200_000, "<!-" * 300_000, "<!" * 500_000, '<a x="' * 160_000 + ">", "</div" * 200_000], ids=range(9))
def test_a_megabyte_of_bad_markup(page):
    began = time.time()
    sum(1 for _ in html_template.scan(page))
    assert time.time() - began < 10  # seconds; a second or so alone, hours if it grew with the square
