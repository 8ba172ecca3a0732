"""Blocks of HTML pages: hand-made pages, the standard library's parser, and deep or broken nesting in linear time."""

import random
import time
from html.parser import HTMLParser

import pytest

from shardlight.functions import markup
from shardlight.operators import convert


@pytest.mark.parametrize(("page", "want"), [
    ("<P>Upper</P><DIV>Case</DIV>", [("text", "Upper"), ("text", "Case")]),
    ("<p>a<!-- <p>hidden</p> -->b", [("text", "ab")]),
    ("<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>x</p></article>", [("section_header_1", "Title"), ("text", "x")]),
    ('<div class="top-ad wide"><p>buy</p></div><div class="adult">kept</div><p id=banner>no<p>yes', [("text", "kept"), ("text", "yes")]),
    ("<ul><li>one<li>two<ul><li>inner</ul>after</ul>tail", [("list_item", "one"), ("list_item", "two"), ("list_item", "inner"), ("list_item", "after"), ("text", "tail")]),
    ("<table><caption>C</caption><tr><th>a<td>b<tr><td>c<p>d</table>", [("caption", "C"), ("table", "a"), ("table", "b"), ("table", "c"), ("table", "d")]),
    ("<dl><dt>t<dd>d<dt>u</dl><blockquote><p>q</p></blockquote><pre> x\n  y</pre>", [("list_item", "t"), ("list_item", "d"), ("list_item", "u"), ("text", "q"), ("code", "x y")]),
    ("a &lt;b&gt; &amp;amp; &eacute; &#x1F600; 1 < 2 <3 </ x><?php a ?>z", [("text", "a <b> &amp; é \U0001f600 1 < 2 <3 z")]),
    ("<script>if (a < b) '<p>no</p>'</SCRIPT><style>p{}</style><title>t</title>x<textarea><p>no</textarea>y", [("text", "x"), ("text", "y")]),
    ('<p title="a > b" data-x=\'<p>\'>in</p></p></div>out', [("text", "in"), ("text", "out")]),
    ("<p>foo<b>bar</b> <i>baz</i><br>next", [("text", "foobar baz next")]),
    ("<p>open <!-- never closed", [("text", "open")]),
    ("<p>open <b never closed", [("text", "open")]),
    ("<nav><p>no<nav>no</nav>no</nav>yes<aside>no", [("text", "yes")]),
    ("", []), ("   \n", []), ("<>", [("text", "<>")]),
])
def test_blocks_by_hand(page, want):
    assert markup.blocks(page) == want


class Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append(("open", tag))

    def handle_endtag(self, tag):
        self.found.append(("close", tag))

    def handle_startendtag(self, tag, attrs):
        self.found.append(("open", tag))

    def handle_data(self, data):
        if self.found and self.found[-1][0] == "text":
            self.found[-1] = ("text", self.found[-1][1] + data)
        else:
            self.found.append(("text", data))


def test_events_are_those_of_the_standard_parser():
    r = random.Random(8)
    parts = ["<p>", "</p>", "<B class=x>", "</B>", "<br/>", "<a href='x>y'>", "</a>", "text ", "&amp;", "<!-- c <p> -->", "<td>", "é", "<!DOCTYPE html>", "<div id=\"a\" hidden>", "</div >", " 1 "]
    for _ in range(300):
        page = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        parser = Events()
        parser.feed(page)
        parser.close()
        own = []
        for kind, name, _ in markup.events(page):
            if kind == "text" and own and own[-1][0] == "text":
                own[-1] = ("text", own[-1][1] + name)
            else:
                own.append((kind, name))
        assert own == parser.found, page


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</p>" * 100_000, "<div><b>x" * 100_000, "<p>" * 100_000, "<!--" * 100_000, "<ul><li>" * 50_000 + "</li>" * 50_000, "<" * 200_000, "<a b='" * 50_000, "<script>" * 50_000, "</x" * 100_000, "<table><tr><td>" * 30_000, "<i>" * 50_000 + "<li>x" * 50_000])
def test_any_page_takes_linear_time(page):
    began = time.process_time()
    markup.blocks(page)
    assert time.process_time() - began < 3


def test_tidy_pages_have_the_items_of_the_pattern(spark):
    pages = spark.createDataFrame([(1, "<html><head><title>t</title></head><body><nav><p>no</p></nav><h2>H &amp; M</h2><p>One\n two</p><ul><li>a</li><li>b</li></ul><table><tr><td>c</td></tr></table></body></html>"), (2, None)], "page_id long, html string")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(convert.html_blocks(pages)) == plain(convert.html_items(pages)) and convert.html_blocks(pages).count() == 5
