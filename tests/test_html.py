"""Text of pages against the parser of the standard library."""

import random
import time
from html.parser import HTMLParser

import pytest

from tidewick.functions.html import text_of, visible_text


class Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.hidden = [], False

    def handle_starttag(self, tag, attrs):
        self.hidden = tag in ("script", "style")

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        self.hidden = False

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def parsed(page):
    parser = Parser()
    parser.feed(page)
    parser.close()
    return "".join(parser.found)


def test_all_pages(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").select("html", visible_text("html").alias("text")).collect()
    assert len(rows) == 50 and all(r.text == (None if r.html is None else parsed(r.html)) for r in rows)


PIECES = [
    "text", " ", "a < b", "1<2", "5 > 4", "&amp;", "&lt;b&gt;", "&copy;", "&#65;", "&#x42;", "&unknown;", "&", "<p>", "</p>", "<br/>", '<a title="x > y">', "<a title='it\"s > so'>", "<a b=c d>", "<img src=x alt=>", "</div >", "<DIV\nclass='q'>",
    "<!-- a > b -->", "<!-- <p> -- -->", "<!---->", "<!DOCTYPE html>", "<script>if (a < b && '</p>') x();</script>", "<STYLE type='t'>p > a { }</style>", "<script src='a>b'></script>", "ünï", "<b><i>", "<x-y z>", "<a href=x/y>", "\n",
]


def test_random_pages():
    r = random.Random(4)
    for _ in range(3000):
        page = "".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) + " end"
        assert text_of(page) == parsed(page), page


@pytest.mark.parametrize(
    "page, text",
    [
        (None, None), ("", ""), ("a<b", "a"), ("a<b title='never closed > ", "a"), ("a<!-- open", "a"), ("a<script>x", "a"), ("a</>b", "ab"), ("a</ x>b", "ab"), ("a<!-->b", "ab"), ("a<!--->b", "ab"), ("a<!--x--!>b", "ab"), ("<?xml v='1'?>a", "a"),
        ("<scripty>a</scripty>", "a"), ("<script>a</scripty></script >b", "b"), ("<a b='1'c=\"2\">x", "x"), ("a <3 b", "a <3 b"), ("&lt;p&gt;", "<p>"), ("<a =b=c>x", "x"),
    ],
)
def test_broken_markup(page, text):
    assert text_of(page) == text


def test_time_follows_length():
    for piece in ("<a ", "<!--", "<script>", "<a b='", '<a b="x" ', "</", "&", "<a b=c ", "<" * 7):
        began = time.perf_counter()
        text_of(piece * 100_000)
        assert time.perf_counter() - began < 5, piece
