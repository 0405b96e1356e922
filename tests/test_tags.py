import resource
import time

import pytest
from listinglake.sources.html import nodes_of
from listinglake.sources.tags import CDATA, CUT, EMPTY, END, RAW, START, TEXT, tokens


def shown(markup):
    return [n["text"] for n in nodes_of(markup) if n["tag"] == "#text"]


def test_tags_attributes_and_references():
    got = list(tokens("""a<P Class='x y' class=z data-a=it's b = "q>r" hidden/>b &amp; c</P >"""))
    assert got == [
        (TEXT, "", "a"), (EMPTY, "p", [("class", "x y"), ("data-a", "it's"), ("b", "q>r"), ("hidden", None)]), (TEXT, "", "b &amp; c"), (END, "p", [])
    ]
    assert list(tokens('<a href="?a=1&copy=2&amp;b&#65;&lt">')) == [(START, "a", [("href", "?a=1&copy=2&bA<")])]


def test_comments_declarations_raw_text():
    raw = frozenset({"script"})
    assert list(tokens("<!doctype html><!-->x<!-- <p> -->y<?pi?></ >z<![CDATA[<b>]]>", raw)) == [(TEXT, "", "x"), (TEXT, "", "y"), (TEXT, "", "z"), (CDATA, "", "<b>")]
    assert list(tokens("<script>a</b></scriptx></SCRIPT >c", raw))[1:] == [(RAW, "script", "a</b></scriptx>"), (END, "script", []), (TEXT, "", "c")]
    assert list(tokens("1 < 2 <3 <script>rest", raw)) == [(TEXT, "", "1 < 2 <3 "), (START, "script", []), (RAW, "script", "rest")]


def test_text_behind_a_forgotten_quote_stays():
    assert shown('<p class="a>one</p><p>two</p>') == [" one", " two"]
    assert shown('one<a href="x') == ["one"]
    assert list(tokens("x <a b='")) == [(TEXT, "", "x "), (CUT, "", "<a b='")]
    assert list(tokens("")) == [] and nodes_of("") == [] and nodes_of(None) is None


MALFORMED = {
    "stray tags": "<a ", "open quotes": '<a href="', "quoted ends": '<a b=">" ', "nested": "<div>", "paragraphs": "<p>", "items": "<ul><li>",
    "end tags": "</b>", "comments": "<!--", "scripts": "<script>", "references": "&", "less than": "<", "odd quotes": "<a b='", "cells": "<table><td>",
}


@pytest.mark.parametrize("piece", MALFORMED.values(), ids=MALFORMED.keys())
def test_a_malformed_megabyte_takes_seconds(piece):
    page, started = piece * (1_000_000 // len(piece)), time.process_time()
    nodes = nodes_of("<p>first</p>" + page)
    assert time.process_time() - started < 10
    assert nodes[1]["text"] == " first"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2 << 20


def test_nested_ends_are_right():
    nodes = nodes_of("<div>" * 3000 + "x" + "</div>" * 1000)
    assert [n["end_id"] for n in nodes] == [3001] * 3001
    assert [n["depth"] for n in nodes] == list(range(3001))
