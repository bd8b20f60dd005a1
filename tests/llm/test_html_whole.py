"""Pages without some end tags or with layout classes keep all of their article."""

import time

import pytest

from tidemark.llm import html

LONG = "The river of the valley was wide and it is said that they had been there for all of the years in which he was king."
UNCLOSED = [
    (f"<html><head><title>t</title><p>{LONG}<p>Short.", f"{LONG}\nShort."),
    (f"<head><meta charset=x><title>t</title><script>var a;</script><link rel=x><article><p>{LONG}</p></article>", LONG),
    *[(f"<article><p>Before it.</p><{tag} id=x><p>{LONG}</p><p>After it.</p></article>", f"Before it.\n{LONG}\nAfter it.") for tag in ("noscript", "object", "svg", "math", "canvas", "select", "template", "audio", "video")],
    (f"<article><p>{LONG}</p><select><option>one<option>two<p>After it.</p></article>", f"{LONG}\nAfter it."),
    (f"<article><p>{LONG}</p><script>var a = '<p>no</p>';", LONG),
    (f"<head><title>t</title><p>no</p></head><p>{LONG}</p>", LONG),
]
WRAPPED = [
    *[(f"<div class='{c}'><article><h1>A title</h1><p>{LONG}</p><p>Short.</p></article></div>", f"A title\n{LONG}\nShort.") for c in ("has-sidebar", "page no-sidebar", "content-sidebar-wrap", "with-header", "content-sidebar", "layout-header")],
    *[(f"<div class='{c}'><h1>A title</h1><p>{LONG}</p><p>Short.</p></div>", f"A title\n{LONG}\nShort.") for c in ("has-sidebar", "content-sidebar-wrap", "content-sidebar")],
    (f"<article><h1 class='entry-header'>A title</h1><p>{LONG}</p></article>", f"A title\n{LONG}"),
    (f"<article><header class='article-header'><h1>A title</h1></header><p>{LONG}</p></article>", f"A title\n{LONG}"),
    (f"<div id=sidebar><main><p>{LONG}</p></main></div>", LONG),
    (f"<p>{LONG}</p><div class='site-footer'><p>Few words.</p></div><div class='nav-wrapper'><p>{LONG}</p></div><section id='comments'><article><p>{LONG}</p></article></section>", LONG),
    (f"<div hidden><main><p>{LONG}</p></main></div><p>{LONG}</p>", LONG),
]


@pytest.mark.parametrize("page,expected", UNCLOSED)
def test_elements_without_end_tags(page, expected):
    assert html.main_text(page)[0] == expected


@pytest.mark.parametrize("page,expected", WRAPPED)
def test_layout_classes(page, expected):
    assert html.main_text(page)[0] == expected


def test_many_unclosed_elements_take_linear_time():
    begin = time.time()
    assert html.main_text(f"<p>{LONG}</p>" + "<canvas>x" * 100_000)[0].startswith(LONG)
    assert time.time() - begin < 20


RUSSIAN = "\u0420\u0435\u043a\u0430 \u0432 \u0434\u043e\u043b\u0438\u043d\u0435 \u0431\u044b\u043b\u0430 \u0448\u0438\u0440\u043e\u043a\u043e\u0439, \u0438 \u043b\u044e\u0434\u0438 \u0436\u0438\u043b\u0438 \u0442\u0430\u043c \u0432\u0441\u0435 \u0433\u043e\u0434\u044b. " * 4
KEPT = [
    (f"<article><p>{LONG}</p><address>By A. Writer</address><p><a href=x>A paragraph that is a link from its beginning to its end</a></p><p><label>Label</label> and <object>object text</object></p></article>", f"{LONG}\nBy A. Writer\nA paragraph that is a link from its beginning to its end\nLabel\nand object text"),
    (f"<article><p>{LONG}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> and <svg><title>no</title><text>drawn</text></svg></p></article>", f"{LONG}\nLet x=2 and drawn"),
    (f"<article><p>{LONG}</p><ul><li><a href=x>A link of a menu</a></li><li><a href=y>Another link</a></li></ul></article>", LONG),
    (f"<p><a href=x>a link block that is near</a></p><p>{RUSSIAN}</p>", RUSSIAN.strip()),
    (f"<p>{LONG}</p><p><a href=x>&eacute;&eacute;</a> is short here</p>", f"{LONG}\n\u00e9\u00e9 is short here"),
]


@pytest.mark.parametrize("page,expected", KEPT)
def test_nothing_else_is_dropped(page, expected):
    assert html.main_text(page)[0] == expected


def test_clashing_columns(spark):
    rows = [(1, f"<p>{LONG}</p>", "a", "b", "c"), (1, f"<p>{LONG}</p>", "a", "b", "c")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, html string, found string, TEXT string, N_Chars string"))
    assert got.columns == ["page_id", "found", "text", "n_chars", "n_blocks"] and [r.text for r in got.collect()] == [LONG, LONG]


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a 'x' \"y\" ", "<a \"'\" ", "<div>", "<div></b>", "</section><p>", "<canvas>", "<!-", "<a href='", "<li><ul>", "&amp", "<a x=\"1\" <"])
def test_broken_pages_take_linear_time(piece):
    begin = time.time()
    html.main_text(f"<article><p>{LONG}</p>" + piece * (1_000_000 // len(piece)) + "</article>")
    assert time.time() - begin < 20


def test_a_list_of_links_does_not_decide_the_end_of_an_article():
    page = f"<article><p>{LONG}</p><ul><li><a href=x>See the first source of this claim here</a></li></ul><p>End of it.</p></article>"
    assert html.main_text(page)[0] == f"{LONG}\nEnd of it."


def test_openings_without_an_end_are_text():
    assert html.main_text("<p>if a <b and c</p>")[0] == "if a"
    assert html.main_text("<p>one <a 'x</p><p>two")[0].startswith("one <a 'x")
    assert html.main_text("a < b <c")[0] == "a < b <c"
