"""The tag scanner on pages of every shape."""

from __future__ import annotations

import pytest

from reviewlab.sources.markup import Element, read_blocks, read_nodes
from reviewlab.sources.pages import extract_blocks

LI = Element("li")


def blocks(page, block=LI, **fields):
    return list(read_blocks(page, block, fields, {}))


def test_a_block_ends_at_its_own_closing_tag():
    page = "<ul><li class=b><div><p>one</p></div></li></ul><p>outside</p><li class=b></li><p>after</p>"
    assert blocks(page, Element("li", {"class_": "b"}), text=Element("p")) == [["one"], [None]]


def test_blocks_inside_blocks():
    page = "<div class=b>a<div class=b><i>in</i></div><i>out</i></div>"
    assert blocks(page, Element("div", {"class_": "b"}), i=Element("i")) == [["in"], ["in"]]


def test_closing_tags_may_be_left_out():
    assert blocks("<ul><li><a>1</a><li><a>2</a><ul><li><a>3</a></ul><li><a>4</a></ul>", a=Element("a")) == [["1"], ["2"], ["3"], ["4"]]
    assert blocks("<table><tr><td>1<td>2<tr><th>3<td>4</table>", Element("tr"), first=Element("td")) == [["1"], ["4"]]
    assert [n.string() for n in read_nodes("<p>one<p>two<div><p>three</div>") if n.tag == "p"] == ["one", None, "three"]


@pytest.mark.parametrize("tag", ['<a href="x>y" title=\'"\'>', "<a title='\"' href='x>y'>", "<A\n HREF = 'x>y' >", "<a data-q href='x&gt;y'>", "<a href='x&#62;y' href='z'>"])
def test_attributes_in_any_form(tag):
    assert blocks(f"<li>{tag}label</a></li>", url=Element("a", take="href"), label=Element("a", {"href": "x>y"})) == [["x>y", "label"]]


def test_texts():
    one = lambda inner: read_nodes(f"<p>{inner}</p>")[0].string()
    assert one("a &lt;b&gt; &#39;&#x41;&eacute;&amp;lt;") == "a <b> 'Aé&lt;"
    assert one("") is None and one("<b>bold</b>") == "bold" and one("a<b>c</b>") is None and one("<b>x</b><i>y</i>") is None
    assert one("a<!-- <b> -->c") == "ac" and one("<b><i>deep</i></b>") == "deep" and one("1 < 2") == "1 < 2"


def test_raw_content_and_what_is_no_tag():
    page = "<!doctype html><script>if (a < b) '<li>'</script><style><li></style><title>a <b> c</title><li>x<li/><li>y"
    assert [n.string() for n in read_nodes(page) if n.tag == "li"] == ["x", None, "y"]
    assert next(n.string() for n in read_nodes(page) if n.tag == "title") == "a <b> c"
    assert read_nodes("no tags < at all <!-- open <li>") == [] and read_nodes("") == []
    assert [n.tag for n in read_nodes("</li><li>x</ul></p></li>")] == ["li"]


def test_classes_by_word_or_whole():
    page = "<li class='a b'>1</li><li class='a b c'>2</li><li class=b>3</li><li>4</li>"
    assert [r[0] for r in blocks(page, Element("li", {"class_": "a b"}), t=Element("li", {"class_": "a b"}))] == ["1"]
    assert len(blocks(page, Element("li", {"class_": "b"}))) == 3


@pytest.mark.parametrize("page", ["<a " * 200_000, "<a x='" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<li><b>" * 30_000, "<script>" * 50_000])
def test_long_broken_pages(page):
    assert len(read_nodes(page)) <= 60_000


def test_pages_of_any_kind(spark):
    pages = [("a", "<li>1</li>" * 5000), ("b", None), ("c", ""), (None, "<li>x"), ("d", "<" * 20000), ("e", '<li title="' * 2000), ("a", "<li>1")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id string, html string, at int")
    got = extract_blocks(df, LI, {"t": LI}).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in got if r.page_id != "e"} == {"a": 5001, None: 1}
    assert extract_blocks(df.limit(0), LI, {"t": LI}).count() == 0
