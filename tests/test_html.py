"""Pages to Markdown: the given pages against a plain version on the standard library's parser, and malformed pages."""

import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from vellum.operators.html import Page, pages_to_markdown

PARTS = {"html", "head", "body", "nav", "ul", "li", "div", "article", "section", "h1", "h2", "h3", "p", "footer", "header", "table", "tr", "td", "th", "blockquote", "title", "main", "aside"}


class Plain(HTMLParser):
    """Blocks of pages made of headings, paragraphs, flat lists, links and bold type."""

    def __init__(self):
        super().__init__()
        self.blocks, self.lines, self.open, self.skip, self.kind, self.title, self.counts = [], [""], [], 0, "", "", [0, 0]

    def end_inline(self):
        name, line, at, address = self.open.pop()
        whole = "\n".join(self.lines)
        head, inner = whole[:at], whole[at:]
        if inner.strip():
            body = f"[{inner.strip()}]({address})" if name == "a" and address else inner.strip() if name == "a" else f"**{inner.strip()}**"
            self.counts[1] += name == "a" and bool(address)
            inner = inner[: len(inner) - len(inner.lstrip())] + body + inner[len(inner.rstrip()) :]
        self.lines = (head + inner).split("\n")

    def flush(self):
        while self.open:
            self.end_inline()
        text = "\n".join(filter(None, (" ".join(x.split()) for x in self.lines)))
        self.lines = [""]
        if text:
            if self.kind.startswith("h"):
                self.counts[0] += 1
                text = "#" * int(self.kind[1]) + " " + text
            self.blocks.append(("- " if self.kind == "li" else "") + text)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.flush()
            self.skip += 1
            self.what = tag
        elif tag in PARTS:
            self.flush()
            self.kind = tag
        elif tag == "br":
            self.lines.append("")
        elif tag in ("b", "a"):
            self.open.append((tag, 0, len("\n".join(self.lines)), dict(attrs).get("href") or ""))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip -= 1
        elif tag in PARTS:
            self.flush()
            self.kind = ""
        elif tag in ("b", "a") and any(o[0] == tag for o in self.open):
            while self.open[-1][0] != tag:
                self.end_inline()
            self.end_inline()

    def handle_data(self, data):
        if not self.skip:
            self.lines[-1] += data.replace("\n", " ")
        elif self.what == "title" and not self.title:
            self.title = " ".join(data.split())


def test_all_pages(spark, sf_dir):
    got = {r["page_id"]: r for r in pages_to_markdown(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        p = Plain()
        p.feed(r["html"])
        p.close()
        p.flush()
        own = got[r["page_id"]]
        assert own["markdown"] == "\n\n".join(p.blocks), r["page_id"]
        assert (own["title"], own["headings"], own["links"]) == (p.title, *p.counts)
        assert "<script" not in own["markdown"] and "track(" not in own["markdown"]


@pytest.mark.parametrize(
    "html, markdown",
    [
        ("<h2>A &amp; B</h2><p>one<br>two <b>x</b> <a href='/u v'>l</a><p>three", "## A & B\n\none\ntwo **x** [l](/u%20v)\n\nthree"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>x", "- a\n\n- b\n\n  - c\n\n- d\n\nx"),
        ("<ol><li>1<p>more</p><li>2</ol>", "1. 1\n\n   more\n\n2. 2"),
        ("<table><tr><th>a<th>b|c<tr><td>1<td><p>2</p><p>3</p></table>", "| a | b\\|c |\n| --- | --- |\n| 1 | 2 3 |"),
        ("<table><tr><td>x<table><tr><td>in</table></td><td>y</table>z", "| x in | y |\n| --- | --- |\n\nz"),
        ("<p>a<script>if (1 < 2) alert('</p>')</script>b<a href='javascript:x'>bad</a></p></div>", "abbad"),
        ("<a href=' java\nscript:alert(1)'>x</a> <a href='&#106;avascript:y'>y</a> <a href='data:text/html,1'>z</a> <a href='?q=a:b'>w</a>", "x y z [w](?q=a:b)"),
        ("<b>un <i>closed<p>next", "**un *closed***\n\nnext"),
        ("<blockquote><p>q<br>r</blockquote><pre>\n a  b\n</pre>", "> q\n> r\n\n```\n a  b\n```"),
        ("a < b <!-- gone --> c <!-- to the end", "a < b c"),
        ('<a title="x>y" href=http://e.org/a onclick=z>t</a><img alt="pic" src=x onerror=y>', "[t](http://e.org/a)pic"),
        ("<select><option>no</select><object>no</object>yes<script>never closed <p>x", "yes"),
        ("</p></b></table>x</td>", "x"),
        ("<p title='>a</p>", "a"),
        ("", ""),
        ("x\ue000y", "xy"),
    ],
)
def test_pages_by_hand(html, markdown):
    assert Page().read(html).markdown() == markdown


def test_time_follows_the_page():
    for part in ("<a ", "\"<p '", "<b>", "<div>", "<li>", "</p>", "<!--", "<script>", "<p>x", "<a href=x>", "<p><li><span><section>", "<ul><li>", "<b>a</i>", "<td>", "&amp;"):
        page = part * (200_000 // len(part))
        began = time.perf_counter()
        Page().read(page)
        assert time.perf_counter() - began < 6, part


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x", "keep"), (2, "", "x", "keep"), (3, "<title>T</title><h1>x</h1>", "x", "keep")], "page_id int, html string, title string, own string")
    rows = pages_to_markdown(df).orderBy("page_id").collect()
    assert pages_to_markdown(df).columns == ["page_id", "own", "title", "markdown", "headings", "links", "tables"]
    assert [tuple(r) for r in rows] == [(1, "keep", None, None, None, None, None), (2, "keep", "", "", 0, 0, 0), (3, "keep", "T", "# x", 1, 0, 0)]
    assert pages_to_markdown(df.limit(0)).select(F.col("markdown")).collect() == []
