"""Web pages to sanitised Markdown: headings, paragraphs, lists, tables, quotations, code, links and emphasis.

A page is cut into comments, tags and text by one pattern that takes time in proportion to the page, and a stack of open
elements decides what text belongs to. Scripts, styles, forms' controls, embedded objects and comments give nothing, nor do
attributes but a link's address and an image's description; a link stays a link only with a relative, http, https or mailto
address, else its text stays. So nothing of the result runs in a browser.

Malformed pages have these results: an element that isn't closed ends where an element around it ends, a list item where
the next one begins, a paragraph at the next block, emphasis and links at the end of their block; closing tags without an
opening one, and attributes' stray quotes, are passed over; a comment or script that isn't closed takes the rest. A null
page gives nulls, an empty one empty Markdown.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
SAFE = re.compile(r"(?:https?:|mailto:|[^:/?#]*+(?:[/?#]|\Z))", re.I)
# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())  # their content is no markup
HIDDEN = frozenset("script style textarea xmp noembed noframes noscript template iframe object svg math select button canvas audio video".split())
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
BLOCKS = frozenset([*HEADINGS, *"html body head p div section article header footer nav aside main ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form address hr title".split()])
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
CELLS = ("td", "th")
#: Kind of element: its names, and the elements that it can stand in again before it is closed.
KINDS = {"p": (("p",), ("table", *CELLS, "li", "div", "blockquote")), "item": (("li",), ("ul", "ol")), "term": (("dt", "dd"), ("dl",)), "cell": (CELLS, ("table",)), "row": (("tr",), ("table",))}
CLOSES = {name: kind for kind, (names, _) in KINDS.items() for name in names}  # other blocks close a paragraph
BREAK = "\ue000"  # stands for a line break; taken out of texts
SPACES = "".join(filter(str.isspace, map(chr, range(0x3001)))) + BREAK
COLUMNS = pa.struct([("title", pa.string()), ("markdown", pa.string()), ("headings", pa.int32()), ("links", pa.int32()), ("tables", pa.int32())])


class Page:
    """One page on its way to Markdown."""

    def __init__(self):
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.stack: list[str] = []
        self.open_ = Counter()  # the stack's names; what is asked at each text or block takes no walk over the stack
        self.hidden = 0
        self.within: list[str] = []  # open cells and tables
        self.heads: list[str] = []  # open headings
        self.scopes = {kind: [0] for kind in KINDS}  # open elements of a kind since the last one that it can stand in again
        self.inline: list[tuple[str, int, str]] = []  # emphasis and links that are open: name, place in the line, address
        self.lists: list[int | None] = []  # the last number of each open list, None without numbers
        self.tables: list[list[list[str]]] = []
        self.title = ""
        self.headings = self.links = self.made = 0
        self.pending_cell = ""  # what blocks within a cell have given
        self.item = False  # whether the next block begins a list item

    def read(self, page: str) -> Page:
        at = 0
        while at < len(page):
            m = TOKEN.match(page, at)
            at = m.end()
            if m[2] is None:
                if not m[0].startswith(("<!", "<?")):
                    self.text(entities.unescape(m[0]))
                continue
            name = m[2].lower()
            if m[1]:
                self.close(name)
            elif name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                content, at = page[at : end.start() if end else len(page)], end.start() if end else len(page)
                self.title = self.title or (" ".join(entities.unescape(content).split()) if name == "title" else "")
            else:
                self.open(name, m[3])
        while self.stack:
            self.close(self.stack[-1])
        self.flush()
        return self

    def text(self, text: str) -> None:
        if not self.hidden:
            self.line.append(text.replace(BREAK, ""))

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            kind = CLOSES.get(name, "p")
            if self.scopes[kind][-1]:
                self.close(next(n for n in reversed(self.stack) if n in KINDS[kind][0]))
            self.flush()
        if name == "br":
            self.line.append(BREAK)
        elif name == "hr":
            self.blocks.append("---")
        elif name == "img":
            self.text(self.attribute(attributes, "alt"))
        if name in VOID:
            return
        self.push(name)
        if name in ("ul", "ol"):
            self.lists.append(0 if name == "ol" else None)
        elif name == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
            self.item = True
        elif name == "table":
            self.tables.append([])
        elif name == "tr" and self.tables:
            self.tables[-1].append([])
        elif name in MARKS or name == "a":
            self.inline.append((name, len(self.line), self.attribute(attributes, "href") if name == "a" else ""))

    def push(self, name: str) -> None:
        self.stack.append(name)
        self.open_[name] += 1
        self.hidden += name in HIDDEN
        if name in CELLS or name == "table":
            self.within.append(name)
        if name in HEADINGS:
            self.heads.append(name)
        for kind, (names, borders) in KINDS.items():
            if name in borders:
                self.scopes[kind].append(0)
            if name in names:
                self.scopes[kind][-1] += 1

    def pop(self) -> str:
        name = self.stack.pop()
        self.open_[name] -= 1
        self.hidden -= name in HIDDEN
        if name in CELLS or name == "table":
            self.within.pop()
        if name in HEADINGS:
            self.heads.pop()
        for kind, (names, borders) in KINDS.items():
            if name in names:
                self.scopes[kind][-1] -= 1
            if name in borders:
                self.scopes[kind].pop()
        return name

    def close(self, name: str) -> None:
        if not self.open_[name]:
            return
        while True:
            last = self.pop()
            if last in BLOCKS:
                self.flush(last)
            elif last in MARKS or last == "a":
                self.end_inline(last)
            if last in ("ul", "ol"):
                self.lists.pop()
            elif last == "li":
                self.item = False
            elif last == "table":
                self.end_table()
            if last == name:
                return

    def end_inline(self, name: str) -> None:
        """Wraps what stands since the last open one of this name; those within it end with it."""
        if not any(n == name for n, *_ in self.inline):
            return
        while True:
            own, at, address = self.inline.pop()
            inner = "".join(self.line[at:])
            if core := inner.strip(SPACES):
                lead, tail = inner[: len(inner) - len(inner.lstrip(SPACES))], inner[len(inner.rstrip(SPACES)) :]
                if own == "a":
                    wrapped = core
                    if address and SAFE.match(address):
                        self.links += 1
                        wrapped = f"[{wrapped}]({address})"
                else:
                    wrapped = f"{MARKS[own]}{core}{MARKS[own]}"
                self.line[at:] = [lead + wrapped + tail]
            if own == name:
                return

    def attribute(self, attributes: str, name: str) -> str:
        value = next((a or b or c for n, a, b, c in ATTRIBUTE.findall(attributes) if n.lower() == name), "")
        return re.sub(r"[\x00-\x20\x7f()<>]", lambda m: f"%{ord(m[0]):02X}", entities.unescape(value).strip()) if name == "href" else entities.unescape(value)

    def flush(self, ending: str = "") -> None:
        """Ends the block that the line belongs to; ``ending`` has just left the stack."""
        while self.inline:
            self.end_inline(self.inline[-1][0])
        raw, self.line = "".join(self.line), []
        pre = self.open_["pre"] or ending == "pre"
        if pre:
            text = raw.replace(BREAK, "\n").strip("\n")
        else:  # a break ends a line, all other white space is one space
            text = "\n".join(x for x in (" ".join(part.split()) for part in raw.split(BREAK)) if x)
        cell = ending if ending in CELLS or ending == "table" else self.within[-1] if self.within else ""
        if cell in CELLS and self.tables:
            rows = self.tables[-1]
            if not rows:
                rows.append([])
            flat = " ".join(text.split()).replace("|", "\\|")
            if ending in CELLS:
                rows[-1].append(" ".join(filter(None, [self.pending_cell, flat])))
                self.pending_cell = ""
            elif flat:
                self.pending_cell = " ".join(filter(None, [self.pending_cell, flat]))
            return
        if not text.strip():
            return
        if pre:
            self.blocks.append(f"```\n{text}\n```")
            return
        heading = HEADINGS[self.heads[0]] if self.heads else HEADINGS.get(ending, "")
        if heading:
            self.headings += 1
            text = heading + " ".join(text.split())
        if self.lists:
            depth, n = len(self.lists) - 1, self.lists[-1]
            mark = "- " if n is None else f"{n}. "
            text = "  " * depth + (mark if self.item else " " * len(mark)) + text.replace("\n", "\n" + "  " * (depth + 1))
            self.item = False
        quoted = "> " * (self.open_["blockquote"] + (ending == "blockquote"))
        self.blocks.append("\n".join(quoted + x for x in text.split("\n")) if quoted else text)

    def end_table(self) -> None:
        rows = [r for r in self.tables.pop() if r]
        if not rows:
            return
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        text = "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])
        if self.tables:  # a table in a cell
            self.pending_cell = " ".join(filter(None, [self.pending_cell, " ".join(c for r in rows for c in r if c)]))
            return
        self.made += 1
        self.blocks.append(text)

    def markdown(self) -> str:
        return "\n\n".join(self.blocks)


PIECE = 64  # pages whose Markdown is held as Python's strings at a time


def convert(pages: pa.Array) -> pa.Array:
    """COLUMNS of each page. Results become Arrow's a few pages at a time: a batch's results as Python's strings, four bytes
    a character at worst, would all stand beside the batch."""
    done = []
    for lo in range(0, len(pages), PIECE):
        out = []
        for page in pages.slice(lo, PIECE):
            p = None if not page.is_valid else Page().read(page.as_py())
            out.append(p and {"title": p.title, "markdown": p.markdown(), "headings": p.headings, "links": p.links, "tables": p.made})
        done.append(pa.array(out, COLUMNS))
    return pa.concat_arrays(done) if done else pa.array([], COLUMNS)


def converted(page: Column) -> Column:
    """title, markdown, headings, links, tables of each page."""

    @F.arrow_udf("struct<title: string, markdown: string, headings: int, links: int, tables: int>")
    def run(pages: pa.Array) -> pa.Array:
        return convert(pages)

    return run(page)


def pages_to_markdown(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with title, markdown, headings, links and tables in place of the pages; columns of these names are replaced."""
    own = [c for c in pages.columns if c != page and c not in ("title", "markdown", "headings", "links", "tables")]
    return pages.select(*own, converted(F.col(page)).alias("_page")).select(*own, "_page.*")
