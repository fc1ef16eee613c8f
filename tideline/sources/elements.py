"""HTML pages to a table of elements (base of S8 and S12).

One pass of the standard parser per page, inside ``mapInPandas``; everything after
it is SQL on the element table.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template"}
CLOSES_P = {
    "p", "div", "ul", "ol", "li", "table", "section", "article", "header", "footer", "nav", "form", "blockquote", "pre",
    "h1", "h2", "h3", "h4", "h5", "h6",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

ELEMENT_DDL = (
    "seq int, tag string, classes string, href string, text string, box int, box_kind string, box_part string,"
    "next_href string, block string, parent_text string"
)


class _Node:
    __slots__ = ("seq", "tag", "attrs", "classes", "parent", "children", "first", "last", "at")

    def __init__(self, seq: int, tag: str, attrs: dict, parent: "_Node | None", first: int):
        self.seq, self.tag, self.attrs, self.parent = seq, tag, attrs, parent
        self.classes = (attrs.get("class") or "").split()
        self.children: list = []
        self.first, self.last = first, None
        self.at = len(parent.children) if parent else 0


class _Tree(HTMLParser):
    """Nodes in document order; text pieces in one list that nodes point into."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.nodes: list[_Node] = []
        self.scripts: list[tuple[_Node, list[str]]] = []
        self.top = _Node(-1, "#document", {}, None, 0)
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_if_open("p", stop={"td", "li", "div", "section", "article"})
        if tag == "li":
            self._close_if_open("li", stop={"ul", "ol"})
        node = _Node(len(self.nodes), tag, dict(attrs), self.open[-1], len(self.pieces))
        self.nodes.append(node)
        self.open[-1].children.append(node)
        if tag == "script":
            self.scripts.append((node, []))
        if tag in VOID:
            node.last = len(self.pieces)
        else:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            while True:
                node = self.open.pop()
                node.last = len(self.pieces)
                if node.tag == tag:
                    return

    def _close_if_open(self, tag, stop):
        for node in reversed(self.open[1:]):
            if node.tag == tag:
                self.handle_endtag(tag)
                return
            if node.tag in stop:
                return

    def handle_data(self, data):
        current = self.open[-1]
        if current.tag == "script":
            self.scripts[-1][1].append(data)
        elif current.tag not in HIDDEN and data.strip():
            self.pieces.append(data.strip())
            current.children.append(data.strip())

    def finish(self):
        self.close()
        for node in self.open:
            node.last = len(self.pieces)

    def text(self, node: _Node, sep: str = " ") -> str:
        return sep.join(self.pieces[node.first:node.last])


def _box_of(node: _Node) -> tuple[int | None, str | None, str | None]:
    """Nearest enclosing job box: its number, kind, and the part the node is in."""
    part, at = None, node
    while at is not None:
        classes = at.classes
        if "posting-title" in classes or "posting-name" in classes:
            part = part or "title"
        if "location" in classes:
            part = part or "location"
        if "ashby-job-posting-brief-title" in classes:
            part = part or "title"
        if "opening" in classes:
            return at.seq, "opening", part
        if "posting" in classes:
            return at.seq, "posting", part
        if "data-job-id" in at.attrs:
            return at.seq, "ashby", part
        if at.tag == "li" and _in_job_list(at):
            return at.seq, "list", part
        at = at.parent
    return None, None, None


def _in_job_list(node: _Node) -> bool:
    at = node.parent
    while at is not None:
        if "jobs-list" in at.classes or "careers-list" in at.classes or (at.tag in ("ul", "ol") and "jobs" in at.classes):
            return True
        at = at.parent
    return False


def _block_after(tree: _Tree, node: _Node) -> str:
    """Text of the siblings after a heading up to the next h2 or h3."""
    lines = []
    for child in node.parent.children[node.at + 1:]:
        if isinstance(child, str):
            lines.append(child)
        elif child.tag in ("h2", "h3"):
            break
        elif child.last > child.first:
            lines.append(tree.text(child, "\n"))
    return "\n".join(lines)


def elements_of(html: str, parents: bool = False) -> Iterator[tuple]:
    """Rows of `ELEMENT_DDL` for links, headings, job-box parts, structured-data
    scripts, and one ``#lines`` row with the text of the whole page."""
    tree = _Tree()
    tree.feed(html or "")
    tree.finish()
    following: str | None = None
    next_link: dict[int, str | None] = {}
    for node in reversed(tree.nodes):
        next_link[node.seq] = following
        if node.tag == "a":
            following = node.attrs.get("href")
    for node in tree.nodes:
        box, kind, part = _box_of(node)
        if node.tag != "a" and node.tag not in HEADINGS and part is None:
            continue
        yield (
            node.seq, node.tag, " ".join(node.classes), node.attrs.get("href"), tree.text(node), box, kind, part,
            next_link[node.seq] if node.tag in HEADINGS else None,
            _block_after(tree, node) if node.tag in ("h2", "h3") else None,
            tree.text(node.parent) if parents and node.tag == "a" else None,
        )
    for node, data in tree.scripts:
        if node.attrs.get("type") == "application/ld+json":
            yield (node.seq, "script", "", None, "".join(data), None, None, None, None, None, None)
    yield (len(tree.nodes), "#lines", "", None, "\n".join(tree.pieces), None, None, None, None, None, None)


def page_elements(pages: DataFrame, key: str = "page_id", tags: tuple[str, ...] | None = None, parents: bool = False) -> DataFrame:
    """Element table of ``pages`` (key, html). ``tags`` keeps only these tags; with
    ``parents`` every link carries the text around it.

    Pages are dealt out before they are parsed: parsing costs far more than moving
    them, and a small compressed file of many pages would be parsed in one task. They
    are dealt over all shuffle partitions, as adaptive execution would merge these by
    their bytes, and alike pages are few bytes."""
    key_type = dict(pages.dtypes)[key]
    names = [f.split()[0] for f in ELEMENT_DDL.split(",")]
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for page, html in zip(batch[key], batch["html"]):
                rows += [(page, *e) for e in elements_of(html, parents) if tags is None or e[1] in tags]
                if len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=[key, *names])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=[key, *names])

    return pages.select(key, "html").repartition(parts, key).mapInPandas(parse, f"{key} {key_type}, {ELEMENT_DDL}")
