"""Pages as arrays of nodes.

A page's tree is built once, next to the page, and stays in the page's row: nodes are numbered in
document order from 1 and carry the number of their last descendant, so what is inside what is told
by two numbers; selecting, descending and reading text are array expressions over one row and need no
shuffle (``operators.dom``). Building takes time and memory in proportion to the page, however its
tags are nested or broken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from listinglake.sources import tags

NODE_SCHEMA = (
    "array<struct<node_id: int, end_id: int, depth: int, tag: string, classes: array<string>, "
    "attrs: map<string, string>, text: string>>"
)
TEXT = "#text"

# Elements without content, and those that stand on lines of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside audio blockquote body canvas caption center col colgroup dd del details dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html ins li link "
    "main math menu meta nav noframes noscript ol p pre script section style svg table tbody td template tfoot th "
    "thead title tr ul video".split()
)
# Start tags that end an open paragraph, and those that end an open sibling.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
ENDS_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
KEEPS_SPACE = frozenset({"pre", "textarea", "title"})
# Elements whose content is no markup, and those of them that show it.
UNSEEN, SHOWN = frozenset({"script", "style"}), frozenset({"textarea", "title"})
_SPACES = re.compile("[ \t\n\f\r\xa0]+")
_NO_WIDTH = re.compile("[​­]")


class _Tree:
    """The nodes so far, and which elements are open: in order, and by tag."""

    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.places: dict[str, list[int]] = {}
        self.gap = False

    def _add(self, tag: str, attrs: list, text: str | None) -> dict:
        node = {
            "node_id": len(self.nodes) + 1, "end_id": len(self.nodes) + 1, "depth": len(self.open), "tag": tag,
            "classes": next((v for k, v in attrs if k == "class" and v), "").split(), "attrs": attrs, "text": text,
        }
        self.nodes.append(node)
        return node

    def _close_to(self, index: int) -> None:
        for node in self.open[index:]:
            node["end_id"] = len(self.nodes)
            self.gap |= node["tag"] in BLOCK
            self.places[node["tag"]].pop()
        del self.open[index:]

    def _innermost(self, names: set[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def close(self, names: set[str], within: set[str] = frozenset()) -> None:
        """Close the innermost open element of ``names``, unless one of ``within`` lies inside it."""
        index = self._innermost(names)
        if index >= 0 and index > self._innermost(within):
            self._close_to(index)

    def start(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_SIBLING:
            self.close(*ENDS_SIBLING[tag])
        if tag in ENDS_P:
            self.close({"p"}, {"button", "td", "th", "table", "object"})
        node = self._add(tag, [(k, v or "") for k, v in attrs], None)
        self.gap |= tag in BLOCK or tag == "br"
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def text(self, data: str) -> None:
        parent = self.open[-1]["tag"] if self.open else ""
        text = data if parent in KEEPS_SPACE else _SPACES.sub(" ", _NO_WIDTH.sub("", data))
        if text:
            self._add(TEXT, [], (" " if self.gap else "") + text)
            self.gap = False

    def finish(self) -> list[dict]:
        self._close_to(0)
        return self.nodes


def nodes_of(html: str | None) -> list[dict] | None:
    """The nodes of one page. Unclosed and misnested tags are tolerated, as browsers do."""
    if html is None:
        return None
    tree = _Tree()
    for kind, name, value in tags.tokens(html, UNSEEN | SHOWN):
        if kind in (tags.START, tags.EMPTY):
            tree.start(name, value)
        elif kind == tags.END:
            tree.close({name})
        elif kind == tags.TEXT or kind == tags.RAW and name in SHOWN and value:
            tree.text(unescape(value) if "&" in value else value)
    return tree.finish()


_ARROW = pa.list_(
    pa.struct([
        ("node_id", pa.int32()), ("end_id", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
        ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
    ])
)


def with_nodes(rows: DataFrame, column: str, name: str = "nodes") -> DataFrame:
    """Replace a column of HTML by its nodes. Batches pass through Arrow; a page is never split."""
    kept = [f for f in rows.schema if f.name != column]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{name}` {NODE_SCHEMA}"])

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                nodes = pa.array([nodes_of(html.as_py()) for html in part.column(column)], type=_ARROW)
                arrays = [part.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*arrays, nodes], [*[f.name for f in kept], name])

    return rows.mapInArrow(shred, schema)
