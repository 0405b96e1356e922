"""Markup cut into tags and text, in one pass that never goes back.

Tags, quotes and comments end where browsers end them. A tag that the page's end cuts off would
swallow all that follows; from the first such tag on, tags end at their next ``>`` whatever is quoted,
so that the text behind a forgotten quote stays. Where not even that comes, the rest is one cut token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

TEXT, START, EMPTY, END, RAW, CDATA, CUT = range(7)

_MARKUP = re.compile(r"<(?:(?P<start>[a-zA-Z][^ \t\n\f\r/>]*+)|/(?P<end>[a-zA-Z][^ \t\n\f\r/>]*+)|(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|[!?/])")
_ATTRIBUTE = re.compile(
    r"""[ \t\n\f\r/]*+([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>]*+))?+"""
)
_FILLING = re.compile(r"[ \t\n\f\r/]*+")
# A reference by name without a semicolon stays as it is where a query string goes on.
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*+(?:;|(?!=)))")


def _value(raw: str | None) -> str | None:
    if raw is None:
        return None
    if raw[:1] in "\"'":
        raw = raw[1:-1] if len(raw) > 1 and raw[-1] == raw[0] else raw[1:]
    return _REFERENCE.sub(lambda m: unescape(m[0]), raw) if "&" in raw else raw


def _attributes(html: str, at: int, until: int) -> tuple[list[tuple[str, str | None]], int]:
    """The attributes from ``at`` on, and where they end; of equal names the first counts."""
    found: dict[str, str | None] = {}
    while (part := _ATTRIBUTE.match(html, at, until)) is not None:
        found.setdefault(part[1].lower(), _value(part[2]))
        at = part.end()
    return list(found.items()), _FILLING.match(html, at, until).end()


def tokens(html: str, raw: frozenset[str] = frozenset()) -> Iterator[tuple[int, str, str | list[tuple[str, str | None]]]]:
    """(kind, name, value) in order: TEXT as written, START with its attributes (EMPTY if it ends in ``/>``), END, CDATA's content.

    The content of elements in ``raw`` comes as one RAW, up to their end tag or the page's end.
    """
    at, end, quoted, closed = 0, len(html), True, {}
    while at < end:
        mark = _MARKUP.search(html, at)
        if mark is None:
            yield TEXT, "", html[at:]
            return
        if mark.start() > at:
            yield TEXT, "", html[at:mark.start()]
        at = mark.end()
        if mark["comment"]:
            # an empty comment may be closed by the dashes that opened it
            empty = 1 if html.startswith(">", at) else 2 if html.startswith("->", at) else 0
            stop = html.find("-->", at)
            at = at + empty if empty else end if stop < 0 else stop + 3
        elif mark["cdata"]:
            stop = html.find("]]>", at)
            yield CDATA, "", html[at:] if stop < 0 else html[at:stop]
            at = end if stop < 0 else stop + 3
        elif mark["start"] or mark["end"]:
            name = (mark["start"] or mark["end"]).lower()
            attributes, stop = _attributes(html, at, end) if quoted else ([], end)
            if stop >= end:
                quoted, stop = False, html.find(">", at)
                if stop < 0:
                    yield CUT, "", html[mark.start():]
                    return
                attributes, _ = _attributes(html, at, stop)
            at = stop + 1
            if mark["end"]:
                yield END, name, []
                continue
            yield EMPTY if html[stop - 1] == "/" else START, name, attributes
            if name in raw:
                if name not in closed:
                    closed[name] = re.compile(rf"</{re.escape(name)}(?=[ \t\n\f\r/>])", re.I)
                stop = closed[name].search(html, at)
                yield RAW, name, html[at:stop.start() if stop else end]
                at = stop.start() if stop else end
        else:
            stop = html.find(">", at)
            at = end if stop < 0 else stop + 1
