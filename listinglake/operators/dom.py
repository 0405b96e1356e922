"""Selecting in a page's nodes and reading their text, as array expressions.

``nodes`` is a whole page's array, where a node's number is its place; ``part`` is any subset in
document order. A selector is a struct column, so it can be written in code with ``selector`` or
come from a table of rules, one row per venue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.once import once
from listinglake.sources.html import TEXT, with_nodes

# tag, classes (all of them), id, attribute present / equal to / containing, a class it must not
# have; and what some ancestor must be
SELECTOR = (
    "struct<tag: string, classes: array<string>, id: string, attr: string, equals: string, part: string, "
    "without: string, in_tag: string, in_class: string, in_id: string>"
)
_FIELDS = ["tag", "classes", "id", "attr", "equals", "part", "without", "in_tag", "in_class", "in_id"]


def selector(**parts: str | list[str]) -> Column:
    unknown = set(parts) - set(_FIELDS)
    if unknown:
        raise ValueError(f"no such selector part: {sorted(unknown)}")
    literal = {k: F.array(*[F.lit(c) for c in v]) if isinstance(v, list) else F.lit(v) for k, v in parts.items()}
    nothing = lambda k: F.lit(None).cast("array<string>" if k == "classes" else "string")
    return F.struct(*[literal.get(k, nothing(k)).alias(k) for k in _FIELDS])


def attr(node: Column, name: str | Column) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name) if isinstance(name, str) else name)


def _absent_or(wanted: Column, test: Column) -> Column:
    return wanted.isNull() | F.coalesce(test, F.lit(False))


def _is_scope(node: Column, s: Column) -> Column:
    """What a selector wants some ancestor to be."""
    return (
        (node["tag"] != TEXT)
        & _absent_or(s["in_tag"], node["tag"] == s["in_tag"])
        & _absent_or(s["in_class"], F.array_contains(node["classes"], s["in_class"]))
        & _absent_or(s["in_id"], F.try_element_at(node["attrs"], F.lit("id")) == s["in_id"])
    )


def _own(node: Column, s: Column) -> Column:
    """What a selector wants of the node itself."""
    value = F.try_element_at(node["attrs"], s["attr"])
    return (
        (node["tag"] != TEXT)
        & _absent_or(s["tag"], node["tag"] == s["tag"])
        & _absent_or(s["classes"], F.size(F.array_except(s["classes"], node["classes"])) == 0)
        & _absent_or(s["id"], F.try_element_at(node["attrs"], F.lit("id")) == s["id"])
        & _absent_or(s["attr"], value.isNotNull())
        & _absent_or(s["equals"], value == s["equals"])
        & _absent_or(s["part"], F.contains(value, s["part"]))
        & (s["without"].isNull() | ~F.coalesce(F.array_contains(node["classes"], s["without"]), F.lit(False)))
    )


def _spans(nodes: Column, s: Column) -> Column:
    """The numbers between which nodes lie inside an ancestor the selector wants; null if it wants none."""
    wanted = s["in_tag"].isNotNull() | s["in_class"].isNotNull() | s["in_id"].isNotNull()
    spans = F.transform(F.filter(nodes, lambda a: _is_scope(a, s)), lambda a: F.struct(a["node_id"].alias("above"), a["end_id"].alias("last")))
    return F.when(wanted, spans)


def _matches(node: Column, s: Column, spans: Column) -> Column:
    inside = F.exists(spans, lambda a: (a["above"] < node["node_id"]) & (node["node_id"] <= a["last"]))
    return _own(node, s) & (spans.isNull() | inside)


def _start(part: Column) -> Column:
    """The number of a run's first node; null where the part has gaps."""
    first_id, last_id = F.get(part, F.lit(0))["node_id"], F.try_element_at(part, F.lit(-1))["node_id"]
    return F.when(last_id - first_id + 1 == F.size(part), first_id)


def select(part: Column, s: Column, nodes: Column | None = None) -> Column:
    """Nodes of ``part`` that match, in document order; ancestors are looked for in ``nodes``."""
    found = lambda p, whole: once(_spans(whole, s), lambda spans: F.filter(p, lambda n: _matches(n, s, spans)))
    return found(part, nodes) if nodes is not None else once(part, lambda p: found(p, p))


def scoped(selectors: Column, nodes: Column) -> Column:
    """An array of selectors with the places of the ancestors they want, for ``select_scoped``.

    Depends on the whole page only, so it is worked out once for all parts that are selected from.
    """
    return F.transform(selectors, lambda s: F.struct(s.alias("s"), _spans(nodes, s).alias("spans")))


def select_scoped(part: Column, found_in: Column) -> Column:
    """Nodes of ``part`` that match any selector of ``scoped``; nothing when that is null."""
    return F.filter(part, lambda n: F.coalesce(F.exists(found_in, lambda x: _matches(n, x["s"], x["spans"])), F.lit(False)))


def select_any(part: Column, selectors: Column, nodes: Column | None = None) -> Column:
    """Nodes of ``part`` that match any of an array of selectors; nothing when the array is null."""
    found = lambda p, whole: once(scoped(selectors, whole), lambda x: select_scoped(p, x))
    return found(part, nodes) if nodes is not None else once(part, lambda p: found(p, p))


def first(part: Column) -> Column:
    """The first node, null without one."""
    return F.try_element_at(part, F.lit(1))


def subtree(nodes: Column, node: Column) -> Column:
    """A node and everything inside it, by place: ``nodes`` is the whole page."""
    return F.slice(nodes, node["node_id"], node["end_id"] - node["node_id"] + 1)


def within(part: Column, node: Column) -> Column:
    """A node and what ``part`` still holds of its inside."""
    def held(p: Column, at: Column) -> Column:
        start = _start(p)
        inside = (at["node_id"] >= start) & (at["end_id"] < start + F.size(p))
        # a run gives it by place
        return F.when(inside, F.slice(p, at["node_id"] - start + 1, at["end_id"] - at["node_id"] + 1)).otherwise(
            F.filter(p, lambda n: n["node_id"].between(at["node_id"], at["end_id"]))
        )

    return once(part, lambda p: once(node, lambda at: held(p, at)))


def children(part: Column, node: Column) -> Column:
    """The elements directly inside a node."""
    inside = within(part, node)
    return F.filter(inside, lambda n: (n["depth"] == node["depth"] + 1) & (n["tag"] != TEXT))


def having(part: Column, s: Column, inner: Column) -> Column:
    """Matching nodes with a descendant that matches ``inner``."""
    return once(
        select(part, inner),
        lambda hits: F.filter(
            select(part, s),
            lambda n: F.exists(hits, lambda h: (h["node_id"] > n["node_id"]) & (h["node_id"] <= n["end_id"])),
        ),
    )


def without(part: Column, removed: Column) -> Column:
    """``part`` less the removed nodes and all inside them."""
    return once(
        removed,
        lambda gone: F.filter(part, lambda n: ~F.exists(gone, lambda r: n["node_id"].between(r["node_id"], r["end_id"]))),
    )


def text_of(part: Column) -> Column:
    """The text of these nodes on one line; blocks and breaks separate, inline elements do not."""
    pieces = F.transform(F.filter(part, lambda n: n["tag"] == TEXT), lambda n: n["text"])
    return F.trim(F.regexp_replace(F.array_join(pieces, ""), " +", " "))


def html_text(rows: DataFrame, column: str) -> DataFrame:
    """Replace a column of markup by the text it shows."""
    return with_nodes(rows, column, "_nodes").withColumn(column, text_of(F.col("_nodes"))).drop("_nodes")


def texts_of(found: Column, part: Column) -> Column:
    """The text of each found node, as an array."""
    return F.transform(found, lambda n: text_of(within(part, n)))


def joined_text(found: Column, part: Column) -> Column:
    """The found nodes' texts, one after the other; ``""`` where they say nothing, null without any."""
    return once(
        found, lambda all_found: F.when(F.size(all_found) > 0, F.trim(F.array_join(F.filter(texts_of(all_found, part), lambda x: x != ""), " ")))
    )


def without_worded(part: Column, found: Column, pattern: Column) -> Column:
    """``part`` less those found nodes whose text matches the pattern."""
    return without(part, F.filter(found, lambda n: F.rlike(text_of(within(part, n)), pattern)))


def take_until(found: Column, part: Column, pattern: Column) -> Column:
    """Found nodes up to, not including, the first whose text matches."""
    worded = lambda n: F.rlike(text_of(within(part, n)), pattern)
    return once(
        _first_id(F.filter(found, worded)), lambda stop: F.filter(found, lambda n: stop.isNull() | (n["node_id"] < stop))
    )


def drop_until(found: Column, part: Column, tag: Column, pattern: Column) -> Column:
    """Found nodes from the first of that tag whose text matches; all of them without one."""
    worded = lambda n: (n["tag"] == tag) & F.rlike(text_of(within(part, n)), pattern)
    return once(
        _first_id(F.filter(found, worded)), lambda start: F.filter(found, lambda n: start.isNull() | (n["node_id"] >= start))
    )


def _first_id(found: Column) -> Column:
    return F.array_min(F.transform(found, lambda n: n["node_id"]))
