"""Main text of pages: structure names what it can, nearest-URL differencing settles the rest.

A page becomes text lines, one per block. Elements that HTML or their class names mark as menus,
footers, adverts, comments and the like are left out; lines of an article or main element are text.
Within a host, pages are ordered by URL path and each is aligned with its nearest neighbour by the
longest common subsequence of lines. Shared lines are template, and are deleted where structure
doesn't say that they belong to the article: articles also share lines when texts quote or copy
each other, and those have to stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listinglake.llm.common import attach, numbered, stored
from listinglake.sources import tags

WORD = re.compile(r"[a-z]+")

# Elements by what they mean in HTML.
RAW = frozenset("script style noscript template iframe svg math textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LEFT_OUT = frozenset("head nav footer aside form button select option menu dialog object audio video canvas".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
) - {"br"}
CLOSE_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "caption", "option", "tbody", "thead", "tfoot"}
# Words of a class, id or role that mark what isn't the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion comment comments discussion replies reply respond sidebar notice "
    "notices alert cookie cookies consent gdpr menu nav navbar navigation breadcrumb breadcrumbs footer popup modal overlay newsletter subscribe share "
    "sharing social related recommended pagination pager toolbar contentinfo complementary search masthead login signup disclaimer".split()
)
FORGIVEN = frozenset("html body article main".split())
# Those of them that are clear inside an article too, where a section on related work or a notice is text.
CLEAR = frozenset(
    "ad ads advert adverts advertisement adsense sponsored comment comments cookie cookies consent gdpr nav navbar navigation breadcrumb breadcrumbs "
    "sidebar newsletter subscribe pagination pager".split()
)
# In an article's own header, which is text: elements and words that tell who wrote it and when.
BY = frozenset("address time".split())
BYLINE = frozenset("byline author authors dateline meta published".split())

OPEN, TEXT, OUT = 0, 1, 2  # undecided, of the article, left out


def _role(name: str, attributes: list[tuple[str, str | None]], state: int, in_header: bool) -> int:
    """What an element's content is, given what it stands in."""
    if state == OUT:
        return OUT
    if name in LEFT_OUT or name == "header" and state == OPEN or in_header and name in BY:
        return OUT
    if name in MAIN:
        state = TEXT
    words = {k: set(WORD.findall((v or "").lower())) for k, v in attributes}
    if name not in FORGIVEN:
        for k in ("class", "id", "role"):
            held = words.get(k, frozenset())
            if held & (CLEAR if state == TEXT and k != "role" else NOISE) or in_header and held & BYLINE:
                return OUT
        if "main" in words.get("role", ()):
            return TEXT
    elif name == "article" and {"comment", "comments", "reply"} & {w for k, held in words.items() for w in (k, *held)}:
        return OUT
    return state


def lines_of(page: str) -> list[tuple[str, int]]:
    """The page's text lines, those left out excepted, each with OPEN or TEXT.

    A header of the page is left out. An article's own header is text, but for what says who wrote it
    and when; words of classes and ids that could as well name a section count outside articles only.
    A tag that the page's end cuts off is text.
    """
    found: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    state, in_header = OPEN, False

    def close_line() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                found.append((text, state))

    def keep(piece: str) -> None:
        if state != OUT and piece:
            parts.append(html.unescape(piece) if "&" in piece else piece)

    def close_to(i: int) -> None:
        nonlocal state, in_header
        for name, _, _ in stack[i:]:
            places[name].pop()
            if name in BLOCK:
                blocks.pop()
        del stack[i:]
        _, state, in_header = stack[-1] if stack else ("", OPEN, False)

    for kind, name, value in tags.tokens(page, RAW):
        if kind in (tags.TEXT, tags.CUT):
            keep(value)
        elif kind == tags.CDATA:
            keep(value.replace("&", "&amp;"))
        if kind not in (tags.START, tags.EMPTY, tags.END):
            continue
        if name == "br":
            keep(" ")
            continue
        if name in BLOCK:
            close_line()
        if kind == tags.END:
            if places.get(name):
                close_to(places[name][-1])
            continue
        if name in RAW or name in VOID or kind == tags.EMPTY and name not in BLOCK and name not in LEFT_OUT:
            continue
        if name in CLOSE_P and places.get("p") and places["p"][-1] >= (blocks[-1] if blocks else 0):
            close_to(places["p"][-1])
        state, in_header = _role(name, value, state, in_header), in_header or name == "header" and state == TEXT
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        stack.append((name, state, in_header))
    close_line()
    return found


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Equal ends are taken first and lines that the other page lacks are set aside; what is left is
    solved row by row on bit vectors.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < min(len(a), len(b)) - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[start:len(a) - tail]) & set(b[start:len(b) - tail])
    x = [i for i in range(start, len(a) - tail) if a[i] in both]
    y = [v for v in b[start:len(b) - tail] if v in both]
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, [full]
    for i in x:
        hit = row & where[a[i]]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    inner, j = [], len(y) - 1
    i = len(x)
    while i and j >= 0:
        # a cleared bit of a row is where the length grows by one
        if rows[i] >> j & 1:
            j -= 1
        elif not rows[i - 1] >> j & 1:
            i -= 1
        else:
            inner.append(x[i - 1])
            i, j = i - 1, j - 1
    return [*range(start), *reversed(inner), *range(len(a) - tail, len(a))]


def nearness(a: str, b: str) -> tuple[int, int]:
    """How much of their paths two pages share: whole segments, then characters."""
    segments = chars = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        segments += 1
    for x, y in zip(a, b):
        if x != y:
            break
        chars += 1
    return segments, chars


def shared_lines(page: tuple, before: tuple | None, after: tuple | None) -> list[int]:
    """Positions of the lines that ``page`` shares with its nearest neighbour; each is (host, path, prints).

    A neighbour of another host is none, and a copy of the page tells nothing.
    """
    near = [n for n in (before, after) if n is not None and n[0] == page[0] and n[2] != page[2]]
    if not near:
        return []
    nearest = max(near, key=lambda n: nearness(page[1], n[1]))  # the earlier of equals
    return common_lines(page[2], nearest[2])


# Neighbouring runs of pages that are aligned in one group.
BLOCK_PAGES = 1000


def _parsed(pages: DataFrame, id_col: str, url: str, page: str, prints: bool) -> DataFrame:
    """The lines of every page: their prints, or their text.

    ``key`` names a row by its id, url and html; equal rows share it and have the same lines. With
    ``prints``: (url, key, prints). Else (page_id, url, key, article, open): the article's text, null
    without one, and the undecided lines of a page without.
    """
    from xxhash import xxh3_128_digest, xxh64_intdigest

    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.to_json(F.struct(F.col(id_col).alias("i"), F.col(url).alias("u"))).alias("named"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    names = ["url", "key", "prints"] if prints else ["page_id", "url", "key", "article", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first, second = [], [], []
            for named, text in zip(batch.column(2), batch.column(3)):
                text = text.as_py()
                keys.append(xxh3_128_digest(f"{named.as_py()}\n{text}".encode()))
                lines = lines_of(text)
                if prints:
                    first.append([xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t, _ in lines])
                else:
                    article = any(kind == TEXT for _, kind in lines)
                    first.append(" ".join(t for t, kind in lines if kind == TEXT) if article else None)
                    second.append([] if article else [t for t, _ in lines])
            made = [pa.array(keys, pa.binary())]
            made += [pa.array(first, pa.list_(pa.int64()))] if prints else [pa.array(first, pa.string()), pa.array(second, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *made] if prints else [batch.column(0), batch.column(1), *made], names)

    key, text = F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("article")
    if prints:
        schema = picked.select("url", key, F.lit(None).cast("array<long>").alias("prints")).schema
    else:
        schema = picked.select("page_id", "url", key, text, F.lit(None).cast("array<string>").alias("open")).schema
    return picked.mapInArrow(run, schema)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each run shares with the runs around it, for the runs of each block, which come in order; edges of other blocks only help.

    Rows (block, run, size, key, host, path, last, prints, edge) in, (run, size, key, before, after,
    shared_before, shared_after) out: the paths of the pages around the run, and the positions of the lines
    it has in common with each, null without one. A run of one page is only compared with the nearer one.
    """
    held: list[tuple] = []

    def settle(before, page, after):
        if page is None or page[8]:
            return None
        before, after = (n if n is not None and n[0] == page[0] and n[4] == page[4] else None for n in (before, after))
        if page[2] == 1 and before is not None and after is not None:
            if nearness(page[5], before[6]) >= nearness(page[5], after[5]):
                after = None
            else:
                before = None
        paths = before and before[6], after and after[5]
        return *page[1:4], *paths, *(n and common_lines(page[7], n[7]) for n in (before, after))

    def batch_of(found):
        found = [f for f in found if f is not None]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["run", "size", "key", "before", "after", "shared_before", "shared_after"]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)], names)

    for batch in batches:
        found = []
        for row in zip(*(batch.column(i).to_pylist() for i in range(9))):
            held.append(row)
            if len(held) == 3:
                found.append(settle(*held))
                held = held[1:]
            elif len(held) == 2:
                found.append(settle(None, *held))
        yield batch_of(found)
    if held:
        yield batch_of([settle(held[-2] if len(held) > 1 else None, held[-1], None)])


def _nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shared) of the pages (key, path, before, after, shared_before, shared_after) of longer runs."""
    for batch in batches:
        keys, found = [], []
        for key, path, before, after, *shared in zip(*(c.to_pylist() for c in batch.columns)):
            first = after is None or before is not None and nearness(path, before) >= nearness(path, after)
            keys.append(key)
            found.append(shared[0 if first else 1] or [])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int32()))], ["key", "shared"])


def differences(pages: DataFrame, id_col: str, url: str, page: str) -> DataFrame:
    """(key, shared): the positions of the lines every page shares with the nearest page of its host that isn't a copy.

    Prints of lines travel, not the lines. Pages are numbered along (host, path) by a range sort. Neighbours
    of one host with equal prints are a run, however long; one row per run is aligned, in blocks of
    consecutive runs, and the runs at a block's ends go to the next block too. Each page of a run then takes
    what the run shares with the page before it or after it, by its own path.
    """
    read = stored(_parsed(pages, id_col, url, page, prints=True))
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/]*", 0))
    path = F.regexp_replace(F.regexp_replace(bare, r"^[^/]*", ""), r"/$|\.html?$", "")
    ordered = read.select("key", host.alias("host"), path.alias("path"), "prints").orderBy("host", "path", "key")
    placed = numbered(ordered, "place")
    total = read.count()

    print_of = placed.select("place", F.xxhash64("host", "prints").alias("print"))
    next_to = print_of.select((F.col("place") + 1).alias("place"), F.col("print").alias("was"))
    heads = print_of.join(next_to, "place", "left").where("was is null or was <> print").select(F.col("place").alias("start"))
    runs = numbered(heads.orderBy("start"), "run")
    until = runs.select((F.col("run") - 1).alias("run"), F.col("start").alias("until"))
    runs = stored(runs.join(until, "run", "left").select("run", "start", (F.coalesce("until", F.lit(total)) - F.col("start")).alias("size")))
    longer = runs.where("size > 1")
    ends = longer.select("run", (F.col("start") + F.col("size") - 1).alias("place")).join(placed, "place").select("run", F.col("path").alias("last"))
    whole = runs.join(placed, F.col("start") == F.col("place")).join(ends, "run", "left")

    block = F.floor(F.col("run") / BLOCK_PAGES)
    at = F.col("run") % BLOCK_PAGES
    blocks = F.when(at == 0, F.array(block, block - 1)).when(at == BLOCK_PAGES - 1, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = whole.withColumn("block", F.explode(blocks)).select(
        "block", "run", "size", "key", "host", "path", F.coalesce("last", "path").alias("last"), "prints", (F.col("block") != block).alias("edge")
    )
    out = "run long, size long, key binary, before string, after string, shared_before array<int>, shared_after array<int>"
    aligned = stored(dealt.repartition("block").sortWithinPartitions("block", "run").mapInArrow(_aligned, out))

    single = aligned.where("size = 1").select("key", F.coalesce("shared_before", "shared_after", F.array().cast("array<int>")).alias("shared"))
    places = longer.select("run", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("place"))
    members = stored(places.join(placed, "place").select("run", "key", "path"))
    copied = attach(members, aligned.where("size > 1").drop("key"), "run", "size", total)
    each = copied.select("key", "path", "before", "after", "shared_before", "shared_after").mapInArrow(_nearer, "key binary, shared array<int>")
    return single.unionByName(each)


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_shared (lines in common with the nearest page) per row.

    A page with an article keeps the article's lines; one without keeps the lines that structure
    doesn't leave out and the nearest page of its host doesn't share. A null page has no text, a
    null url belongs to a host without a name; repeated rows repeat; copies of a page tell it nothing,
    so the nearest one that differs is looked for beyond them; other columns are ignored; an empty table gives an empty result.
    """
    # equal rows have equal lines, whose neighbours may differ: the row with most in common decides
    found = F.max(F.struct(F.size("shared").alias("n"), "shared"))["shared"]
    shared = differences(pages, id_col, url, page).groupBy("key").agg(found.alias("shared"))
    joined = _parsed(pages, id_col, url, page, prints=False).join(shared, "key")
    own = F.filter("open", lambda t, i: ~F.array_contains("shared", i))
    text = F.coalesce("article", F.array_join(own, " "))
    return joined.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.size("shared").alias("n_shared"))
