"""URL rules as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from listinglake.functions.text import is_blank, not_blank


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def query_of(url: Column) -> Column:
    at = F.instr(url, "?")
    return F.when(at > 0, url.substr(at + 1, F.length(url))).otherwise(F.lit(""))


def is_under(url: Column, prefixes: Column) -> Column:
    """The url starts with one of an array of prefixes."""
    return F.exists(prefixes, lambda p: F.startswith(url, p))


def dated_key(url: Column, date: Column) -> Column:
    """One page per night: the date as the url's fragment."""
    return F.concat_ws("#", url, date.cast("string"))


def resolved(link: Column, base: Column) -> Column:
    """A link as a full url: absolute, scheme-relative, host-relative, or beside the base page."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(page, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_extract(base, "^([^#]*)", 1), link))
        .otherwise(F.concat(folder, link))
    )


def first_not_blank(*links: Column) -> Column:
    return F.try_element_at(F.filter(F.array(*links), not_blank), F.lit(1))


def without_params(url: Column, starting: Iterable[str]) -> Column:
    """The url without query parameters that start as given, and without blank ones."""
    drop = list(starting)

    def kept(p: Column) -> Column:
        keep = ~is_blank(p)
        for prefix in drop:
            keep = keep & ~F.startswith(p, F.lit(prefix))
        return keep

    params = F.filter(F.split(query_of(url), "&"), kept)
    base = without_query(url)
    return F.when(F.size(params) == 0, base).otherwise(F.concat(base, F.lit("?"), F.array_join(params, "&")))


def original_size(url: Column) -> Column:
    """Without the parameters a picture's page adds to have it scaled."""
    return without_params(url, ["mode=", "width="])


def imgix_full_width(url: Column) -> Column:
    """An imgix picture at full width; other hosts' urls stay."""
    return F.when(url.contains("imgix.net"), without_params(url, ["w="])).otherwise(url)


def without_thumbnail_suffix(url: Column) -> Column:
    """The full picture's name behind ``-lbox-WxH-FFF.ext`` or ``-WxH-c-center.ext``."""
    lbox = F.regexp_replace(url, r"-lbox-\d+x\d+-FFF(\.\w+)$", "$1")
    return F.regexp_replace(lbox, r"-\d+x\d+-c-center(\.\w+)$", "$1")


def css_background(style: Column) -> Column:
    """The url in a CSS background, quoted either way; null without one."""
    single, double = F.regexp_extract(style, r"url\('([^']+)'\)", 1), F.regexp_extract(style, r'url\("([^"]+)"\)', 1)
    return F.coalesce(F.nullif(single, F.lit("")), F.nullif(double, F.lit("")))


def widest_of(srcset: Column) -> Column:
    """The url of the widest ``srcset`` entry, the first on ties; null when none states a width."""
    entries = F.split(srcset, ",")
    sized = F.transform(
        entries,
        lambda e, i: F.struct(
            _width(e).alias("w"),
            (-i).alias("first"),
            F.element_at(F.split(F.trim(e), r"\s+"), 1).alias("url"),
        ),
    )
    return F.array_max(F.filter(sized, lambda s: s["w"].isNotNull()))["url"]


def _width(entry: Column) -> Column:
    return F.regexp_extract(F.trim(entry), r"^\S+\s+(-?\d{1,9})w?(?:\s|$)", 1).try_cast("int")


def file_extension(url: Column) -> Column:
    """What follows the last dot of the last path segment, ``jpg`` without one."""
    name = F.substring_index(without_query(url), "/", -1)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit("jpg"))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def published_image(date: Column, venue_id: Column, poster_url: Column) -> Column:
    return F.concat(F.concat_ws("-", date.cast("string"), venue_id, short_hash(poster_url)), F.lit(".webp"))


def cached_image(poster_url: Column) -> Column:
    return F.concat_ws(".", short_hash(poster_url), file_extension(poster_url))


def image_mime(header: Column, url: Column) -> Column:
    """The content type a response states, else the one its url's extension stands for."""
    stated = F.trim(F.substring_index(header, ";", 1))
    by_name = F.lower(file_extension(url))
    return F.coalesce(
        F.when(not_blank(stated), stated),
        F.when(by_name == "png", "image/png").when(by_name == "gif", "image/gif")
        .when(by_name == "webp", "image/webp").otherwise("image/jpeg"),
    )
