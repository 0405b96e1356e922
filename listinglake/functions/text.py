"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listinglake.functions.once import once

# Every character that counts as white space: ASCII, all Unicode separators, the control ones.
SPACE = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))


def stripped(text: Column) -> Column:
    """Trimmed of every kind of white space; ``trim`` alone takes only U+0020."""
    # a text between printing ASCII characters is trimmed, which saves it the pattern
    closed = F.ascii(F.substring(text, 1, 1)).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)
    return F.when(closed, text).otherwise(F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", ""))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the count all length limits are written in."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def longer_than(text: Column, limit: int) -> Column:
    """More than ``limit`` UTF-16 units; only texts near the limit are encoded to tell."""
    n = F.length(text)
    return (n > limit) | ((n * 2 > limit) & (utf16_length(text) > limit))


def words(text: Column) -> Column:
    """Words between runs of ASCII white space."""
    # most words open with a printing ASCII character, which saves them the pattern
    plain = lambda w: F.ascii(w).between(33, 126)
    return F.filter(F.split(stripped(text), r"\s+"), lambda w: plain(w) | not_blank(w))


def shortened(text: Column, limit: int = 60) -> Column:
    """The text on one line in quotes, cut after ``limit`` UTF-16 units; no character is cut in two."""
    def quoted(line: Column) -> Column:
        # what a cut can keep: characters beyond the first plane count twice
        ends = F.transform(F.sequence(F.lit(0), F.lit(limit)), lambda n: F.left(line, n))
        kept = F.element_at(F.filter(ends, lambda part: utf16_length(part) <= limit), -1)
        return F.when(~longer_than(line, limit), F.concat(F.lit('"'), line, F.lit('"'))).otherwise(
            F.concat(F.lit('"'), kept, F.lit('..."'))
        )

    line = lambda text: F.array_join(words(text), " ")
    # the words of a text's start begin the line of the whole; enough of them decide what is quoted
    start = lambda begun: F.when(longer_than(begun, limit), begun).otherwise(line(text))
    return once(once(line(F.left(text, F.lit(8 * limit))), start), quoted)


def title_words(title: Column) -> Column:
    """Distinct words of a title by letters and digits alone, so ``80's`` is ``80s``."""
    bare = F.transform(words(F.lower(title)), lambda w: F.regexp_replace(w, r"[^\p{L}\p{Nd}]", ""))
    return F.array_distinct(F.filter(bare, lambda w: w != ""))


def similarity_words(title: Column) -> Column:
    """Distinct words of more than two characters, in a fixed order with the longest first.

    Longer words are the rarer ones, which keeps the prefixes that index a title selective.
    """
    found = F.array_distinct(F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda w: longer_than(w, 2)))
    keyed = F.transform(found, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda s: s["w"])


def title_spacing(text: Column) -> Column:
    """Every Unicode space a plain one, runs collapsed, ends trimmed; line breaks and tabs stay."""
    return F.trim(F.regexp_replace(text, r"\p{Zs}+", " "))


# Zero-width characters, the byte order mark and the soft hyphen.
INVISIBLE = r"\x{200b}\x{200c}\x{200d}\x{feff}\x{ad}"
# White space other than U+0020, ISO controls, invisible characters.
ODD = rf"[\x{{00}}-\x{{1f}}\x{{7f}}-\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}{INVISIBLE}]"


def odd_characters(title: Column) -> Column:
    """The characters a title may not hold, named ``U+%04X``, sorted and distinct."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(title, F.lit(f"({ODD})"), F.lit(1))))
    return F.array_join(F.transform(found, lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))), ", ")


def title_problem(title: Column) -> Column:
    """Why a title is refused: ``blank``, the odd characters it holds, ``spacing``; else null."""
    return (
        F.when(is_blank(title), F.lit("blank"))
        .when(title.rlike(ODD), odd_characters(title))
        .when((title != F.trim(title)) | title.contains("  "), F.lit("spacing"))
    )


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
