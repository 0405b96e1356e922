"""Dates as venues print them, always the start date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listinglake.functions.once import once

# English month names in order.
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
]
# The forms dates take, with day, month and year as groups.
ORDINAL = r"(\d{1,2})\w*\s+(\w+),?\s+(\d{4})"
SHORT = r"(\d{2}) (\w{3}) (\d{4})"
SHORT_YEAR = r"(\d{1,2}) (\w{3}) (\d{2})"
DOTTED_YEAR = r"\w{3}\.(\d{2})\.(\w{3})\.(\d{2})"
SINGLE = r"(\d{1,2})\s+(\w+)\s+(\d{4})"
DAY_MONTH = r"(\d{1,2})\w*\s+(\w+)"
ISO = r"(\d{4}-\d{2}-\d{2})"
MONTH_FIRST_START = r"^(\w+)\s+(\d{1,2})\w{2}"
MONTH_FIRST_END = r"-\s*(\w+)\s+\d{1,2}\w{2}\s+(\d{4})"
ORDINAL_PLAIN = r"(\d{1,2})\w{2}\s+(\w+)\s+(\d{4})"


def month_number(name: Column) -> Column:
    """1 to 12 for a three-letter month name or a full one in any case; null for anything else."""
    short = F.find_in_set(name, F.lit(",".join(m[:3] for m in MONTHS)))
    full = F.find_in_set(F.upper(name), F.lit(",".join(m.upper() for m in MONTHS)))
    # a name is in one list at most, but for May, which has the same place in both
    return F.nullif(F.greatest(short, full), F.lit(0))


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is no such day."""
    midnight = (F.lit(0), F.lit(0), F.lit(0))
    return F.try_make_timestamp_ntz(year, month, day, *midnight).cast("date")


def _number(text: Column) -> Column:
    return text.try_cast("int")


def iso_date(text: Column, pattern: str = ISO) -> Column:
    """The first ``yyyy-MM-dd`` in an attribute, a timestamp or a url."""
    return F.regexp_extract(text, pattern, 1).try_cast("date")


def local_date(instant: Column, zone: Column) -> Column:
    """The date of a UTC instant where the venue is."""
    return F.from_utc_timestamp(instant, zone).cast("date")


def printed_date(text: Column, pattern: str, century: int = 0) -> Column:
    """Day, month name and year by one of the patterns; ``century`` completes two-digit years."""
    day, month, year = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    return day_of(_number(year) + century, month_number(month), _number(day))


def _range_year(end_year: Column, start_month: Column, end_month: Column) -> Column:
    """A range states its year at the end; one that starts in a later month started the year before."""
    return end_year - (start_month > end_month).cast("int")


def range_start(text: Column) -> Column:
    """``1 - 9 Aug 2026``, ``19 Sep - 5 Dec 2026``, ``11 Dec - 3 Jan 2027``, or one day."""
    line = F.trim(text)

    def ranged(ends: Column) -> Column:
        left, right = F.try_element_at(ends, F.lit(1)), F.try_element_at(ends, F.lit(2))
        end_month = month_number(F.regexp_extract(right, SINGLE, 2))
        named = F.regexp_extract(left, r"^\d{1,2}\s+(\w+)", 1)
        parts = F.struct(
            _number(F.regexp_extract(left, r"^(\d{1,2})", 1)).alias("day"),
            F.when(named == "", end_month).otherwise(month_number(named)).alias("month"),
            end_month.alias("end_month"), _number(F.regexp_extract(right, SINGLE, 3)).alias("end_year"),
        )
        return once(parts, _start_of)

    several = once(F.split(line, r"\s*-\s*", 2), ranged)
    return F.when(F.instr(line, "-") > 0, several).otherwise(printed_date(line, SINGLE))


def _start_of(parts: Column) -> Column:
    year = _range_year(parts["end_year"], parts["month"], parts["end_month"])
    return day_of(year, parts["month"], parts["day"])


def month_first_range_start(text: Column) -> Column:
    """``September 10th - October 3rd 2026``, or ``10th September 2026``."""
    line = F.trim(text)
    month = lambda p: month_number(F.regexp_extract(line, p, 1))
    number = lambda p: _number(F.regexp_extract(line, p, 2))
    ranged = once(
        F.struct(number(MONTH_FIRST_START).alias("day"), month(MONTH_FIRST_START).alias("month"), month(MONTH_FIRST_END).alias("end_month"), number(MONTH_FIRST_END).alias("end_year")), _start_of
    )
    return F.when(line.rlike(MONTH_FIRST_END), ranged).otherwise(printed_date(line, ORDINAL_PLAIN))


def parts_start(day: Column, month: Column, end_month: Column, end_year: Column) -> Column:
    """A range whose parts are marked up on their own."""
    parts = F.struct(
        _number(F.trim(day)).alias("day"), month_number(F.trim(month)).alias("month"),
        month_number(F.trim(end_month)).alias("end_month"), _number(F.trim(end_year)).alias("end_year"),
    )
    return once(parts, _start_of)


def block_date(block: Column, day: Column) -> Column:
    """A day within a block headed ``August 2026``."""
    words = F.split(block, " ")
    return day_of(_number(F.try_element_at(words, F.lit(2))), month_number(F.try_element_at(words, F.lit(1))), _number(day))
