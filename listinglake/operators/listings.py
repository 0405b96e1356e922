"""From extracted rows to one listing per venue: order, years, first copies, failures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listinglake.session import durable
from listinglake.skew import BLOCK_ROWS, attach, carry_forward, shuffled, with_position


def dedupe_first(rows: DataFrame, key: Sequence[str | Column], position: str = "listing_pos") -> DataFrame:
    """The first row in listing order of every key, by aggregation: copies fold before the shuffle."""
    first = F.min_by(F.struct(*rows.columns), position).alias("_row")
    return rows.groupBy(*key).agg(first).select("_row.*")


def later_month(month: Column, previous: Column) -> Column:
    """The year turns where the month falls back."""
    return month < previous


def january_after_another(month: Column, previous: Column) -> Column:
    """The year turns where January follows any other month."""
    return (month == 1) & (previous != 1)


def running_year(
    rows: DataFrame,
    base_year: int,
    turns: Callable[[Column, Column], Column] = later_month,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Give rows with a ``month`` but no year their ``year``, in listing order per venue.

    Positions are distinct within a venue and may leave gaps, as pages do, so places are numbered
    first. Blocks of places count their own turns; one row per block carries the count on.
    """
    placed = with_position(rows, ["venue_id"], [F.col("listing_pos")], "_place")
    blocked, keys = carry_forward(placed, ["venue_id"], "_place", block_rows)
    within = Window.partitionBy(*keys).orderBy("listing_pos")
    turned = blocked.withColumn("_turn", F.coalesce(turns(F.col("month"), F.lag("month").over(within)), F.lit(False)).cast("int"))
    counted = turned.withColumn("_turns", F.sum("_turn").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda pick: pick(F.struct("listing_pos", "month"))["month"]
    folds = turned.groupBy(*keys).agg(
        F.sum("_turn").alias("inside"), at(F.min).alias("first"), at(F.max).alias("last")
    )
    blocks = Window.partitionBy("venue_id").orderBy("_block")
    edge = F.coalesce(turns(F.col("first"), F.lag("last").over(blocks)), F.lit(False)).cast("int")
    carried = (
        folds.withColumn("edge", edge)
        .withColumn("_before", F.sum(F.col("inside") + F.col("edge")).over(blocks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("inside"))
        .select(*keys, "_before")
    )
    return (
        attach(counted, durable(carried), keys, "inner")
        .withColumn("year", (F.lit(base_year) + F.col("_before") + F.col("_turns")).cast("int"))
        .select(*rows.columns, "year")
    )


def page_position(page_no: Column, item_no: Column) -> Column:
    """A row's place in its venue's listing: by page, then by place on the page."""
    return F.shiftleft(page_no.cast("bigint"), 32) + item_no


def pages_in_use(pages: DataFrame) -> DataFrame:
    """All pages (``venue_id, page_no`` from 0, ``items``) before their venue's first page without items.

    How far a crawler may go is its own affair: what it has fetched is read. ``after_gap`` marks
    a page whose predecessor is not there, which is a failure of its venue.
    """
    ends = durable(
        pages.where(F.col("items") == 0).groupBy("venue_id").agg(F.min("page_no").alias("first_empty"))
    )
    kept = attach(pages, ends, ["venue_id"]).where(F.col("first_empty").isNull() | (F.col("page_no") < F.col("first_empty")))
    before = pages.select("venue_id", (F.col("page_no") + 1).alias("page_no"), F.lit(True).alias("_led"))
    return (
        kept.drop("first_empty").join(shuffled(before), ["venue_id", "page_no"], "left")
        .withColumn("after_gap", (F.col("page_no") > 0) & F.col("_led").isNull()).drop("_led")
    )


def missing_pages(used: DataFrame) -> DataFrame:
    """The page missing before each page in use that has none before it, with its venue's failure."""
    number = F.col("page_no") - 1
    return used.where("after_gap").select(
        "venue_id", number.cast("int").alias("page_no"), F.concat(F.lit("Page "), number.cast("string"), F.lit(" is missing")).alias("error")
    )


def stalled_pages(guide: DataFrame) -> DataFrame:
    """Guide pages (``venue_id, page_no, last_month`` as yyyymm) that lead no further than the page before.

    Each page meets its predecessor by number, so no venue's pages gather in one task.
    """
    before = guide.select("venue_id", (F.col("page_no") + 1).alias("page_no"), F.col("last_month").alias("before"))
    return guide.join(before, ["venue_id", "page_no"]).where(F.col("last_month") <= F.col("before"))


def continued_pages(guide: DataFrame) -> DataFrame:
    """Guide pages that ask for another: those short of the ``guide_end`` the guide declares."""
    return guide.where(F.col("last_month") < F.col("guide_end"))


def failed_fetches(pages: DataFrame) -> DataFrame:
    """Venues with a page that did not open, and the first such url."""
    # fixed value: the failure's words
    closed = pages.where(~F.col("status").between(200, 299))
    return closed.groupBy("venue_id").agg(
        F.count(F.lit(1)).alias("failed_pages"), F.min(F.struct("page_no", "url", "status")).alias("first")
    ).select("venue_id", "failed_pages", F.concat(F.lit("Failed to fetch "), "first.url", F.lit(": "), F.col("first.status").cast("string")).alias("error"))


def isolate_failures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows carry an ``error`` or null. One error takes its whole venue out, and no other.

    Returns the rows of intact venues, and per failed venue how many rows failed and the first reason.
    """
    failed = durable(
        rows.where(F.col("error").isNotNull()).groupBy("venue_id")
        .agg(F.count(F.lit(1)).alias("failures"), F.min(F.struct("listing_pos", "error")).alias("first"))
        .select("venue_id", "failures", F.col("first.error").alias("error"))
    )
    return attach(rows, failed.select("venue_id"), ["venue_id"], "left_anti").drop("error"), failed


def silent_venues(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Venues asked whose payload held no event at all."""
    return asked.select("venue_id").distinct().join(rows.select("venue_id").distinct(), "venue_id", "left_anti")
