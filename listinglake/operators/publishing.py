"""The published what's-on list: which gigs, in which order, what changed, which images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.text import stripped
from listinglake.functions.urls import cached_image, published_image
from listinglake.model import RENDERED
from listinglake.skew import with_position
from listinglake.venues import with_venue_name


def upcoming(gigs: DataFrame, today: Column) -> DataFrame:
    return gigs.where(F.col("date") >= today)


def page_window(gigs: DataFrame, today: Column) -> DataFrame:
    """From today to the same day next year, both included."""
    return gigs.where(F.col("date").between(today, F.add_months(today, 12)))


def drop_stale_days(cards: DataFrame, now: Column) -> DataFrame:
    """Cards of days not over in London at the instant ``now`` (UTC)."""
    return cards.where(F.col("date") >= F.from_utc_timestamp(now, "Europe/London").cast("date"))


def cards(metal: DataFrame, today: Column) -> DataFrame:
    """Published rows, unordered; ``first_seq`` keeps the order ties fall back on."""
    image = F.concat(F.lit("images/"), published_image(F.col("date"), F.col("venue_id"), F.col("poster_url")))
    return with_venue_name(page_window(metal, today).withColumn("image_url", image)).select(
        "date", "title", "venue", "url", "image_url", "venue_id", "poster_url", "first_seq"
    )


def title_order() -> list[Column]:
    return [F.lower("title"), F.col("first_seq")]


def page_rows(metal: DataFrame, today: Column) -> DataFrame:
    """Cards by day, then by title ignoring case: one global range sort."""
    return cards(metal, today).orderBy("date", *title_order())


def display_date(date: Column) -> Column:
    return F.date_format(date, "EEEE, d MMMM yyyy")


def date_groups(page: DataFrame) -> DataFrame:
    """The page's days with their heading and size. A day's cards stay rows, see ``placed``."""
    return page.groupBy("date").agg(F.count(F.lit(1)).alias("n_gigs")).select("date", display_date(F.col("date")).alias("display_date"), "n_gigs")


def placed(page: DataFrame) -> DataFrame:
    """Every card with its day's heading and its place within the day.

    A day's cards are rows in order rather than one nested list, so a day of any size stays spread
    over tasks; writing partitioned by date gives one folder per group.
    """
    return with_position(page, ["date"], title_order()).withColumn("display_date", display_date(F.col("date")))


def day_pages(placed_cards: DataFrame, size: int = 500) -> DataFrame:
    """Cards of ``placed`` as lists of at most ``size``, numbered per day from 1, each list in page order.

    A list's bound is the parameter, so a day with half of all cards becomes many rows on many tasks.
    Every list of a day but its last is full; exploded, the lists are the cards that went in.
    """
    if size < 1:
        raise ValueError("a page holds at least one card")
    number = F.floor((F.col("position") - 1) / size).cast("long") + 1
    # the place comes first in each card, so sorting a list puts it in page order
    card = F.struct("position", *[F.col(c) for c in placed_cards.columns if c not in ("date", "display_date", "position")])
    return placed_cards.groupBy("date", "display_date", number.alias("page")).agg(F.array_sort(F.collect_list(card)).alias("cards"))


def search(page: DataFrame, query: str) -> DataFrame:
    """Cards whose title or venue holds the query, case aside. A blank query keeps all."""
    wanted = F.lower(stripped(F.lit(query)))
    text = F.lower(F.concat_ws("\n", "title", "venue"))
    return page.where((wanted == "") | F.contains(text, wanted))


def no_matches(found: DataFrame, query: str) -> bool:
    """Whether to say that nothing matched: never for a blank query."""
    return bool(query.strip()) and found.isEmpty()


def day_prints(page: DataFrame, columns: Sequence[str] = ("title", "venue", "url", "image_url")) -> DataFrame:
    """One print per day of its cards, by fixed-size aggregates that do not depend on row order."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]
    card = F.concat_ws("\u0001", *said)
    return page.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(card)).alias("x"),
        F.sum(F.xxhash64(F.lit("."), card).cast("decimal(38,0)")).alias("s"),
    )


def publish_delta(page: DataFrame, published: DataFrame) -> DataFrame:
    """Days whose cards differ from what is published; none means nothing moves."""
    new, old = day_prints(page).alias("new"), day_prints(published).alias("old")
    same = (F.col("new.n") == F.col("old.n")) & (F.col("new.x") == F.col("old.x")) & (F.col("new.s") == F.col("old.s"))
    return (
        new.join(old, F.col("new.date") == F.col("old.date"), "full")
        .select(
            F.coalesce("new.date", "old.date").alias("date"),
            F.when(F.col("old.n").isNull(), "added").when(F.col("new.n").isNull(), "removed")
            .when(~same, "changed").alias("change"),
        )
        .where(F.col("change").isNotNull())
    )


def snapshot_stamp(at: Column) -> Column:
    """The name a render is archived under; it sorts as its time does."""
    return F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def write_snapshot(page: DataFrame, path: str, stamp: str) -> None:
    """Archive one render in a folder of its own; earlier ones stay."""
    page.withColumn("snapshot", F.lit(stamp)).write.mode("append").partitionBy("snapshot").parquet(path)


def current_snapshot(archive: DataFrame) -> DataFrame:
    """The newest render of the archive. The stamp is a partition value: only its folder is read."""
    newest = archive.agg(F.max("snapshot")).first()[0]
    return archive.where(F.col("snapshot") == newest)


def rendered_entry(page: DataFrame, file: str, today: Column, at: Column) -> DataFrame:
    """The log entry for a render."""
    return page.agg(F.count(F.lit(1)).cast("int").alias("gig_count")).select(
        F.lit(RENDERED).alias("_type"), at.alias("recorded_at"), F.lit(file).alias("file"), "gig_count", today.alias("logical_date")
    )


def image_names(gigs: DataFrame) -> DataFrame:
    return gigs.select(
        published_image(F.col("date"), F.col("venue_id"), F.col("poster_url")).alias("file"), "poster_url"
    ).distinct()


def images_to_publish(page: DataFrame, published: DataFrame) -> DataFrame:
    """Images the page shows that are not published yet (``published`` has ``file``)."""
    return image_names(page).join(published.select("file"), "file", "left_anti")


def images_to_drop(metal: DataFrame, published: DataFrame) -> DataFrame:
    """Published images no metal gig claims, whether on the page or off it."""
    return published.select("file").join(image_names(metal).select("file"), "file", "left_anti")


def images_to_cache(gigs: DataFrame, cached: DataFrame) -> DataFrame:
    """Posters not downloaded yet, each once however many gigs share it."""
    wanted = gigs.select("poster_url").distinct().withColumn("file", cached_image(F.col("poster_url")))
    return wanted.join(cached.select("file"), "file", "left_anti")
