"""Gigs that moved to another url: which are missing, what they resemble, what their url says."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.text import similarity_words
from listinglake.functions.urls import resolved
from listinglake.model import KEY
from listinglake.session import durable
from listinglake.skew import attach_counted, shuffled

# Fixed value: the least share of title words two listings of one gig have in common.
LEAST_SIMILAR = 0.4

NIGHT = ["venue_id", "date"]


def missing_gigs(listing: DataFrame, previous: DataFrame, today: Column) -> DataFrame:
    """Gigs the log holds, still to come, that their venue lists no more."""
    return previous.where(F.col("date") >= today).join(listing.select(*KEY).distinct(), KEY, "left_anti")


def url_verdict(url_status: DataFrame) -> DataFrame:
    """What each old url's answer says: moved (and where to), gone, or live."""
    status = F.col("status")
    moved = status.between(300, 399) & F.col("location").isNotNull()
    return url_status.select(
        "url",
        F.when(moved, "moved").when(status.isin(404, 410), "gone").otherwise("live").alias("verdict"),
        F.when(moved, resolved(F.col("location"), F.col("url"))).alias("moved_to"),
    )


def _needed(n: Column, m: Column) -> Column:
    """Words that sets of ``n`` and ``m`` words must share to be similar enough."""
    return F.ceil((n + m) * (LEAST_SIMILAR / (1 + LEAST_SIMILAR)) - 1e-9).cast("int")


def _signatures(titles: DataFrame) -> DataFrame:
    """``titles`` (``size``, and ``ordered`` words, the night's rarest first) under what they meet by.

    Two sets that share enough words share one among the first of either, all but as many as they
    need less one. Words that only one side has come before all others in that order; ``ordered`` leaves them
    out, since nothing meets there. One shared word is enough only where one set has a single word and the other at
    most two; those meet apart (``lone``), so that a common word leads to no other short title.
    """
    n = F.col("size")
    needed = _needed(n, F.greatest(F.lit(2), F.ceil(n * LEAST_SIMILAR - 1e-9).cast("int")))
    filed = lambda words, lone: F.transform(words, lambda w: F.struct(F.lit(lone).alias("lone"), w.alias("word")))
    none = F.slice("ordered", 1, 0)
    every = F.concat(
        filed(F.when(n <= 2, F.col("ordered")).otherwise(none), True),
        filed(F.when(n >= 2, F.slice("ordered", F.lit(1), F.greatest(F.size("ordered") - needed + 1, F.lit(0)))).otherwise(none), False),
    )
    kept = [c for c in titles.columns if c != "ordered"]
    return titles.select(*kept, F.explode(every).alias("_at")).select(*kept, "_at.lone", "_at.word")


def _rarest_first(titles: DataFrame, counts: DataFrame, by: Sequence[str] = (*NIGHT, "words"), mark: str = "word") -> DataFrame:
    """What names a title (``by``), its ``size``, and ``ordered``: the ``mark`` of its words in ``counts``, by how many titles of the night have them.

    Each word travels with what names its title, so long titles should be named by a number.
    """
    named = [c for c in by if c not in NIGHT]
    worded = titles.select(*NIGHT, *named, F.size("words").alias("size"), F.explode("words").alias("word"))
    return attach_counted(worded, counts, [*NIGHT, "word"], "n", "inner").groupBy(*by, "size").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", mark))), lambda w: w[mark]).alias("ordered")
    )


def _shared_words(sets: DataFrame) -> DataFrame:
    """The words that both sides of a night have, with their counts there and a number each."""
    each = sets.select(*NIGHT, "offered", "asked", F.explode("words").alias("word"))
    held = each.groupBy(*NIGHT, "word").agg(F.count(F.lit(1)).alias("n"), F.bool_or("offered").alias("offered"), F.bool_or("asked").alias("asked"))
    return held.where(F.col("offered") & F.col("asked")).select(*NIGHT, "word", "n").withColumn("number", F.monotonically_increasing_id())


def _similarity(common: Column, a: Column, b: Column) -> Column:
    return common / (a + b - common)


def lookalikes(listing: DataFrame, missing: DataFrame) -> DataFrame:
    """For each missing gig the listed one it resembles most, if any.

    Alike is the same venue and night with enough title words in common, or the same poster. The
    most similar wins, then the first in listing order. Result: the missing key, ``by_url``,
    ``similarity``.

    Equal titles are one entry on either side, so copies never meet copies. Titles then meet only
    through a shared word among those, rarest first, that decide similarity; where none is similar enough, the
    titles under the missing gig's own poster meet through any shared word, and where they share
    none, the poster's first listed gig stands. Titles and words are numbered first, and only numbers meet.
    """
    best_first = lambda pos: F.struct((-pos).alias("first"), F.col("url"))
    worded = listing.select(
        *NIGHT, "poster_url", "url", "listing_pos", similarity_words(F.col("title")).alias("words")
    )
    # one row per night, poster and title: the first listed, by partial aggregation; ``place`` grows with ``pick``
    titles = durable(
        worded.groupBy(*NIGHT, "poster_url", "words").agg(F.max(best_first(F.col("listing_pos"))).alias("pick"))
        .orderBy("pick").withColumn("place", F.monotonically_increasing_id())
    )
    gone = durable(
        missing.select(*NIGHT, "poster_url", "url", similarity_words(F.col("title")).alias("words"))
    )
    sides = titles.select(*NIGHT, "words", "place", F.lit(False).alias("gone")).unionByName(
        gone.select(*NIGHT, "words", F.lit(None).cast("bigint").alias("place"), F.lit(True).alias("gone"))
    )
    sets = durable(
        sides.groupBy(*NIGHT, "words")
        .agg(F.max("place").alias("place"), F.count(F.lit(1)).alias("n"), F.bool_or("gone").alias("asked"))
        .select(*NIGHT, "words", "n", "place", F.col("place").isNotNull().alias("offered"), "asked")
        .withColumn("id", F.monotonically_increasing_id())
    )
    names = sets.select(*NIGHT, "words", "n", "id")
    lists = durable(_rarest_first(sets, durable(_shared_words(sets)), by=["id", "offered", "asked"], mark="number"))
    keyed = durable(attach_counted(gone, names, [*NIGHT, "words"], "n", "inner").select(*NIGHT, "poster_url", "url", "id"))

    signed = _signatures(lists).select("id", "size", "offered", "asked", "lone", "word")
    filed = signed.where("offered").select(F.col("id").alias("by_id"), F.col("size").alias("by_size"), "lone", "word")
    a, b = F.col("size"), F.col("by_size")
    met = durable(
        signed.where("asked").join(shuffled(filed), ["word", "lone"])
        # sets too unlike in size cannot have enough in common
        .where(F.least(a, b) >= LEAST_SIMILAR * F.greatest(a, b) - 1e-9)
        # two titles meet at each word they share, and are compared once
        .select("id", "size", "by_id", "by_size").distinct()
    )
    theirs = lists.where("offered").select(F.col("id").alias("by_id"), F.col("ordered").alias("by_ordered"))
    offered = sets.where("offered").select(F.col("id").alias("by_id"), "place")
    alike = durable(
        _best(
            met.join(shuffled(lists.where("asked").select("id", "ordered")), "id").join(shuffled(theirs), "by_id")
            .withColumn("similarity", _similarity(F.size(F.array_intersect("ordered", "by_ordered")), a, b))
            .where(F.col("similarity") >= LEAST_SIMILAR).select("id", "by_id", "similarity").join(shuffled(offered), "by_id"),
            ["id"],
        )
    )

    own_poster = [*NIGHT, "poster_url"]
    pictured = durable(keyed.select(*own_poster, "id").distinct().join(shuffled(alike.select("id")), "id", "left_anti"))
    shown = durable(
        attach_counted(titles.join(shuffled(pictured.select(*own_poster).distinct()), own_poster, "left_semi"), names, [*NIGHT, "words"], "n", "inner")
        .select(*own_poster, "id", "place")
    )
    spelled = lambda rows, *keep: rows.join(shuffled(lists.select("id", "size", "ordered")), "id").select(*keep, F.explode("ordered").alias("word"))
    # titles meet at each word they share; how often they meet is how many words they have in common
    some_word = _best(
        spelled(pictured, "id", "size", "poster_url")
        .join(shuffled(spelled(shown, F.col("size").alias("by_size"), "place", "poster_url")), ["word", "poster_url"])
        .groupBy("id", "size", "poster_url", "place", "by_size").agg(F.count(F.lit(1)).alias("common"))
        .withColumn("similarity", _similarity(F.col("common"), a, b)),
        ["id", "poster_url"],
    )
    first_of_poster = shown.groupBy(*own_poster).agg(F.max("place").alias("first_place"))
    by_poster = (
        pictured.join(shuffled(first_of_poster), own_poster).join(shuffled(some_word), ["id", "poster_url"], "left")
        .select(
            "id", "poster_url",
            F.coalesce("best", F.struct(F.lit(0.0).alias("similarity"), F.col("first_place").alias("place"))).alias("best"),
        )
    )
    sizes = sets.select("id", "n")
    found = attach_counted(keyed, durable(alike.join(shuffled(sizes), "id")), ["id"], "n", "inner").select(*KEY, "date", "best").unionByName(
        attach_counted(keyed, durable(by_poster.join(shuffled(sizes), "id")), ["id", "poster_url"], "n", "inner").select(*KEY, "date", "best")
    )
    picks = titles.select("place", F.col("pick.url").alias("by_url"))
    return (
        found.select(*KEY, "date", "best.place", "best.similarity").join(shuffled(picks), "place")
        .select(*KEY, "date", "by_url", "similarity")
    )


def _best(pairs: DataFrame, key: list[str]) -> DataFrame:
    return pairs.groupBy(*key).agg(F.max(F.struct("similarity", "place")).alias("best"))


def replacements(
    listing: DataFrame, previous: DataFrame, url_status: DataFrame, today: Column
) -> DataFrame:
    """Old key and new for every gig found to have moved.

    A gig nothing resembles is never looked up. A url that redirects names the gig's new home,
    which has to be in the venue's listing; a deleted one leaves it to the best lookalike; one
    still served, or never asked, settles nothing.
    """
    candidates = lookalikes(listing, missing_gigs(listing, previous, today))
    asked = candidates.join(url_verdict(url_status), "url")
    listed = listing.select("venue_id", F.col("url").alias("moved_to"), F.lit(True).alias("listed")).distinct()
    settled = asked.where(F.col("verdict") != "live").join(listed, ["venue_id", "moved_to"], "left")
    target = F.when(F.col("verdict") == "gone", F.col("by_url")).when(F.col("listed"), F.col("moved_to"))
    return (
        settled.select("venue_id", "url", F.col("venue_id").alias("by_venue_id"), target.alias("by_url"))
        .where(F.col("by_url").isNotNull())
    )
