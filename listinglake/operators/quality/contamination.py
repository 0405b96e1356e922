"""Site-wide text repeated through a venue's descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.functions.once import once
from listinglake.functions.text import not_blank, words
from listinglake.operators.quality.batch import CLAIM, Batch, gig_print
from listinglake.session import durable
from listinglake.skew import attach, shuffled

# Words per phrase, share of a row's words that marks it, rows worth comparing.
PHRASE_WORDS, MARKED_SHARE, LEAST_ROWS = 6, 0.5, 3
# The fewest counters that a venue's phrases fall into in the first pass, a multiple of 64.
COUNTERS = 4096


def phrase_counters(found: Column, counters: Column) -> Column:
    """The counter each run of six words falls into, in order; null for texts shorter than that."""
    # a run's hash reads the words' hashes where they are: cutting them out first took four times as long
    run = lambda hashed, i: F.xxhash64(*[F.get(hashed, i + k) for k in range(PHRASE_WORDS)])
    starts = lambda hashed: F.sequence(F.lit(0), F.greatest(F.size(hashed) - PHRASE_WORDS, F.lit(0)))
    runs = once(
        F.transform(found, lambda w: F.xxhash64(w)),
        lambda hashed: F.transform(starts(hashed), lambda i: F.pmod(run(hashed, i), counters).cast("int")),
    )
    return F.when(F.size(found) >= PHRASE_WORDS, runs)


def counters_for(longest: Column, least: int) -> Column:
    """Counters of a venue whose longest text has so many characters: a power of two times ``least``.

    A text of n characters has at most n / 2 words, in practice a sixth of n, so one text never
    sets more than half of the counters, however long it is.
    """
    doublings = F.ceil(F.log2(F.greatest(longest / least, F.lit(1.0)))).cast("int")
    return F.call_function("shiftleft", F.lit(least).cast("bigint"), doublings)


def _bitmaps(likely: DataFrame, venues: DataFrame) -> DataFrame:
    """Each venue's counters as an array of 64-bit masks, about an eighth as long as its longest text."""
    place = F.floor(F.col("counter") / 64).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("counter") % 64)
    places = F.explode(F.sequence(F.lit(0), (F.col("counters") / 64 - 1).cast("int")))
    every = venues.select("number", places.alias("i"), F.lit(0).cast("bigint").alias("mask"))
    masks = likely.select("number", place.alias("i"), bit.alias("mask")).unionByName(every)
    in_order = masks.groupBy("number", "i").agg(F.bit_or("mask").alias("mask")).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("i", "mask"))).alias("m"))
    bits = F.transform("m", lambda x: x["mask"])
    return in_order.select("number", bits.alias("bits")).where(F.exists("bits", lambda m: m != 0))


def contaminated(listing: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Gigs made up mostly of phrases that half of their venue's rows share.

    ``listing`` has ``venue_id, listing_pos, gig, description``. A phrase is shared when at least
    ``max(2, ceil(rows / 2))`` distinct gigs hold it. Sending every phrase of every text through a
    shuffle would dwarf the texts, so a first pass counts phrases into counters, at least ``counters``
    per venue and as many as its longest text calls for, combined before the shuffle: a counter below the threshold cannot hold a shared
    phrase. The second pass lets through only phrases of the other counters, and counts those by
    their words. Nothing is missed, since a counter is never less than any phrase in it.
    """
    rows = listing.where(not_blank(F.col("description")))
    venues = durable(
        rows.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("description")).alias("longest")).where(F.col("n") >= LEAST_ROWS)
        .select("venue_id", F.greatest(F.lit(2), F.ceil(F.col("n") / 2)).cast("bigint").alias("need"), counters_for(F.col("longest"), counters).alias("counters"), "n")
        # counters are counted under a number, since there are nearly as many as words
        .withColumn("number", F.monotonically_increasing_id())
    )
    split = lambda df: df.withColumn("w", words(F.col("description"))).withColumn("runs", phrase_counters(F.col("w"), F.col("counters")))

    counted = split(attach(rows, venues, ["venue_id"], "inner", size="n")).select(
        "number", F.explode(F.array_distinct("runs")).alias("counter")
    )
    often = counted.groupBy("number", "counter").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 1)
    likely = durable(
        _bitmaps(
            attach(often, venues.select("number", "need"), ["number"], "inner").where(F.col("held") >= F.col("need")), venues
        ).join(shuffled(venues), "number").drop("number")
    )
    is_likely = lambda c: F.call_function("getbit", F.element_at("bits", F.floor(c / 64).cast("int") + 1), c % 64) == 1
    kept = F.filter(
        F.transform("runs", lambda c, i: F.when(is_likely(c), i)), lambda i: i.isNotNull()
    )
    texts = F.transform(kept, lambda i: F.array_join(F.slice("w", i + 1, PHRASE_WORDS), " "))
    held = split(attach(rows, likely, ["venue_id"], "inner", size="n")).select(
        "venue_id", "need", "gig", "listing_pos", F.size("w").alias("n_words"), F.explode(texts).alias("phrase")
    )
    # identical rows are one gig: their phrases count once, however often they are listed
    repeats = durable(
        held.groupBy("venue_id", "gig", "listing_pos", "phrase")
        .agg(F.count(F.lit(1)).alias("times"), F.max("need").alias("need"), F.max("n_words").alias("n_words"))
        .groupBy("venue_id", "gig", "phrase")
        .agg(F.max("times").alias("times"), F.max("need").alias("need"), F.max("n_words").alias("n_words"),
             F.min("listing_pos").alias("listing_pos"))
    )
    shared = durable(
        repeats.groupBy("venue_id", "phrase").agg(F.count(F.lit(1)).alias("gigs"), F.max("need").alias("need"))
        .where(F.col("gigs") >= F.col("need")).select("venue_id", "phrase")
    )
    covered = attach(repeats, shared, ["venue_id", "phrase"], "left_semi", stored=True).groupBy("venue_id", "gig").agg(
        F.sum("times").alias("times"), F.max("n_words").alias("n_words"), F.min("listing_pos").alias("listing_pos")
    )
    share = F.least(F.col("times") * PHRASE_WORDS, F.col("n_words")) / F.col("n_words")
    return covered.withColumn("share", share).where(F.col("share") >= MARKED_SHARE)


def contamination(batch: Batch) -> DataFrame:
    """One marked gig names every row of its venue, those with blank text too."""
    listing = batch.listing.select("venue_id", "listing_pos", "description", gig_print().alias("gig"))
    marked = durable(contaminated(listing).groupBy("venue_id").agg(F.count(F.lit(1)).alias("affected")))
    sizes = batch.facts.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))
    # fixed value: the report's words
    detail = F.concat(
        F.col("affected").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" gig(s) mostly shared text")
    )
    flagged = durable(
        sizes.join(marked, "venue_id").select("venue_id", "n", F.lit("shared text").alias("problem"), detail.alias("detail"))
    )
    return attach(batch.facts, flagged, ["venue_id"], "inner", size="n").select(*CLAIM)
