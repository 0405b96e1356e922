"""The venue dimension. Rows are few and fixed, so joins with it are always broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Venue id, display name.
VENUES = [
    ("cart-and-horses", "Cart & Horses"),
    ("new-cross-inn", "New Cross Inn"),
    ("black-heart", "The Black Heart"),
    ("underworld", "The Underworld"),
    ("dome", "The Dome"),
    ("fiddlers-elbow", "The Fiddler's Elbow"),
    ("blondies-taproom", "Blondies Brewery Taproom"),
    ("blondies-bar", "Blondies Bar"),
    ("helgis", "Helgi's"),
    ("electric-ballroom", "Electric Ballroom"),
    ("electric-brixton", "Electric Brixton"),
    ("dingwalls", "Dingwalls"),
    ("the-garage", "The Garage"),
    ("roundhouse", "Roundhouse"),
    ("signature-brew-blackhorse-road", "Signature Brew Blackhorse Road"),
    ("signature-brew-haggerston", "Signature Brew Haggerston"),
    ("o2-forum-kentish-town", "O2 Forum Kentish Town"),
    ("o2-academy-brixton", "O2 Academy Brixton"),
    ("the-grace", "The Grace"),
    ("o2-academy-islington", "O2 Academy Islington"),
    ("o2-shepherds-bush-empire", "O2 Shepherd's Bush Empire"),
    ("union-chapel", "Union Chapel"),
    ("scala", "Scala"),
    ("229", "229"),
    ("alexandra-palace", "Alexandra Palace"),
    ("paper-dress-vintage", "Paper Dress Vintage"),
    ("the-dev", "The Dev"),
    ("windmill-brixton", "Windmill Brixton"),
    ("islington-assembly-hall", "Islington Assembly Hall"),
    ("barfly", "Barfly"),
    ("indigo-at-the-o2", "indigo at The O2"),
    ("the-o2-arena", "The O2 Arena"),
    ("eventim-apollo", "Eventim Apollo"),
    ("ovo-arena", "OVO Arena Wembley"),
]
# The venues whose listing is only ever a poster image.
POSTER_ONLY = ["the-dev"]
# Titles a venue's poster lists that are not gigs, matched ignoring case.
EXCLUDED_TITLES = {"the-dev": "karaoke"}

VENUE_IDS = [venue_id for venue_id, _ in VENUES]

_SCHEMA = "venue_id string, name string, has_source boolean, excluded_title_regex string"


def venues(spark: SparkSession) -> DataFrame:
    rows = [(v, n, v not in POSTER_ONLY, EXCLUDED_TITLES.get(v)) for v, n in VENUES]
    return spark.createDataFrame(rows, _SCHEMA)


def with_venue_name(df: DataFrame) -> DataFrame:
    """Add the venue's display name as ``venue``; an id the dimension lacks fails the job."""
    named = venues(df.sparkSession).select("venue_id", F.col("name").alias("_name"))
    unknown = F.raise_error(F.concat(F.lit("Unknown venue id: "), F.col("venue_id")))
    return (
        df.join(F.broadcast(named), "venue_id", "left")
        .withColumn("venue", F.when(F.col("_name").isNull(), unknown).otherwise(F.col("_name")))
        .drop("_name")
    )


def unknown_venues(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested venue ids that the known ones lack."""
    return requested.select("venue_id").distinct().join(known.select("venue_id"), "venue_id", "left_anti")
