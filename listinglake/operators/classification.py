"""Choosing what to classify, asking a scorer, reading its replies, and what that cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listinglake.classify_rates import TEXT_MODEL, VISION_MODEL, rates
from listinglake.functions.text import longer_than, not_blank, stripped
from listinglake.model import CLASSIFIED, KEY, LLM, METAL, OTHER
from listinglake.operators.as_of import last_known

# Fixed value: a description shorter than this is judged from the poster.
THIN_TEXT = 80


def to_classify(
    current: DataFrame, settled: DataFrame, limit: int | None = None, venue_ids: DataFrame | None = None
) -> DataFrame:
    """Gigs without a verdict, soonest first; only the first ``limit`` where one is given."""
    if venue_ids is not None:
        current = current.join(venue_ids, "venue_id", "left_semi")
    ordered = current.join(settled.select(*KEY), KEY, "left_anti").orderBy("date", "first_seq")
    return ordered if limit is None else ordered.limit(limit)


def use_vision(description: Column) -> Column:
    return ~longer_than(description, THIN_TEXT - 1)


def routed(gigs: DataFrame) -> DataFrame:
    """Each gig with the model that judges it and the text put to that model."""
    vision = use_vision(F.col("description"))
    return gigs.select(
        *KEY,
        "poster_url",
        vision.alias("use_vision"),
        F.when(vision, VISION_MODEL).otherwise(TEXT_MODEL).alias("llm_model"),
        F.concat(F.lit("Title: "), "title", F.lit("\n\nEvent page text: "), "description").alias("prompt"),
    )


# Given one routed row: the reply, and the tokens billed for it where known. May raise.
Judge = Callable[[dict], tuple[str, int | None, int | None]]
# Given a batch of them: for each, in order, what a ``Judge`` returns or the exception it would raise.
BatchJudge = Callable[[list[dict]], list[tuple[str, int | None, int | None] | Exception]]

_SCORED = "reply string, input_tokens int, output_tokens int, error string"


def one_by_one(judge: Judge) -> BatchJudge:
    """A judge of single rows as one of batches; a row that raises loses no other."""

    def ask(rows: list[dict]) -> list:
        answers = []
        for row in rows:
            try:
                answers.append(judge(row))
            except Exception as problem:  # noqa: BLE001
                answers.append(problem)
        return answers

    return ask


def score(asked: DataFrame, judge: Judge, kept: DataFrame | None = None) -> DataFrame:
    """Ask ``judge`` about every routed row. One that raises keeps its reason and loses no other."""
    return score_batches(asked, one_by_one(judge), kept)


def score_batches(asked: DataFrame, judge: BatchJudge, kept: DataFrame | None = None) -> DataFrame:
    """Put every routed row to ``judge``, a batch at a time where the rows lie.

    A row whose answer is an exception keeps its reason; a batch that raises as a whole, or answers
    another number of rows, fails as a whole. ``kept`` holds earlier results of this function: a row
    with the same key, model and prompt that has a reply there is not asked (and paid for) again.
    """
    if kept is not None:
        same = [*KEY, "llm_model", F.sha2("prompt", 256).alias("_asked")]
        had = kept.where(F.col("reply").isNotNull()).select(*same, "reply", "input_tokens", "output_tokens", "error").dropDuplicates([*KEY, "llm_model", "_asked"])
        keyed = asked.withColumn("_asked", F.sha2("prompt", 256))
        on = [*KEY, "llm_model", "_asked"]
        again = keyed.join(had.select(*on), on, "left_anti").select(*asked.columns)
        reused = keyed.join(had, on).select(*asked.columns, "reply", "input_tokens", "output_tokens", "error")
        return score_batches(again, judge).unionByName(reused)
    columns = asked.columns

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.to_dict("records")
            try:
                said = list(judge(rows))
                if len(said) != len(rows):
                    raise ValueError(f"{len(said)} answers to {len(rows)} rows")
            except Exception as problem:  # noqa: BLE001
                said = [problem] * len(rows)
            answers = [(None, None, None, str(a) or repr(a)) if isinstance(a, Exception) else (*a, None) for a in said]
            found = pd.DataFrame(answers, columns=["reply", "input_tokens", "output_tokens", "error"], index=batch.index)
            for name in ("input_tokens", "output_tokens"):
                found[name] = found[name].astype("Int32")
            yield pd.concat([batch[columns], found], axis=1)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema) + ", " + _SCORED
    return asked.mapInPandas(ask, schema)


def genre_of(reply: Column) -> Column:
    """The genre the last non-blank line states and nothing else, give or take ``.`` and ``!``."""
    lines = F.filter(F.split(reply, r"\r\n|\n|\r"), not_blank)
    answer = F.lower(F.regexp_replace(stripped(F.try_element_at(lines, F.lit(-1))), "[.!]+$", ""))
    return F.when(answer == METAL.lower(), METAL).when(answer == OTHER.lower(), OTHER)


def outcomes(scored: DataFrame) -> DataFrame:
    """Scored rows with their genre, or why they have none."""
    genre = genre_of(F.col("reply"))
    unread = F.concat(F.lit('Unexpected reply: "'), stripped(F.col("reply")), F.lit('"'))
    return scored.withColumn("genre", genre).withColumn(
        "error", F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("genre").isNull(), F.coalesce(unread, F.lit("No reply")))
    )


def verdict_entries(outcome: DataFrame, recorded_at: Column) -> DataFrame:
    """Log entries for the rows that have a genre."""
    return outcome.where(F.col("error").isNull()).select(
        F.lit(CLASSIFIED).alias("_type"), recorded_at.alias("recorded_at"), *KEY, "genre",
        F.lit(LLM).alias("source"), "llm_model", "use_vision", "input_tokens", "output_tokens",
    )


def with_cost(verdicts: DataFrame) -> DataFrame:
    """Dollars per verdict at the rate of its UTC day; null where anything needed is unknown."""
    day = F.col("recorded_at").cast("date")
    rate = F.broadcast(rates(verdicts.sparkSession))
    priced = verdicts.join(
        rate,
        (F.col("llm_model") == F.col("model")) & (day >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (day < F.col("valid_to"))),
        "left",
    )
    cost = F.col("input_tokens") / 1e6 * F.col("in_per_m") + F.col("output_tokens") / 1e6 * F.col("out_per_m")
    return priced.withColumn("cost", cost).drop("model", "valid_from", "valid_to", "in_per_m", "out_per_m")


def with_cost_as_of(verdicts: DataFrame, rates_by_day: DataFrame) -> DataFrame:
    """Like ``with_cost``, with rates (model, valid_from, valid_to, in_per_m, out_per_m) from a table of any size.

    A day is priced by its model's newest rate from that day or before, unless that rate has ended by then.
    """
    dated = verdicts.withColumn("_day", F.col("recorded_at").cast("date"))
    parts = ["valid_from", "valid_to", "in_per_m", "out_per_m"]
    priced = last_known(dated, rates_by_day, [("llm_model", "model")], "_day", "valid_from", parts)
    live = F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to"))
    cost = F.col("input_tokens") / 1e6 * F.col("in_per_m") + F.col("output_tokens") / 1e6 * F.col("out_per_m")
    return priced.withColumn("cost", F.when(live, cost)).drop("_day", *parts)


def cost_report(verdicts: DataFrame) -> DataFrame:
    """Per path and in total: verdicts, tokens, dollars, and how many could not be priced."""
    path = F.when(F.col("use_vision"), "vision").otherwise("text")
    return (
        with_cost(verdicts).withColumn("path", path).rollup("path")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
            F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
            F.count_if(F.col("cost").isNull()).alias("unpriced"),
        )
        .withColumn("path", F.coalesce("path", F.lit("total")))
        .withColumn("dollars", F.format_string("$%.4f", "cost"))
        .drop("cost")
    )


