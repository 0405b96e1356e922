"""Every key's genre, own or inherited along replacements, kept up as the log grows.

Keys that replace each other form trees: a key points to the one it replaced last, down to a root that
replaced none (or into a cycle, which its smallest key names). A batch's entries can only change keys of
the trees they belong to. So keys are stored under their tree's root, with an index from key to root: a
batch looks its keys up, reads their trees, puts its verdicts and replacements in, walks those trees
again by doubling pointers, and writes them back. Entries may come in any order, as newer ones are told
by their numbers; a batch that is run again reads the state from before it and replaces what it wrote.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listinglake.model import CLASSIFIED, KEY, METAL, OTHER, REPLACED, USER
from listinglake.operators.inheritance import inherited_from
from listinglake.session import durable
from listinglake.skew import attach
from listinglake.streaming.rows import Rows

# u and m: twice the number of the newest verdict of a user and of a model, plus one if it says Metal.
NODE = "venue_id string, url string, u bigint, m bigint, edge_seq bigint, old_venue_id string, old_url string"
POINTS = ["edge_seq", "old_venue_id", "old_url"]


@dataclass(frozen=True)
class Forest:
    trees: Rows  # (root, key): the key's state and genre; ``left`` where it belongs to another root by now
    index: Rows  # key: root

    @staticmethod
    def at(path: str, buckets: int = 64, fanout: int = 8) -> Forest:
        trees = Rows(f"{path}/trees", f"root string, {NODE}, genre string, left boolean, batch bigint", ("root", *KEY), "batch", ("root",), buckets, fanout)
        return Forest(trees, Rows(f"{path}/index", "venue_id string, url string, root string, batch bigint", tuple(KEY), "batch", (), buckets, fanout))


def _arrived(entries: DataFrame) -> DataFrame:
    """What a batch says of each key it names."""
    coded = F.col("seq") * 2 + (F.col("genre") == METAL).cast("bigint")
    by_user = F.col("source") == USER
    verdicts = entries.where(F.col("_type") == CLASSIFIED).groupBy(*KEY).agg(F.max(F.when(by_user, coded)).alias("u"), F.max(F.when(~by_user, coded)).alias("m"))
    replaced = entries.where(F.col("_type") == REPLACED)
    old = F.max_by(F.struct("seq", *KEY), "seq").alias("old")
    edges = replaced.groupBy("by_venue_id", "by_url").agg(old).select(
        F.col("by_venue_id").alias("venue_id"), F.col("by_url").alias("url"), F.col("old.seq").alias("edge_seq"),
        F.col("old.venue_id").alias("old_venue_id"), F.col("old.url").alias("old_url"),
    )
    every = verdicts.unionByName(edges, allowMissingColumns=True).unionByName(replaced.select(*KEY).distinct(), allowMissingColumns=True)
    whole = F.max_by(F.struct(*POINTS), "edge_seq").alias("_e")
    return every.groupBy(*KEY).agg(F.max("u").alias("u"), F.max("m").alias("m"), whole).select(*KEY, "u", "m", "_e.*")


def _name(venue: str, url: str):
    return F.concat_ws("\u0001", F.col(venue), F.col(url))


def roots(nodes: DataFrame) -> DataFrame:
    """(venue_id, url, root) of stored ``nodes``, whose pointers stay among them."""
    size = nodes.count()
    at = durable(nodes.select(*KEY, _name(*KEY).alias("k"), F.coalesce(F.when(F.col("old_url").isNotNull(), _name("old_venue_id", "old_url")), _name(*KEY)).alias("p")))
    walk = durable(at.select("k", "p", F.least("k", "p").alias("low"), (F.col("k") == F.col("p")).alias("end")))
    for _ in range(math.ceil(math.log2(max(size, 2))) + 1):
        step = walk.select(F.col("k").alias("p"), F.col("p").alias("_p"), F.col("low").alias("_low"), F.col("end").alias("_end"))
        moved = attach(walk.drop("end"), step, ["p"], "inner", summary_rows=size)
        walk = durable(moved.select("k", F.col("_p").alias("p"), F.least("low", "_low").alias("low"), F.col("_end").alias("end")))
        if walk.where(~F.col("end")).isEmpty():
            break
    # who still walks is on a cycle or leads into one: the smallest name on it
    on = walk.select(F.col("k").alias("p"), F.col("low").alias("_low"))
    ended = walk.where("end").select("k", F.col("p").alias("root"))
    cycling = attach(walk.where(~F.col("end")).select("k", "p"), on, ["p"], "inner", summary_rows=size).select("k", F.col("_low").alias("root"))
    return at.select(*KEY, "k").join(ended.unionByName(cycling), "k").select(*KEY, "root")


def advance(forest: Forest, entries: DataFrame, batch: int) -> dict[str, int]:
    """Put one batch's entries in. Says how many keys they name and how many stored rows were read for them."""
    arrived = durable(_arrived(entries))
    named = arrived.count()
    if not named:
        return {"batch": batch, "named": 0, "read": 0}
    known = durable(forest.index.lookup(arrived.select(*KEY), batch))
    held = durable(forest.trees.lookup(known.select("root").distinct(), batch).where(~F.col("left")))
    both = held.select(*KEY, "u", "m", *POINTS).unionByName(arrived)
    newest = F.max_by(F.struct(*POINTS), "edge_seq").alias("_e")
    nodes = durable(both.groupBy(*KEY).agg(F.max("u").alias("u"), F.max("m").alias("m"), newest).select(*KEY, "u", "m", "_e.*"))

    code = F.coalesce("u", "m")
    own = nodes.where(code.isNotNull()).select(*KEY, F.when(code % 2 == 1, METAL).otherwise(OTHER).alias("genre"))
    edges = nodes.where("old_url is not null").select(
        F.col("old_venue_id").alias("venue_id"), F.col("old_url").alias("url"), F.col("venue_id").alias("by_venue_id"), F.col("url").alias("by_url"), F.col("edge_seq").alias("seq")
    )
    own = durable(own)
    taken = inherited_from(edges, own.select(*KEY))
    handed = taken.join(own.select(F.col("venue_id").alias("from_venue_id"), F.col("url").alias("from_url"), "genre"), ["from_venue_id", "from_url"]).select(*KEY, "genre")
    placed = nodes.join(roots(nodes), KEY).join(own.unionByName(handed), KEY, "left")
    now = durable(placed.withColumn("left", F.lit(False)).withColumn("batch", F.lit(batch).cast("bigint")).select(*forest.trees.columns))
    gone = held.select("root", *KEY).join(now.select("root", *KEY), ["root", *KEY], "left_anti")
    gone = gone.withColumn("left", F.lit(True)).withColumn("batch", F.lit(batch).cast("bigint"))
    forest.trees.write(now.unionByName(gone, allowMissingColumns=True).select(*forest.trees.columns), batch)
    forest.index.write(now.select(*forest.index.columns), batch)
    return {"batch": batch, "named": named, "read": known.count() + held.count()}


def keep_forest(stream: DataFrame, forest: Forest, checkpoint: str, told: list[dict[str, int]] | None = None) -> StreamingQuery:
    """Put what has arrived in, batch by batch; ``told`` collects what each batch read."""

    def put(arrived: DataFrame, batch: int) -> None:
        # read by several steps, and once from the stream
        said = advance(forest, durable(arrived.where(F.col("_type").isin(CLASSIFIED, REPLACED))), batch)
        if told is not None:
            told.append(said)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def class_status(spark: SparkSession, forest: Forest) -> DataFrame:
    """The genre every key has so far, its own or the one inherited along its replacements."""
    return forest.trees.read(spark).where("genre IS NOT NULL AND NOT left").select(*KEY, "genre")
