"""A log that several writers append to at once, and whose files can be swapped under its readers.

Entries lie in batches of Parquet files. A batch counts once a commit names it; commits are numbered
files that can only be created, never overwritten, so of two writers that claim the same number one
loses, numbers its entries anew behind the other's and tries the next. What was staged without a
commit is never read.

A commit says which number the next entry takes, so no append has to look for the largest. A swap is a
commit too: its batch stands for all commits up to the one it was made from. Readers go by the newest
commit they see, from the newest swap on, and so see the files before a swap or those after it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from listinglake.model import LOG_COLUMNS, LOG_SCHEMA
from listinglake.operators import compaction
from listinglake.sources import files
from listinglake.sources.log import empty_log, numbered_from, write_log

COMMIT_SCHEMA = "number int, batch string, upto int, swap int, next long"


class Conflict(Exception):
    """Another swap came first."""


@dataclass(frozen=True)
class Snapshot:
    """The log as of one commit: its number (-1 before the first), the batches that count, the next entry's number."""

    path: str
    version: int
    batches: tuple[str, ...]
    next_seq: int
    swap: int  # the number of the newest swap, -1 without one


def _commit(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/commits/{number:012d}"


def _batch(path: str, batch: str) -> str:
    return f"{path.rstrip('/')}/entries/batch={batch}"


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest commit, or an earlier one."""
    known = files.names(spark, f"{path.rstrip('/')}/commits")
    last = int(known[-1]) if known else -1
    if version is not None:
        if not -1 <= version <= last:
            raise ValueError(f"the log has no version {version}")
        last = version
    if last < 0:
        return Snapshot(path, -1, (), 0, -1)
    newest = json.loads(files.read_text(spark, _commit(path, last)))
    swapped = json.loads(files.read_text(spark, _commit(path, newest["swap"]))) if newest["swap"] >= 0 else None
    since = range(swapped["upto"] + 1 if swapped else 0, last + 1)
    # one row per commit since the newest swap
    read = spark.read.schema(COMMIT_SCHEMA).json([_commit(path, n) for n in since]).where("upto < 0").orderBy("number") if since else None
    appended = [r.batch for r in read.collect()] if read is not None else []
    return Snapshot(path, last, (*([swapped["batch"]] if swapped else []), *appended), newest["next"], newest["swap"])


def read(spark: SparkSession, at: Snapshot) -> DataFrame:
    """The entries of a snapshot; it reads the same whatever is committed later."""
    return _entries(spark, at.path, at.batches)


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the newest commit."""
    return read(spark, snapshot(spark, path))


def _entries(spark: SparkSession, path: str, batches: tuple[str, ...]) -> DataFrame:
    if not batches:
        return empty_log(spark)
    reader = spark.read.schema(LOG_SCHEMA).option("basePath", f"{path.rstrip('/')}/entries")
    return reader.parquet(*[_batch(path, b) for b in batches]).select(*LOG_COLUMNS)


def _staged(entries: DataFrame, path: str) -> str:
    batch = f"b{uuid.uuid4().hex}"
    write_log(entries, _batch(path, batch), mode="error")
    return batch


def append_committed(spark: SparkSession, path: str, batch: DataFrame, position: str = "position") -> Snapshot:
    """Append ``batch`` in ``position`` order behind whatever is committed by then, or refuse it as a whole.

    ``batch`` is numbered again for every commit that came first, so it should be a stored table.
    An empty batch commits nothing.
    """
    while True:
        now = snapshot(spark, path)
        numbered, last = numbered_from(batch, now.next_seq - 1, position)
        if last is None:
            return now
        staged = _staged(numbered, path)
        record = {"number": now.version + 1, "batch": staged, "upto": -1, "swap": now.swap, "next": last + 1}
        if files.publish(spark, _commit(path, now.version + 1), json.dumps(record)):
            return snapshot(spark, path, now.version + 1)


def swap(spark: SparkSession, made_from: Snapshot, entries: DataFrame) -> Snapshot:
    """Let ``entries`` stand for all commits of ``made_from``, after proof that they read the same.

    The proof is over what was written. Appends that were committed since stay; a swap that was
    committed since is a ``Conflict``. Where the proof fails nothing changes for readers.
    """
    path, before = made_from.path, read(spark, made_from)
    staged = _staged(entries.repartitionByRange("_type", "seq").sortWithinPartitions("_type", "seq"), path)
    after = _entries(spark, path, (staged,))
    differing = [r.projection for r in compaction.compact_verify(before, after).collect() if not r.equal]
    if differing:
        raise ValueError(f"the new files read differently: {', '.join(differing)}")
    while True:
        now = snapshot(spark, path)
        if now.swap != made_from.swap:
            raise Conflict(f"commit {now.swap} has swapped the files of {path} already")
        number = now.version + 1
        record = {"number": number, "batch": staged, "upto": made_from.version, "swap": number, "next": now.next_seq}
        if files.publish(spark, _commit(path, number), json.dumps(record)):
            return snapshot(spark, path, number)


def compact_in_place(spark: SparkSession, path: str) -> DataFrame:
    """Swap the log's files for its compacted entries; entries per kind before and after."""
    now = snapshot(spark, path)
    before = read(spark, now)
    swapped = swap(spark, now, compaction.compact(before))
    return compaction.compact_summary(before, _entries(spark, path, swapped.batches[:1]))


def unread(spark: SparkSession, path: str) -> list[str]:
    """Batches that the newest snapshot doesn't read: staged without a commit, or swapped for others.

    They may expire once no writer is at work and no reader holds an earlier snapshot.
    """
    held = set(snapshot(spark, path).batches)
    return [_batch(path, b) for n in files.names(spark, f"{path.rstrip('/')}/entries") if (b := n.partition("=")[2]) not in held]
