"""State kept up by streams equals the batch projections after every batch, in any order of arrival."""

import random
import re

from pyspark.sql import functions as F

from listinglake.model import GIG_FIELDS, KEY
from listinglake.operators import projections as p
from listinglake.sources import log as source
from listinglake.streaming import current, forest, state
from listinglake.streaming.ingest import stream_log
from listinglake.streaming.rows import Rows, keep_rows
from tests.conftest import rows
from tests.test_log import classified, log_of, observed, replaced

NEWEST = "venue_id string, url string, title string, seq bigint"


def made(rng, n, keys):
    """Entries of every kind over few keys, so that chains, forks and cycles of replacements appear."""
    key = lambda: f"k{rng.randrange(keys)}"
    out = []
    for seq in range(n):
        kind = rng.choice(["observed", "classified", "replaced", "replaced"])
        if kind == "observed":
            out.append(observed(seq, key(), f"title {seq}"))
        elif kind == "classified":
            out.append(classified(seq, key(), rng.choice(["Metal", "Other"]), rng.choice(["LLM", "LLM", "User"])))
        else:
            old, new = rng.sample(range(keys), 2)
            out.append(replaced(seq, f"k{old}", f"k{new}"))
    return out


def test_forest_equals_class_status_after_every_batch(spark, tmp_path):
    rng = random.Random(1)
    entries = made(rng, 60, 25)
    rng.shuffle(entries)
    grown = forest.Forest.at(str(tmp_path), buckets=4, fanout=2)
    for batch in range(3):
        seen = log_of(spark, *entries[:(batch + 1) * 20])
        forest.advance(grown, log_of(spark, *entries[batch * 20:(batch + 1) * 20]), batch)
        assert rows(forest.class_status(spark, grown), *KEY, "genre") == rows(p.class_status(seen), *KEY, "genre")
    # a batch that is run again changes nothing
    forest.advance(grown, log_of(spark, *entries[40:]), 2)
    assert rows(forest.class_status(spark, grown), *KEY, "genre") == rows(p.class_status(log_of(spark, *entries)), *KEY, "genre")
    assert forest.advance(grown, log_of(spark), 3) == {"batch": 3, "named": 0, "read": 0}


def test_a_batch_reads_the_chains_it_touches(spark, tmp_path):
    # a hundred chains of four, their oldest classified
    chains = [e for c in range(100) for e in (
        classified(c * 4, f"c{c}-0", "Metal"), *(replaced(c * 4 + i, f"c{c}-{i - 1}", f"c{c}-{i}") for i in (1, 2, 3)))]
    grown = forest.Forest.at(str(tmp_path), buckets=16)
    forest.advance(grown, log_of(spark, *chains), 0)
    assert forest.class_status(spark, grown).where("genre = 'Metal'").count() == 400
    told = forest.advance(grown, log_of(spark, classified(1000, "c7-0", "Other")), 1)
    assert told == {"batch": 1, "named": 1, "read": 5}  # one place in the index, four keys
    assert rows(forest.class_status(spark, grown).where("genre = 'Other'"), "url") == [(f"c7-{i}",) for i in range(4)]
    # two chains are joined, and parted again by a newer replacement
    told = forest.advance(grown, log_of(spark, replaced(1001, "c8-3", "c9-0")), 2)
    assert told["read"] == 2 + 8
    assert forest.advance(grown, log_of(spark, classified(1002, "c8-0", "Other")), 3)["read"] == 1 + 8
    assert rows(forest.class_status(spark, grown).where("genre = 'Other'"), "url") == [(f"c{c}-{i}",) for c in (7, 8) for i in range(4)]
    assert forest.advance(grown, log_of(spark, replaced(1003, "elsewhere", "c9-2")), 4)["read"] == 1 + 8
    assert forest.advance(grown, log_of(spark, classified(1004, "elsewhere", "Other")), 5)["read"] == 1 + 3
    assert rows(forest.class_status(spark, grown).where("genre = 'Other'"), "url")[8:] == [("c9-2",), ("c9-3",), ("elsewhere",)]


def test_current_gigs_through_restarts(spark, tmp_path):
    rng = random.Random(3)
    entries = made(rng, 80, 20)
    late = [replaced(500, "early", "k1"), observed(501, "early"), observed(502, "other"), observed(503, "other", "second")]
    order = [late[0], *rng.sample(entries, len(entries)), late[3], late[2], late[1]]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for turn in range(3):
        part = order[turn * 28:(turn + 1) * 28]
        source.as_json_text(log_of(spark, *part)).coalesce(1).write.mode("append").text(folder)
        state.keep_up(current.current(stream_log(spark, folder, 1)), out, out + "-checkpoint").awaitTermination()
        seen = log_of(spark, *order[:(turn + 1) * 28])
        got = current.still_on(state.current_state(spark, out, KEY))
        assert rows(got, *KEY, *GIG_FIELDS, "seq") == rows(p.current_gigs(seen), *KEY, *GIG_FIELDS, "seq")
    assert rows(got.where("url IN ('early', 'other')"), "url", "title") == [("other", "second")]


def test_current_gigs_are_folded_without_a_python_worker(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    entries = [observed(5, "a", "five"), replaced(6, "b", "a"), observed(2, "a", "two"), observed(7, "b"), observed(1, "c", "one")]
    for turn, part in enumerate([entries[:2], entries[2:]]):
        source.as_json_text(log_of(spark, *part)).coalesce(1).write.mode("append").text(folder)
        stream = current.current(stream_log(spark, folder, 1))
        state.keep_up(stream, out, out + "-checkpoint").awaitTermination()
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan and "Python" not in plan
    told = state.current_state(spark, out, KEY)
    assert rows(told, "url", "title", "seq", "first_seq", "gone") == [("a", "five", 5, 2, False), ("b", None, 7, 7, True), ("c", "one", 1, 1, False)]


def test_newest_rows_merge_in_levels_and_look_up_their_folders(spark, tmp_path):
    rng = random.Random(4)
    table = Rows(str(tmp_path), NEWEST, tuple(KEY), "seq", buckets=8, fanout=2)
    assert table.read(spark).count() == 0
    made_so_far, seqs = [], rng.sample(range(1000), 70)
    for batch in range(7):
        part = [("v", f"u{rng.randrange(12)}", f"t{s}", s) for s in seqs[batch * 10:(batch + 1) * 10]]
        made_so_far += part
        table.write(spark.createDataFrame(part, NEWEST), batch)
        newest = {r[1]: r for r in sorted(made_so_far, key=lambda r: r[3])}
        assert rows(table.read(spark)) == sorted(newest.values(), key=str)
    assert table.covering(spark) == [(0, 3), (4, 5), (6, 6)] and table.covering(spark, 4) == [(0, 3)] and table.covering(spark, 3) == [(0, 1), (2, 2)]
    wanted = spark.createDataFrame([("v", "u3"), ("v", "nobody")], "venue_id string, url string")
    found = table.lookup(wanted)
    assert rows(found) == [newest["u3"]]
    folders = {f.rsplit("/", 2)[1] for f in table.read(spark).inputFiles()}
    picked = {r.b for r in wanted.select(table.bucket().alias("b")).collect()}
    assert len(folders) > len(picked)
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(" + ",".join(map(str, sorted(picked))) + r"\)", found._jdf.queryExecution().executedPlan().toString())
    # an unfinished run doesn't count
    (tmp_path / "run=000000000000-000000000006").mkdir()
    assert table.covering(spark)[0] == (0, 3)


def test_rows_kept_by_a_stream(spark, tmp_path):
    entries = [observed(i, f"u{i % 7}", f"t{i}") for i in random.Random(5).sample(range(60), 60)]
    folder, table = str(tmp_path / "in"), Rows(str(tmp_path / "out"), NEWEST, tuple(KEY), "seq", buckets=4, fanout=2)
    for turn in range(2):
        source.as_json_text(log_of(spark, *entries[turn * 30:(turn + 1) * 30])).repartition(3).write.mode("append").text(folder)
        keep_rows(stream_log(spark, folder, 1).where(F.col("_type") == "observed").select(*table.columns), table, str(tmp_path / "checkpoint")).awaitTermination()
    assert rows(table.read(spark), *KEY, "title", "seq") == rows(p.latest_observations(log_of(spark, *entries)), *KEY, "title", "seq")
