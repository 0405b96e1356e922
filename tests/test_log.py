"""Projections, sequencing, inheritance and compaction on small logs."""

import random

import pytest
from pyspark.sql import functions as F

from listinglake.model import GIG_FIELDS, KEY, LOG_COLUMNS, LOG_SCHEMA
from listinglake.operators import compaction
from listinglake.operators import projections as p
from listinglake.operators.inheritance import inherited_from
from listinglake.operators.sequencing import assign_sequence
from listinglake.plans.compact import compact_log
from listinglake.sources import log as source
from tests.conftest import rows


def log_of(spark, *entries):
    return spark.createDataFrame([tuple(e.get(c) for c in LOG_COLUMNS) for e in entries], LOG_SCHEMA)


def observed(seq, url, title="T", venue="v", at="2026-08-01 10:00:00", **more):
    import datetime as dt

    return dict(_type="observed", seq=seq, venue_id=venue, url=url, title=title, date=dt.date(2026, 9, 1), poster_url="p",
                description="d", recorded_at=dt.datetime.fromisoformat(at), **more)


def classified(seq, url, genre, source="LLM", venue="v"):
    return dict(_type="classified", seq=seq, venue_id=venue, url=url, genre=genre, source=source)


def replaced(seq, old, new, venue="v"):
    return dict(_type="replaced", seq=seq, venue_id=venue, url=old, by_venue_id=venue, by_url=new)


def test_latest_is_by_seq_not_time(spark):
    log = log_of(spark, observed(1, "a", "new", at="2026-08-01 00:00:00"), observed(0, "a", "old", at="2026-08-09 00:00:00"))
    assert rows(p.current_gigs(log), "url", "title") == [("a", "new")]


def test_a_replaced_key_never_returns(spark):
    log = log_of(spark, observed(0, "a"), replaced(1, "a", "b"), observed(2, "b"), observed(3, "a", "seen again"))
    assert rows(p.current_gigs(log), "url") == [("b",)]
    assert rows(p.new_or_changed(log.where("seq = 3"), p.current_gigs(log)), "url") == [("a",)]
    there_and_back = log_of(spark, observed(0, "a"), observed(1, "b"), replaced(2, "a", "b"), replaced(3, "b", "a"))
    assert rows(p.current_gigs(there_and_back), "url") == []


def test_changed_against_the_latest_only(spark):
    log = log_of(spark, observed(0, "a", "one"), observed(1, "a", "two"))
    scraped = log.select(*KEY, *GIG_FIELDS).unionByName(log_of(spark, observed(0, "b")).select(*KEY, *GIG_FIELDS))
    assert rows(p.new_or_changed(scraped, p.current_gigs(log)), "url", "title") == [("a", "one"), ("b", "T")]


def test_user_outranks_model_whenever_recorded(spark):
    log = log_of(spark, classified(0, "a", "Other", "User"), classified(1, "a", "Metal"), classified(2, "b", "Other"), classified(3, "b", "Metal"))
    assert rows(p.effective_verdicts(log), "url", "genre") == [("a", "Other"), ("b", "Metal")]


def test_verdicts_are_inherited_along_chains(spark):
    log = log_of(
        spark, classified(0, "a", "Metal"), replaced(1, "a", "b"), replaced(2, "b", "c"), classified(3, "x", "Other", "User"),
        replaced(4, "x", "y"), classified(5, "y", "Metal"), replaced(6, "y", "z"),
    )
    assert rows(p.class_status(log), "url", "genre") == [("a", "Metal"), ("b", "Metal"), ("c", "Metal"), ("x", "Other"), ("y", "Metal"), ("z", "Metal")]
    # a key with a model verdict of its own still inherits the user's, and the walk passes through it
    assert rows(p.overridden(log), "url") == [("x",), ("y",), ("z",)]


def naive_walk(edges, known):
    newest = {}
    for old, new, _ in sorted(edges, key=lambda e: e[2]):
        newest[new] = old
    found = {}
    for key in newest:
        at, steps = newest[key], 0
        while key not in known and at not in known and at in newest and steps <= len(newest):
            at, steps = newest[at], steps + 1
        if key not in known and at in known:
            found[key] = at
    return found


@pytest.mark.parametrize("seed", range(3))
def test_inheritance_against_a_walk(spark, seed):
    """Random graphs with chains, fans and cycles."""
    rng = random.Random(seed)
    n = 60
    edges = [(str(i), str(i + 1), i) for i in range(40)] + [(str(rng.randrange(n)), str(rng.randrange(n)), 100 + i) for i in range(25)]
    known = {str(rng.randrange(n)) for _ in range(4)}
    table = spark.createDataFrame([("v", o, "v", b, s) for o, b, s in edges], "venue_id string, url string, by_venue_id string, by_url string, seq bigint")
    result = inherited_from(table, spark.createDataFrame([("v", k) for k in known], "venue_id string, url string"))
    assert {r.url: r.from_url for r in result.collect()} == naive_walk(edges, known)


def test_due_venues_cooldown_is_strict(spark):
    venues = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "venue_id string")
    last = spark.sql("select * from values ('a', timestamp_ntz'2026-08-01 10:00:00'), ('b', timestamp_ntz'2026-08-01 10:00:01'), ('c', timestamp_ntz'2026-07-01 00:00:00') t(venue_id, last_scraped)")
    now = F.lit("2026-08-02 10:00:00").cast("timestamp_ntz")
    assert rows(p.due_venues(venues, last, now)) == [("a",), ("c",), ("d",)]
    assert len(rows(p.due_venues(venues, last, now, force=True))) == 4


def test_already_ingested_needs_the_whole_source(spark):
    log = log_of(spark, observed(0, "https://s.org/p#1#gig-x-2026-01-01"), observed(1, "https://s.org/post-2#gig-y"))
    sources = spark.createDataFrame([("https://s.org/p#1",), ("https://s.org/post",), ("https://s.org/post-2",), ("https://s.org/p",)], "source_url string")
    assert set(rows(p.already_ingested(log, sources))) == {("https://s.org/p",), ("https://s.org/p#1",), ("https://s.org/post-2",)}


def sequence(numbers, last):
    out, previous = [], last
    for n in numbers:
        seq = previous + 1 if n is None else n
        out.append((seq, seq > previous))
        previous = seq
    return out


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_sequence_in_blocks_of_any_size(spark, block):
    rng, numbers, high = random.Random(7), [], 10
    for _ in range(60):
        if rng.random() < 0.2:
            high += rng.randrange(60, 90)
            numbers.append(high)
        else:
            numbers.append(None)
    for given in (numbers, [None] * 10, [5, None, 5, None]):
        last = -1 if given[0] is None or given[0] < 10 else 3
        batch = spark.createDataFrame(list(enumerate(given)), "position bigint, seq bigint")
        found = assign_sequence(batch, "position", last, block).orderBy("position").collect()
        assert [(r.seq, r.in_order) for r in found] == sequence(given, last)


def test_append_numbers_and_refuses(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = log_of(spark, observed(None, "a"), observed(None, "b")).withColumn("position", F.monotonically_increasing_id())
    source.append(source.read_log(spark, path), batch, path)
    source.append(source.read_log(spark, path), batch, path)
    assert [r.seq for r in source.read_log(spark, path).orderBy("seq").collect()] == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="does not follow"):
        source.append(source.read_log(spark, path), log_of(spark, observed(2, "c")).withColumn("position", F.lit(0).cast("bigint")), path)
    assert source.read_log(spark, path).count() == 4


@pytest.mark.parametrize("entry, problem", [
    (observed(None, " "), "blank url"), (observed(None, "a", venue=""), "blank venue"), (observed(None, "a", title="A  b"), "title: spacing"),
    ({**observed(None, "a"), "poster_url": "\u00a0"}, "blank poster"), (replaced(None, "a", "a"), "replaced by itself"),
])
def test_append_refuses_what_a_log_must_not_hold(spark, tmp_path, entry, problem):
    path = str(tmp_path / "log")
    batch = log_of(spark, observed(None, "fine"), entry).withColumn("position", F.monotonically_increasing_id())
    with pytest.raises(ValueError, match=problem):
        source.append_json(source.read_json_log(spark, path), batch, path)
    assert source.read_json_log(spark, path).count() == 0


def test_json_lines(spark, tmp_path):
    path = tmp_path / "events.ndjson"
    assert source.read_json_log(spark, str(path)).count() == 0
    path.write_text(
        '{"_type": "rendered", "seq": 0, "file": "2026-08-01T12-00-00Z.html", "gigCount": 42, "logicalDate": "2026-08-01", "recordedAt": "2026-08-01T12:00:00Z"}\n'
        '{"_type": "classified", "seq": 1, "venue": "Signature Brew Blackhorse Road", "url": "https://tixr.com/e/187182", "recordedAt": "2026-08-11T21:20:43.785398Z", "genre": "Other", "source": "LLM"}\n'
    )
    read = source.read_json_log(spark, str(path)).orderBy("seq").collect()
    assert (read[0].file, read[0].gig_count, str(read[0].logical_date)) == ("2026-08-01T12-00-00Z.html", 42, "2026-08-01")
    assert (read[1].url, read[1].llm_model, read[1].input_tokens, str(read[1].recorded_at)) == ("https://tixr.com/e/187182", None, None, "2026-08-11 21:20:43.785398")
    path.write_text("{not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        source.read_json_log(spark, str(path)).collect()


def random_log(spark, seed):
    rng, entries = random.Random(seed), []
    for seq in range(120):
        url, kind = f"u{rng.randrange(12)}", rng.random()
        if kind < 0.5:
            entries.append(observed(seq, url, rng.choice("AB")))
        elif kind < 0.8:
            entries.append(classified(seq, url, rng.choice(["Metal", "Other"]), rng.choice(["LLM", "LLM", "User"])))
        elif kind < 0.9:
            i = rng.randrange(11)
            entries.append(replaced(seq, f"u{i}", f"u{i + 1}"))
        else:
            entries.append(dict(_type="rendered", seq=seq, file=f"f{seq}"))
    return log_of(spark, *entries)


def test_compaction_changes_no_projection(spark):
    log = random_log(spark, 1)
    compacted = compaction.compact(log)
    assert compacted.count() < log.count()
    assert all(r.equal for r in compaction.compact_verify(log, compaction.compacted_log(log)).collect())
    assert rows(compaction.compact(compacted), "seq") == rows(compacted, "seq")


def test_verification_sees_a_lost_entry(spark):
    log = random_log(spark, 2)
    lost = p.current_gigs(log).agg(F.max("seq")).first()[0]
    found = {r.projection: r.equal for r in compaction.compact_verify(log, log.where(F.col("seq") != lost)).collect()}
    assert not found["current_gigs"]


def test_compacting_files(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    source.write_log(random_log(spark, 3), old)
    summary = {r["_type"]: (r.before, r.after) for r in compact_log(spark, old, new).collect()}
    assert summary["observed"][0] > summary["observed"][1] and summary["rendered"][0] == summary["rendered"][1]
    state = lambda path: rows(p.current_gigs(source.read_log(spark, path)), *KEY, *GIG_FIELDS)
    assert state(old) == state(new)


def test_override_takes_the_first_gig_of_a_shared_url(spark):
    current = spark.createDataFrame([("b-venue", "u", 3), ("a-venue", "u", 7), ("c", "v", 1)], "venue_id string, url string, first_seq bigint")
    asked = spark.createDataFrame([("u", "Metal"), ("w", "Other")], "url string, genre string")
    verdicts, rejects = p.override_batch(current, asked)
    assert rows(verdicts, "venue_id", "url") == [("b-venue", "u")] and rows(rejects) == [("w", "Other")]
