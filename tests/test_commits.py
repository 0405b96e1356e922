"""Several writers, swaps under readers, and what a crash leaves."""

import pytest
from pyspark.sql import functions as F

from listinglake.operators import compaction
from listinglake.operators import projections as p
from listinglake.session import side_by_side
from listinglake.sources import commits, files
from tests.conftest import rows
from tests.test_log import classified, log_of, observed, replaced


def batch(spark, *entries):
    return log_of(spark, *[{**e, "seq": None} for e in entries]).withColumn("position", F.monotonically_increasing_id()).cache()


def test_a_file_is_published_once_and_whole(spark, tmp_path):
    at = f"{tmp_path}/commits/7"
    assert files.names(spark, f"{tmp_path}/commits") == []
    assert files.publish(spark, at, "one") and not files.publish(spark, at, "two")
    assert files.read_text(spark, at) == "one" and files.names(spark, f"{tmp_path}/commits") == ["7"]
    won = side_by_side([lambda i=i: files.publish(spark, f"{tmp_path}/commits/8", str(i)) for i in range(8)])
    assert sum(won) == 1 and files.read_text(spark, f"{tmp_path}/commits/8") == str(won.index(True))


def test_writers_from_one_state_all_land(spark, tmp_path):
    path = str(tmp_path)
    writers = [batch(spark, *[observed(None, f"{w}-{i}") for i in range(5)]) for w in range(4)]
    side_by_side([lambda b=b: commits.append_committed(spark, path, b) for b in writers])
    got = rows(commits.read_committed(spark, path), "seq", "url")
    assert sorted(s for s, _ in got) == list(range(20))
    for w in range(4):  # each batch in its order, and in one piece
        own = sorted((s, u) for s, u in got if u.startswith(f"{w}-"))
        assert [u for _, u in own] == [f"{w}-{i}" for i in range(5)] and own[-1][0] - own[0][0] == 4
    assert commits.snapshot(spark, path).next_seq == 20


def test_a_loser_numbers_anew(spark, tmp_path, monkeypatch):
    path, publish, lost = str(tmp_path), files.publish, []

    def other_first(spark, at, text):
        if not lost:
            lost.append(at)
            commits.append_committed(spark, path, batch(spark, observed(None, "first")))
        return publish(spark, at, text)

    monkeypatch.setattr(files, "publish", other_first)
    commits.append_committed(spark, path, batch(spark, observed(None, "second"), observed(None, "third")))
    assert rows(commits.read_committed(spark, path), "seq", "url") == [(0, "first"), (1, "second"), (2, "third")]
    # what the loser had staged first is read by nobody
    assert len(commits.unread(spark, path)) == 1


def test_a_crash_between_staging_and_commit_shows_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    commits.append_committed(spark, path, batch(spark, observed(None, "a")))

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched, pytest.raises(OSError):
        patched.setattr(files, "publish", crash)
        commits.append_committed(spark, path, batch(spark, observed(None, "b")))
    assert rows(commits.read_committed(spark, path), "seq", "url") == [(0, "a")]
    assert len(commits.unread(spark, path)) == 1
    commits.append_committed(spark, path, batch(spark, observed(None, "c")))
    assert rows(commits.read_committed(spark, path), "seq", "url") == [(0, "a"), (1, "c")]


def test_refusals_and_empty_batches_commit_nothing(spark, tmp_path):
    path = str(tmp_path)
    assert commits.append_committed(spark, path, batch(spark)).version == -1
    assert commits.read_committed(spark, path).count() == 0
    commits.append_committed(spark, path, batch(spark, observed(None, "a")))
    with pytest.raises(ValueError, match="blank url"):
        commits.append_committed(spark, path, batch(spark, observed(None, " ")))
    behind = log_of(spark, observed(0, "b")).withColumn("position", F.lit(0).cast("long"))
    with pytest.raises(ValueError, match="does not follow"):
        commits.append_committed(spark, path, behind)
    assert commits.snapshot(spark, path).version == 0


def test_swap_keeps_readers_and_later_appends(spark, tmp_path):
    path = str(tmp_path)
    commits.append_committed(spark, path, batch(spark, observed(None, "a", "one"), observed(None, "a", "two"), classified(None, "a", "Metal")))
    commits.append_committed(spark, path, batch(spark, classified(None, "a", "Other"), replaced(None, "x", "a")))
    seen = commits.snapshot(spark, path)
    held = commits.read(spark, seen)
    before = rows(held)
    commits.append_committed(spark, path, batch(spark, observed(None, "b")))
    summary = None
    swapped = commits.swap(spark, seen, compaction.compact(held))
    assert len(swapped.batches) == 2 and swapped.next_seq == 6
    got = commits.read_committed(spark, path)
    assert rows(got, "seq") == [(1,), (3,), (4,), (5,)]
    assert rows(p.current_gigs(got), "url", "title") == [("a", "two"), ("b", "T")]
    # who holds the old snapshot still reads the old entries, and none of the new ones
    assert rows(held) == before == rows(commits.read(spark, commits.snapshot(spark, path, seen.version)))
    # a second swap from before the first one is refused; one from after it is not
    with pytest.raises(commits.Conflict):
        commits.swap(spark, seen, compaction.compact(held))
    summary = commits.compact_in_place(spark, path)
    assert {r._type: r.dropped for r in summary.collect()} == {"observed": 0, "classified": 0, "replaced": 0}
    commits.append_committed(spark, path, batch(spark, observed(None, "c")))
    assert rows(commits.read_committed(spark, path), "seq") == [(1,), (3,), (4,), (5,), (6,)]
    assert len(commits.snapshot(spark, path).batches) == 2


def test_a_failed_proof_leaves_the_log(spark, tmp_path):
    path = str(tmp_path)
    commits.append_committed(spark, path, batch(spark, observed(None, "a"), observed(None, "b")))
    now = commits.snapshot(spark, path)
    with pytest.raises(ValueError, match="current_gigs"):
        commits.swap(spark, now, commits.read(spark, now).where("url = 'a'"))
    assert commits.snapshot(spark, path) == now
    with pytest.raises(ValueError, match="no version"):
        commits.snapshot(spark, path, 5)


def test_swap_during_an_append(spark, tmp_path, monkeypatch):
    """An append that loses to a swap numbers its entries behind it; both count."""
    path, publish, lost = str(tmp_path), files.publish, []
    commits.append_committed(spark, path, batch(spark, observed(None, "a", "one"), observed(None, "a", "two")))

    def swap_first(spark, at, text):
        if not lost:
            lost.append(at)
            commits.compact_in_place(spark, path)
        return publish(spark, at, text)

    monkeypatch.setattr(files, "publish", swap_first)
    commits.append_committed(spark, path, batch(spark, observed(None, "b")))
    assert rows(commits.read_committed(spark, path), "seq", "title") == [(1, "two"), (2, "T")]
