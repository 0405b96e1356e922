"""Only days that changed are written; readers see one publication or the next."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listinglake.session import durable
from listinglake.sources import files, published
from tests.conftest import rows


def page(spark, **days):
    made = [(dt.date(2026, 9, int(d[1:])), "heading", i + 1, t, "v", f"u{t}", None if t == "no" else "i") for d, titles in days.items() for i, t in enumerate(titles)]
    return durable(spark.createDataFrame(made, published.CARDS))


def at(day):
    return F.lit(f"2026-08-{day:02d} 10:00:00").cast("timestamp")


def on_disk(path):
    return {f.relative_to(path): (f.read_bytes(), f.stat().st_mtime_ns) for f in path.rglob("*.parquet") if "cards" in f.parts}


def shown(spark, path):
    return [(r.date.day, r.position, r.title, r.lastmod.day) for r in sorted(published.read_page(spark, path).collect(), key=lambda r: (r.date, r.position))]


def test_unchanged_days_keep_their_files(spark, tmp_path):
    path = str(tmp_path)
    assert published.read_page(spark, path).count() == 0 and published.lastmod(spark, path) is None
    assert rows(published.publish(page(spark, d1=["a", "b"], d2=["c"], d3=["no"]), path, at(1)), "change") == [("added",)] * 3
    first, stamp = on_disk(tmp_path), published.lastmod(spark, path)
    # nothing changed: nothing is written, lastmod stays
    assert published.publish(page(spark, d1=["a", "b"], d2=["c"], d3=["no"]), path, at(2)).count() == 0
    assert on_disk(tmp_path) == first and published.lastmod(spark, path) == stamp == "2026-08-01T10:00:00Z"
    told = published.publish(page(spark, d1=["b", "a"], d2=["c"], d4=["e"]), path, at(3))
    assert [(r[0].day, r[1]) for r in rows(told)] == [(1, "changed"), (3, "removed"), (4, "added")]
    assert shown(spark, path) == [(1, 1, "b", 3), (1, 2, "a", 3), (2, 1, "c", 1), (4, 1, "e", 3)]
    second = on_disk(tmp_path)
    assert all(second[f] == was for f, was in first.items())
    assert {f.parts[1] for f in set(second) - set(first)} == {"date=2026-09-01", "date=2026-09-04"}
    assert [r[0].day for r in rows(published.unread(spark, path))] == [1, 3]
    # a day that only leaves moves the page's lastmod, and no other day's
    published.publish(page(spark, d1=["b", "a"], d2=["c"]), path, at(5))
    assert published.lastmod(spark, path) == "2026-08-05T10:00:00Z" and [x[3] for x in shown(spark, path)] == [3, 3, 1]
    # back to what it said before, null and empty told apart
    assert rows(published.publish(page(spark, d1=["a", "b"], d2=["c"]), path, at(6)), "change") == [("changed",)]
    assert shown(spark, path) == [(1, 1, "a", 6), (1, 2, "b", 6), (2, 1, "c", 1)]
    published.publish(page(spark), path, at(7))
    assert shown(spark, path) == [] and published.days(spark, path).count() == 0


def test_a_crash_or_a_rival_leaves_the_page(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    published.publish(page(spark, d1=["a"]), path, at(1))

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched, pytest.raises(OSError):
        patched.setattr(files, "publish", crash)
        published.publish(page(spark, d1=["b"], d2=["c"]), path, at(2))
    assert shown(spark, path) == [(1, 1, "a", 1)]
    publish = files.publish

    def rival(spark, name, text):
        publish(spark, name, text.replace("2026-08-03", "2026-08-09"))
        return publish(spark, name, text)

    with monkeypatch.context() as patched, pytest.raises(published.Conflict):
        patched.setattr(files, "publish", rival)
        published.publish(page(spark, d1=["b"], d2=["c"]), path, at(3))
    published.publish(page(spark, d1=["b"], d2=["c", "d"]), path, at(4))
    assert shown(spark, path) == [(1, 1, "b", 3), (2, 1, "c", 4), (2, 2, "d", 4)]
