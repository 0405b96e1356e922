"""Classification, posters, payloads, publishing, whole runs and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from listinglake.classify_rates import TEXT_MODEL, VISION_MODEL
from listinglake.functions import dates as d
from listinglake.functions import text as x
from listinglake.functions import urls as u
from listinglake.model import GIG_FIELDS, KEY, LISTING_SCHEMA, LOG_COLUMNS, LOG_SCHEMA
from listinglake.operators import api_listing, classification as c, posters, projections as p, publishing as pub
from listinglake.plans import daily, render, scrape
from listinglake.plans.classify import classify
from listinglake.sources import log as source
from listinglake.sources import payloads, rules
from listinglake.sources.testviews import log as events_log
from listinglake.streaming import state
from listinglake.streaming.ingest import stream_log
from listinglake.venues import venues, with_venue_name
from tests.conftest import rows


def values(spark, fn, given):
    """``fn`` over a column of texts, in order."""
    table = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    return [r.v for r in table.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def day(text):
    return F.lit(text).cast("date")


def at(text):
    return F.lit(text).cast("timestamp_ntz")


# --- classification ---------------------------------------------------------------------------


def test_replies(spark):
    given = ["Metal", "  Other\n", "Metal.", "I can't identify anyone.\n\nOther", "metal!!", "Not metal", "It is Metal, I think", "", "\n \n", None]
    assert values(spark, c.genre_of, given) == ["Metal", "Other", "Metal", "Other", "Metal", None, None, None, None, None]


def test_one_failure_loses_no_other_row(spark):
    def judge(row):
        if row["url"] == "b":
            raise ValueError("poster too large")
        return ("Metal", 10, None) if row["url"] == "a" else ("no idea", None, None)

    gigs = spark.createDataFrame([("v", k, "t", "p", text) for k, text in (("a", "y" * 80), ("b", "y" * 79), ("c", ""))], "venue_id string, url string, title string, poster_url string, description string")
    routed = c.routed(gigs)
    assert rows(routed, "url", "use_vision", "llm_model") == [("a", False, TEXT_MODEL), ("b", True, VISION_MODEL), ("c", True, VISION_MODEL)]
    outcome = c.outcomes(c.score(routed, judge))
    assert rows(outcome, "url", "genre", "input_tokens", "error") == [("a", "Metal", 10, None), ("b", None, None, "poster too large"), ("c", None, None, 'Unexpected reply: "no idea"')]


def test_batches_and_kept_replies(spark):
    """A batch that fails, or answers another number of rows, fails for all its rows; kept replies are not asked for again."""
    gigs = spark.createDataFrame([("v", k, f"t{k}", "p", "y" * 90) for k in "abc"], "venue_id string, url string, title string, poster_url string, description string")
    routed = c.routed(gigs)

    def raising(asked):
        raise RuntimeError("model is down")

    assert {r.error for r in c.score_batches(routed, raising).collect()} == {"model is down"}
    assert {r.error for r in c.score_batches(routed, lambda asked: []).collect()} <= {"0 answers to 1 rows", "0 answers to 2 rows", "0 answers to 3 rows"}
    kept = c.score(routed.where("url <> 'c'"), lambda row: ("Metal", 1, 1))
    kept = kept.withColumn("reply", F.when(F.col("url") == "a", F.col("reply"))).unionByName(kept.where("url = 'a'"))
    again = c.score_batches(routed, lambda asked: [("Other", 2, 2)] * len(asked), kept)
    assert rows(again, "url", "reply", "input_tokens") == [("a", "Metal", 1), ("b", "Other", 2), ("c", "Other", 2)]
    assert rows(posters.too_large(spark.createDataFrame([("a", "x" * 7_000_000), ("b", "x" * 7_000_001), (None, None)], "image_url string, content string"))) == [
        ("b", 7_000_001, "Image at b is 7000001 bytes, too large to send (limit ~7000000)")]


COSTED = "seq int, llm_model string, use_vision boolean, input_tokens int, output_tokens int, recorded_at timestamp_ntz"


def test_costs(spark):
    before, after = dt.datetime(2026, 8, 31, 23, 59, 59), dt.datetime(2026, 9, 1)
    table = spark.createDataFrame(
        [(0, TEXT_MODEL, False, 1000, 20, before), (1, VISION_MODEL, True, 1000, 10, before), (2, VISION_MODEL, True, 1000, 20, after),
         (3, None, None, None, None, after), (4, "unknown", False, 5, 5, after), (5, TEXT_MODEL, None, None, 5, after)], COSTED,
    )
    cost = {r.seq: r.cost for r in c.with_cost(table).collect()}
    assert cost == {0: pytest.approx(0.0011), 1: pytest.approx(0.0021), 2: pytest.approx(0.0033), 3: None, 4: None, 5: None}
    report = {r.path: (r.n, r.input_tokens, r.output_tokens, r.unpriced, r.dollars) for r in c.cost_report(table).collect()}
    assert report == {"text": (4, 1005, 30, 3, "$0.0011"), "vision": (2, 2000, 30, 0, "$0.0054"), "total": (6, 3005, 60, 3, "$0.0065")}
    assert c.cost_report(table.limit(0)).count() == 0


# --- text, urls, dates ------------------------------------------------------------------------


def test_title_rules(spark):
    given = ["Good Title", " lead", "two  spaces", "tab\there", "a​b\x07", " ", "", "soft­hyphen", "nbsp x", "line x"]
    assert values(spark, x.title_problem, given) == [None, "spacing", "spacing", "U+0009", "U+0007, U+200B", "blank", "blank", "U+00AD", "U+00A0", "U+2028"]
    assert values(spark, x.title_spacing, ["LUN8 ", "a   b", "keep\nbreak"]) == ["LUN8", "a b", "keep\nbreak"]


def test_url_rules(spark):
    base = F.lit("https://a.org/x/y?q=1#f")
    assert values(spark, lambda t: u.resolved(t, base), ["/p", "//b.org/p", "z", "?n=2", "http://c.org", "#g"]) == [
        "https://a.org/p", "https://b.org/p", "https://a.org/x/z", "https://a.org/x/y?n=2", "http://c.org", "https://a.org/x/y?q=1#g"]
    assert values(spark, u.file_extension, ["https://a.org/p/x.png?y=.z", "https://a.org/poster", "https://a.org/b.c.webp"]) == ["png", "jpg", "webp"]
    assert values(spark, u.widest_of, ["/a 1w, /b 3w, /c 3w", "/a 2x", "", "/a"]) == ["/b", None, None, None]
    assert values(spark, u.imgix_full_width, ["https://x.imgix.net/a?w=1", "https://x.imgix.net/a?w=1&h=2", "https://y.org/a?w=1"]) == ["https://x.imgix.net/a", "https://x.imgix.net/a?h=2", "https://y.org/a?w=1"]
    assert values(spark, x.slug, ["Iron & Wine!", "--A  b--", "Été"]) == ["iron-wine", "a-b", "t"]


def test_date_forms(spark):
    date = lambda *v: dt.date(*v)
    assert values(spark, d.range_start, ["21 Aug 2026", "1 - 9 Aug 2026", "19 Sep - 5 Dec 2026", "11 Dec - 3 Jan 2027", "nothing"]) == [
        date(2026, 8, 21), date(2026, 8, 1), date(2026, 9, 19), date(2026, 12, 11), None]
    assert values(spark, lambda t: d.printed_date(t, d.ORDINAL), ["Sat 26th September, 2026", "31st February 2026", "5 Sept 2026"]) == [date(2026, 9, 26), None, None]
    assert values(spark, d.month_number, ["Jun", "June", "JUNE", "jun", "Sept", "May", ""]) == [6, 6, 6, None, None, 5, None]
    assert values(spark, d.iso_date, ["2026-08-14T19:00", "2026-8-1", "2026-02-30"]) == [date(2026, 8, 14), None, None]


# --- posters ----------------------------------------------------------------------------------


def test_posters(spark):
    reply = "Here you go\n2026-08-14 | Doom Night\n 2026-08-15|Big KARAOKE Sunday \n2026-8-16 | no\n- 2026-08-17 | no"
    table = spark.createDataFrame(
        [("i.jpg", "https://s.org/p", "the-dev", reply), ("j.jpg", "https://s.org/q", "scala", reply), ("k.jpg", "https://s.org/r", "scala", "nothing here"),
         ("l.jpg", "https://s.org/s", "scala", "2026-08-14 | A\n2026-13-40 | B")], "image_url string, source_url string, venue_id string, reply string",
    )
    gigs = posters.poster_gigs(table)
    assert rows(gigs, "url", "description") == [
        ("https://s.org/p#gig-doom-night-2026-08-14", "Doom Night"), ("https://s.org/q#gig-big-karaoke-sunday-2026-08-15", "Big KARAOKE Sunday"), ("https://s.org/q#gig-doom-night-2026-08-14", "Doom Night")]
    assert rows(posters.unread_replies(table), "source_url") == [("https://s.org/r",), ("https://s.org/s",)]
    entries = posters.ingest_entries(gigs, gigs.where("venue_id = 'scala'"), at("2026-08-01 00:00:00"))
    assert rows(entries.groupBy("_type", "genre", "source").count()) == [("classified", "Metal", "User", 3), ("observed", None, None, 1)]


# --- payloads ---------------------------------------------------------------------------------


def test_bodies_that_wrap_html(spark):
    assert values(spark, payloads.unwrapped_html, ['"<p>a\\u0026b</p>"', " ", "false", "12", "not json"]) == ["<p>a&b</p>", "", "", "", None]


def test_api_listings(spark):
    api = rules.api_rules(spark)
    event = dict(name="Band  One ", encodedName="band-one", eventDate="2026-08-14T19:00", image="", tickets=[{"ticketUrl": "https://www.ticketmaster.co.uk/b?x=1"}],
                 localizations=[{"description": "<p>Sorry, this show has been CANCELLED"}], genres=[{"name": "Rock"}], lineup=[{"id": "7", "name": "Band"}, {"id": "8", "name": "Guest"}])
    body = json.dumps({"documents": [event, {**event, "tickets": []}, {**event, "image": "i.jpg", "localizations": [{"description": "A &amp; <b>B</b>"}], "tickets": [{"ticketUrl": "https://evil.org/"}]}]})
    bodies = spark.createDataFrame([("o2-academy-brixton", 0, body), ("o2-forum-kentish-town", 0, '{"documents": []}')], "venue_id string, page_no int, body string")
    page = spark.createDataFrame([("o2-academy-brixton", "https://www.academymusicgroup.com/o2academybrixton/events/band-one-tickets-ae7", '<img src="/no.jpg"><img sizes="100vw" src="/hero.jpg?w=1">')], "venue_id string, url string, body string")
    found = {(r.venue_id, r.url, r.title, r.poster_url, r.description, r.error) for r in api_listing.search_rows(bodies, page, api).collect()}
    assert found == {
        ("o2-academy-brixton", "https://www.ticketmaster.co.uk/b", "Band One", "https://www.academymusicgroup.com/hero.jpg", "Lineup: Band, Guest. Genre: Rock.", None),
        ("o2-academy-brixton", "https://evil.org/", "Band One", "i.jpg", "A & B", "Gig url https://evil.org/ isn't under https://www.ticketmaster.co.uk/ or http://www.ticketmaster.co.uk/ or https://www.gigantic.com/"),
        ("o2-forum-kentish-town", None, None, None, None, "No events returned"),
    }
    gig = dict(name="LUN8 ", perm_name="lun8", date="2026-08-14T23:30:00Z", timezone="Europe/London", images=["x.jpg"], raw_description="", status="cancelled")
    bodies = spark.createDataFrame([("229", 0, json.dumps({"data": [gig, {**gig, "perm_name": "gone"}], "links": {}}))], "venue_id string, page_no int, body string")
    status = spark.createDataFrame([("https://dice.fm/event/lun8", 301, "https://dice.fm/event/lun8-live"), ("https://dice.fm/event/gone", 404, None)], "url string, status int, location string")
    found = [(r.url, r.title, r.date, r.description, r.error is None) for r in api_listing.partner_rows(bodies, status, api).orderBy("listing_pos").collect()]
    assert found == [("https://dice.fm/event/lun8-live", "LUN8 - CANCELLED", dt.date(2026, 8, 15), "", True), ("", "LUN8 - CANCELLED", dt.date(2026, 8, 15), "", False)]
    show = lambda hour, **more: dict(Title="Show", URL="https://www.ovoarena.co.uk/events/detail/s", StartDateTime=f"2026-08-14T{hour}:00", Category="3", ImageURL="s.jpg", **more)
    bodies = spark.createDataFrame([("ovo-arena", 0, json.dumps({"events": [show("14"), show("19"), {**show("20"), "Category": "9"}, {**show("20"), "StartDateTime": "2026-08-15T20:00", "ImageURL": False}]}))], "venue_id string, page_no int, body string")
    page = spark.createDataFrame([("ovo-arena", "https://www.ovoarena.co.uk/events/detail/s", '<div class="event_description">Loud</div>')], "venue_id string, url string, body string")
    found = {(r.url, r.description, r.error) for r in api_listing.calendar_rows(bodies, page, api, rules.copy_rules(spark)).collect()}
    key = "https://www.ovoarena.co.uk/events/detail/s#2026-08-"
    assert found == {(key + "14", "Loud", None), (key + "15", "Loud", f"No poster for {key}15")}


# --- publishing -------------------------------------------------------------------------------


def test_page_window_is_inclusive(spark):
    dates = [(dt.date(2028, 2, 28),), (dt.date(2028, 2, 29),), (dt.date(2029, 2, 28),), (dt.date(2029, 3, 1),)]
    table = spark.createDataFrame(dates, "date date")
    assert rows(pub.page_window(table, day("2028-02-29"))) == [(dt.date(2028, 2, 29),), (dt.date(2029, 2, 28),)]


def test_search(spark):
    page = spark.createDataFrame([("Doom Night", "The Dev"), ("Pop", "Scala")], "title string, venue string")
    assert rows(pub.search(page, "  DOOM "), "title") == [("Doom Night",)]
    assert rows(pub.search(page, "scal"), "title") == [("Pop",)]
    assert pub.search(page, " ").count() == 2
    assert pub.no_matches(pub.search(page, "zzz"), "zzz") and not pub.no_matches(pub.search(page, ""), "")


def test_unknown_venue_fails(spark):
    with pytest.raises(Exception, match="Unknown venue id: nowhere"):
        with_venue_name(spark.createDataFrame([("nowhere",)], "venue_id string")).collect()


# --- whole runs -------------------------------------------------------------------------------


def extracted(spark, *gigs):
    table = [("scala", i, f"https://scala.co.uk/events/{k}", title, dt.date(2026, 9, 1 + i), f"{k}.jpg", copy, None) for i, (k, title, copy) in enumerate(gigs)]
    return spark.createDataFrame(table, LISTING_SCHEMA + ", error string")


def test_from_scrape_to_page(spark, tmp_path):
    path, archive = str(tmp_path / "log"), str(tmp_path / "archive")
    read = lambda: source.read_log(spark, path)
    asked = spark.createDataFrame([("scala",), ("dingwalls",)], "venue_id string")
    none = spark.createDataFrame([], "url string, status int, location string")
    failing = spark.createDataFrame([("dingwalls", None, None, None, None, None, None, "broken")], LISTING_SCHEMA + ", error string")
    listing = extracted(spark, ("a", "Doom Night One", "Heavy " * 20), ("b", "Soft Evening", "Quiet " * 20)).unionByName(failing)
    due = scrape.venues_to_scrape(asked, venues(spark), read(), at("2026-08-01 00:00:00"))
    assert due.count() == 2
    run = scrape.scrape(read(), listing, asked, none, at("2026-08-01 00:00:00"), day("2026-08-01"))
    assert rows(run.failed, "venue_id", "error") == [("dingwalls", "broken")]
    assert run.problems.count() == 0
    assert rows(run.summary) == [(2, 2, 0, 0)]
    source.append(read(), run.entries, path)
    assert rows(scrape.venues_to_scrape(asked, venues(spark), read(), at("2026-08-01 12:00:00"))) == [("dingwalls",)]

    images = spark.createDataFrame([("stale.webp",)], "file string")
    with pytest.raises(render.Unresolved, match="2 upcoming"):
        render.render(read(), day("2026-08-01"), F.lit("2026-08-01 10:00:00").cast("timestamp"), archive, images)
    result = classify(read(), lambda row: ("Metal" if "Doom" in row["prompt"] else "Other", 100, 5), at("2026-08-01 09:00:00"))
    assert rows(result.summary) == [(2, 1, 1, 0)]
    source.append(read(), result.entries, path)
    assert classify(read(), lambda row: ("Metal", 1, 1), at("2026-08-01 09:00:00")).entries.count() == 0

    first = render.render(read(), day("2026-08-01"), F.lit("2026-08-01 10:00:00").cast("timestamp"), archive, images)
    assert rows(first.page, "title", "venue", "display_date", "position") == [("Doom Night One", "Scala", "Tuesday, 1 September 2026", 1)]
    assert rows(first.changed_days, "change") == [("added",)] and rows(first.images_to_drop) == [("stale.webp",)]
    source.append(read(), first.entries, path)
    again = render.render(read(), day("2026-08-02"), F.lit("2026-08-02 10:00:00").cast("timestamp"), archive, images)
    assert again.changed_days.count() == 0
    assert daily.is_done(read(), "2026-08-01") and not daily.is_done(read(), "2026-08-02")
    ran = []
    assert not daily.daily(read(), "2026-08-01", [lambda: ran.append(1)]) and daily.daily(read(), "2026-08-01", [lambda: ran.append(1)], force=True) and ran == [1]

    # the gig moves: its old url is gone, and a lookalike is listed on its night
    gone = spark.createDataFrame([("https://scala.co.uk/events/a", 404, None)], "url string, status int, location string")
    moved = scrape.scrape(read(), extracted(spark, ("a2", "Doom Night One SOLD OUT", "Heavy " * 20), ("b", "Soft Evening", "Quiet " * 20)), asked.where("venue_id = 'scala'"), gone, at("2026-08-03 00:00:00"), day("2026-08-03"))
    assert rows(moved.entries, "_type", "url", "by_url") == [("observed", "https://scala.co.uk/events/a2", None), ("replaced", "https://scala.co.uk/events/a", "https://scala.co.uk/events/a2")]
    source.append(read(), moved.entries, path)
    assert rows(p.metal_gigs(read()), "url") == [("https://scala.co.uk/events/a2",)]


# --- streams ----------------------------------------------------------------------------------


def test_stream_agrees_with_batch(spark, sf, tmp_path):
    entries = events_log(spark, sf)
    folder = str(tmp_path / "in")
    source.as_json_text(entries.repartition(5, F.xxhash64("seq"))).write.text(folder)

    def kept(build, key, name):
        out = str(tmp_path / name)
        state.keep_up(build(stream_log(spark, folder, 2)), out, out + "-checkpoint").awaitTermination()
        return state.current_state(spark, out, key)

    newest = state.rows_of(entries, kept(state.latest, KEY, "latest"))
    assert rows(newest, *KEY, *GIG_FIELDS) == rows(p.latest_observations(entries), *KEY, *GIG_FIELDS)
    assert rows(kept(state.verdicts, KEY, "verdicts"), *KEY, "genre") == rows(p.effective_verdicts(entries), *KEY, "genre")


def test_log_columns():
    assert LOG_COLUMNS == [f.split()[0] for f in LOG_SCHEMA.split(", ")]
