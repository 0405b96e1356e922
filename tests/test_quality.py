"""Checks at and just under their limits, and the whole gate against a plain reading of the rules."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from listinglake.catalog import quality as queries
from listinglake.model import LISTING_SCHEMA
from listinglake.operators import relisting
from listinglake.operators.quality import contamination, gate
from listinglake.operators.quality.batch import Batch, Check, gig_print
from listinglake.operators.quality.contamination import contaminated
from tests.conftest import SMALL, rows

DAY = dt.date(2026, 9, 1)


def gig(pos, venue="v", **more):
    row = dict(venue=venue, pos=pos, url=f"u{pos}", title=f"word{pos}", date=DAY + dt.timedelta(days=pos), poster=f"p{pos}.jpg", copy=f"text {pos}")
    row.update(more)
    return tuple(row[k] for k in ("venue", "pos", "url", "title", "date", "poster", "copy"))


def batch_of(spark, listing, asked=(), previous=()):
    table = spark.createDataFrame(listing, LISTING_SCHEMA)
    venues = {g[0] for g in listing} | set(asked)
    return Batch.of(table, spark.createDataFrame([(v,) for v in venues], "venue_id string"), spark.createDataFrame(list(previous), LISTING_SCHEMA))


def found(spark, order, listing, asked=(), previous=()):
    claims = gate.claims_of(batch_of(spark, listing, asked, previous), [c for c in gate.CHECKS if c.order == order])
    return {(r.venue_id, r.detail, r.n_gigs, r.first_url) for r in gate.problems_of(claims).collect()}


def test_empty(spark):
    told = found(spark, 1, [gig(1)], asked=["new", "known"], previous=[gig(1, "known"), gig(2, "known")])
    assert told == {("new", "listed nothing, and the log holds no gigs for it either", 0, None), ("known", "listed nothing, though the log holds 2 gig(s) for it", 0, None)}


def test_misshapen(spark):
    wall = "description is a cookie or bot wall, not gig copy"
    listing = [
        gig(1, title="x" * 200), gig(2, title="x" * 201), gig(3, copy="  \n"), gig(4, copy="{json"), gig(5, copy="Please Enable JS and"),
        gig(6, copy="enable jscript now"), gig(7, copy="ENABLE JAVASCRIPT"), gig(8, copy="read our privacy policy"), gig(9, copy="y" * 10_000),
        gig(10, copy="y" * 10_001), gig(11, copy="enable jsx"), gig(12, title="\U0001f600" * 101), gig(13, copy="We use cookies"),
    ]
    assert found(spark, 2, listing) == {
        ("v", "title of 201 chars", 1, "u2"), ("v", "no description", 1, "u3"), ("v", wall, 5, "u4"),
        ("v", "description of 10001 chars", 1, "u10"), ("v", "title of 202 chars", 1, "u12"),
    }


def test_unparsed(spark):
    listing = [
        gig(1, title="TOUR <LiMiNaL>"), gig(2, title="A <B>bold</B> one"), gig(3, title="Rock & Roll; AT&T"), gig(4, title="Salt &amp; Pepper"), gig(5, title="CafÃ© tour"),
        gig(6, title="Itâ€™s"), gig(7, copy="see <iframe src=x>"), gig(8, copy="also <p>this</p>"), gig(9, title="&#39;Quoted"),
    ]
    assert found(spark, 3, listing) == {
        ("v", "title holds unparsed markup", 1, "u2"), ("v", "title holds an html entity", 2, "u4"), ("v", "title holds mis-decoded characters", 2, "u5"),
        ("v", "2 description(s) hold unparsed markup, e.g. u7", 0, None),
    }


def test_duplicate(spark):
    same, other = gig(1), gig(2, url="u1")
    assert found(spark, 4, [same, (*same[:1], 9, *same[2:]), gig(3)]) == {("v", "listed 2 times", 1, "u1")}
    assert found(spark, 4, [same, other, gig(3, "w", url="u1")]) == {("v", "listed 2 times, and not identically", 2, "u1")}


@pytest.mark.parametrize("n", [5, 6])
def test_crowded(spark, n):
    told = found(spark, 5, [gig(i, date=DAY) for i in range(n)])
    assert told == ({("v", "6 gig(s) on 2026-09-01", 6, "u0")} if n == 6 else set())


@pytest.mark.parametrize("n", [20, 21])
def test_shared_poster(spark, n):
    told = found(spark, 6, [gig(i, poster="https://x.org/a/logo.png?w=3") for i in range(n)])
    assert told == ({("v", "21 gig(s) share logo.png", 21, "u0")} if n == 21 else set())


def test_shared_description(spark):
    long = "a " * 40
    listing = [
        gig(1, title="Paper Dress 80s Club", copy="x"), gig(2, title="80's night", copy="x"), gig(3, title="Alpha", copy=long), gig(4, title="Beta", copy=long),
        gig(5, title="Gamma", copy=" "), gig(6, title="Delta", copy=" "), gig(7, title="One two", copy="y"), gig(8, title="two three", copy="y"), gig(9, title="three one", copy="y"),
        gig(10, "w", title="Zed", copy=long),
    ]
    assert found(spark, 7, listing) == {("v", '"' + ("a " * 40).strip()[:60] + '..."', 2, "u3"), ("v", '"y"', 3, "u7")}


def test_contamination_names_the_whole_venue(spark):
    nav = "home news tickets about contact find us here today now"
    listing = [gig(1, copy=f"{nav} one"), gig(2, copy=f"{nav} two"), gig(3, copy=f"{nav} three"), gig(4, copy="entirely of its own making this text is"), gig(5, copy="")]
    assert found(spark, 8, listing) == {("v", "3 of 5 gig(s) mostly shared text", 5, "u1")}
    assert found(spark, 8, listing[:2]) == set()


def test_counters_grow_with_the_longest_text(spark):
    sizes = spark.createDataFrame([(1,), (4096,), (4097,), (130_000,)], "n int")
    assert [r[0] for r in sizes.select(contamination.counters_for(F.col("n"), 4096)).collect()] == [4096, 4096, 8192, 131_072]


def test_failing_venues_are_those_of_the_claims(spark):
    batch = queries.batch_of(spark, SMALL)
    assert rows(gate.failing(batch)) == rows(gate.failed_venues(gate.claims_of(batch)))


def plain_contaminated(listing):
    """Contaminated gigs by the rules as they read, venue by venue."""
    out = set()
    for venue in {g[0] for g in listing}:
        mine = [g for g in listing if g[0] == venue and g[6].strip()]
        if len(mine) < 3:
            continue
        by_gig = {(g[0], *g[2:]): re.split(r"\s+", g[6].strip()) for g in mine}
        grams = {k: [" ".join(w[i : i + 6]) for i in range(len(w) - 5)] for k, w in by_gig.items()}
        need, count = max(2, math.ceil(len(mine) / 2)), {}
        for found_grams in grams.values():
            for g in set(found_grams):
                count[g] = count.get(g, 0) + 1
        for k, w in by_gig.items():
            hits = sum(count[g] >= need for g in grams[k])
            if min(hits * 6, len(w)) / len(w) >= 0.5:
                out.add(k[:2])
    return out


@pytest.mark.parametrize("counters", [64, 4096])
def test_contamination_by_the_rules(spark, counters):
    """Random texts from few words, copies included; a few counters only let more through to be counted."""
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 14))) for _ in range(25)]
    listing = []
    for i in range(140):
        copy = " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 4)))
        listing.append(gig(i, venue="hot" if rng.random() < 0.6 else f"v{rng.randrange(12)}", copy=copy, title="t", date=DAY, poster="p"))
    listing += [(*g[:1], 1000 + g[1], *g[2:]) for g in listing[:30]]
    table = spark.createDataFrame(listing, LISTING_SCHEMA).withColumn("gig", gig_print())
    urls = {g[1]: g[2] for g in listing}
    assert {(r.venue_id, urls[r.listing_pos]) for r in contaminated(table, counters).collect()} == plain_contaminated(listing)


def test_first_check_speaks_and_any_withholds(spark):
    """The misshapen rows are also duplicates; the crowded day has one row no earlier check named."""
    listing = [gig(i, date=DAY, url="same", copy="{") for i in range(3)] + [gig(i, date=DAY) for i in range(3, 7)] + [gig(9, "ok")]
    claims = gate.claims_of(batch_of(spark, listing))
    assert {(r.check_name, r.n_gigs) for r in gate.report(claims).collect()} == {("misshapen", 3), ("crowded", 7)}
    batch = batch_of(spark, listing)
    failed = gate.failed_venues(claims)
    assert rows(gate.passed(batch.listing, failed), "url") == [("u9",)]
    assert gate.withheld(batch.listing, failed).count() == 7


def test_a_report_that_names_no_gig_withholds_nothing(spark):
    batch = batch_of(spark, [gig(1, copy="has <p>markup</p>")], asked=["silent"])
    claims = gate.claims_of(batch)
    assert {r.check_name for r in gate.report(claims).collect()} == {"empty", "unparsed"}
    assert gate.failed_venues(claims).count() == 0


def test_checks_can_be_added(spark):
    def late(batch):
        return batch.facts.where("date > '2026-09-03'").select("venue_id", F.lit("late").alias("problem"), F.lit("too late").alias("detail"), "gig", "listing_pos", "url")

    claims = gate.claims_of(batch_of(spark, [gig(1), gig(5)]), [*gate.CHECKS, Check(9, "late", "Late gigs", late)])
    assert {(r.check_name, r.first_url) for r in gate.report(claims).collect()} == {("late", "u5")}
    assert gate.misplaced_claims(claims, batch_of(spark, [gig(1), gig(5)]).facts).count() == 0


# --- relisting --------------------------------------------------------------------------------


def similarity(a, b):
    words = lambda t: {w for w in re.split(r"[^\w]+|_", t.lower()) if len(w) > 2}
    a, b = words(a), words(b)
    return len(a & b) / len(a | b) if a and b else 0.0


def plain_lookalike(missing, listing):
    alike = [g for g in listing if (g[0], g[4]) == (missing[0], missing[4]) and (similarity(g[3], missing[3]) >= 0.4 or g[5] == missing[5])]
    return max(alike, key=lambda g: (similarity(g[3], missing[3]), -g[1]))[2] if alike else None


def test_lookalikes_by_the_rules(spark):
    rng = random.Random(11)
    names = ["live", "night", "metal", "doom", "sludge", "the", "at", "london", "fest", "day"]
    title = lambda: " ".join(rng.choice(names) for _ in range(rng.randrange(0, 6)))
    make = lambda i, old: gig(i, venue=rng.choice("ab"), title=title(), date=DAY + dt.timedelta(days=rng.choice([0, 0, 0, 1])), poster=f"p{rng.randrange(6)}", url=f"{old}{i}")
    listing, missing = [make(i, "n") for i in range(60)], [make(i, "o") for i in range(60)]
    table, gone = (spark.createDataFrame(x, LISTING_SCHEMA) for x in (listing, missing))
    result = {r.url: r.by_url for r in relisting.lookalikes(table, gone).collect()}
    assert result == {m[2]: plain_lookalike(m, listing) for m in missing if plain_lookalike(m, listing)}


def test_long_titles_meet_by_number(spark):
    """Words travel one by one under their title's number, never with all the words of it."""
    rng = random.Random(12)
    names = [f"word{i}" for i in range(400)]
    title = lambda: " ".join(rng.sample(names, rng.choice([0, 1, 2, 3, 150, 200])))
    make = lambda i, old, base=(): gig(i, title=rng.choice([title(), *base]), date=rng.choice([DAY, None]) if i % 9 == 0 else DAY, poster=rng.choice(["p0", "p1", "p2", None]), url=f"{old}{i}")
    listing = [make(i, "n") for i in range(50)]
    near = [" ".join(g[3].split()[: max(1, len(g[3].split()) * 2 // 3)]) for g in listing if g[3]]
    missing = [m for m in (make(i, "o", near) for i in range(50)) if m[4]]
    table, gone = (spark.createDataFrame(x, LISTING_SCHEMA) for x in (listing, missing))
    result = {r.url: (r.by_url, round(r.similarity, 9)) for r in relisting.lookalikes(table, gone).collect()}
    told = lambda m, g: g and (g, round(similarity(next(x for x in listing if x[2] == g)[3], m[3]), 9))
    plain = {m[2]: plain_lookalike(m, [g for g in listing if g[5] or similarity(g[3], m[3]) >= 0.4]) for m in missing}
    assert result == {m[2]: told(m, plain[m[2]]) for m in missing if plain[m[2]]}
    sets = spark.range(3).select(F.lit("v").alias("venue_id"), F.lit(3).alias("date"), F.array(F.lit("a"), F.lit("b"), F.col("id").cast("string")).alias("words"), "id", F.lit(True).alias("offered"), F.lit(True).alias("asked"))
    lists = relisting._rarest_first(sets, relisting._shared_words(sets), by=["id", "offered", "asked"], mark="number")
    signed = relisting._signatures(lists)
    assert "words" not in signed.columns and dict(signed.dtypes)["word"] == "bigint" and not any("array" in kind for _, kind in signed.dtypes)


def test_replacements(spark):
    today = F.lit("2026-09-01").cast("date")
    listing = [gig(1, url="https://s.org/new", title="LOLA (AUS) + Lucky Hit | London"), gig(2, url="https://s.org/else", title="Other thing")]
    old = lambda url, **more: gig(1, url=url, **{"title": "LOLA (AUS) | London", "poster": "old.jpg", **more})
    previous = [
        old("https://s.org/gone"), old("https://s.org/moved"), old("https://s.org/astray"), old("https://s.org/live"), old("https://s.org/never-asked"),
        old("https://s.org/past", date=dt.date(2026, 8, 31)), old("https://s.org/unlike", title="Nothing shared"),
        old("https://s.org/picture", title="Nothing shared", poster="p1.jpg"), old("https://s.org/new"),
    ]
    answers = [("gone", 404, None), ("moved", 301, "/new"), ("astray", 302, "https://s.org/elsewhere"), ("live", 200, None), ("past", 404, None), ("unlike", 404, None), ("picture", 410, None)]
    status = spark.createDataFrame([(f"https://s.org/{u}", s, to) for u, s, to in answers], "url string, status int, location string")
    found_pairs = relisting.replacements(spark.createDataFrame(listing, LISTING_SCHEMA), spark.createDataFrame(previous, LISTING_SCHEMA), status, today)
    assert rows(found_pairs, "url", "by_url") == [("https://s.org/gone", "https://s.org/new"), ("https://s.org/moved", "https://s.org/new"), ("https://s.org/picture", "https://s.org/new")]


def test_redirect_without_a_target_is_live(spark):
    status = spark.createDataFrame([("https://s.org/a/b", 302, None), ("https://s.org/a/b", 301, "c"), ("https://s.org/a/b", 308, "//t.org/x")], "url string, status int, location string")
    assert [(r.verdict, r.moved_to) for r in relisting.url_verdict(status).collect()] == [("live", None), ("moved", "https://s.org/a/c"), ("moved", "https://t.org/x")]


@pytest.mark.parametrize("text,want", [("🎸" * 40, '"' + "🎸" * 30 + '..."'), ("a" + "🎸" * 40, '"a' + "🎸" * 29 + '..."'), ("🎸" * 30, '"' + "🎸" * 30 + '"'), ("x" * 61, '"' + "x" * 60 + '..."')])
def test_quotes_are_cut_by_utf16_units(spark, text, want):
    from listinglake.functions.text import shortened

    assert spark.createDataFrame([(text,)], "t string").select(shortened(F.col("t"))).first()[0] == want


def test_quotes_and_trims_read_no_more_than_they_need(spark):
    """The start of a long text decides its quote, and must give the quote that the whole gives."""
    from listinglake.functions.text import SPACE, shortened, stripped, words

    space, odd = "\u00a0", "\u2003"
    texts = ["", " ", space, "a" * 700, "a " * 700, " " * 900 + "late words", "x" + " " * 600 + "y" * 70, f"{space}in front {odd}", "b" * 479 + space + "c",
             "c" * 59 + " " * 500 + space + "d", f"d {space} " * 200, "🎸" * 500, f"e{space}" * 300, "f" * 60 + " " * 600 + space]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    whole = F.array_join(words(F.col("t")), " ")
    got = table.select(shortened(F.col("t")).alias("q"), whole.alias("line"), stripped(F.col("t")).alias("s"), "t").collect()
    units = lambda t: len(t.encode("utf-16-le")) // 2
    for r in got:
        line = r.line
        cut = next(line[:n] for n in range(60, -1, -1) if units(line[:n]) <= 60)
        assert r.q == (f'"{line}"' if units(line) <= 60 else f'"{cut}..."')
    plain = table.select(F.regexp_replace("t", f"^[{SPACE}]+|[{SPACE}]+$", "").alias("s")).collect()
    assert [r.s for r in got] == [r.s for r in plain]
    assert "left(t, 480)" in shortened(F.col("t"))._jc.toString()


def test_runs_are_hashed_where_they_are(spark):
    found = contamination.phrase_counters(F.col("w"), F.lit(4096))
    assert "slice" not in found._jc.toString()
    one, other = "a b c d e f g h".split(), "x c d e f g h".split()
    table = spark.createDataFrame([(one,), (other,), (one[:5],), (None,)], "w array<string>")
    a, b, short, none = (r[0] for r in table.select(found).collect())
    assert len(a) == 3 and len(b) == 2 and a[2] == b[1] and short is None and none is None


@pytest.mark.parametrize("text,want", [
    ("plain & simple < 3", None), ("&amp; so", "an html entity"), ("a <br> b", "unparsed markup"), ("caf\u00c3\u00a9", "mis-decoded characters"),
    ("don\u00e2\u20ac\u2122t", "mis-decoded characters"), ("\u00c2\u00a3", "mis-decoded characters"), ("\u00c2ngstr", None), ("<P>&amp;", "unparsed markup"), (None, None),
])
def test_markers(spark, text, want):
    from listinglake.operators.quality.text_checks import marker_in

    assert spark.createDataFrame([(text,)], "t string").select(marker_in(F.col("t"))).first()[0] == want


def test_a_word_that_all_titles_share_makes_no_pairs(spark):
    """Titles of two words share one of three: a night of n a side meets nothing through that word."""
    made = {}
    for n in (200, 400):
        titles = lambda side: spark.range(n).select(F.lit("v").alias("venue_id"), F.lit(3).alias("date"), F.array(F.lit("presents"), F.concat(F.lit(side), "id")).alias("words"))  # noqa: E731, B023
        a, b = titles("a"), titles("b")
        counts = a.union(b).select("venue_id", "date", F.explode("words").alias("word")).groupBy("venue_id", "date", "word").agg(F.count(F.lit(1)).alias("n"))
        left = relisting._signatures(relisting._rarest_first(a, counts))
        right = relisting._signatures(relisting._rarest_first(b, counts)).drop("words").where("not lone")
        made[n] = left.count(), left.where("not lone").join(right, ["venue_id", "date", "word"]).count()
    assert made[400][0] == 2 * made[200][0] and made[200][1] == made[400][1] == 0
