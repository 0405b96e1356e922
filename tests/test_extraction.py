"""Each source's rules against a page shaped as that source's is."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from listinglake.model import PAGES_SCHEMA
from listinglake.operators import dom, extraction
from listinglake.session import durable
from listinglake.sources import rules
from listinglake.sources.html import with_nodes
from listinglake.venues import POSTER_ONLY, VENUE_IDS

D = dt.date

# venue: listing pages, {event url: event page}, expected rows (url, title, date, poster, description)
CASES = {
    "black-heart": (
        ["""<article class="eventlist-event eventlist-event--upcoming"><div class="eventlist-column-thumbnail"><img data-image="/i/a.jpg"></div>
         <a class="eventlist-title-link" href="/events/one">Band One</a><time class="event-date" datetime="2026-08-14">x</time>
         <time class="event-date" datetime="2026-08-15">y</time></article><article class="eventlist-event--past"><a href="/no">n</a></article>"""],
        {"https://www.ourblackheart.com/events/one": '<div class="eventitem-column-content">Loud &lt;b&gt;night&lt;/b&gt; out</div>'},
        [("https://www.ourblackheart.com/events/one", "Band One", D(2026, 8, 14), "https://www.ourblackheart.com/i/a.jpg", "Loud night out")],
    ),
    "fiddlers-elbow": (
        ["""<article class="eventlist-event--upcoming"><div class="eventlist-column-thumbnail"><img src="https://i.example.org/b.jpg"></div>
         <a class="eventlist-title-link" href="/whos-playing/two">Band Two</a><time class="event-date" datetime="2026-09-01"></time>
         <div class="eventlist-excerpt"><p>From the list</p></div></article>"""],
        {},
        [("https://www.thefiddlerselbow.co.uk/whos-playing/two", "Band Two", D(2026, 9, 1), "https://i.example.org/b.jpg", "From the list")],
    ),
    "the-garage": (
        ["""<div class="card card--full"><span class="card__strip-heading">Fri.14.Aug.26</span><a class="card__heading" href="https://www.thegarage.london/gigs/a/">Act A</a>
         <div class="card__grid-media"><img data-lazy-src="https://i.example.org/lazy.jpg" src="data:x"></div></div>
         <div class="card card--full"><span class="card__strip-heading">Sat.15.Aug.26</span><a class="card__heading">Act B</a>
         <p class="card__notification"><a href="/gigs/b/">moved</a></p></div>"""],
        {
            "https://www.thegarage.london/gigs/a/": '<div class="single-article--contains-list"><div class="single-article__content"><p>Great band.</p><p>For more events <a>look here</a></p></div></div>',
            "https://www.thegarage.london/gigs/b/": '<img class="article-image__bg" data-lazy-src="/bg.jpg"><div class="single-article--contains-list"><div class="single-article__content"><p>Other.</p></div></div>',
        },
        [("https://www.thegarage.london/gigs/a/", "Act A", D(2026, 8, 14), "https://i.example.org/lazy.jpg", "Great band."),
         ("https://www.thegarage.london/gigs/b/", "Act B", D(2026, 8, 15), "https://www.thegarage.london/bg.jpg", "Other.")],
    ),
    "the-o2-arena": (
        ["""<div class="eventItem"><div class="thumb"><img class="wide" src="/w.jpg"><img class="square" src="/s.jpg"></div>
         <div class="date"><span class="m-date__rangeFirst"><span class="m-date__day"> 28 </span><span class="m-date__month">Dec</span></span>
         <span class="m-date__rangeLast"><span class="m-date__day">2</span><span class="m-date__month">January</span><span class="m-date__year"> 2027</span></span></div>
         <h3 class="title"><a href="/events/detail/show">Show</a></h3></div>""",
         """<div class="eventItem"><div class="thumb"><img class="square" src="/t.jpg"></div><div class="date"><span class="m-date__singleDate">
         <span class="m-date__day">5</span><span class="m-date__month">June</span><span class="m-date__year">2026</span></span></div>
         <h3 class="title"><a href="/events/detail/next">Next</a></h3></div>""",
         "<p>no more</p>",
         '<div class="eventItem"><h3 class="title"><a href="/events/detail/late">Late</a></h3></div>'],
        {"https://www.theo2.co.uk/events/detail/show": '<div class="event_description">Big</div>',
         "https://www.theo2.co.uk/events/detail/next": '<div class="event_description"></div>'},
        [("https://www.theo2.co.uk/events/detail/show", "Show", D(2026, 12, 28), "https://www.theo2.co.uk/s.jpg", "Big"),
         ("https://www.theo2.co.uk/events/detail/next", "Next", D(2026, 6, 5), "https://www.theo2.co.uk/t.jpg", "")],
    ),
    "new-cross-inn": (
        ["""<ul><li><a href="https://pit.live/events/1"><h3 class="nci-event-name">Punk Night</h3></a><dd>Fri 14 Aug 2026</dd><img src="/p.jpg"></li>
         <li><a href="/about">About</a></li>
         <li><a href="https://pit.live/events/1"><h3 class="nci-event-name">Punk Night again</h3></a><dd>15 Aug 2026</dd><img src="/q.jpg"></li></ul>"""],
        {"https://pit.live/events/1": """<div x-ref="desc" x-html="'&lt;p&gt;Fast \\u0026 loud&lt;/p&gt;'"></div>"""},
        [("https://pit.live/events/1", "Punk Night", D(2026, 8, 14), "https://www.newcrossinn.com/p.jpg", "Fast & loud")],
    ),
    "cart-and-horses": (
        ["".join(
            f'<div class="news-carousel__item"><div class="news-carousel__date-wrap"><span class="news-carousel__month">{m}</span><span class="news-carousel__day">{day}</span></div>'
            f'<a class="news-carousel__link" href="/news-offers-events/{m}{day}/">Gig {m}</a><img class="news-carousel__image" src="/{m}.jpg"></div>'
            for m, day in (("Dec", 30), ("Jan", 2), ("Jan", 9), ("Feb", 1))
        ) + '<div class="news-carousel__item"><a class="news-carousel__link" href="/offer/">Offer</a></div>'],
        {f"https://www.cartandhorses.london/news-offers-events/{x}/": '<h1 class="page_header">Head</h1><nav>menu</nav><div class="page_content_inner">Body</div>'
         for x in ("Dec30", "Jan2", "Jan9", "Feb1")},
        [(f"https://www.cartandhorses.london/news-offers-events/{m}{day}/", f"Gig {m}", D(y, n, day), f"https://www.cartandhorses.london/{m}.jpg", "Head Body")
         for m, n, day, y in (("Dec", 12, 30, 2026), ("Jan", 1, 2, 2027), ("Jan", 1, 9, 2027), ("Feb", 2, 1, 2027))],
    ),
    "electric-ballroom": (
        ["".join(
            f'<div class="grid-block card"><div class="grid-image" style="background-image: url(\'https://i.example.org/{i}.jpg\')"></div><p class="event-date">Friday {day} {m}</p>'
            f'<h2 class="event-name"><a href="/events/{i}/">Name {i}</a></h2></div>' for i, (day, m) in enumerate((("14th", "November"), ("2nd", "March")))
        )],
        {f"https://electricballroom.co.uk/events/{i}/": '<div class="article-content"><h2>Metal</h2><p>Great show</p><p>Please note this show is 14+</p><p>Strictly 14+</p></div>' for i in (0, 1)},
        [("https://electricballroom.co.uk/events/0/", "Name 0", D(2026, 11, 14), "https://i.example.org/0.jpg", "Metal Great show"),
         ("https://electricballroom.co.uk/events/1/", "Name 1", D(2027, 3, 2), "https://i.example.org/1.jpg", "Metal Great show")],
    ),
    "electric-brixton": (
        ["""<div class="fl-post-grid-post"><div class="uabb-post-thumbnail"><img src="/e.jpg"></div><p class="event-date">Sat 19th August 2026</p>
         <h3 class="event-title"><a href="/events/x/">X</a></h3></div>"""],
        {"https://www.electricbrixton.uk.com/events/x/": '<div class="event-context">Dance<br>all night</div>'},
        [("https://www.electricbrixton.uk.com/events/x/", "X", D(2026, 8, 19), "https://www.electricbrixton.uk.com/e.jpg", "Dance all night")],
    ),
    "islington-assembly-hall": (
        ["""<li class="event__item"><a class="event__item__background" data-src="https://i.example.org/pic-300x300-c-center.jpg"></a><span class="event__item__date__month">Oct</span>
         <span class="event__item__date__numeric">3</span><a class="event__item__title" href="/events/o/">O</a></li>""",
         """<li class="event__item"><a class="event__item__background" data-src="/q.jpg"></a><span class="event__item__date__month">Feb</span>
         <span class="event__item__date__numeric">4</span><a class="event__item__title" href="/events/f/">F</a></li>"""],
        {f"https://islingtonassemblyhall.co.uk/events/{x}/": '<div class="event__description"><p>Songs.</p><p>*This is a 14+ event</p><p>By purchasing a ticket to this event you agree</p><div>not a p</div></div>' for x in "of"},
        [("https://islingtonassemblyhall.co.uk/events/o/", "O", D(2026, 10, 3), "https://i.example.org/pic.jpg", "Songs."),
         ("https://islingtonassemblyhall.co.uk/events/f/", "F", D(2027, 2, 4), "https://islingtonassemblyhall.co.uk/q.jpg", "Songs.")],
    ),
    "scala": (
        ["""<div class="tb-event-item"><div class="tb-event-feature-pic" style="background:url('https://i.example.org/s.jpg')"></div><h2><a href="/events/s/">S</a></h2><p class="date">19th August 2026</p></div>"""],
        {"https://scala.co.uk/events/s/": """<div class="event-post"><div class="entry-content"><div class="tb-event-headerbox">S + Support</div><p class="event-date">19th</p>
         <p>Doors seven</p><h3>About S</h3><p>They play.</p><p class="age-restrictions">14+</p><div class="button">Buy</div></div></div>"""},
        [("https://scala.co.uk/events/s/", "S", D(2026, 8, 19), "https://i.example.org/s.jpg", "S + Support About S They play.")],
    ),
    "windmill-brixton": (
        ["""<a class="EventLink" href="/events/2026-08-14-the-act"><div class="Image-wrap"><img src="https://i.example.org/w?mode=crop&width=200&v=2"><img src="/second.jpg"></div><span class="title name">The Act</span></a>"""],
        {"https://www.windmillbrixton.co.uk/events/2026-08-14-the-act": '<div class="EventDetailDescription">Text</div>'},
        [("https://www.windmillbrixton.co.uk/events/2026-08-14-the-act", "The Act", D(2026, 8, 14), "https://i.example.org/w?v=2", "Text")],
    ),
    "union-chapel": (
        ["""<div class="item" data-chron="2026-08-14 19:00"><a href="/login">x</a><a href="/whats-on/u"><div class="card-image" style='background-image:url("https://i.example.org/u.jpg")'></div></a>
         <h3 class="card-title">U Live</h3><h3 class="card-title">U Live</h3></div><div class="item">undated</div>"""],
        {"https://unionchapel.org.uk/whats-on/u": """<article class="pt-4"><p>First.</p><p>Use the Book Now button above</p><h4>For accessibility</h4><p>Later.</p></article><aside class="sidebar">With V</aside>"""},
        [("https://unionchapel.org.uk/whats-on/u", "U Live", D(2026, 8, 14), "https://i.example.org/u.jpg", "First. With V")],
    ),
    "alexandra-palace": (
        ["".join(
            f'<div class="event_card_wrapper"><a class="event_target" href="/whats-on/{i}/">Ally Pally {i}</a><p class="dates">{text}</p>'
            f'<div class="event_img"><img src="/s{i}.jpg" srcset="/a{i}.jpg 300w, /b{i}.jpg 1200w, /c{i}.jpg 1200w"></div></div>'
            for i, text in enumerate(("21 Aug 2026", "1 - 9 Aug 2026", "19 Sep - 5 Dec 2026", "11 Dec - 3 Jan 2027"))
        )],
        {f"https://www.alexandrapalace.com/whats-on/{i}/": '<div class="ap_text_block">One</div><p>no</p><div id="key-information">Two</div>' for i in range(4)},
        [(f"https://www.alexandrapalace.com/whats-on/{i}/", f"Ally Pally {i}", on, f"/b{i}.jpg", "One Two")
         for i, on in enumerate((D(2026, 8, 21), D(2026, 8, 1), D(2026, 9, 19), D(2026, 12, 11)))],
    ),
    "eventim-apollo": (
        ["".join(
            f'<div class="search-item"><a class="cover-link" href="/events/{i}/"></a><div class="card__image"><img src="/{i}.jpg"><img src="/backup.jpg"></div>'
            f'<h3 class="card__title">Apollo {i}</h3><p class="date">{text}</p></div>'
            for i, text in enumerate(("14th August 2026", "Dec 30th - Jan 2nd 2027", "June 3rd - July 4th 2026"))
        )],
        {f"https://www.eventimapollo.com/events/{i}/": '<div class="event-hero"><div class="variable-color mt-sm">Words</div></div>' for i in range(3)},
        [(f"https://www.eventimapollo.com/events/{i}/", f"Apollo {i}", on, f"https://www.eventimapollo.com/{i}.jpg", "Words")
         for i, on in enumerate((D(2026, 8, 14), D(2026, 12, 30), D(2026, 6, 3)))],
    ),
    "dingwalls": (
        ["""<div class="gig"><div class="elementor-widget-heading elementor-widget-theme-post-title"><a href="/gig/d/">D 2nd May 2020</a></div>
         <div class="elementor-widget-heading">Saturday 26th September, 2026</div><div class="elementor-widget-theme-post-featured-image"><img src="/d.jpg"></div></div>"""],
        {"https://dingwalls.com/gig/d/": '<div class="elementor-location-single">D plays</div>'},
        [("https://dingwalls.com/gig/d/", "D 2nd May 2020", D(2026, 9, 26), "https://dingwalls.com/d.jpg", "D plays")],
    ),
    "roundhouse": (
        ["""<div class="event-card"><a class="event-card__link" href="/whats-on/r/">go</a><div class="event-card__image"><img src="/r.jpg"></div>
         <h3 class="event-card__title">R</h3><p class="event-card__date">Wed 12 Aug 26</p></div>"""],
        {"https://www.roundhouse.org.uk/whats-on/r/": """<div class="event-hero__heading-wrapper">R live</div><section class="event-about"><p>Copy</p>
         <div class="layout-block--related-events-list">Others</div></section>"""},
        [("https://www.roundhouse.org.uk/whats-on/r/", "R", D(2026, 8, 12), "https://www.roundhouse.org.uk/r.jpg", "R live Copy")],
    ),
    "paper-dress-vintage": (
        ["""<div data-event-month="August 2026"><a class="events__event" href="https://paperdressvintage.co.uk/e/1"><div class="event__poster" style="background-image:url('https://i.example.org/p-lbox-300x300-FFF.jpg')"></div>
         <h4>80s Club</h4><p class="margin__bottom--1">Fri 14 Aug</p></a></div>
         <div data-event-month="January 2027"><a class="events__event" href="/e/2"><div class="event__poster" style="background-image:url('https://i.example.org/q.jpg')"></div>
         <h4>New Year</h4><p class="margin__bottom--1">Sat 2 Jan</p></a></div>"""],
        {f"https://paperdressvintage.co.uk/e/{i}": '<div class="event__content">Hello</div>' for i in (1, 2)},
        [("https://paperdressvintage.co.uk/e/1", "80s Club", D(2026, 8, 14), "https://i.example.org/p.jpg", "Hello"),
         ("https://paperdressvintage.co.uk/e/2", "New Year", D(2027, 1, 2), "https://i.example.org/q.jpg", "Hello")],
    ),
    "underworld": (
        ["""<section id="gigs"><article class="list"><div class="list-image"><img src="https://x.imgix.net/u.jpg?w=300&h=2"></div><h2 class="list-header-title"><a href="/event/u/">U</a> + V</h2>
         <time datetime="2026-08-14"></time><time datetime="2026-08-15"></time></article></section><article class="list">other</article>"""],
        {"https://www.theunderworldcamden.co.uk/event/u/": """<article class="event"><p>Doom.</p><p>This is a 14+ event</p><p>All must carry PHOTO ID</p><footer>Share</footer></article>"""},
        [("https://www.theunderworldcamden.co.uk/event/u/", "U + V", D(2026, 8, 14), "https://x.imgix.net/u.jpg?h=2", "Doom.")],
    ),
}
# venues that share another one's rules
TWINS = {"dome": "black-heart", "the-grace": "the-garage", "indigo-at-the-o2": "the-o2-arena"}


@pytest.fixture(scope="module")
def extracted(spark):
    """All venues through one run of the job."""
    base = {r["venue_id"]: r["base_url"] for r in rules.CARD_RULES}
    pages = [(v, base[v], i, 200, body) for v, (bodies, _, _) in CASES.items() for i, body in enumerate(bodies)]
    events = [(v, url, 0, 200, body) for v, (_, found, _) in CASES.items() for url, body in found.items()]
    listing = extraction.html_listing(
        spark.createDataFrame(pages, PAGES_SCHEMA), spark.createDataFrame(events, PAGES_SCHEMA),
        rules.card_rules(spark), rules.copy_rules(spark), 2026,
    )
    return listing.collect()


@pytest.mark.parametrize("venue", list(CASES))
def test_source(extracted, venue):
    found = sorted((r for r in extracted if r.venue_id == venue), key=lambda r: r.listing_pos)
    assert [r.error for r in found] == [None] * len(found)
    assert [(r.url, r.title, r.date, r.poster_url, r.description) for r in found] == CASES[venue][2]


def test_every_source_has_rules():
    listed = {r["venue_id"] for r in rules.CARD_RULES} | {v for v, _, _ in rules.API_RULES}
    assert listed == set(VENUE_IDS) - set(POSTER_ONLY)
    assert set(CASES) | set(TWINS) == {r["venue_id"] for r in rules.CARD_RULES}


def test_twins_share_their_rules():
    by_venue = {r["venue_id"]: r for r in rules.CARD_RULES}
    own = {"venue_id", "base_url", "under", "house_image"}
    for twin, like in TWINS.items():
        assert {k: v for k, v in by_venue[twin].items() if k not in own} == {k: v for k, v in by_venue[like].items() if k not in own}


def test_failures_take_out_only_their_venue(spark):
    pages = [
        ("dingwalls", "https://dingwalls.com/whats-on/", 0, 200, CASES["dingwalls"][0][0].replace("/gig/d/", "https://elsewhere.example.org/d")),
        ("scala", "https://scala.co.uk/events/categories/live-music/", 0, 200, CASES["scala"][0][0]),
        ("roundhouse", "https://www.roundhouse.org.uk/whats-on/?type=event", 0, 200, CASES["roundhouse"][0][0]),
    ]
    events = [("scala", u, 0, 200, b) for u, b in CASES["scala"][1].items()]
    events += [("roundhouse", u, 0, 200, "<p>changed</p>") for u in CASES["roundhouse"][1]]
    listing = extraction.html_listing(
        spark.createDataFrame(pages, PAGES_SCHEMA), spark.createDataFrame(events, PAGES_SCHEMA), rules.card_rules(spark), rules.copy_rules(spark), 2026
    )
    intact, failed = extraction.listing_of(listing)
    assert {r.venue_id for r in intact.collect()} == {"scala"}
    errors = {r.venue_id: r.error for r in failed.collect()}
    assert errors["dingwalls"].startswith("Gig url https://elsewhere.example.org/d isn't under https://dingwalls.com/gig/")
    assert errors["roundhouse"] == "No description found on event page https://www.roundhouse.org.uk/whats-on/r/"


def long_page(spark, n):
    markup = "<body><div class=box>" + "".join(f"<p>word {i}</p>" for i in range(n)) + "</div><p>out</p></body>"
    return durable(with_nodes(spark.createDataFrame([(markup,)], "html string"), "html"))


def test_scoped_selection_grows_with_the_page(spark):
    def seconds(page):
        found = dom.select(F.col("nodes"), dom.selector(tag="p", in_class="box"))
        started = time.perf_counter()
        page.select(F.length(dom.joined_text(found, F.col("nodes")))).collect()
        return time.perf_counter() - started

    small, large = long_page(spark, 5_000), long_page(spark, 10_000)
    seconds(small)
    assert seconds(large) < 3 * seconds(small) + 1


def test_ancestors_are_found_in_a_part_with_gaps(spark):
    nodes = F.col("nodes")
    gone = dom.without(nodes, F.slice(dom.select(nodes, dom.selector(tag="p")), 3, 2))
    inside = lambda part: F.size(dom.select(part, dom.selector(tag="p", in_class="box")))
    first = lambda part: dom.text_of(dom.within(part, dom.first(dom.select(nodes, dom.selector(classes=["box"])))))
    found = long_page(spark, 5).select(inside(nodes).alias("a"), inside(gone).alias("b"), first(nodes).alias("c"), first(gone).alias("d")).first()
    assert found == (5, 3, "word 0 word 1 word 2 word 3 word 4", "word 0 word 1 word 4")
