import random
import re
import time
from html import unescape

from listinglake.llm.html_main import common_lines, lines_of, main_text, shared_lines

SF = "/root/testdata/sf0.01"


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        at = common_lines(a, b)
        assert len(at) == longest(a, b) and at == sorted(set(at))
        it = iter(b)
        assert all(any(a[i] == v for v in it) for i in at)


def test_nearest_page_decides():
    page = ("h", "/a/b/1", [1, 2, 3])
    near, far = ("h", "/a/b/2", [2, 9]), ("h", "/z", [1, 3])
    assert shared_lines(page, far, near) == [1] and shared_lines(page, far, None) == [0, 2]
    assert shared_lines(page, ("other", "/a/b/1", [1]), ("h", "/a/b/1", [1, 2, 3])) == []


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        # the table's pages hold one article of h1 and p blocks
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_structure():
    page = """<html><head><title>no</title><style>p{}</style></head><body><header>no</header><nav>no</nav>
    <main><h1>A &amp;amp; B</h1><p>one<b>two</b>&nbsp; three<p>four<!-- no --><div class='cookie-notice x'>no</div><script>if (a<b) "</p>"</script>
    <aside>no</aside><ul><li>five</li><li>six</ul><section id=comments><p>no</p></section><form><input>no</form></main><footer>no</footer>"""
    assert [t for t, _ in lines_of(page)] == ["A &amp; B", "onetwo three", "four", "five", "six"]
    assert lines_of("") == [] and lines_of("a < b & c") == [("a < b & c", 0)] and lines_of("<p") == [("<p", 0)]


def test_words_inside_articles():
    page = """<div id=discussion>no</div><div class="related-work">no</div><article><header><h1>Title</h1><p class="byline">no</p><address>no</address>
    <time>no</time><p>Lead</p><nav>no</nav></header><section id="discussion"><p>one</p></section><div class="related-work">two</div><p class="notice">three</p>
    <div class="share social">four</div><div class="sponsored ad">no</div><div id="comments-list"><p>no</p></div><aside>no</aside><form>no</form><p>five</article><header>no</header>"""
    assert [t for t, _ in lines_of(page)] == ["Title", "Lead", "one", "two", "three", "four", "five"]
    assert lines_of('<article class="comment"><p>no</article><article><p>yes <a class="x>y</a></article>') == [("yes y", 1)]


def test_malformed_megabytes_take_seconds():
    for piece in ("<a ", '<a href="', "<div>", '<a b=">" ', "<p>", "<ul><li>", "</p>", "<script>", "<b>"):
        started = time.process_time()
        lines = lines_of("<article><p>first</p>" + piece * (1_000_000 // len(piece)))
        assert lines[0] == ("first", 1) and time.process_time() - started < 10


def test_pages_without_article(spark):
    def page(*lines):
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"

    rows = [(1, "http://h/a/1", page("top", "x é", "end")), (2, "http://h/a/2?q=1", page("top", "y", "end")), (2, "http://h/a/2?q=1", page("top", "y", "end")),
            (None, None, None), (4, "http://solo/", page("alone")), (5, "http://big/1", page(*map(str, range(20_000)))), (6, "http://big/2", page(*map(str, range(0, 20_000, 2))))]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text) for r in main_text(pages).collect()), key=str)
    # equal rows get equal text
    want = [(1, "x é"), (2, "y"), (2, "y"), (None, ""), (4, "alone"), (5, " ".join(map(str, range(1, 20_000, 2)))), (6, "")]
    assert got == sorted(want, key=str)
    assert main_text(pages.limit(0)).count() == 0


def test_run_of_copies_meets_pages_beyond(spark):
    def page(*lines):
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"

    copies = [(i, f"http://h/b/{i}", page("top", "menu", "same", "z", "end")) for i in range(2, 7)]
    rows = [(1, "http://h/a/1", page("top", "menu", "x", "end")), *copies, (7, "http://h/b/61", page("top", "menu", "z", "w")), (8, "http://other/b/3", page("top", "same", "menu")), *[(i, f"http://twins/{i}", page("top", "v")) for i in (9, 10, 11)]]
    got = {r.page_id: (r.text, r.n_shared) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = {1: ("x", 3), **{i: ("same end", 3) for i in range(2, 7)}, 7: ("w", 3), 8: ("top same menu", 0), **{i: ("top v", 0) for i in (9, 10, 11)}}
    assert got == want


def test_long_run_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr("listinglake.llm.html_main.BLOCK_PAGES", 2)
    rows = [(i, f"http://h/{i:03}", f"<p>top<p>{i if i % 40 == 0 else 'same'}") for i in range(100)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: str(i) if i % 40 == 0 else "same" for i in range(100)}
