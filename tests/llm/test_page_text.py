import html
import random
import re
import time

import numpy as np

from quarry.llm import page_text as P
from quarry.llm.page_text import blocks, common, page_text, query


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_is_longest():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcdef") for _ in range(r.randint(0, 12))] for _ in range(2))
        got = sorted(common(a, b))
        assert len(got) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_halved_alignments(monkeypatch):
    """Tables beyond CELLS are halved; the result is as long."""
    monkeypatch.setattr(P, "CELLS", 6)
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
        got = sorted(common(a, b))
        rest = iter(b)
        assert len(got) == lcs(a, b) and all(a[i] in rest for i in got)
    monkeypatch.undo()
    x = np.arange(6000)
    began = time.time()
    assert len(P._aligned(x, np.concatenate([x[3000:], x[:3000]]))) == 3000
    assert time.time() - began < 20


def test_linear_time():
    for bad in ('<a "x ', "<a 'x ", "<", "<!", "</", "<p", '<div class="ad">', "<!-- <p>", "<b class='ad'>x<"):
        took = []
        for n in (20_000, 160_000):
            began = time.time()
            blocks(bad * (n // len(bad)))
            blocks("<p>a</p>" + bad * (n // len(bad)) + "<p>z</p>")
            took.append(time.time() - began)
        assert took[1] < max(1, 20 * took[0]), (bad, took)
    began = time.time()
    blocks('<a "x ' * (1_000_000 // 6))
    assert time.time() - began < 1
    assert blocks('<p>one<p title="a>b">two<p title="x>three') == [("one", False), ("two", False), ("three", False)]


def test_blocks():
    page = """<!DOCTYPE html><html class="menu"><head><title>T</title></head><body class="nav"><nav><ul><li>menu</li></ul></nav><header>top</header>
    <div class="side-bar ad">buy <div>more</div> now</div><!-- c > --><script>var t="</p>";</script><article><header><h1>Head  line</h1></header><p>One &amp; two&nbsp;&#x41;<br>three<p><b>Four
    five</b> six</p>a < b<ul><li>x</li><li>y</li></ul><form>f</form><div id="comments">c</div><pre>k  l</pre></article><footer>&copy;</footer></body></html>"""
    assert blocks(page) == [("Head line", True), ("One & two A three", True), ("Four five six", True), ("a < b", True), ("x", True), ("y", True), ("k l", True)]
    assert blocks("") == [] and blocks("plain < text") == [("plain < text", False)]
    assert blocks("<p>a<div class=ad>b<p>c") == [("a", False), ("b", False), ("c", False)]
    assert blocks("<p hidden>no</p><p>yes") == [("yes", False)]


def test_wrappers_with_marked_names():
    article = "<article><p>Text</p></article>"
    for wrap in ("layout has-sidebar", "content no-sidebar", "page sidebar", "with-ads", "ad-free"):
        assert blocks(f'<div class="{wrap}"><div class="ad">buy</div><div>{article}</div></div><div class="site-footer">f</div>') == [("Text", True)]
    assert blocks('<div role="form"><main>a</main></div>') == [("a", True)]
    assert blocks('<div class="content no-sidebar"><p>a</p><p class="post-comments">b</p></div>') == [("a", False)]
    assert blocks(f"<div hidden>{article}</div><p>b</p>") == [("b", False)]
    assert blocks(f'<div class="ad"><div class="ad">x</div>y</div>{article}<div class="ad">z</div>') == [("Text", True)]
    assert len(blocks('<div class="ad">' * 20_000 + article + "</div>" * 20_000)) == 1


def test_differencing(spark):
    chrome = "<div>Site name</div><div>Welcome to us</div>"
    rows = [(i, f"http://h{i % 2}.org/a/{i}", chrome + f"<p>Own text {i}</p><p>More of {i}</p>" + "<div>Imprint</div>") for i in range(8)]
    rows += [(20, None, "<p>alone</p>"), (21, "http://x.org/a", None), (None, "http://y.org/", "<p>z</p>"), (22, "http://x.org/b", ""), (23, "http://q.org/1", "<article><p>Same in both</p></article>"), (24, "http://q.org/2", "<article><p>Same in both</p></article>"), (25, "http://big.org/", "<p>word</p>" * 5000)]
    rows += [rows[0]]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, text int")
    got = page_text(df.coalesce(1)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == f"Own text {i}\nMore of {i}" for i in range(8))
    assert by[20] == "alone" and by[21] == by[22] == "" and by[None] == "z"
    assert by[23] == by[24] == "Same in both" and by[25].count("\n") == 4999
    assert page_text(df.limit(0)).count() == 0


def page(own, top="Menu", end="Imprint"):
    return f"<div>{top}</div><p>{own}</p><p>By the editors</p><div>{end}</div>"


def test_copies_are_not_held_against_each_other(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    rows = [(1, "http://a.org/x?utm_source=f", page("One")), (2, "http://a.org/x", page("One")), (3, "http://a.org/y", page("Two"))]
    rows += [(i, "http://b.org/x", page("Three")) for i in range(10, 15)] + [(15, "http://b.org/x#top", page("Three, edited")), (16, "http://b.org/z", page("Four"))]
    rows += [(i, f"http://c.org/{i}", page("Not found")) for i in range(20, 26)] + [(26, "http://c.org/7", page("Five"))]
    rows += [(30, "http://d.org/x?a", page("Six")), (31, "http://d.org/x?b", page("Six"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    by = {r.page_id: r.text for r in page_text(df.coalesce(1)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert by[1] == by[2] == "One" and by[3] == "Two"
    assert {by[i] for i in range(10, 15)} == {"Three"} and by[15] == "Three, edited" and by[16] == "Four"
    assert {by[i] for i in range(20, 26)} == {"Not found"} and by[26] == "Five"
    assert by[30] == by[31] == "Menu\nSix\nBy the editors\nImprint"


def test_any_partitioning(spark):
    r = random.Random(3)
    rows = [(i, f"http://h{i // 20}.org/{r.choice('abc')}/{i % 20:02}", page(f"Text {i}")) for i in range(60)]
    rows += [(100 + i, f"http://h1.org/b/{i:03}", page("Not found")) for i in range(40)] + [(200 + i, "http://one.org/", page("Copy")) for i in range(20)] + [(300, "http://one.org/z", page("Other"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: re.search("<p>(.*?)</p>", h)[1] for i, _, h in rows}
    for n in ("1", "3", "16", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {x.page_id: x.text for x in page_text(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want, n


def test_query(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = query(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def story(own, end="Share this story", also=""):
    return f"<nav>m</nav><article><h1>Title {own}</h1><p>Text of {own}.</p>{also}<p>{end}</p></article><footer>f</footer>"


def test_site_lines_in_articles(spark):
    """What nearly all pages of a host have in their articles goes; sentences that some articles share stay."""
    quote = "<p>A sentence that is quoted.</p>"
    rows = [(i, f"http://a.org/{i}", story(i, also=quote if i < 6 else "")) for i in range(10)]
    rows += [(20 + i, f"http://b.org/{i}", story(i)) for i in range(7)]  # too few to tell
    rows += [(30 + i, f"http://c.org/{i}", story(i, end=f"End {i // 3}")) for i in range(9)]  # no line on more than half
    rows += [(40 + i, "http://d.org/x", story("x")) for i in range(9)]  # copies of one page
    rows += [(50 + i, f"http://e.org/{i}?q={i}", story(i)) for i in range(8)] + [(58, "http://e.org/0?q=7", story(0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    by = {r.page_id: r.text for r in page_text(df).collect()}
    for i, u, h in rows:
        want = [x for x in re.findall("<(?:p|h1)>(.*?)</", h) if x != "Share this story" or u[7] in "bd"]
        assert by[i] == "\n".join(want), (i, u)
    by = {r.page_id: r.text for r in page_text(df, site_paths=100).collect()}
    assert all(by[i] == "\n".join(re.findall("<(?:p|h1)>(.*?)</", h)) for i, _, h in rows)


def test_repeated_rows_are_alike(spark):
    rows = [(i, "http://a.org/x", page("Own one")) for i in range(3)] + [(9, "http://a.org/y", page("Own two"))] + [(None, "http://a.org/x", page("Own one"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 2, 5):
        got = page_text(df.repartition(n)).collect()
        assert sorted(x.text for x in got) == ["Own one"] * 4 + ["Own two"]
