"""Templates by structure, article text that names must not delete, and pages made to be slow."""

import collections
import random
import re
import time

import pytest

from strandmap.llm import html
from tests.llm.test_site_templates import SCHEMA, words

SF = "/root/testdata/sf0.01"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_pages_without_an_article_element(spark):
    """With no article, and with no telling tag or class at all, the structures that recur on a host give the same texts."""
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    whole = texts(spark, pages)
    plain = lambda s: re.sub(r"<(/?)article", r"<\1div", s or "")
    bare = lambda s: re.sub(r"<(/?)(?:nav|footer)\b", r"<\1div", plain(s)).replace('class="ad"', 'class="x9"')
    assert texts(spark, [(i, u, plain(s)) for i, u, s in pages]) == whole
    hosts = collections.Counter(re.sub(r".*?://([^/?#]*).*", r"\1", u or "").lower() for _, u, _ in pages)
    got = texts(spark, [(i, u, bare(s)) for i, u, s in pages])
    many = [i for i, u, _ in pages if hosts[re.sub(r".*?://([^/?#]*).*", r"\1", u or "").lower()] >= 10]
    same = [got[i] == whole[i] for i in many]
    assert len(many) > 20 and sum(same) / len(same) > 0.95


def test_structures_are_counted_as_brute_force_counts_them(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        host = f"h{i % 7}.org"
        boxes = "".join(f'<div class="k{rng.randrange(5)}"><a href="/{rng.random()}">{words(rng.random(), 4)}</a></div>' for _ in range(3))
        rows.append((i, f"http://{host}/{i}", f"{boxes}<section><p>{words(i, 60)}</p></section><div class=foot{i}>{words(i + 0.5, 5)}</div>"))
    rows += [(100 + i, rows[0][1], rows[0][2]) for i in range(4)]  # copies count once
    seen = collections.defaultdict(set)
    for _, u, s in rows:
        page = html.Page(s)
        for _, slot, off in page.slots():
            seen[u.split("/")[2], slot, off].add(page.main_hash())
    want = {(h, html.signed(slot)) for (h, slot, off), pages in seen.items() if off and len(pages) >= html.MIN_PAGES and len(pages) > len(seen.get((h, slot, False), ()))}
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", html.host_col(html.F.col("url")))
    slots = {(u.split("/")[2], html.signed(slot)) for _, u, s in rows for _, slot, _ in html.Page(s).slots()}
    got = {(r["host"], h) for r in html.templates(df).collect() for h in r["hashes"]} & slots
    assert got == want and len(want) > 5


def test_names_inside_an_article_delete_nothing():
    kept = '<span class="social-science">a</span><div class="share-price">b</div><blockquote class="comment">c</blockquote><label>d</label><div class="entry-header"><h2>e</h2></div>'
    text = "a\n\nb\n\nc\n\nd\n\ne"
    assert html.Page(f"<article>{kept}</article>").text() == text
    assert html.Page(f"<article><header><h1>t</h1></header><p>x</p><footer>no</footer><header>no</header></article>").text() == "t\n\nx"
    assert html.Page("<main><p>intro</p><article><p>x</p></article><div class=related><p>no</p></div></main><p>no</p>").text() == "intro\n\nx"
    long = words("l", 80)
    assert html.Page(f'<div><div class="comments"><p>no</p></div><div class="post"><p>{long}</p><div class="share-price">b</div><div class="share">no</div></div></div>').text() == f"{long}\n\nb"


HOSTILE = {
    "open tags": "<a " * 200_000, "open quotes": '<a "x ' * 150_000, "mixed quotes": "<a \"' " * 150_000 + ">", "deep and p": "<b>" * 60_000 + "<p>x" * 60_000, "closing": "<i>" + "<b>" * 60_000 + "</u>" * 100_000,
    "lists": "<ul><li>" * 60_000 + "<li>x" * 60_000, "scoped p": "<p><div>" + "<b>" * 60_000 + "<p>y" * 60_000, "comments": "<!-- " * 200_000, "raw": "<script>" * 100_000, "signs": "<" * 1_000_000, "ends": "</ " * 300_000, "entities": "&amp" * 250_000,
    "attributes": "<div " + "a=" * 400_000 + ">x", "tables": "<table><tr><td>" * 20_000 + "<td>x" * 60_000, "quoted ends": "<a '>\">" * 140_000,
}


@pytest.mark.parametrize("name", list(HOSTILE))
def test_hostile_pages_take_time_in_proportion(name):
    began = time.process_time()
    html.Page(HOSTILE[name]).text(frozenset([1]))
    assert time.process_time() - began < 5


def test_tags_end_where_a_scan_from_each_place_says():
    rng = random.Random(8)
    for _ in range(3000):
        s = "".join(rng.choice("<a>\"' ") for _ in range(rng.randrange(30)))
        tags = html._Tags(s)
        for at in [i + 1 for i, c in enumerate(s) if c == "<"]:
            m = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>").match(s, at)
            assert tags.end(at) == (m.end() if m else s.find(">", at) + 1 or -1)


def test_joined_templates_are_those_broadcast(spark, monkeypatch):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    bare = [(i, u, re.sub(r"<(/?)(?:nav|footer|article)\b", r"<\1div", s or "").replace('class="ad"', 'class="x9"')) for i, u, s in pages]
    whole = texts(spark, bare)
    monkeypatch.setattr(html, "BROADCAST_ROWS", -1)
    assert texts(spark, bare) == whole


def test_names_that_helpers_have(spark):
    df = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>", "h", "p", "q", "r")], "page_id long, url string, html string, hashes string, _host string, _page string, text string")
    row = html.main_text(df).first().asDict()
    assert row == {"page_id": 1, "url": "http://a.b/", "hashes": "h", "_host": "p", "_page": "q", "text": "x"}
