"""Templates of sites where articles are copied, hosts are large, and pages are short."""

import random

from strandmap.llm import html

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages):
    df = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], SCHEMA)
    return {r["page_id"]: r["text"] for r in html.main_text(df).collect()}


def words(seed, n=30):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(5000)], k=n))


def test_boxes_of_copied_articles_stay(spark):
    boxes = "<ul><li>one</li><li>two</li></ul><table><tr><td>cell</td></tr></table><section><p>of a section</p></section><figure><figcaption>drawn</figcaption></figure>"
    article = f"<article><h1>t</h1><p>{words('a')}</p>{boxes}</article>"
    share = "<div><p>read this too</p></div>"
    copies = [f"<title>{i}</title><p>seen {i}</p>{article.replace('</article>', f'<div class=comments>{i}</div></article>')}" for i in range(4)]
    got = texts(spark, copies + [f"<article><p>{words(i)}</p>{share}</article>" for i in range(8)])
    assert {got[i] for i in range(4)} == {f"t\n\n{words('a')}\n\none\n\ntwo\n\ncell\n\nof a section\n\ndrawn"}
    assert all(got[4 + i] == words(i) for i in range(8))  # what recurs under different articles is a template


def test_templates_of_large_hosts(spark):
    menu = "<div><p>all of this section</p></div>"
    pages = [(menu if i < 20 else "") + f"<div><p>{words(i)}</p></div>" for i in range(200)]
    cells = [f"<table><tr><td>yes</td><td>{words(1000 + i)}</td></tr></table>" for i in range(5)]
    got = texts(spark, pages + cells + [menu + "<p>brief</p>"])
    assert all(got[i] == words(i) for i in range(200))
    assert all(got[200 + i] == f"yes\n\n{words(1000 + i)}" for i in range(5)) and got[205] == "brief"


def test_copies_of_a_page_are_one_content(spark):
    page = f"<div><p>{words('p')}</p></div><div><p>{words('q')}</p></div>"
    assert set(texts(spark, [f"<title>{i}</title>{page}" for i in range(5)]).values()) == {f"{words('p')}\n\n{words('q')}"}
