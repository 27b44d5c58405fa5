"""HTML extraction, embedding near-duplicates, quality, the queries and the pipeline."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandmap.llm import hnsw, html, quality

SF = "/root/testdata/sf0.001"

# --- HTML ---

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="header-fixed">
<header>no</header><nav><ul><li><a href="/x">no</a></li></ul></nav><div class="ad">no</div><div id="cookie-consent">no</div>
<article class="post comments-open"><h1>One &amp; two</h1><p>a <b>b<br>c</b>  d&nbsp;e<p>f&lt;g<!-- no <p>no</p> --><div>h<ul><li>i<li>j</ul></div>
<div class="comments"><p>no</p></div><form><p>no</p></form><aside>no</aside></article><footer>no"""


def test_main_text():
    assert html.Page(PAGE).text() == "One & two\n\na b c d e\n\nf<g\n\nh\n\ni\n\nj"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("plain &amp text", "plain & text"), ("<p>a</p>b<p>c", "a\n\nb\n\nc"), ("<main><p>m</p></main><p>no</p>", "m"), ("<p hidden>no</p><div role=navigation>no</div>x", "x"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<script>if (a<b) x</script>y", "y"), ("<script>never closed", ""), ("a<br>b", "a b"), ("a<!-- open", "a"), ("<p>a < b</p>", "a < b"),
        ("<textarea><p>no</p></textarea>z", "z"), ("</div></p>q", "q"), ("<ARTICLE><P>U</ARTICLE>", "U"), ("<article></article><p>x</p>", "x"), ("<pre>a\n  b</pre>", "a b"), ("<svg><p>no</p></svg>k", "k"),
        ('<a title="x>y">l</a>', "l"), ('<div class="siteFooter">no</div><div id="SITE_NAV">no</div><div class="added shadow">k</div>', "k"),
    ],
)
def test_fragments(source, text):
    assert html.Page(source).text() == text


def test_site_templates_are_removed(spark):
    furniture = '<div class="x1"><p>Call us on 555</p></div>'
    rows = [(i, f"http://Site.org/{i}", f"{furniture}<div><p>own text of page {i} that goes on</p><p>second block {i}</p></div><p>Legal lines</p>") for i in range(8)]
    rows += [(100 + i, "http://rare.org/", furniture + "<p>once and then some more words</p>") for i in range(2)] + [(200, None, None), (201, "http://Site.org/9", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert got[3] == "own text of page 3 that goes on\n\nsecond block 3"
    assert got[100] == "Call us on 555\n\nonce and then some more words" and got[200] == got[201] == ""
    assert html.main_text(df.limit(0)).count() == 0


def test_articles_on_many_pages_stay(spark):
    rows = [(i, "http://h.org/", "<nav>n</nav><article><p>the same article</p><p>quoted</p></article>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html.main_text(df).collect()} == {"the same article\n\nquoted"}


# --- embeddings ---


def brute_links(rows, threshold):
    ok = [(i, lab, np.array(v, float)) for i, lab, v in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, a, v in ok:
        for j, b, w in ok:
            if i != j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i].add(j)
    component = {}
    for i in sorted(links):
        if i not in component:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in component:
                    component[x] = i
                    todo += links[x]
    return {i: (len(s), component[i]) for i, s in links.items()}


@pytest.mark.parametrize(("shard", "queries"), [(16_384, 65_536), (60, 100)])
def test_embeddings(spark, monkeypatch, shard, queries):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    monkeypatch.setattr(hnsw, "QUERIES", queries)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    v = np.concatenate([base.repeat(6, 0) + 0.04 * rng.normal(size=(240, 16)), base[:5].repeat(20, 0), rng.normal(size=(60, 16)), 3 * base[:4]]).astype(np.float32)
    rows = [(int(i), int(i) % 2, x.tolist()) for i, x in enumerate(v)]
    rows += [(900, None, v[0].tolist()), (901, 0, [0.0] * 16), (902, 0, None), (903, 0, [float("nan")] * 16), (904, 0, [None] + [1.0] * 15), (905, 0, [1.0, 2.0]), (906, 0, [2.0, 4.0]), (907, 1, []), (908, 0, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component"]) for r in hnsw.near_duplicates(df).collect()}
    assert got == brute_links(rows, 0.98)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    g = hnsw.Graph(v)
    ids, sims = g.search(v[:300], 64)
    exact = np.argsort(-(v[:300] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, exact, strict=True)]) > 0.9 and (np.diff(sims, axis=1) <= 1e-6).all()


def test_dense_groups_are_found_whole():
    rng = np.random.default_rng(3)
    v = np.concatenate([np.ones((400, 12)) + 0.02 * rng.normal(size=(400, 12)), rng.normal(size=(900, 12))])
    s = hnsw.Shard(v, 0.98)
    found = s.links(v)
    cos = (v @ v.T) / (s.norm[:, None] * s.norm) >= 0.98
    assert sum(map(len, found)) >= 0.98 * cos.sum() and all(cos[i, x].all() for i, x in enumerate(found))


# --- quality ---


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, quality.training_rows(labels))
    got = quality.score(docs, model).select("doc_id", "score").toPandas().merge(labels.toPandas())
    held = got[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)]
    good = held[held.quality == 1].score >= 0.3
    bad = held[held.quality == 0].score < 0.3
    assert len(held) > 50 and good.mean() > 0.97 and bad.mean() > 0.9 and got.score.between(0, 1).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words in a line", 0.5), (2, "BAD!! BAD!! BAD!!", 0.5), (3, None, 0.5), (4, "", 0.5), (5, "more good words here", 0.5), (None, "x", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (5, None), (77, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert got[5] > 0.6 and got[2] < 0.1 and got[3] == got[4] == pytest.approx(1 / 3)
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


# --- queries and pipeline ---


def test_queries_have_their_columns(spark):
    from strandmap.llm import queries as q

    columns = {
        "op1": ["doc_id", "fingerprint", "component_id"], "op2": ["page_id", "host", "path", "rule", "verdict"], "op3": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op4": ["doc_id", "held_out", "score", "predicted"], "op6": ["doc_id", "start", "n_tokens", "ids_crc32"], "op8": ["vec_id", "n_links", "component_id", "kept"],
        "op7": ["doc_id", "n_bytes", "payload_bytes", "tail_crc32", "payload_sha256", "media_bytes", "media_sha256", "feature"], "op9": ["doc_id", "size", "source_size", "target", "taken"], "op10": ["page_id", "url", "text", "n_chars"],
    }
    for name, f in q.queries().items():
        out = f(spark, SF)
        assert set(columns.get(name.split("_")[0], out.columns)) == set(out.columns), name
        table = {"op2": "pages", "op10": "pages", "op8": "embeddings"}.get(name.split("_")[0], "documents")
        assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count(), name


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs.toPandas()]
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        tables.append(docs.toPandas())
        docs = spark.createDataFrame(tables[-1])
    assert all(list(t.columns) == list(tables[0].columns) for t in tables[:-1])
    rejected = set(tables[0].doc_id) - set(tables[1].doc_id)
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    known = labels.reindex(sorted(rejected)).dropna()
    assert rejected and (known == 0).all()
    assert set(tables[2].doc_id) <= set(tables[1].doc_id) and tables[2].text.is_unique and set(tables[1].text) >= set(tables[2].text)
    words = lambda t: t.text.str.split().str.len()
    assert abs(words(tables[3]).sum() / words(tables[2]).sum() - 1.5) < 0.1
    assert len(tables[4]) == len(tables[3]) and C.ORACLE_SQL is None


def test_pipeline_stages_with_odd_rows(spark):
    import corpus_pipeline as C

    rows = [(1, "a b c", "en", "s", 5), (None, "a b c", None, None, None), (2, None, "en", "s", 0), (3, "", None, "s", 0), (1, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [tuple(r) for r in C.stage_dedup(spark, docs, SF).collect()]
    assert sorted(r[0] for r in out if r[0] is not None) == [1, 2] and len(out) == 3
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, docs, SF).collect()
