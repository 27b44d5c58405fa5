"""Which rows the classifier learns from, and what it makes of odd ones, against a brute-force vote."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strandmap.llm import quality

GOOD, BAD = "the quiet river runs past the old mill and the green field", "BUY NOW!!! $$$ click click 100% FREE $$$"


def corpus(spark, n=60):
    rows = [(i, (GOOD if i % 2 else BAD) + f" w{i} w{i * 7}") for i in range(n)] + [(None, GOOD), (7, "other text of id seven"), (7, GOOD), (8, None), (900, ""), (901, "long words " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "_id": F.lit("x"), "label": F.lit("y")})
    labels = [(i, i % 2) for i in range(n // 2)] * 2 + [(None, 1), (5, None), (4, 1), (12345, 1)]
    return rows, docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_labelled_rows_are_bounded_and_whole(spark):
    rows, docs, labels = corpus(spark)
    m = quality.fit(docs, labels)
    assert len(m.labels) == 61  # 30 ids twice, one of them with both labels; documents of id 7 once
    assert len(quality.fit(docs, labels, sample=10).labels) == 10
    hot = docs.unionByName(docs.where("doc_id = 7").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("k"))
    assert len(quality.fit(hot, labels).labels) == 61
    assert quality.fit(docs, labels.limit(0)).score(np.zeros((2, quality.TERMS))).tolist() == [0.5, 0.5]


def test_votes_are_those_of_brute_force(spark):
    rows, docs, labels = corpus(spark)
    m = quality.fit(docs, labels)
    out = quality.score(docs, m).collect()
    assert len(out) == len(rows) and out[0].asDict()["_id"] == "x" and quality.score(docs.limit(0), m).count() == 0
    for r in out:
        c = quality.counts(*text_columns(r["text"]))
        v = quality.weigh(c, m.idf)[0] @ m.basis
        if not np.linalg.norm(v):
            assert r["score"] == m.labels.mean()
            continue
        cos = m.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cos, kind="stable")[: quality.NEIGHBOURS]
        w = np.maximum(cos[near].astype(float), 0) ** 8
        assert abs(r["score"] - (w * m.labels[near]).sum() / w.sum()) < 1e-3
    by = {r["doc_id"]: r["score"] for r in out}
    assert min(by[i] for i in range(31, 60, 2)) > max(by[i] for i in range(32, 60, 2))


def text_columns(text):
    raw = np.frombuffer((text or "").encode() + b" ", np.uint8)
    return raw[:-1], np.array([0, len(raw) - 1])


def test_document_frequencies_count_every_document(spark):
    rows, docs, _ = corpus(spark)
    df, n = quality.document_frequencies(docs, "text")
    assert n == len(rows)
    term = quality.SHAPES + xxhash.xxh64_intdigest(b"river", quality_seed()) % (quality.TERMS - quality.SHAPES - 1)
    assert df[term] >= sum("river" in (t or "") for _, t in rows)


def quality_seed():
    """The seed of the hash of words, read off the hash itself."""
    from strandmap.llm.textscan import xxh64

    got = xxh64(np.frombuffer(b"river" + b" " * 16, np.uint8), np.array([0]), np.array([5]))[0]
    return next(s for s in range(100) if xxhash.xxh64_intdigest(b"river", s) == int(got))


def test_short_texts_are_counted_in_bounded_blocks(monkeypatch):
    import pyarrow as pa

    texts = pa.array([f"w{i} x" if i % 7 else None for i in range(5000)])
    whole = {lo: c for lo, _, c in quality._blocks(texts)}
    assert max(len(c) for c in whole.values()) <= quality.HELD and sum(map(len, whole.values())) == 5000
    monkeypatch.setattr(quality, "HELD", 1 << 30)
    (one,) = [c for _, _, c in quality._blocks(texts)]
    assert (np.concatenate([whole[lo] for lo in sorted(whole)]) == one).all()
