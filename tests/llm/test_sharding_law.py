"""Sharding against a brute-force count of its law, with rows that are alike in every column."""

import collections

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandmap.llm import sharding


def size(text):
    return len((text or "").encode()) + 16


def check_law(rows, out, shards, tolerance=0.01):
    """rows: (doc_id, text, ...); out: the sharded frame.  Every row is there once, slots are gapless, sizes near equal."""
    assert sorted(zip(out.doc_id.fillna(-1), out.text.fillna("~"), strict=True)) == sorted((-1 if r[0] is None else r[0], "~" if r[1] is None else r[1]) for r in rows)
    assert all(s == size(None if t is None or t != t else t) for s, t in zip(out["size"], out.text, strict=True))
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    total, longest = int(out["size"].sum()), int(out["size"].max())
    own = collections.Counter()
    for k, s in zip(out.shard, out["size"], strict=True):
        own[k] += s
    assert set(own) <= set(range(shards))
    # Each of a shard's two borders misses its place by the tolerance or by one row at most.
    assert all(abs(own[k] - total / shards) <= 2 * max(tolerance * total / shards, longest) for k in range(shards))


@pytest.mark.parametrize(("n", "shards", "ranges"), [(400, 4, 16), (401, 4, 1), (3, 7, 2), (1000, 40, 16)])
def test_rows_alike_in_every_column_are_split(spark, n, shards, ranges):
    rows = [(1, "a", "c")] * n
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard string"), shards=shards, ranges=ranges).toPandas()
    check_law(rows, out, shards)
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1


def test_ties_beside_others(spark):
    rows = [(1, "tie", [1, None])] * 700 + [(1, "tie", [None, 1])] * 650 + [(None, None, None)] * 500 + [(i, "w" * (i % 90), [i]) for i in range(1500)] + [(i, "same", None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags array<int>").repartition(5)
    out = sharding.shard(df, shards=9, ranges=4).toPandas()
    check_law(rows, out, 9)
    tags = collections.Counter(str(None if t is None else [None if x is None or x != x else int(x) for x in t]) for t in out.tags)
    assert tags == collections.Counter(str(r[2]) for r in rows)  # nulls in different places are different rows
    key = ["shard", "slot"]
    again = sharding.shard(df.repartition(3), shards=9, ranges=4).toPandas()
    pick = lambda o: o.sort_values(key)[[*key, "doc_id", "text"]].reset_index(drop=True)
    pd.testing.assert_frame_equal(pick(out), pick(again))


def test_few_probes_find_the_same_law(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PROBES", 64)
    rows = [(i, "x" * (i * i % 300)) for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=11, ranges=4).toPandas()
    check_law(rows, out, 11)


def test_names_that_helpers_have(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    for name in ("_size", "_top", "_k1", "_range", "_row", "c0", "_Before"):
        df = df.withColumn(name, F.lit(name))
    df = df.withColumn("a.b c", F.lit("q")).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    out = sharding.shard(df, shards=3)
    assert out.columns == [*df.columns, "size", "shard", "slot"] and out.count() == 50
    assert out.where("`_Before` = '_Before' and c0 = 'c0' and `a.b c` = 'q' and m['k'] = doc_id").count() == 50
