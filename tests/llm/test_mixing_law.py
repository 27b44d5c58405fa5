"""Mixing against a brute-force count of its law."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap.llm import mixing
from strandmap.llm.shared import word_count


def check_law(rows, out, weights=(3, 1, 2), share=1.5, most=2.0):
    """rows: (id, source, size); every row is there, copies stay within bounds, each source misses its target by one document at most."""
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n or 0
    goal = mixing.targets(dict(sizes), weights, share, most)
    got, longest = collections.Counter(), collections.Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) and 0 <= r["copies"] <= -(-most // 1)
        got[r["source"]] += r["copies"] * r["size"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(got[s] - goal[s]) <= longest[s] + 1e-6


def mixed(spark, rows, **options):
    return mixing.mix(spark.createDataFrame(rows, "id long, source string, n long").repartition(3), F.col("n"), **options).collect()


def test_many_sources(spark):
    rng = np.random.default_rng(1)
    names = [None, "", "Z", "a", "é", "\U0001f600", "￿", *[f"s{i:03d}" for i in range(150)]]
    rows = [(i, names[int(k)], int(n)) for i, (k, n) in enumerate(zip(rng.zipf(1.3, 5000) % len(names), rng.integers(0, 300, 5000), strict=True))]
    out = mixed(spark, rows)
    check_law(rows, out)
    key = lambda o: sorted((r["id"], r["copies"]) for r in o)
    assert key(out) == key(mixed(spark, rows[::-1]))
    check_law(rows, mixed(spark, rows, weights=(0, 5), share=0.7, most=1.0), (0, 5), 0.7, 1.0)


def test_rows_alike_in_every_column(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 7)
    rows = [(1, "a", 10)] * 400 + [(i, "a", 10) for i in range(50)] + [(2, "b", 3)] * 100 + [(None, None, None)] * 5 + [(7, None, 4)] * 3
    check_law(rows, mixed(spark, rows))


def test_no_weight_and_no_words(spark):
    assert {r["copies"] for r in mixed(spark, [(1, "a", 5), (2, "b", 6)], weights=(0,))} == {0}
    out = mixed(spark, [(1, "a", 0), (2, None, None)])
    assert [(r["copies"], r["target"]) for r in out] == [(0, 0.0)] * 2 and mixed(spark, []) == []


def test_names_that_helpers_have_and_long_rows(spark):
    df = spark.createDataFrame([(i, "x " * (200_000 if i == 3 else i), "s") for i in range(20)], "id long, text string, source string")
    for name in ("_size", "_rank", "_part", "_group", "_t1", "c0", "_up", "_Count"):
        df = df.withColumn(name, F.lit(name))
    df = df.withColumn("tags", F.array(F.lit(None).cast("int"), F.lit(1)))
    out = mixing.mix(df, word_count(F.col("text")))
    assert out.columns == [*df.columns, "size", "source_size", "target", "copies"]
    assert out.where("_rank = '_rank' and _part = '_part' and `_Count` = '_Count'").count() == 20 and out.where("id = 3").first()["size"] == 200_000
