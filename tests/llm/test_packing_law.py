"""Packing against brute force: least padding over the exact lengths, whole batches, repeated rows."""

import collections

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmap.llm import packing
from tests.llm.test_operators import brute_padding


def least_padding(lengths, buckets):
    """`brute_padding` over all pairs of borders at once."""
    values, n = np.unique(np.array(lengths), return_counts=True)
    rows, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * values)])
    cost = values[None, :] * (rows[None, 1:] - rows[:-1, None]) - (total[None, 1:] - total[:-1, None])  # of one bucket from i to j
    cost = np.where(np.arange(len(values))[:, None] <= np.arange(len(values))[None, :], cost, 1 << 60)
    best = cost[0]
    for _ in range(buckets - 1):
        best = np.minimum(best, (np.concatenate([[0], best[:-1]])[:, None] + cost).min(0))
    return best[-1]


def test_least_padding():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths, buckets = rng.integers(0, 60, rng.integers(1, 30)).tolist(), int(rng.integers(1, 6))
        assert least_padding(lengths, buckets) == brute_padding(lengths, buckets)


def check_law(rows, out, budget, buckets):
    assert sorted((str(r["id"]), r["length"]) for r in out) == sorted((str(i), n or 0) for i, n in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["bucket"], r["batch"]].append(r)
    tops = {}
    for (b, _), own in by.items():
        assert sorted(r["place"] for r in own) == list(range(len(own)))
        padded = {r["padded"] for r in own}
        assert len(padded) == 1 and (len(own) == 1 or len(own) * own[0]["padded"] <= budget)
        tops.setdefault(b, own[0]["padded"])
        assert tops[b] == own[0]["padded"]
    for b in tops:
        batches = sorted(k for x, k in by if x == b)
        assert batches == list(range(len(batches))) and len({len(by[b, k]) for k in batches[:-1]}) <= 1
    assert sum(r["padded"] - r["length"] for r in out) == least_padding([n or 0 for _, n in rows], buckets)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=60), st.integers(1, 9))
def test_borders_of_long_documents(lengths, buckets):
    values = sorted(set(lengths))
    n = np.array([lengths.count(v) for v in values], float)
    ends = packing.borders(n, n * values, np.array(values, float), buckets)
    upper = {v: values[next(e for e in ends if e >= i)] for i, v in enumerate(values)}
    assert sum(upper[v] - v for v in lengths) == brute_padding(lengths, buckets)


@pytest.mark.parametrize("seed", [1, 2])
def test_query_is_optimal_above_cells(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, int(n)) for i, n in enumerate(np.exp(rng.normal(6, 1.5, 300)))]
    check_law(rows, packing.pack(spark.createDataFrame(rows, "id long, n long"), "n", 8192, 6).collect(), 8192, 6)


def test_rows_alike_in_every_column(spark):
    rows = [(1, 7)] * 3000 + [(None, None)] * 900 + [(1, 9)] * 40 + [(i, i % 50) for i in range(600)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "id long, n long").repartition(parts)
        out = packing.pack(df, "n", 60, 4).collect()
        check_law(rows, out, 60, 4)
    assert [r["place"] for r in packing.pack(spark.createDataFrame([(1, None)], "id long, n long"), "n").collect()] == [0]


def test_names_that_helpers_have(spark):
    df = spark.createDataFrame([(i, i) for i in range(40)], "id long, n long")
    for name in ("_rows", "_cell", "_before", "_length", "_t1", "c1", "_Group"):
        df = df.withColumn(name, F.lit(name))
    out = packing.pack(df, F.col("n"), 100, 3)
    assert out.columns == [*df.columns, "length", "bucket", "padded", "batch", "place"] and out.where("_rows = '_rows' and _before = '_before' and c1 = 'c1'").count() == 40
