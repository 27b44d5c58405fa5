"""Embedding near-duplicates over several shards, repeated ids, dense groups and the driver's table, against brute force."""

import numpy as np
import pytest

from strandmap.llm import hnsw
from tests.llm.test_models import brute_links


def test_repeated_ids_are_vectors_of_their_own(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [1.0, 0.01])], "vec_id long, label int, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"], r["component"]) for r in hnsw.near_duplicates(df).collect()) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_null_ids_and_equal_rows(spark):
    rows = [(None, "a", [1.0, 0.0]), (5, "a", [1.0, 0.0]), (5, "a", [1.0, 0.0]), (None, "b", [0.0, 3.0]), (None, "b", [0.0, 1.0]), (9, "", [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label string, embedding array<float>, component string, node int")
    out = sorted(((r["vec_id"], r["n_links"], r["component"]) for r in hnsw.near_duplicates(df).collect()), key=str)
    assert out == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 1, None), (None, 1, None), (9, 0, 9)], key=str)


@pytest.mark.parametrize(("shard", "size"), [(50, 1 << 30), (65_536, 16 * 4 * 90), (700, 1 << 30)])
def test_many_shards_find_what_one_finds(spark, monkeypatch, shard, size):
    monkeypatch.setattr(hnsw, "SHARD", shard)
    monkeypatch.setattr(hnsw, "SHARD_BYTES", size)
    monkeypatch.setattr(hnsw, "QUERIES", 3 * shard)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    v = np.concatenate([base.repeat(5, 0) + 0.05 * rng.normal(size=(200, 16)), base[:1].repeat(400, 0) + 0.06 * rng.normal(size=(400, 16)), base[:3].repeat(9, 0), rng.normal(size=(60, 16))]).astype(np.float32)
    rows = [(int(i), int(i) % 2, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component"]) for r in hnsw.near_duplicates(df).collect()}
    want = brute_links(rows, 0.98)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.99


def test_both_ends_count_a_link(monkeypatch):
    """A search that misses half of what it should find still gives equal counts at both ends."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(300, 12))
    v[150:] = v[:150] + 0.001 * rng.normal(size=(150, 12))
    tried = hnsw.Shard.tried

    def half(self, q, norm, beam):
        i, j, full = tried(self, q, norm, beam)
        keep = (i + j) % 2 == 0
        return i[keep & (q[i][:, 0] > 0)], j[keep & (q[i][:, 0] > 0)], full

    monkeypatch.setattr(hnsw, "AUDIT", 0)
    monkeypatch.setattr(hnsw.Shard, "tried", half)
    one = np.ones(300, np.int64)
    s = hnsw.Shard(v, 0.98)
    counts, _, of = hnsw.between(s, None, one, one)
    linked = np.flatnonzero(counts)
    assert len(linked) and all(counts[i] == counts[(i + 150) % 300] for i in linked) and (of[linked] == linked % 150).all()
    a, b = hnsw.Shard(v[:150], 0.98), hnsw.Shard(v[150:], 0.98)
    ca, cb, _ = hnsw.between(a, b, one[:150], one[150:])
    assert ca.sum() and (ca == cb).all()


def test_recall_on_the_table(spark):
    """Every vector of the table and near copies of each, from one to forty of them: recall against brute force."""
    rng = np.random.default_rng(7)
    table = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    rows = list(table)
    for i, label, v in table:
        if v is not None and label is not None:
            v = np.array(v, float)
            for k in range(40 if i % 200 == 0 else 1):
                noise = rng.normal(size=len(v))
                near = v + noise * np.linalg.norm(v) / np.linalg.norm(noise) * rng.uniform(0.01, 0.22)
                rows.append((10_000_000 + 100 * i + k, label, near.astype(np.float32).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in hnsw.near_duplicates(df).collect()}
    found = want = 0
    for label in {r[1] for r in rows if r[1] is not None}:
        own = [(i, np.array(v, float)) for i, l, v in rows if l == label and v is not None and any(v)]
        v = np.array([x for _, x in own])
        v /= np.linalg.norm(v, axis=1)[:, None]
        exact = (v @ v.T >= 0.98).sum(1) - 1
        found, want = found + sum(got[i] for i, _ in own), want + exact.sum()
        assert all(got[i] <= n for (i, _), n in zip(own, exact, strict=True))
    assert want > 3000 and found >= 0.98 * want
