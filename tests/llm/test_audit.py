"""The audit of op8's beam where one group is hot."""

import numpy as np

from strandmap.llm import hnsw


def test_small_groups_beside_a_hot_one(monkeypatch):
    """The narrow beam misses all links of small groups; the hot group's links don't hide that."""
    rng = np.random.default_rng(9)
    hot = np.ones((1500, 12)) + 0.02 * rng.normal(size=(1500, 12))
    small = np.repeat(rng.normal(size=(300, 12)), 2, 0) + 0.001 * rng.normal(size=(600, 12))
    s = hnsw.Shard(np.concatenate([hot, small]), 0.98)
    search = hnsw.Shard._search

    def poor(self, q, norm, beam):
        found = search(self, q, norm, len(self.v))
        return found if beam > s.first else [f if len(f) > beam else f[(self.v[f] == x).all(1)] for f, x in zip(found, q, strict=True)]

    s.first = s.beam
    monkeypatch.setattr(hnsw.Shard, "_search", poor)
    found = s.links(s.v)
    assert s.beam > s.first and all(len(f) >= 2 for f in found[1500:])


def test_own_vectors_are_no_links(monkeypatch):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(1500, 12))
    v[1100:] = v[700:1100] + 0.001 * rng.normal(size=(400, 12))
    s = hnsw.Shard(v, 0.98)
    beam, search = s.beam, hnsw.Shard._search
    monkeypatch.setattr(hnsw.Shard, "_search", lambda self, q, norm, b: search(self, q, norm, b) if b > beam else [f[(self.v[f] == x).all(1)] for f, x in zip(search(self, q, norm, b), q, strict=True)])
    assert sum(map(len, s.links(v[:700]))) == 700 and s.beam == beam  # none of these has a link
    assert sum(map(len, s.links(v[700:]))) >= 1600 * 0.98 and s.beam > beam
