"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Equal vectors of a label are one node.  Nodes of a label are dealt into shards by hash.  A task builds the graph of one
shard once (Malkov and Yashunin, "Efficient and Robust Approximate Nearest Neighbor Search Using Hierarchical Navigable
Small World Graphs", 2016), links its members with each other, and, where the label has further shards, stores it in the
shared folder.  Then each two shards of a label are loaded by a task and ask each other.  Answers are audited on a sample
against brute force and the beam is widened until the audit passes.  A query whose whole beam is within the threshold is
asked again with a wider one, in the end of the whole shard, so there is no cap on links.  Links are verified by cosine in
double precision, counted for both of their ends, whichever of them found the other, and contracted to components.
Building and searching handle many nodes at a time with numpy.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.llm.components import Forest, components, forest
from strandmap.llm.shared import cut, get, map_arrow, own_folder, partitions, put

#: Vectors in a shard, and their bytes; the lesser counts.  A task holds two shards.
SHARD, SHARD_BYTES = 65_536, 32 << 20
#: Vectors that one task asks of a stored shard, in whole shards of them.
QUERIES = 262_144
#: Neighbours of a node above level 0 (twice as many there), and beams to build and to start searching with.
M, BUILD_BEAM, BEAM = 12, 48, 64
#: Queries checked by brute force for each graph, and the recall they must reach.
AUDIT, RECALL = 64, 0.99
#: Labels up to this many have their shard counts broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
_Q = 256


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row, best first."""
    if sims.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return np.take_along_axis(at, np.argsort(-np.take_along_axis(sims, at, 1), axis=1, kind="stable"), 1)
    return np.argsort(-sims, axis=1, kind="stable")


class Graph:
    """A graph over unit row vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 7, stored: dict[str, np.ndarray] | None = None):
        self.v = np.ascontiguousarray(vectors, np.float32)
        if stored is not None:
            self.top, self.order = int(stored["top"]), stored["order"]
            self.near = [stored[f"near{l}"] for l in range(self.top + 1)]
            return
        n = len(self.v)
        level = np.minimum((-np.log(1.0 - np.random.default_rng(seed).random(n)) / np.log(M)).astype(int), 6)
        self.level = level
        self.top = int(level.max()) if n else 0
        self.order = np.argsort(-level, kind="stable")
        self.near = [np.full((n, 2 * M if l == 0 else M), -1, np.int32) for l in range(self.top + 1)]
        self.far = [np.full(x.shape, -2.0, np.float32) for x in self.near]  # similarity of each neighbour
        self.size = 0
        while self.size < n:
            self._insert(self.order[self.size : self.size + max(32, min(512, self.size))])

    def _insert(self, new: np.ndarray) -> None:
        q = self.v[new]
        entry = np.full((len(new), 1), self.order[0])
        own = q @ q.T
        np.fill_diagonal(own, -2.0)
        for l in range(self.top, -1, -1):
            here = np.flatnonzero(self.level[new] >= l)
            ids = np.zeros((len(new), 0), np.int64)
            sims = np.zeros((len(new), 0), np.float32)
            if self.size:
                ids, sims = self._layer(q, entry, BUILD_BEAM if len(here) else 1, l)
                entry = np.where(ids[:, :4] >= 0, ids[:, :4], self.order[0])
            if not len(here):
                continue
            k = min(2 * M, len(here))
            mates = own[np.ix_(here, here)]
            at = _top(mates, mates, k)
            ids = np.concatenate([ids[here], new[here][at]], 1)
            sims = np.concatenate([sims[here], np.take_along_axis(mates, at, 1)], 1)
            self._connect(l, new[here], ids, sims)
        self.size += len(new)

    def _connect(self, l: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        degree = self.near[l].shape[1]
        chosen, best = self._select(ids, sims, M)
        self.near[l][nodes, : chosen.shape[1]] = chosen
        self.far[l][nodes, : chosen.shape[1]] = best
        # The way back: each chosen node gets the new ones too, and keeps the most diverse of all.
        a, b, s = np.repeat(nodes, chosen.shape[1]), chosen.ravel(), best.ravel()
        ok = b >= 0
        a, b, s = a[ok], b[ok], s[ok]
        by = np.lexsort((-s, b))
        a, b, s = a[by], b[by], s[by]
        first = np.concatenate([[True], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        rank = np.arange(len(b)) - np.repeat(start, np.diff(np.append(start, len(b))))
        keep = rank < degree
        targets, row = b[start], np.cumsum(first)[keep] - 1
        more = np.full((len(targets), degree), -1, np.int64)
        more_s = np.full((len(targets), degree), -2.0, np.float32)
        more[row, rank[keep]], more_s[row, rank[keep]] = a[keep], s[keep]
        ids = np.concatenate([self.near[l][targets], more], 1)
        sims = np.concatenate([self.far[l][targets], more_s], 1)
        for lo in range(0, len(targets), _Q):
            c, cs = self._select(ids[lo : lo + _Q], sims[lo : lo + _Q], degree)
            t = targets[lo : lo + _Q]
            self.near[l][t], self.far[l][t] = -1, -2.0
            self.near[l][t, : c.shape[1]], self.far[l][t, : c.shape[1]] = c, cs

    def _select(self, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row up to k neighbours: first those nearer to the node than to any chosen before, then the nearest others."""
        out, out_s = [], []
        for lo in range(0, len(ids), _Q):
            i, s = ids[lo : lo + _Q], sims[lo : lo + _Q].copy()
            s[i < 0] = -2.0
            by = np.lexsort((i, -s), axis=1)
            i, s = np.take_along_axis(i, by, 1), np.take_along_axis(s, by, 1)
            s[:, 1:][(i[:, 1:] == i[:, :-1])] = -2.0  # repeated ones
            by = _top(i, s, min(2 * k, s.shape[1]))
            i, s = np.take_along_axis(i, by, 1), np.take_along_axis(s, by, 1)
            v = self.v[np.maximum(i, 0)]
            pair = v @ v.transpose(0, 2, 1)
            good = np.zeros(i.shape, bool)
            for c in range(i.shape[1]):
                blocked = (good[:, :c] & (pair[:, c, :c] > s[:, c, None])).any(1)
                good[:, c] = ~blocked & (s[:, c] > -2.0) & (good.sum(1) < k)
            by = np.argsort(~good, axis=1, kind="stable")[:, :k]
            i, s = np.take_along_axis(i, by, 1), np.take_along_axis(s, by, 1)
            out.append(np.where(s > -2.0, i, -1))
            out_s.append(s)
        return np.concatenate(out), np.concatenate(out_s)

    def _layer(self, q: np.ndarray, entry: np.ndarray, beam: int, l: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes that each query meets at level l, best first; -1 where there are fewer."""
        out = [self._beam(q[lo : lo + _Q], entry[lo : lo + _Q], beam, l) for lo in range(0, len(q), _Q)]
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def _beam(self, q, entry, beam, l):
        n = len(q)
        seen = np.zeros((n, len(self.v) + 1), bool)
        seen[:, -1] = True  # -1 ends up here
        rows = np.arange(n)[:, None]
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2.0, np.float32)
        done = np.ones((n, beam), bool)

        def meet(at, new):
            """Add unseen nodes to the beams of the queries ``at``."""
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.where(seen[at[:, None], new], -1, new)
            seen[at[:, None], new] = True
            s = np.matmul(self.v[np.maximum(new, 0)], q[at][:, :, None])[:, :, 0]
            s[new < 0] = -2.0
            all_i, all_s = np.concatenate([ids[at], new], 1), np.concatenate([sims[at], s], 1)
            all_d = np.concatenate([done[at], new < 0], 1)
            by = _top(all_i, all_s, beam)
            ids[at], sims[at], done[at] = (np.take_along_axis(x, by, 1) for x in (all_i, all_s, all_d))

        meet(np.arange(n), entry.astype(np.int64))
        wide = 4 if beam > 8 else 1
        while True:
            at = np.flatnonzero(~done.all(1))
            if not len(at):
                return ids, sims
            pick = np.argsort(done[at], axis=1, kind="stable")[:, :wide]
            taken = np.where(np.take_along_axis(done[at], pick, 1), -1, np.take_along_axis(ids[at], pick, 1))
            d = done[at]
            np.put_along_axis(d, pick, True, 1)
            done[at] = d
            found = np.where(taken[:, :, None] >= 0, self.near[l][np.maximum(taken, 0)], -1).reshape(len(at), -1)
            meet(at, found.astype(np.int64))

    def arrays(self) -> dict[str, np.ndarray]:
        """What searching needs beside the vectors."""
        return {"top": np.array(self.top), "order": self.order} | {f"near{l}": x for l, x in enumerate(self.near)}

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best ``beam`` nodes found for each query."""
        q = np.ascontiguousarray(q, np.float32)
        entry = np.full((len(q), 1), self.order[0])
        for l in range(self.top, 0, -1):
            ids, _ = self._layer(q, entry, 4, l)
            entry = np.where(ids >= 0, ids, self.order[0])
        return self._layer(q, entry, min(beam, len(self.v)), 0)


class Shard:
    """A graph with exact vectors, asked for all links of a query."""

    def __init__(self, vectors: np.ndarray, threshold: float, stored: dict[str, np.ndarray] | None = None):
        norm = np.linalg.norm(vectors.astype(float), axis=1)
        self.v, self.norm, self.threshold = vectors, norm, threshold
        self.graph = Graph(vectors / norm[:, None], stored=stored)
        self.beam, self.audited = min(BEAM, len(vectors)), 0
        if stored is not None:
            self.beam = int(stored["beam"])
        #: What a similarity in single precision may be off by.
        self.off = max(1e-4, vectors.shape[1] * 2.0**-23)

    def _wider(self, beam: int) -> int:
        """Four times the beam; the whole shard once that is cheaper."""
        return 4 * beam if 4 * beam <= len(self.v) // 32 else len(self.v)

    def _exact(self, q: np.ndarray, norm: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Cosines of queries i with members j in double precision."""
        out = np.empty(len(i))
        for lo in range(0, len(i), 1 << 16):
            a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            out[lo : lo + (1 << 16)] = np.einsum("kd,kd->k", q[a].astype(float), self.v[b].astype(float)) / (norm[a] * self.norm[b])
        return out

    def scan(self, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Whether each query and each member are linked: (queries, members), for few queries at a time."""
        near = (q / norm[:, None]).astype(np.float32) @ self.graph.v.T
        linked = near >= self.threshold + self.off
        i, j = np.nonzero((near >= self.threshold - self.off) & ~linked)
        ok = self._exact(q, norm, i, j) >= self.threshold
        linked[i[ok], j[ok]] = True
        return linked

    def tried(self, q: np.ndarray, norm: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, members) of the links found by beams, and the queries that every beam was too narrow for."""
        at, to, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(q))
        while len(todo) and beam < len(self.v):
            ids, sims = self.graph.search(q[todo] / norm[todo, None], beam)
            full = sims[:, -1] >= self.threshold - self.off
            r, c = np.nonzero((sims >= self.threshold - self.off) & (ids >= 0) & ~full[:, None])
            i, j = todo[r], ids[r, c].astype(np.int64)
            ok = self._exact(q, norm, i, j) >= self.threshold
            at.append(i[ok])
            to.append(j[ok])
            todo, beam = todo[full], self._wider(beam)
        return np.concatenate(at), np.concatenate(to), todo

    def _search(self, q: np.ndarray, norm: np.ndarray, beam: int) -> list[np.ndarray]:
        i, j, todo = self.tried(q, norm, beam)
        order = np.argsort(i, kind="stable")
        ends = np.searchsorted(i[order], np.arange(1, len(q)))
        out = np.split(j[order], ends) if len(q) else []
        for lo in range(0, len(todo), _Q):
            part = todo[lo : lo + _Q]
            for t, row in zip(part, self.scan(q[part], norm[part]), strict=True):
                out[t] = np.flatnonzero(row)
        return out

    def _audit(self, q: np.ndarray, norm: np.ndarray) -> None:
        """Widen the beam until the mean share of its links that a query finds is RECALL.

        A query's own vector is no link here, and queries whose links fill the beam, which are searched again with a
        wider one anyway, say nothing.  Further queries are drawn where those drawn have no links.
        """
        drawn = np.random.default_rng(len(q)).permutation(len(q))[: 8 * AUDIT]
        at: list[int] = []
        links: list[np.ndarray] = []
        for lo in range(0, len(drawn), AUDIT):
            part = drawn[lo : lo + AUDIT]
            for t, c in zip(part, self.scan(q[part], norm[part]), strict=True):
                near = np.flatnonzero(c)
                others = near[~(self.v[near] == q[t]).all(1)]
                if len(others) and len(near) < self.beam:
                    at.append(t)
                    links.append(others)
            if self.audited + len(at) >= AUDIT:
                break
        self.audited += len(at)
        while at and self.beam < len(self.v):
            found = self._search(q[at], norm[at], self.beam)
            if np.mean([np.isin(want, got).mean() for want, got in zip(links, found, strict=True)]) >= RECALL:
                break
            self.beam = self._wider(self.beam)

    def ready(self, q: np.ndarray, norm: np.ndarray) -> None:
        """Audit the beam on these queries, unless enough have been audited."""
        if self.audited < AUDIT and self.beam < len(self.v):
            self._audit(q, norm)

    def links(self, q: np.ndarray) -> list[np.ndarray]:
        """Members within the threshold of each query, itself included where it is one."""
        norm = np.linalg.norm(q.astype(float), axis=1)
        self.ready(q, norm)
        return [x for lo in range(0, len(q), 4 * _Q) for x in self._search(q[lo : lo + 4 * _Q], norm[lo : lo + 4 * _Q], self.beam)]


class Classes:
    """Components of the nodes of one or two shards while their links are met."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        child, root = forest(self.of[a], self.of[b])
        to = np.arange(len(self.of))
        to[child] = root
        self.of = to[self.of]

    def join_all(self, rows: np.ndarray, first: int, linked: np.ndarray) -> None:
        """Join ``rows`` with the nodes from ``first`` on that they are linked with: one link of each row at a time, until none joins two components."""
        while True:
            apart = linked & (self.of[rows][:, None] != self.of[None, first : first + linked.shape[1]])
            some = np.flatnonzero(apart.any(1))
            if not len(some):
                return
            self.join(rows[some], first + apart[some].argmax(1))


def between(a: Shard, b: Shard | None, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the members of two shards, or of one with itself (``b`` None): for each member the vectors linked with it, and their components.

    ``n_a`` and ``n_b`` tell how many equal vectors a member stands for.  A link counts for both ends if either search has
    found it: those of queries that were compared with the whole other shard are complete, the others' pairs are held together.
    Gives the counts of both, and the smallest member (those of b after those of a) of each one's component.
    """
    size = len(a.v)
    classes = Classes(size + (len(b.v) if b else 0))
    counts = [np.zeros(size, np.int64), np.zeros(len(b.v) if b else 0, np.int64)]
    pairs, whole = [], []
    sides = [(a, b or a, 0, size if b else 0, n_b if b else n_a)] + ([(b, a, size, 0, n_a)] if b else [])
    for own, other, _, _, _ in sides:
        other.ready(own.v, own.norm)
        found = [other.tried(own.v[lo : lo + 4 * _Q], own.norm[lo : lo + 4 * _Q], other.beam) for lo in range(0, len(own.v), 4 * _Q)]
        steps = range(0, len(own.v), 4 * _Q)
        pairs.append((np.concatenate([i + lo for (i, _, _), lo in zip(found, steps, strict=True)]), np.concatenate([j for _, j, _ in found])))
        full = np.zeros(len(own.v), bool)
        full[np.concatenate([t + lo for (_, _, t), lo in zip(found, steps, strict=True)])] = True
        whole.append(full)
    codes = [pairs[0][0] * len(sides[0][1].v) + pairs[0][1]]
    if b:
        codes.append(pairs[1][1] * len(b.v) + pairs[1][0])
    else:
        codes.append(pairs[0][1] * size + pairs[0][0])
    for k, (own, other, base, first, n) in enumerate(sides):
        todo, partly = np.flatnonzero(whole[k]), ~whole[1 - k if b else 0]
        for lo in range(0, len(todo), _Q):
            part = todo[lo : lo + _Q]
            linked = other.scan(own.v[part], own.norm[part])
            if not b:
                linked[np.arange(len(part)), part] = False
            counts[k][part] += linked @ n
            classes.join_all(base + part, first, linked)
            i, j = np.nonzero(linked & partly[None, :])
            i = part[i]
            codes.append(i * len(other.v) + j if k == 0 else j * len(own.v) + i)
            if not b:
                codes.append(j * size + i)
    code = np.unique(np.concatenate(codes))
    i, j = np.divmod(code, len(b.v) if b else max(size, 1))
    if not b:
        i, j = i[i != j], j[i != j]
    classes.join(i, j + (size if b else 0))
    open_i = ~whole[0][i]
    counts[0] += np.bincount(i[open_i], (n_b if b else n_a)[j[open_i]], size).astype(np.int64)
    if b:
        open_j = ~whole[1][j]
        counts[1] += np.bincount(j[open_j], n_a[i[open_j]], len(b.v)).astype(np.int64)
    return counts[0], counts[1], classes.of


class _Out:
    """Counts and edges of a task as batches (kind 0: node, links; kind 1: two nodes of a component; kind 2: a shard, by its place in ``files``)."""

    def __init__(self):
        self.held = Forest()

    def counts(self, nodes: np.ndarray, counts: np.ndarray):
        some = counts > 0
        yield self._batch(0, nodes[some], counts[some])

    def edges(self, nodes: np.ndarray, of: np.ndarray):
        child = np.flatnonzero(of != np.arange(len(of)))
        for e in self.held.add(nodes[child], nodes[of[child]]):
            yield self._batch(1, e["a"].to_numpy(), e["b"].to_numpy())

    def rest(self):
        for e in self.held.rest():
            yield self._batch(1, e["a"].to_numpy(), e["b"].to_numpy())

    @staticmethod
    def _batch(kind: int, a: np.ndarray, b: np.ndarray, file: tuple | None = None) -> pa.RecordBatch:
        more = [pa.array([x] * len(a), t) for x, t in zip(file or (None,) * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), *more], ["kind", "a", "b", "label", "dim", "shard", "path"])


OUT = "kind int, a long, b long, label string, dim long, shard long, path string"


def _within(threshold: float, folder: str):
    """Rows sorted by (label, dim, shard): a shard's members -> links within each shard; shards of labels with several are stored."""
    names = ["label", "dim", "shard", "shards", "node", "n"]

    def shard_of(key, parts, out):
        v, node, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        s = Shard(v, threshold)
        counts, _, of = between(s, None, n, n)
        yield from out.counts(node, counts)
        yield from out.edges(node, of)
        if key[3] > 1:
            data = io.BytesIO()
            np.savez(data, v=v, node=node, n=n, beam=np.array(s.beam), **s.graph.arrays())
            path = f"{folder}/{uuid.uuid4().hex}.npz"
            put(path, data.getvalue())
            yield out._batch(2, np.zeros(1), np.array([len(v)]), (key[0], key[1], key[2], path))

    def work(batches):
        out, key, parts = _Out(), None, []
        for x in batches:
            if not len(x):
                continue
            columns = {c: x[c].to_pylist() if c == "label" else x[c].to_numpy(zero_copy_only=False) for c in names}
            flat, offsets = x["v"].flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(columns["dim"])])
            keys = list(zip(*(columns[c] if c == "label" else columns[c].tolist() for c in names[:4]), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if keys[lo] != key:
                    if parts:
                        yield from shard_of(key, parts, out)
                    key, parts = keys[lo], []
                parts.append((flat[offsets[lo] : offsets[hi]].reshape(hi - lo, -1), columns["node"][lo:hi], columns["n"][lo:hi]))
        if parts:
            yield from shard_of(key, parts, out)
        yield from out.rest()

    return work


def _load(path: str, threshold: float) -> tuple[Shard, np.ndarray, np.ndarray]:
    stored = dict(np.load(io.BytesIO(get(path))))
    return Shard(stored["v"], threshold, stored), stored["node"], stored["n"]


def _across(threshold: float):
    """Rows (path, others): a stored shard and further ones of its label -> the links between it and each of them."""

    def work(batches):
        out = _Out()
        for x in batches:
            for path, others in zip(x["path"].to_pylist(), x["others"].to_pylist(), strict=True):
                a, node_a, n_a = _load(path, threshold)
                for other in others:
                    b, node_b, n_b = _load(other, threshold)
                    counts_a, counts_b, of = between(a, b, n_a, n_b)
                    yield from out.counts(node_a, counts_a)
                    yield from out.counts(node_b, counts_b)
                    yield from out.edges(np.concatenate([node_a, node_b]), of)
        yield from out.rest()

    return work


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per vector: id, ``n_links`` (other vectors at a cosine of ``threshold`` at least), ``component`` (smallest id reachable).

    Only vectors of equal, non-null labels and equal length are compared.  Null vectors, and those of zeros only or with
    null or non-finite components, have no links and are components of their own.  Equal vectors are compared once and
    count one by one; repeated ids are vectors of their own; a null id names no component unless all ids in it are null.
    Links are those that the search from either end finds, which the audits keep at a recall of RECALL or more; both ends
    count them.  An empty table gives no rows; other columns are left out.
    """
    spark = df.sparkSession
    kind = df.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    key = ["label", "h1", "h2"]
    nodes = rows.where("ok").groupBy(*key).agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("n"))
    nodes = cut(nodes.withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("v").cast("long")}))
    most = F.greatest(F.least(F.lit(SHARD), F.floor(F.lit(SHARD_BYTES) / (F.col("dim") * (4 if single else 8)))), F.lit(16))
    sizes = cut(nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / most).alias("shards")))
    sized = nodes.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LABELS else sizes, ["label", "dim"]).withColumn("shard", F.pmod("h1", "shards"))
    dealt = sized.select("label", "dim", "shard", "shards", "node", "n", "v").repartition(partitions(df), "label", "dim", "shard").sortWithinPartitions("label", "dim", "shard")
    found = cut(map_arrow(dealt, _within(threshold, own_folder(spark, "graphs")), OUT))
    links = found.where("kind < 2").select("kind", "a", "b")
    files = found.where("kind = 2").select("label", "dim", "shard", "path", F.col("b").alias("members"))
    if not files.isEmpty():
        # Each shard with the later ones of its label, as many in a row as hold QUERIES vectors.
        first, other = files.alias("x"), files.alias("y")
        each = first.join(other, F.expr("x.label = y.label and x.dim = y.dim and x.shard < y.shard")).select("x.path", F.col("y.path").alias("other"), F.floor((F.col("y.shard") * F.greatest("x.members", "y.members")) / QUERIES).alias("block"))
        asked = each.groupBy("path", "block").agg(F.collect_list("other").alias("others")).select("path", "others")
        n = max(asked.count(), 1)
        links = links.unionAll(cut(map_arrow(asked.repartition(n, F.xxhash64("path", "others")), _across(threshold), OUT)).select("kind", "a", "b"))
    counts = links.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    classes = components(links.where("kind = 1").select("a", "b")).select(F.col("id").alias("node"), "component")
    per_node = nodes.select(*key, "node", "least", "n").join(counts, "node", "left").join(classes, "node", "left")
    per_node = cut(per_node.select(*key, "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("class")))
    named = per_node.groupBy("class").agg(F.min("least").alias("component"))
    good = rows.where("ok").select("id", *key).join(per_node.join(named, "class").select(*key, "n_links", "component"), key).select("id", "n_links", "component")
    bad = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return good.union(bad).withColumnRenamed("id", id_col)
